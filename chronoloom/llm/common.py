"""What the operators share on the Spark side: shared storage and batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.sources.storage import shared_dir, stash

__all__ = ["documents", "fold", "hinted", "joined", "rows_of", "schema_plus", "shared_dir", "small_batches", "stash"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that batches of long texts fit in a Python worker, and Parquet
    row groups of 32 MB, which a writer holds in memory beside the workers.

    Plans are lazy, so these are settings of the session that stay; all text operators set the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("parquet.block.size", str(32 << 20))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids take part as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def schema_plus(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with the columns of ``ddl`` after its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


#: Most ids that are broadcast (16 bytes each in a task's memory); more ids are joined by shuffling.
BROADCAST_IDS = 2_000_000


def hinted(ids: DataFrame) -> DataFrame:
    """``ids`` to join with texts: broadcast if few enough, so that texts stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def rows_of(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``docs`` whose key is in ``ids``."""
    return docs.join(hinted(ids), key, "left_semi")


#: Most ids that ``joined`` broadcasts, some 8 MB as a hash relation; of more, a filter of so many bits (4 MB) is.
FEW_IDS, FILTER_BITS = 100_000, 1 << 25


def _place(key: Column) -> tuple[Column, Column, Column]:
    """Where the filter has an id: its row, the word there and the bit of that."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return F.shiftright(at, 15), F.shiftright(at, 6).bitwiseAND(511), at.bitwiseAND(63).cast("int")


def _id_filter(ids: DataFrame) -> DataFrame:
    """(part, words): a bit is set for each id (the first column); parts without ids have no row."""
    part, word, bit = _place(F.col(ids.columns[0]))
    words = ids.select(part.alias("part"), word.alias("word"), bit.alias("bit")).groupBy("part", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    held = words.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return held.select("part", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0).cast("bigint"))).alias("words"))


def joined(docs: DataFrame, key: Column, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (inner, left_semi or left_anti) with ``ids`` where ``key`` equals their first column.

    What the driver holds and sends is bounded: up to ``FEW_IDS`` ids themselves. Of more it is a filter, and only rows
    that pass it are shuffled to meet the ids; other texts stay where they are. Ids are bigint, and their columns'
    names are not in ``docs``.
    """
    met = key == F.col(ids.columns[0])
    if ids.count() <= FEW_IDS:
        return docs.join(F.broadcast(ids), met, how)
    part, word, bit = _place(key)
    may = (part == F.col("__part")) & (F.getbit(F.get("__words", word.cast("int")), bit) == 1)
    marks = F.broadcast(stash(_id_filter(ids), "id-filter").withColumnRenamed("part", "__part").withColumnRenamed("words", "__words"))
    passed = docs.join(marks, may, "left_semi").join(ids.hint("shuffle_hash"), met, how)
    return docs.join(marks, may, "left_anti").union(passed) if how == "left_anti" else passed
