"""Registered queries over series features, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import features as fx
from chronoloom.functions import long_series as lx
from chronoloom.plans.bindings import series_day, series_type, series_user, with_sql


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *keys: str, **digits: int) -> DataFrame:
    return df.select(*keys, *(r(c, digits.get(c, 6)) for c in df.columns if c not in keys))


def d01_d10_basic_statistics(spark, sf_dir):
    return rounded(fx.basic_statistics(series_user(spark, sf_dir)), "series_id", spec_entropy=4)


def d01_basic_statistics_daily(spark, sf_dir):
    return rounded(fx.basic_statistics(series_day(spark, sf_dir), with_spectrum=False), "series_id", median=2, mad=2, cusum_max=2)


def d01_d08_long_basic_statistics(spark, sf_dir):
    """Of few, long series: slices, and ranks in a global order."""
    return rounded(lx.basic_statistics(series_type(spark, sf_dir)), "series_id", cusum_max=4)


def d14_d16_long_slopes_and_runs(spark, sf_dir):
    return rounded(lx.slopes_and_runs(series_type(spark, sf_dir), rows=512), "series_id")


def d17_d19_long_peaks(spark, sf_dir):
    return rounded(fx.peaks_and_changes(series_type(spark, sf_dir), changes=False), "series_id")


def d21_long_ar_residuals(spark, sf_dir):
    return lx.ar_residuals(series_type(spark, sf_dir)).select("series_id", "pos", r("residual"))


def d22_d26_long_residual_diagnostics(spark, sf_dir):
    return rounded(lx.residual_diagnostics(series_type(spark, sf_dir)), "series_id")


def d28_d31_long_data_quality(spark, sf_dir):
    return rounded(lx.data_quality(series_type(spark, sf_dir)), "series_id")


def d33_long_event_segments(spark, sf_dir):
    return lx.event_segments(series_type(spark, sf_dir))


def d34_d36_long_event_summary(spark, sf_dir):
    return _flat_events(lx.event_summary(series_type(spark, sf_dir)))


def d11_basic_statistics_report(spark, sf_dir):
    return fx.report(fx.basic_statistics(series_user(spark, sf_dir)), "basic")


def d14_d16_slopes_and_runs(spark, sf_dir):
    return rounded(fx.slopes_and_runs(series_user(spark, sf_dir)), "series_id")


def d17_d19_peaks(spark, sf_dir):
    out = fx.peaks_and_changes(series_user(spark, sf_dir), changes=False).select("series_id", "peak_count", "peak_max_width", "peak_spacing_cv")
    return rounded(out, "series_id")


def d12_d13_d18_changes_and_widths(spark, sf_dir):
    return fx.peaks_and_changes(series_user(spark, sf_dir)).select("series_id", *fx.CHANGES, "peak_max_width")


def d20_dynamics_report(spark, sf_dir):
    """All eight lines."""
    return fx.report(fx.channel_dynamics(series_user(spark, sf_dir)), "dynamics")


def d20_dynamics_report_all(spark, sf_dir):
    """The same, under its name of when ``d20_dynamics_report`` had fewer lines."""
    return fx.report(fx.channel_dynamics(series_user(spark, sf_dir)), "dynamics")


def d21_ar_residuals(spark, sf_dir):
    return fx.ar_residuals(series_user(spark, sf_dir)).select("series_id", "pos", r("residual"))


def d22_d26_residual_diagnostics(spark, sf_dir):
    return rounded(fx.residual_diagnostics(series_user(spark, sf_dir)), "series_id")


def d27_residual_report(spark, sf_dir):
    return fx.report(fx.residual_diagnostics(series_user(spark, sf_dir)), "residuals")


def d28_d31_data_quality(spark, sf_dir):
    return rounded(fx.data_quality(series_user(spark, sf_dir)), "series_id")


def d32_quality_report(spark, sf_dir):
    return fx.report(fx.data_quality(series_user(spark, sf_dir)), "quality")


def d33_event_segments(spark, sf_dir):
    return fx.event_segments(series_user(spark, sf_dir))


def _flat_events(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.get("event_counts", F.lit(i)).alias(k) for i, k in enumerate(("rises", "falls", "flats", "oscillations")))).drop("event_counts")


def d34_d36_event_summary(spark, sf_dir):
    return _flat_events(fx.event_summary(series_user(spark, sf_dir)))


def d37_event_report(spark, sf_dir):
    return fx.report(fx.event_summary(series_user(spark, sf_dir)), "events")


def d38_feature_table(spark, sf_dir):
    every = _flat_events(fx.feature_table(series_user(spark, sf_dir), changes=False))
    return rounded(every, "series_id", spec_entropy=4)


def d38_feature_table_all(spark, sf_dir):
    """All columns, those without SQL too."""
    return _flat_events(fx.feature_table(series_user(spark, sf_dir)))


def i1_i3_top_residuals(spark, sf_dir):
    """The five largest residuals of each series, the first of equal ones."""
    from pyspark.sql import Window

    x = fx.ar_residuals(series_user(spark, sf_dir)).select("series_id", "pos", r(F.abs("residual")).alias("size"))
    w = Window.partitionBy("series_id").orderBy(F.desc("size"), "pos")
    return x.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


QUERIES = {
    f.__name__: f
    for f in (
        d01_d10_basic_statistics, d01_basic_statistics_daily, d11_basic_statistics_report, d12_d13_d18_changes_and_widths, d14_d16_slopes_and_runs, d17_d19_peaks, d20_dynamics_report, d20_dynamics_report_all, d21_ar_residuals,
        d01_d08_long_basic_statistics, d14_d16_long_slopes_and_runs, d17_d19_long_peaks, d21_long_ar_residuals, d22_d26_long_residual_diagnostics, d28_d31_long_data_quality, d33_long_event_segments, d34_d36_long_event_summary,
        d22_d26_residual_diagnostics, d27_residual_report, d28_d31_data_quality, d32_quality_report, d33_event_segments, d34_d36_event_summary, d37_event_report, d38_feature_table, d38_feature_table_all, i1_i3_top_residuals,
    )
}


def _basic(series: str) -> str:
    return f"""
bs AS (SELECT series_id, pos, value, count(*) OVER w AS n, avg(value) OVER w AS mu, median(value) OVER w AS med, lag(value) OVER o AS lag1, lag(value, 24) OVER o AS lag24
  FROM {series} WINDOW w AS (PARTITION BY series_id), o AS (PARTITION BY series_id ORDER BY pos)),
bc AS (SELECT *, sum(value - med) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM bs),
basic AS (SELECT series_id, any_value(med) AS median, median(abs(value - med)) AS mad,
    coalesce(sum((value - mu) * (lag1 - mu)) / nullif(sum((value - mu) ** 2), 0), 0) AS acf1,
    CASE WHEN any_value(n) > 24 THEN coalesce(sum((value - mu) * (lag24 - mu)) / nullif(sum((value - mu) ** 2), 0), 0) ELSE 0 END AS acf_seasonal,
    max(abs(run)) AS cusum_max,
    coalesce((quantile_cont(value, 0.975) - quantile_cont(value, 0.025)) / nullif(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0), 0) AS qkurt FROM bc GROUP BY series_id)"""


_SPECTRUM = """
fb AS (SELECT series_id, n, unnest(range(n // 2)) AS k FROM (SELECT series_id, count(*) AS n FROM series_user GROUP BY 1)),
fp AS (SELECT series_id, n, k, sum(value * cos(2 * pi() * k * pos / n)) ** 2 + sum(value * sin(2 * pi() * k * pos / n)) ** 2 AS power FROM fb JOIN series_user USING (series_id) GROUP BY 1, 2, 3),
spectrum AS (SELECT series_id, arg_max(k, (power, -k)) / any_value(n) AS peak_freq,
    coalesce(-sum(CASE WHEN power > 0 THEN (power / total) * log2(power / total) END), 0) AS spec_entropy FROM (SELECT *, sum(power) OVER (PARTITION BY series_id) AS total FROM fp) GROUP BY series_id)"""

_SLOPES = """
ds AS (SELECT series_id, pos, value, count(*) OVER (PARTITION BY series_id) AS n, lag(value) OVER o AS lag1, lag(value, 2) OVER o AS lag2 FROM series_user WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
dg AS (SELECT *, sign(value - lag1) AS s FROM ds),
dl AS (SELECT *, last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM dg),
dr AS (SELECT *, sum(CASE WHEN pos > 1 AND s <> 0 AND s <> coalesce(before, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM dl),
du AS (SELECT series_id, max(c) AS longest FROM (SELECT series_id, run, count(*) AS c FROM dr WHERE pos > 0 GROUP BY 1, 2) GROUP BY 1),
slopes AS (SELECT dr.series_id, CASE WHEN any_value(n) < 3 THEN 0 ELSE max(abs(value - lag1)) END AS slope_max, CASE WHEN any_value(n) < 3 THEN 0 ELSE max(abs(value - 2 * lag1 + lag2)) END AS slope_second_diff_max,
    CASE WHEN any_value(n) < 3 THEN 0 ELSE any_value(longest) / any_value(n) END AS monotone_duration FROM dr LEFT JOIN du USING (series_id) GROUP BY dr.series_id)"""

_PEAKS = """
pz AS (SELECT series_id, pos, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS z, count(*) OVER w AS n FROM series_user WINDOW w AS (PARTITION BY series_id)),
pi AS (SELECT *, sum(CASE WHEN z = pl THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY pos) AS island FROM (SELECT *, lag(z) OVER (PARTITION BY series_id ORDER BY pos) AS pl FROM pz)),
pt AS (SELECT series_id, island, min(pos) AS a, max(pos) AS b, any_value(z) AS z, any_value(n) AS n FROM pi GROUP BY 1, 2),
pm AS (SELECT *, (a + b) // 2 AS p FROM (SELECT *, lag(z) OVER (PARTITION BY series_id ORDER BY island) AS zl, lead(z) OVER (PARTITION BY series_id ORDER BY island) AS zr FROM pt) WHERE zl < z AND zr < z),
pe AS (SELECT pm.series_id, pm.p, pm.z, coalesce(max(CASE WHEN q.pos < pm.p AND q.z > pm.z THEN q.pos END), 0) AS lo, coalesce(min(CASE WHEN q.pos > pm.p AND q.z > pm.z THEN q.pos END), any_value(pm.n) - 1) AS hi
  FROM pm JOIN pz q ON q.series_id = pm.series_id GROUP BY 1, 2, 3),
pp AS (SELECT pe.series_id, pe.p, pe.z - greatest(min(CASE WHEN q.pos <= pe.p THEN q.z END), min(CASE WHEN q.pos >= pe.p THEN q.z END)) AS prominence
  FROM pe JOIN pz q ON q.series_id = pe.series_id AND q.pos BETWEEN pe.lo AND pe.hi GROUP BY pe.series_id, pe.p, pe.z),
ph AS (SELECT pp.series_id, p, z, prominence, z - prominence / 2 AS level, n - 1 AS last FROM pp JOIN pm USING (series_id, p) WHERE prominence >= 1.0),
pc AS (SELECT ph.series_id, p, any_value(level) AS level, coalesce(max(q.pos) FILTER (WHERE q.pos < p AND q.z <= level), 0) AS l, coalesce(min(q.pos) FILTER (WHERE q.pos > p AND q.z <= level), any_value(last)) AS r
  FROM ph JOIN pz q ON q.series_id = ph.series_id GROUP BY ph.series_id, p),
pw AS (SELECT c.series_id, max(CASE WHEN r0.z < level THEN r - (level - r0.z) / (r1.z - r0.z) ELSE r END - CASE WHEN l0.z < level THEN l + (level - l0.z) / (l1.z - l0.z) ELSE l END) AS peak_max_width
  FROM pc c JOIN pz l0 ON l0.series_id = c.series_id AND l0.pos = l JOIN pz l1 ON l1.series_id = c.series_id AND l1.pos = l + 1
  JOIN pz r0 ON r0.series_id = c.series_id AND r0.pos = r JOIN pz r1 ON r1.series_id = c.series_id AND r1.pos = r - 1 GROUP BY c.series_id),
pg AS (SELECT series_id, p - lag(p) OVER (PARTITION BY series_id ORDER BY p) AS gap FROM pp WHERE prominence >= 1.0),
peaks AS (SELECT series_id, CAST(count(g.series_id2) AS DOUBLE) AS peak_count, coalesce(any_value(peak_max_width), 0) AS peak_max_width, coalesce(CASE WHEN count(g.series_id2) > 1 THEN stddev_pop(gap) / (avg(gap) + 1e-8) END, 0) AS peak_spacing_cv
  FROM (SELECT DISTINCT series_id FROM series_user) LEFT JOIN (SELECT series_id AS series_id2, gap FROM pg) g ON g.series_id2 = series_id LEFT JOIN (SELECT series_id AS series_id3, peak_max_width FROM pw) v ON v.series_id3 = series_id GROUP BY series_id)"""

#: Change points by dynamic programming over a grid of every fifth point; cells are sums of the kernel between stretches of the grid.
_CHANGES = """
cn AS (SELECT series_id, count(*) AS n, (count(*) + 4) // 5 AS last FROM series_user GROUP BY 1 HAVING count(*) >= 10),
cd AS MATERIALIZED (SELECT a.series_id, a.pos // 5 AS i, b.pos // 5 AS j, (a.value - b.value) ** 2 AS d FROM series_user a JOIN series_user b ON a.series_id = b.series_id AND a.pos < b.pos),
cg AS (SELECT series_id, CASE WHEN median(d) > 0 THEN 1 / median(d) ELSE 1 END AS gamma FROM cd GROUP BY 1),
ck AS (SELECT series_id, i, j, sum(2 * exp(-least(greatest(d * gamma, 1e-2), 1e2))) AS k FROM cd JOIN cg USING (series_id) GROUP BY 1, 2, 3),
ca AS (SELECT series_id, a, e, least(5 * e, n) - 5 * a AS length FROM (SELECT *, unnest(range(e)) AS a FROM (SELECT *, unnest(range(1, last + 1)) AS e FROM cn))),
cc AS (SELECT series_id, a, e, CASE WHEN any_value(length) < 2 THEN 1e300 ELSE any_value(length) - 1 - coalesce(sum(k), 0) / any_value(length) END AS cost
  FROM ca LEFT JOIN ck USING (series_id) WHERE i >= a AND j < e OR i IS NULL OR length < 2 GROUP BY 1, 2, 3),
cl AS MATERIALIZED (SELECT series_id, e, list(cost ORDER BY a) AS costs FROM cc GROUP BY 1, 2),
ct AS (SELECT series_id, 0 AS e, [CAST(0 AS DOUBLE)] AS total, [CAST(0 AS BIGINT)] AS origin FROM cn
  UNION ALL SELECT series_id, e, list_append(total, list_min(sums) + 5), list_append(origin, CAST(list_position(sums, list_min(sums)) - 1 AS BIGINT))
  FROM (SELECT ct.series_id, ct.e + 1 AS e, total, origin, list_transform(range(1, ct.e + 2), lambda x: total[x] + costs[x]) AS sums FROM ct JOIN cl ON cl.series_id = ct.series_id AND cl.e = ct.e + 1)),
cb AS (SELECT ct.series_id, e, origin[e + 1] AS a, origin FROM ct JOIN cn ON cn.series_id = ct.series_id AND e = last
  UNION ALL SELECT series_id, a, origin[a + 1], origin FROM cb WHERE a > 0),
cs AS (SELECT cb.series_id, e, avg(value ORDER BY pos) AS mean FROM cb JOIN series_user s ON s.series_id = cb.series_id AND s.pos >= 5 * a AND s.pos < 5 * e GROUP BY 1, 2),
cj AS (SELECT *, abs(mean - lag(mean) OVER (PARTITION BY series_id ORDER BY e)) AS jump FROM cs),
changes AS (SELECT series_id, CAST(coalesce(least(count(e) - 1, 5), 0) AS DOUBLE) AS changepoint_count, coalesce(max(jump), 0) AS changepoint_score
  FROM cj GROUP BY 1 UNION ALL SELECT series_id, 0.0, 0.0 FROM series_user GROUP BY 1 HAVING count(*) < 10)"""

_RESIDUALS = """
rl AS (SELECT series_id, pos, value, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS lag1 FROM series_user),
rm AS (SELECT series_id, avg(value) AS my, avg(lag1) AS mz FROM rl WHERE lag1 IS NOT NULL GROUP BY 1),
rb AS (SELECT series_id, any_value(my) AS my, any_value(mz) AS mz, coalesce(sum((value - my) * (lag1 - mz)) / nullif(sum((lag1 - mz) ** 2), 0), 0) AS b FROM rl JOIN rm USING (series_id) WHERE lag1 IS NOT NULL GROUP BY 1),
resid AS (SELECT series_id, pos, value - (my + b * (lag1 - mz)) AS residual FROM rl JOIN rb USING (series_id) WHERE pos >= 1),
rs AS (SELECT *, count(*) OVER w AS m, avg(residual) OVER w AS mu, stddev_pop(residual) OVER w AS sd, lag(residual) OVER (PARTITION BY series_id ORDER BY pos) AS lag,
    row_number() OVER (PARTITION BY series_id ORDER BY abs(residual), pos) AS rank FROM resid WINDOW w AS (PARTITION BY series_id)),
residuals AS (SELECT series_id, avg(residual) AS residual_mean, max(abs(residual)) AS residual_max, avg(CASE WHEN abs(residual) > 2 * (sd + 1e-8) THEN 1.0 ELSE 0.0 END) AS residual_exceed_ratio,
    coalesce(sum((residual - mu) * (lag - mu)) / nullif(sum((residual - mu) ** 2), 0), 0) AS residual_acf1,
    sum(CASE WHEN rank > floor(0.9 * m) THEN abs(residual) END) / (sum(abs(residual)) + 1e-8) AS residual_concentration FROM rs GROUP BY series_id)"""

_QUALITY = """
qx AS (SELECT series_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM series_user WINDOW w AS (PARTITION BY series_id)),
qb AS (SELECT series_id, max(c) AS c FROM (SELECT series_id, CASE WHEN hi > lo THEN least(25, 1 + floor(25 * (value - lo) / (hi - lo))) ELSE 1 END AS bin, count(*) AS c FROM qx GROUP BY 1, 2) GROUP BY 1),
quality AS (SELECT series_id, any_value(c) / count(*) AS quality_quantization_score,
    avg(CASE WHEN value <= lo + greatest((hi - lo) * 0.01, 1e-3) OR value >= hi - greatest((hi - lo) * 0.01, 1e-3) THEN 1.0 ELSE 0.0 END) AS quality_saturation_ratio,
    CAST(CASE WHEN stddev_pop(value) < 1e-3 THEN 1 ELSE 0 END AS DOUBLE) AS quality_constant_channel_ratio, CAST(0 AS DOUBLE) AS quality_dropout_ratio FROM qx JOIN qb USING (series_id) GROUP BY series_id)"""

_EVENTS = """
ed AS (SELECT series_id, pos, value, count(*) OVER (PARTITION BY series_id) AS n, lag(value) OVER o AS l1, lag(value, 2) OVER o AS l2 FROM series_user WINDOW o AS (PARTITION BY series_id ORDER BY pos)),
et AS (SELECT *, stddev_pop(value - l1) OVER (PARTITION BY series_id) * 1.5 + 1e-6 AS thr FROM ed),
ec AS (SELECT series_id, pos - 1 AS cut FROM et WHERE pos >= 2 AND abs(value - 2 * l1 + l2) > thr AND n >= 4
  UNION ALL SELECT DISTINCT series_id, 0 FROM et UNION ALL SELECT DISTINCT series_id, CAST(n - 1 AS INTEGER) FROM et),
eg AS (SELECT series_id, row_number() OVER o - 1 AS segment, cut AS first_pos, lead(cut) OVER o AS last_pos FROM ec WINDOW o AS (PARTITION BY series_id ORDER BY cut)),
ek AS (SELECT * FROM eg WHERE last_pos IS NOT NULL AND segment < 8),
en AS (SELECT series_id, count(*) AS n FROM series_user GROUP BY 1),
ew AS (SELECT series_id FROM ek GROUP BY 1 HAVING count(*) < 3),
segments AS (SELECT series_id, segment, first_pos, last_pos FROM ek WHERE series_id NOT IN (SELECT series_id FROM ew)
  UNION ALL SELECT series_id, s, CASE s WHEN 0 THEN 0 ELSE s * greatest(1, n // 3) END, CASE s WHEN 2 THEN n - 1 ELSE (s + 1) * greatest(1, n // 3) - 1 END FROM en JOIN ew USING (series_id), (SELECT unnest(range(3)) AS s) WHERE n >= 4
  UNION ALL SELECT series_id, 0, 0, n - 1 FROM en WHERE n < 4),
ep AS (SELECT series_id, segment, count(*) AS c, stddev_pop(value) AS sd, arg_max(value, pos) - arg_min(value, pos) AS slope, any_value(thr) AS thr
  FROM segments JOIN (SELECT *, stddev_pop(value) OVER (PARTITION BY series_id) * 0.05 + 1e-6 AS thr FROM series_user) USING (series_id) WHERE pos BETWEEN first_pos AND last_pos GROUP BY 1, 2),
ef AS (SELECT series_id, CASE WHEN c < 2 THEN NULL WHEN slope > thr THEN 0 WHEN slope < -thr THEN 1 WHEN sd > 2 * thr THEN 3 ELSE 2 END AS kind FROM ep),
es AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS event_segment_count, CAST(count(*) FILTER (WHERE kind = 0) AS DOUBLE) AS rises, CAST(count(*) FILTER (WHERE kind = 1) AS DOUBLE) AS falls,
    CAST(count(*) FILTER (WHERE kind = 2) AS DOUBLE) AS flats, CAST(count(*) FILTER (WHERE kind = 3) AS DOUBLE) AS oscillations FROM ef GROUP BY 1),
event_sums AS (SELECT *, CAST(list_position([rises, falls, flats, oscillations], greatest(rises, falls, flats, oscillations)) - 1 AS DOUBLE) AS event_dominant_pattern FROM es)"""

_BASIC_COLUMNS = ("median", "mad", "acf1", "acf_seasonal", "cusum_max", "qkurt")
_RESIDUAL_COLUMNS = ("residual_mean", "residual_max", "residual_exceed_ratio", "residual_acf1", "residual_concentration")
_QUALITY_COLUMNS = ("quality_quantization_score", "quality_saturation_ratio", "quality_constant_channel_ratio", "quality_dropout_ratio")
_SLOPE_COLUMNS = ("slope_max", "slope_second_diff_max", "monotone_duration")


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


_ALL_BASIC = f"{_r(*_BASIC_COLUMNS)}, CAST(0 AS DOUBLE) AS mean_abs_corr, CAST(1 AS DOUBLE) AS pca_var_ratio1, {_r('peak_freq')}, {_r('spec_entropy', digits=4)}"


def _report(family: str, *more: str, without: tuple[str, ...] = ()) -> str:
    title, labels = fx.REPORTS[family]
    labels = {c: v for c, v in labels.items() if c not in without}
    number = lambda c, digits: f"CASE WHEN abs({c}) * 1e{digits} < 0.5 THEN 0 ELSE {c} END"
    rows = [f"'  {label}: ' || printf('{fmt}', {number(c, fmt[2])})" for c, (label, fmt) in labels.items()]
    return f"concat_ws(chr(10), '{title}', {', '.join([*rows, *more])})"


_DOMINANT = f"'  {fx.DOMINANT}: ' || {list(fx.PATTERNS)}[CAST(event_dominant_pattern AS INTEGER) + 1]"


_U = with_sql("series_user")
ORACLE_SQL = {
    "d01_d10_basic_statistics": f"{_U},{_basic('series_user')},{_SPECTRUM} SELECT series_id, {_ALL_BASIC} FROM basic JOIN spectrum USING (series_id)",
    "d01_basic_statistics_daily": f"{with_sql('series_day')},{_basic('series_day')} SELECT series_id, {_r('median', 'mad', 'cusum_max', digits=2)}, {_r('acf1', 'acf_seasonal', 'qkurt')}, CAST(0 AS DOUBLE) AS mean_abs_corr, CAST(1 AS DOUBLE) AS pca_var_ratio1 FROM basic",
    "d11_basic_statistics_report": f"{_U},{_basic('series_user')},{_SPECTRUM} SELECT series_id, {_report('basic')} AS report FROM basic JOIN spectrum USING (series_id)",
    "d14_d16_slopes_and_runs": f"{_U},{_SLOPES} SELECT series_id, {_r(*_SLOPE_COLUMNS)} FROM slopes",
    "d17_d19_peaks": f"{_U},{_PEAKS} SELECT series_id, peak_count, {_r('peak_max_width', 'peak_spacing_cv')} FROM peaks",
    "d20_dynamics_report": f"{_U.replace('WITH', 'WITH RECURSIVE', 1)},{_SLOPES},{_PEAKS},{_CHANGES} SELECT series_id, {_report('dynamics')} AS report FROM slopes JOIN peaks USING (series_id) JOIN changes USING (series_id)",
    "d21_ar_residuals": f"{_U},{_RESIDUALS} SELECT series_id, pos, {_r('residual')} FROM resid",
    "d22_d26_residual_diagnostics": f"{_U},{_RESIDUALS} SELECT series_id, {_r(*_RESIDUAL_COLUMNS)} FROM residuals",
    "d27_residual_report": f"{_U},{_RESIDUALS} SELECT series_id, {_report('residuals')} AS report FROM residuals",
    "d28_d31_data_quality": f"{_U},{_QUALITY} SELECT series_id, {_r(*_QUALITY_COLUMNS)} FROM quality",
    "d32_quality_report": f"{_U},{_QUALITY} SELECT series_id, {_report('quality')} AS report FROM quality",
    "d33_event_segments": f"{_U},{_EVENTS} SELECT series_id, segment, first_pos, last_pos FROM segments",
    "d34_d36_event_summary": f"{_U},{_EVENTS} SELECT series_id, event_segment_count, rises, falls, flats, oscillations, event_dominant_pattern FROM event_sums",
    "d37_event_report": f"{_U},{_EVENTS} SELECT series_id, {_report('events', _DOMINANT)} AS report FROM event_sums",
    "d38_feature_table": f"""{_U},{_basic('series_user')},{_SPECTRUM},{_SLOPES},{_PEAKS},{_RESIDUALS},{_QUALITY},{_EVENTS}
      SELECT series_id, {_ALL_BASIC}, {_r(*_SLOPE_COLUMNS)}, peak_count, {_r('peak_max_width', 'peak_spacing_cv')}, {_r(*_RESIDUAL_COLUMNS)}, {_r(*_QUALITY_COLUMNS)}, event_segment_count, rises, falls, flats, oscillations, event_dominant_pattern
      FROM basic JOIN spectrum USING (series_id) JOIN slopes USING (series_id) JOIN peaks USING (series_id) JOIN residuals USING (series_id) JOIN quality USING (series_id) JOIN event_sums USING (series_id)""",
    "i1_i3_top_residuals": f"""{_U},{_RESIDUALS} SELECT * FROM (SELECT series_id, pos, size, row_number() OVER (PARTITION BY series_id ORDER BY size DESC, pos) AS rank
      FROM (SELECT series_id, pos, round(abs(residual), 6) + 0.0 AS size FROM resid)) WHERE rank <= 5""",
}

#: The same SQL over few, long series.
_LONG = {
    "d14_d16_long_slopes_and_runs": "d14_d16_slopes_and_runs", "d17_d19_long_peaks": "d17_d19_peaks", "d21_long_ar_residuals": "d21_ar_residuals", "d22_d26_long_residual_diagnostics": "d22_d26_residual_diagnostics",
    "d28_d31_long_data_quality": "d28_d31_data_quality", "d33_long_event_segments": "d33_event_segments", "d34_d36_long_event_summary": "d34_d36_event_summary",
}
ORACLE_SQL |= {name: ORACLE_SQL[of].replace(_U, with_sql("series_type")).replace("series_user", "series_type") for name, of in _LONG.items()}
ORACLE_SQL["d01_d08_long_basic_statistics"] = f"{with_sql('series_type')},{_basic('series_type')} SELECT series_id, {_r('median', 'mad', 'acf1', 'acf_seasonal', 'qkurt')}, {_r('cusum_max', digits=4)} FROM basic"
