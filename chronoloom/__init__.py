"""Analytics on many time series, forecasts and agent trajectories as Spark jobs."""
