"""Commerce analytics as Spark jobs: cleaning, facts, metrics, segments, cohorts, tests, forecasts."""
