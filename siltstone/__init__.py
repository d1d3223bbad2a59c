"""Spark-first analytics over repository activity: text scoring, rollups, cohorts, code metrics and rank statistics."""
