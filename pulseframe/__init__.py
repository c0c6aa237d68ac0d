"""Spark-first analytics for biosignal and face-feature experiments."""
