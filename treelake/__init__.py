"""Spark-first analytics over content-addressed version-control data."""
