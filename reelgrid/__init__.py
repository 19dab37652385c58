"""Spark-first analytics over video-derived tables: search, fusion, interval and time joins, ETL, evaluation."""

__version__ = "0.1.0"
