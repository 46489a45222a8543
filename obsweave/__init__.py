"""Observation analytics as Spark jobs: ingest, features, training, scoring, reads."""
