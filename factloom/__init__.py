"""Factloom: readiness-driven dataflow over typed facts, on Spark SQL and Structured Streaming."""
