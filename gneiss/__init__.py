"""Grounded document analytics on Spark: chunking, retrieval, verified answers and their evaluation."""
