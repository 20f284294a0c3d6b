"""Spark engine for text-to-SQL data work: every operator is DataFrame in, DataFrame out."""
