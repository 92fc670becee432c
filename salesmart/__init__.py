"""Retail sales marts, star schema and quality gates as Spark DataFrame operators."""
