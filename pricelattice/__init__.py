"""Retail price analytics as Spark DataFrame transforms."""
