"""Rental-store analytics written as Spark DataFrame jobs."""
