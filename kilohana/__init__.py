"""Kilohana: corpus search, analytics and maintenance on Spark."""
