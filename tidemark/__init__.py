"""Landmark analytics and corpus operators as Spark DataFrame transformations."""
