"""Operators of repeated-landmark analyses, DataFrame to DataFrame."""
