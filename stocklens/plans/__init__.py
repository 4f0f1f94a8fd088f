"""Whole queries and batch jobs."""
