"""Reusable relational operators: latest row per key, merges, dense ids, ranks, checks."""
