"""Whole queries over several operators: postings, sources, fetches."""
