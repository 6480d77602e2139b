"""Training-data operators: search, tokenising, scanning, scoring, extraction, deduplication.

Nothing outside this subpackage imports it.
"""
