"""Training-data operators: tokenizing, mixing, near-duplicates, extraction, search.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
