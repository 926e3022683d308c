"""Corpus-preparation operators: deduplication, tokenising, mixing, filtering, scoring and chat rendering.

Nothing else in the library imports this subpackage.
"""
