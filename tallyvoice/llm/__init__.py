"""Operators for large training-data corpora: filtering, deduplication, privacy, tokens, chat.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
