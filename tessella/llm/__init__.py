"""Training-data operators: scoring, language, mixing, dedup, urls, tokens, search, packing, archives.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
