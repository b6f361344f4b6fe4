"""Training-data operators: tokenising, language, sharding, mixing, toxicity, search, secrets and deduplication.

Nothing outside this subpackage imports it.
"""
