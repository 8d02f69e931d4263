"""Training-data operators: scoring, rules, scans, dedup, packing, mixing, search, stores and PII.

Nothing outside this subpackage imports it.
"""
