"""Operators for preparing training text: search, near-duplicate detection, packing,
personal data, quality, toxicity, web archives, decontamination, licences, sharding.

Nothing outside this subpackage imports it.
"""
