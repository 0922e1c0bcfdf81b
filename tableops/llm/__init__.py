"""Operators for large training corpora: fixity audit, decontamination, secret scans, BPE,
line / near / substring deduplication, URL filters, quality rules and sharding.

Nothing else in the library imports this subpackage. ``catalog`` registers one query per
operator, ``corpus_pipeline.py`` at the repository top chains five of them.
"""
