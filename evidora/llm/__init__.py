"""Training-data operators: URL filters, deduplication, decontamination, scoring, redaction, packing, search.

Self-contained: nothing outside this subpackage imports it.
"""
