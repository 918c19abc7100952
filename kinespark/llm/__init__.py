"""Training-data operators: near-duplicate joins, tokenization, decontamination,
quality scoring, stores, licence and URL filters, media sequences, substring dedup.

Nothing outside this subpackage imports it. ``queries`` registers the driver's queries.
"""
