"""Training-data operators: packing, licence scans, toxicity, mixing, LM scoring,
language identification, vector search, URL filters and near-duplicates.

Nothing outside this subpackage imports it.
"""
