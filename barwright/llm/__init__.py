"""Training-data operators: text scans, near-duplicate detection, mixing, tokens.

Nothing outside this subpackage imports it.
"""
