"""Training-data operators: filtering, deduplication, tokenisation and redaction.

Nothing else in the package imports this subpackage.
"""
