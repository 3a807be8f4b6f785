"""Relational operators: patterns, names, reconciliation, layout, review, redaction."""
