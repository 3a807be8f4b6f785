"""Detection on streams."""
