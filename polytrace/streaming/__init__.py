"""The operators that carry state, on streams."""
