"""Column expressions: patterns, spans, checks."""
