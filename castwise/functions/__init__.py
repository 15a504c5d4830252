"""Column expressions: text, scores and time labels."""
