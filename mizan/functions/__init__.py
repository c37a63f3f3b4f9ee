"""Column expressions: text, references, dates, arrays, metrics."""
