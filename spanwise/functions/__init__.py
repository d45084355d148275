"""Column functions: text measures, reading answers."""
