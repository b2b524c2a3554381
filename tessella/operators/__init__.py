"""Column- and frame-level operators."""
