"""Column expressions: windows over ordered series, and scalar helpers."""
