"""Column expressions. Lengths and cuts of text count code points; byte offsets count UTF-8 bytes."""
