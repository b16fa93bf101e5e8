"""Column functions: exact numerics, timestamps, labels."""
