"""Column functions: native expressions, and scanners for nested text."""
