"""Operators that Spark has no single call for, as compositions of its own."""
