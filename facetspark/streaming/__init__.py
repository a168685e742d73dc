"""Structured Streaming forms of the operators that have one."""
