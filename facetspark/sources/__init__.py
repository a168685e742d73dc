"""Readers and writers of the text formats, and typed options."""
