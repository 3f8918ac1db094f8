"""Structured Streaming forms of operators; each has a batch twin that gives the same result on the same rows."""
