"""Structured Streaming versions of the latest-value (T1), history (T2) and
running estimate (T3) jobs.  Each has a batch twin with the same result."""
