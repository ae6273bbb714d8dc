"""Structured Streaming operators: the polling loops as continuous queries over file sources."""
