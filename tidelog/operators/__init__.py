"""Operators on events, the log and what is delivered from it."""
