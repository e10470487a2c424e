"""Operators: pure functions from frames to frames, without I/O or actions (the one
exception, ranked recommendation, writes intermediate tables and says so)."""
