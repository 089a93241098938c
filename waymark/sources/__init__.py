"""Readers and writers: every source becomes a DataFrame with a declared schema."""
