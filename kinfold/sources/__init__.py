"""Readers and writers of records, and records derived from the test tables."""
