"""Readers and writers for samples, raw tables, run documents and predictions."""
