"""Whole plans: ingest and answer."""
