"""Incremental layer ingest with Structured Streaming."""
