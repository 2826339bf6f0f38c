"""Structured Streaming: continuous ingestion and live figures."""
