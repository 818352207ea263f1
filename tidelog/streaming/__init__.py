"""Ingestion of op-logs as streams."""
