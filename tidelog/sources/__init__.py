"""Readers of log files."""
