"""Queries over spans, logs, metrics and profiles."""
