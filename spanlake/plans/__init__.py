"""Composite analytics: findings, anomalies and traffic patterns."""
