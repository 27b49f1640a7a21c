"""Whole jobs: storing, ingesting, alerting, suggesting."""
