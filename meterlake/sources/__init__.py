"""Readers that turn raw usage records and settings into typed DataFrames."""
