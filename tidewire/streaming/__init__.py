"""Streaming of the news-intelligence engine."""
