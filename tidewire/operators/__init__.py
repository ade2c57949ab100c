"""Operators of the news-intelligence engine."""
