"""Sources of the news-intelligence engine."""
