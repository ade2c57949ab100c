"""Plans of the news-intelligence engine."""
