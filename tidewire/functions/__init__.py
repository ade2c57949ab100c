"""Functions of the news-intelligence engine."""
