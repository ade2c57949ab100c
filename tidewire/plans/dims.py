"""Dimension tables of the engine; all have a fixed, small number of rows, so joins broadcast them."""

from __future__ import annotations

# Source tiers (site, tier, rank) and the weight of each tier.
TIERS = [
    ("official_ai", "official", 0), ("curated_media", "ai_media", 2), ("aibreakfast", "ai_vertical", 1), ("aihubtoday", "ai_vertical", 1),
    ("aibase", "ai_vertical", 1), ("aihot", "ai_vertical", 1), ("bestblogs", "ai_vertical", 1), ("waytoagi", "community", 2),
    ("followbuilders", "builders", 2), ("opmlrss", "user_opml", 3), ("tikhub_douyin", "self_media", 4), ("tikhub_xiaohongshu", "self_media", 4),
    ("xapi", "advanced", 4), ("socialdata_x", "advanced", 4), ("techurls", "discussion", 5), ("buzzing", "discussion", 5),
    ("iris", "discussion", 5), ("tophub", "discussion", 5), ("zeli", "discussion", 5), ("hackernews", "discussion", 5),
    ("newsnow", "discussion", 5), ("tw_media", "tw_media", 2), ("kr36_ai", "watchlist", 6), ("juya_daily", "watchlist", 6),
]
TIER_WEIGHTS = {"official": 1.0, "ai_vertical": 0.78, "ai_media": 0.58, "community": 0.54, "builders": 0.62, "user_opml": 0.5, "self_media": 0.48, "advanced": 0.45, "discussion": 0.32, "tw_media": 0.56, "watchlist": 0.3, "other": 0.25}
PRIORS = {"official_ai": 0.35, "curated_media": 0.18, "aibase": 0.45, "aihot": 0.45, "aihubtoday": 0.45, "followbuilders": 0.25, "opmlrss": 0.15, "xapi": 0.15, "socialdata_x": 0.15, "tw_media": 0.15, "kr36_ai": 0.1, "juya_daily": 0.1}
TITLE_STOPWORDS = ["a", "an", "and", "are", "as", "at", "for", "from", "in", "into", "is", "new", "of", "on", "the", "to", "with", "发布", "推出", "上线", "更新"]
VENDORS = {"openai": "openai", "anthropic": "anthropic", "claude": "anthropic", "google": "google", "deepmind": "google", "gemini": "google", "microsoft": "microsoft", "github": "github", "huggingface": "huggingface", "hugging face": "huggingface", "meta": "meta", "llama": "meta", "deepseek": "deepseek", "mistral": "mistral", "xai": "xai", "grok": "xai"}
TRACKING = ["ref", "spm", "fbclid", "gclid", "igshid", "mkt_tok", "mc_cid", "mc_eid", "_hsenc", "_hsmi"]
#: Rank of a site without a tier.
OTHER_RANK = 9
# Thresholds.
KEEP_AT, BRIEF_AT, RETENTION_DAYS, WINDOW_HOURS = 0.65, 0.72, 21, 24
