"""The feeds that a run reads: their addresses, words and limits, as rows for ``feeds.catalogue_items``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.sources.feeds import CATALOGUE

_NEWS = "https://news.google.com/rss/search?q="
_US, _TW = "&hl=en-US&gl=US&ceid=US%3Aen", "&hl=zh-TW&gl=TW&ceid=TW%3Azh-Hant"

# Name, address, words an entry must hold, whether only its title counts, and how many entries are taken.
OFFICIAL = [
    ("OpenAI News", "https://openai.com/news/rss.xml", "", False, None),
    ("Google DeepMind", "https://deepmind.google/blog/rss.xml", "", False, None),
    ("Google AI Blog", "https://blog.google/innovation-and-ai/technology/ai/rss/", "", False, None),
    ("Google Gemini Blog", "https://blog.google/products-and-platforms/products/gemini/rss/", "", False, None),
    ("Hugging Face Blog", "https://huggingface.co/blog/feed.xml", "", False, None),
    ("GitHub AI & ML", "https://github.blog/ai-and-ml/feed/", "", False, None),
    ("GitHub Changelog", "https://github.blog/changelog/feed/", "", False, None),
    ("OpenAI Skills", "https://github.com/openai/skills/commits/main.atom", "hatch,pet,migrate-to-codex", False, None),
    ("Thinking Machines Lab", "https://thinkingmachines.ai/index.xml", "", False, None),
    ("NVIDIA Blog", "https://blogs.nvidia.com/feed/", "", False, None),
    ("Microsoft Blog", "https://blogs.microsoft.com/feed/", "", False, None),
    ("AWS News", "https://aws.amazon.com/about-aws/whats-new/recent/feed/", "", False, None),
    ("Google Cloud Blog (Google News)", _NEWS + "site%3Acloud.google.com%2Fblog+AI+when%3A7d" + _US, "ai", False, None),
]
CURATED = [
    ("The Decoder AI News", "https://the-decoder.com/feed/", "", False, 10),
    ("TechCrunch AI", "https://techcrunch.com/category/artificial-intelligence/feed/", "", False, 8),
    ("The Verge", "https://www.theverge.com/rss/index.xml", "ai,artificial intelligence,openai,anthropic,claude,chatgpt,gpt,gemini,llm,agent,copilot", True, 6),
    ("MarkTechPost Research", "https://www.marktechpost.com/feed/", "paper,research,arxiv,benchmark,dataset,model,llm,agent,diffusion,transformer,multimodal,reasoning,inference,training,open-source", True, 6),
    ("VentureBeat AI", "https://venturebeat.com/category/ai/feed", "", False, 8),
    ("Artificial Intelligence News", "https://www.artificialintelligence-news.com/feed/", "", False, 8),
    ("Claude Code Releases", "https://github.com/anthropics/claude-code/releases.atom", "", False, 6),
    ("CNBC Technology", "https://www.cnbc.com/id/19854910/device/rss/rss.html", "ai,artificial intelligence,openai,anthropic,claude,chatgpt,gpt,llm,machine learning,ai chip,ai chips,nvidia,deepseek,gemini", True, 6),
    ("LMArena Blog", "https://blog.lmarena.ai/rss/", "", False, 6),
    ("Reuters AI (Google News)", _NEWS + "site:reuters.com%20AI%20when:2d&hl=en-US&gl=US&ceid=US:en", "ai", True, 10),
    ("The Information (Google News)", _NEWS + "site%3Atheinformation.com+AI+when%3A7d" + _US, "ai", True, 10),
    ("Meta AI (Google News)", _NEWS + "%28%22Meta+AI%22+OR+%22Meta+FAIR%22%29+when%3A7d" + _US, "ai", True, 8),
    ("DeepSeek (Google News)", _NEWS + "DeepSeek+AI+model+when%3A3d" + _US, "ai,deepseek", True, 8),
    ("xAI / Grok (Google News)", _NEWS + "%28xAI+OR+%22Elon+Musk%22+Grok+OR+%22Grok+4%22+OR+%22Grok+5%22%29+when%3A7d" + _US, "xai,grok", True, 8),
    ("Epoch AI (Google News)", _NEWS + "site%3Aepoch.ai+when%3A14d" + _US, "", False, 8),
]
TAIWAN_WORDS = "ai,openai,anthropic,claude,chatgpt,gpt,gemini,llm,人工智慧,人工智能,大型語言模型,大模型,語言模型,機器學習,深度學習,生成式ai,生成式人工智慧,智慧體,智能體,演算法,晶片,輝達,nvidia,英偉達"
TAIWAN = [
    ("iThome", "https://www.ithome.com.tw/rss", TAIWAN_WORDS, True, 8),
    ("TechNews 科技新報", "https://technews.tw/feed/", TAIWAN_WORDS, True, 8),
    ("數位時代 (Google News)", _NEWS + "site%3Abnext.com.tw+%28AI+OR+%E4%BA%BA%E5%B7%A5%E6%99%BA%E6%85%A7+OR+%E5%A4%A7%E6%A8%A1%E5%9E%8B+OR+ChatGPT%29+when%3A7d" + _TW, TAIWAN_WORDS, True, 8),
]
KR36 = [("36Kr", "https://36kr.com/feed", "ai,人工智能,大模型,大语言模型,智能体,机器人,算力,大模型,生成式ai,深度学习,机器学习,芯片,英伟达,nvidia", True, 10)]
JUYA = [("橘鴉AI早報", "https://daily.juya.uk/rss.xml", "", False, None)]
#: Groups of feeds: site, its name, feeds, days that an entry may be old, and what stands before titles.
GROUPS = [
    ("official_ai", "Official AI Updates", OFFICIAL, 45, None),
    ("curated_media", "精選媒體", CURATED, 30, None),
    ("tw_media", "TW Media", TAIWAN, 5, None),
    ("kr36_ai", "36Kr AI (Watchlist)", KR36, 3, None),
    ("juya_daily", "橘鴉AI早報 (Watchlist)", JUYA, 5, "橘鸦AI早报"),
]


def known_feeds(spark: SparkSession) -> DataFrame:
    """The catalogue (``feeds.CATALOGUE``), a feed's key being its address: some thirty rows, the same for all data."""
    rows = [(url, site, name, title, [w for w in words.split(",") if w], strict, days, first, True, 1, prefix) for site, name, feeds, days, prefix in GROUPS for title, url, words, strict, first in feeds]
    return spark.createDataFrame(rows, CATALOGUE)
