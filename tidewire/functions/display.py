"""What readers see of items and stories: clocks, percentages, priority, sections, tones, tags and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import terms
from tidewire.functions.times import bound

# The sections with the labels, the patterns (on all text, or on all but the label) and the sites that
# put an item there.
SECTIONS = ["models", "products", "devtools", "industry", "research", "community"]
MODEL_TERMS = r"gpt[-\s]?\d|claude|gemini|grok|llama|qwen|deepseek|mistral|kimi\s?k\d|glm|gemma|模型|model|weights|权重|權重|多模态|多模態|视频生成|影片生成|diffusion|sora|seedance|llm|大模型"
TOOL_TERMS = r"skill|copilot|codex|cli|api|sdk|dashboard|workflow|tool|工具|助手|应用|應用|插件|外掛|工作流|支付宝|支付寶|浏览器|瀏覽器|搜索|搜尋"
SECTION_TERMS = {
    "products": r"app|product|agent|workflow|siri|copilot|chatgpt|perplexity|runway|suno|支付宝|支付寶|产品|產品|应用|應用|智能体|智慧體|机器人|機器人|浏览器|瀏覽器|搜索|搜尋|助手|生成工具|办公|辦公|教育",
    "devtools": r"github|cursor|codex|copilot|openrouter|api|sdk|mcp|cli|framework|inference|推理|开发者|開發者|开源|開源|代码|程式碼|编程|程式設計|算力|芯片|晶片|nvidia|cloud|部署|benchmarking|token",
    "industry": r"funding|raised|ipo|acquire|acquisition|lawsuit|regulation|policy|white house|pentagon|nvidia|salesforce|meta|microsoft|融资|融資|收购|收購|上市|监管|監管|政策|裁员|裁員|估值|债券|債券|芯片|晶片|公司|行业|行業|政府|五角大楼|五角大樓|白宫|白宮",
    "research": r"paper|arxiv|research|benchmark|eval|dataset|lmsys|rdi|berkeley|huggingface daily papers|论文|論文|研究|基准|基準|评测|評測|数据集|資料集|训练|訓練|k-means|speculative decoding",
    "community": r"waytoagi|社区|社群|公众号|公眾號|阿里|通义|通義|千问|千問|智谱|智譜|kimi|月之暗面|minimax|字节|字節|火山|百度|腾讯|騰訊|华为|華為|蚂蚁|螞蟻|讯飞|訊飛|国内|國內|中文|开源中国|開源中國|少数派|少數派|虎嗅",
}
SECTION_LABELS = {"products": ["ai_product_update", "agent_workflow", "robotics"], "devtools": ["developer_tool", "developer_tooling", "infra_compute"], "industry": ["industry_business"], "research": ["research_paper"], "community": []}
COMMUNITY_SITES = ["waytoagi", "followbuilders", "aibase"]
COMMUNITY_SOURCES = ["it之家", "36氪", "掘金", "readhub", "aibase", "公众号", "公眾號", "宝玉", "寶玉", "小互", "ayi"]
# Names of sources as signals with their priority, and labels of sections, events and importance.
SIGNALS = {"AI HOT": "AI HOT精選", "Official AI Updates": "官方更新", "Follow Builders": "Builders", "AIbase": "AIbase", "OPML RSS": "OPML"}
PRIORITIES = {"官方更新": 100, "AI HOT精選": 90, "AIbase": 82, "Builders": 74, "OPML": 68}
SECTION_BADGES = {"hot": "熱點", "models": "模型", "products": "產品", "devtools": "開發者", "industry": "行業", "research": "研究", "community": "社群"}
SECTION_TAGS = {"models": "模型釋出", "devtools": "開發者", "research": "研究", "community": "社群"}
EVENT_LABELS = {"earnings": "財報", "market": "市佔", "security": "資安", "pricing": "價格", "benchmark": "評測", "model_release": "模型發布"}
IMPORTANCE_LABELS = {"official": "官方更新", "multi_source": "多源熱議", "industry": "行業動態", "watch": "值得關注"}
LABEL_TONES = {"curated_hotlist": "hot", "model_release": "models", "developer_tool": "devtools", "developer_tooling": "devtools", "infrastructure": "devtools", "infra_compute": "devtools", "research_paper": "research", "industry_business": "industry", "ai_product_update": "products", "agent_workflow": "products", "robotics": "products"}
SIGNAL_TONES = [("official", ["官方", "official"]), ("hot", ["ai hot", "精選"]), ("builders", ["builders", "github", "x"]), ("aihub", ["aihub", "aibase", "媒體"]), ("aggregate", ["hn", "hacker", "聚合"]), ("newsletter", ["opml", "日報"])]
TITLE_REPAIRS = [(r"(?i)\bcodex\b", [("法典", "Codex")]), (r"(?i)\bbug bounty\b", [("錯誤賞金", "漏洞懸賞"), ("Bug 賞金", "漏洞懸賞")]), (r"(?i)\bbio bug bounty\b", [("生物漏洞懸賞", "生物安全漏洞懸賞")]), (r"(?i)\brepositor(?:y|ies)\b", [("儲存庫", "程式碼倉庫")]), (r"(?i)\bdesktop app\b", [("桌面應用程式", "桌面應用")])]

_empty = lambda c: F.coalesce(c, F.lit(""))
_given = lambda c: F.nullif(F.trim(c), F.lit(""))


def _of(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[_empty(key)]


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def timeline(published: Column, seen: Column, generated: Column) -> Column:
    """The time an item is shown at: its publication, unless that lies over 10 minutes after the view was made."""
    ahead = published > generated + F.make_dt_interval(mins=F.lit(10))
    return F.when(ahead, F.coalesce(seen, published)).otherwise(F.coalesce(published, seen))


def score_percent(*scores: Column) -> Column:
    score = F.coalesce(*scores, F.lit(0.0)).cast("double")
    return F.when(F.isnan(score) | (score <= 0), 0.0).otherwise(half_up(F.when(score <= 1, score * 100).otherwise(score)))


def bounded_percent(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score_percent(score)))


def tier_percent(site: Column, rank: Column) -> Column:
    of_rank = F.greatest(F.lit(28.0), F.least(F.lit(86.0), 86.0 - rank * 9))
    return F.when(site == "official_ai", 100.0).when(site == "aihot", 90.0).when(rank.isNull(), 38.0).otherwise(of_rank)


def editorial_percent(site: Column, outside: Column, internal: Column) -> Column:
    given = bounded_percent(outside)
    own = F.when(internal > 0, F.greatest(F.lit(45.0), half_up(internal * 0.72))).otherwise(36.0)
    return F.when(given > 0, given).when(site == "official_ai", 90.0).when(site == "aihot", 78.0).otherwise(own)


def freshness_percent(age_hours: Column, half_life: float = 48.0) -> Column:
    return F.when(age_hours.isNull() | (age_hours < 0), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(100 * F.pow(F.lit(0.5), age_hours / half_life)))))


def priority(internal: Column, editorial: Column, tier: Column, fresh: Column, n_signals: Column) -> Column:
    signal = F.least(F.lit(100.0), F.coalesce(n_signals, F.lit(0)) * 18.0)
    return half_up(editorial * 0.3 + tier * 0.22 + internal * 0.2 + fresh * 0.18 + signal * 0.1)


def is_high(internal: Column, priority_: Column, site: Column) -> Column:
    return (internal >= 75) | (priority_ >= 82) | F.coalesce(site.isin("official_ai", "aihot"), F.lit(False))


def is_curated(site: Column, tier: Column) -> Column:
    return F.coalesce(site.isin("official_ai", "aihot"), F.lit(False)) | F.coalesce(tier.isin("official", "curated"), F.lit(False))


def sections(content: Column, label: Column, site: Column, source: Column) -> Column:
    """The sections of an item, in table order; industry if there is none. ``content``: its lower-cased text without the
    label; source: source and site name, lower-cased."""
    label = _empty(label)
    known = {name: terms.spelled_out(pattern) for name, pattern in {"models": MODEL_TERMS, "tools": TOOL_TERMS, **SECTION_TERMS}.items()}
    in_content = terms.hits(content, known["models"])["terms"]
    in_text = terms.hits(F.concat_ws(" ", content, label), (t for name, of in known.items() if name != "models" for t in of))["terms"]
    said = F.struct(in_content.alias("content"), in_text.alias("text"), label.alias("label"), _empty(source).alias("source"), site.alias("site"))
    return bound(said, lambda s: _sections(s["content"], s["text"], s["label"], s["site"], s["source"], known))


def _sections(content: Column, text: Column, label: Column, site: Column, source: Column, known: dict[str, list[str]]) -> Column:
    hits = {"models": terms.some_of(content, known["models"]) | ((label == "model_release") & ~terms.some_of(text, known["tools"]))}
    for name in SECTION_TERMS:
        hits[name] = terms.some_of(text, known[name]) | label.isin(SECTION_LABELS[name] or ["?"])
    from_community = F.coalesce(site.isin(COMMUNITY_SITES), F.lit(False)) | F.exists(F.array(*map(F.lit, COMMUNITY_SOURCES)), lambda s: F.contains(source, s))
    hits["community"] = hits["community"] | from_community
    found = F.array_compact(F.array(*[F.when(hits[s], F.lit(s)) for s in SECTIONS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("industry")))


def source_signal(site_name: Column) -> Column:
    return F.coalesce(_of(SIGNALS, site_name), F.nullif(_empty(site_name), F.lit("")), F.lit("來源"))


def source_priority(signal: Column) -> Column:
    return F.coalesce(_of(PRIORITIES, signal), F.lit(50))


def source_sort_key(site_name: Column, site: Column, source: Column) -> Column:
    name = F.coalesce(F.nullif(_empty(site_name), F.lit("")), _empty(site))
    return F.coalesce(_given(F.concat_ws(" ", source_signal(site_name), name, _empty(source))), F.lit("來源"))


def signal_tone(signal: Column) -> Column:
    text, out = F.lower(_empty(signal)), F.when(F.lit(False), "")
    for tone, terms in SIGNAL_TONES:
        out = out.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), tone)
    return out.otherwise("default")


def score_tone(score: Column) -> Column:
    return F.when(score >= 90, "hot").when(score >= 75, "strong").otherwise("watch")


def label_tone(site: Column, label: Column, sections_: Column) -> Column:
    return F.when(site == "official_ai", "official").when(site == "aihot", "hot").otherwise(F.coalesce(_of(LABEL_TONES, label), F.when(F.array_contains(sections_, "community"), "community"), F.lit("default")))


def tags(section: str, sections_: Column, site: Column, verified: Column, size: int = 3) -> Column:
    """At most ``size`` tags of an item shown on a section's page."""
    echo = F.lit(None).cast("string") if section == "hot" else F.when(F.lit(section == "models") & F.array_contains(sections_, "models"), F.lit(None)).otherwise(F.lit(SECTION_BADGES[section]))
    of_sections = [F.when(F.array_contains(sections_, s), t) for s, t in SECTION_TAGS.items()]
    all_ = F.array(echo, F.when(verified, "多源驗證"), F.when(site == "official_ai", "官方"), F.when(site == "aihot", "AI HOT"), *of_sections)
    return F.slice(F.array_distinct(F.array_compact(all_)), 1, size)


def event_badges(*events: Column) -> Column:
    """The labels of the union of event code arrays."""
    codes = F.array_distinct(F.flatten(F.array(*[F.coalesce(e, F.array().cast("array<string>")) for e in events])))
    return F.array_compact(F.transform(codes, lambda c: F.create_map(*[F.lit(x) for pair in EVENT_LABELS.items() for x in pair])[c]))


def importance_label(category: Column) -> Column:
    return F.coalesce(_of(IMPORTANCE_LABELS, category), F.lit(IMPORTANCE_LABELS["watch"]))


def hot_score(hotness: Column) -> Column:
    return F.when(hotness <= 0, 0.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(100.0), half_up(hotness * 60))))


def duration_label(earliest: Column, latest: Column) -> Column:
    """How long a story has been growing; empty for one point in time."""
    minutes = half_up(F.abs(F.unix_micros(latest) - F.unix_micros(earliest)) / 60e6).cast("long")
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    long_ = F.concat(F.lit("發酵 "), hours, F.lit("小時"), F.when(rest > 0, F.concat(rest.cast("string"), F.lit("分"))).otherwise(""))
    return F.when(earliest.isNull() | latest.isNull() | (earliest == latest), "").when(minutes < 20, "短時集中").when(minutes < 60, F.concat(F.lit("發酵 "), minutes.cast("string"), F.lit(" 分鐘"))).otherwise(long_)


def repaired_title(original: Column, translated: Column) -> Column:
    out = F.trim(_empty(translated))
    for pattern, swaps in TITLE_REPAIRS:
        for a, b in swaps:
            out = F.when(_empty(original).rlike(pattern), F.replace(out, F.lit(a), F.lit(b))).otherwise(out)
    return out


def is_english_title(text: Column) -> Column:
    said = F.trim(_empty(text))
    latin, han = F.length(F.regexp_replace(said, "[^A-Za-z]", "")), F.length(F.regexp_replace(said, "[^㐀-鿿]", ""))
    return (latin >= 4) & (latin > han * 2)


def shown_title(title_zh: Column, title: Column, title_en: Column, title_original: Column) -> Column:
    """The title that is shown: the Chinese one, else the first part of a bilingual one, repaired by the original."""
    preferred = F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in (title_zh, title, title_en)], F.lit("未命名更新")))
    parts = F.split(preferred, " / ")
    split = F.size(parts) > 1
    zh = F.nullif(title_zh, F.lit("")).isNotNull()
    shown = F.when(~zh & split, F.trim(parts[0])).otherwise(preferred)
    original = F.coalesce(F.nullif(title_en, F.lit("")), F.nullif(title_original, F.lit("")), F.when(split, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), " / ")), F.lit(""))
    return repaired_title(original, shown)


def original_title(title: Column, title_bilingual: Column, title_en: Column, title_original: Column, shown: Column) -> Column:
    """The English title that stands under the shown one; empty if there is no other."""
    both = F.split(F.trim(F.coalesce(F.nullif(title, F.lit("")), title_bilingual, F.lit(""))), " / ")
    rest = F.when(F.size(both) > 1, F.trim(F.array_join(F.slice(both, F.lit(2), F.greatest(F.lit(0), F.size(both) - 1)), " / ")))
    usable = lambda c: F.when(is_english_title(c) & (F.trim(_empty(c)) != shown), F.trim(_empty(c)))
    return F.coalesce(usable(title_en), usable(rest), usable(title_original), F.lit(""))


def summary_text(summary: Column, size: int = 180) -> Column:
    flat = F.trim(F.regexp_replace(_empty(summary), r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.trim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def freshness_route(latest_age: Column, stories_lag: Column) -> Column:
    """How a consumer should read the views: stale data are named, stories that lag too far give way to items."""
    return F.struct((latest_age > 36).alias("warn_stale"), (stories_lag > 48).alias("fall_back_to_items"))
