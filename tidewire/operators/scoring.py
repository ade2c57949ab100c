"""Scores: relevance cascade, event tags, importance, engagement heat and hotness, all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import has_word, matched
from tidewire.functions.times import bound
from tidewire.functions.urls import host
from tidewire.plans.dims import KEEP_AT


@dataclass(frozen=True)
class Rules:
    """The terms of a relevance cascade; the engine's rules are data, so tests use a dictionary of their own.

    Terms match anywhere; ``words`` and ``broad_words`` between word boundaries. ``unsafe`` and ``promo`` are patterns:
    one of the former or two of the latter make a text unsafe. ``tutorial`` opens a title, ``tutorial_inside`` is in it.
    """

    signal: list[str]
    broad: list[str]
    tech: list[str]
    noise: list[str]
    commerce: list[str]
    unsafe: list[str]
    tutorial: list[str]
    labels: list[tuple[str, list[str]]] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    broad_words: list[str] = field(default_factory=list)
    promo: list[str] = field(default_factory=list)
    tutorial_inside: list[str] = field(default_factory=list)


# The rules for news about artificial intelligence.
NEWS = Rules(
    signal=[
        "a.i.", "agent view", "agent skills", "for agents", "parallel agent", "并行 agent", "known agents", "hermes-agent", "agentmemory", "cursor", "aigc", "llm", "gpt", "claude", "gemini", "deepseek", "openai", "anthropic", "copilot", "codex", "mcp", "hugging face", "huggingface", "transformer", "prompt", "diffusion",
        "多模态", "交互模型", "变换器", "语言模型", "视觉语言模型", "基础模型", "本地模型", "具身智能", "大模型", "人工智能", "机器学习", "深度学习", "智能体", "算力", "推理", "微调",
        "人工智慧", "機器學習", "深度學習", "大型語言模型", "語言模型", "生成式人工智慧", "生成式ai", "智慧體", "智能體", "多模態", "基礎模型", "視覺語言模型", "具身智慧", "演算法", "微調", "神經網路",
    ],
    words=["ai", "aigc", "llm", "gpt", "openai", "anthropic", "deepseek", "gemini", "claude", "robot", "robotics", "embodied", "autonomous", "machine learning", "artificial intelligence", "transformer", "diffusion"],
    broad=["agent", "模型", "推理"],
    broad_words=["agent"],
    tech=["robot", "robotics", "embodied", "autonomous", "vision", "chip", "semiconductor", "cuda", "npu", "gpu", "cloud", "developer", "benchmark", "dataset", "eval", "evaluation", "sandbox", "context", "开源", "技术", "编程", "软件", "沙箱", "上下文", "芯片", "机器人", "具身", "開源", "技術", "編程", "程式設計", "軟體", "晶片", "機器人"],
    noise=["娱乐", "明星", "八卦", "足球", "篮球", "彩票", "情感", "旅游", "美食"],
    commerce=["淘宝", "天猫", "京东", "拼多多", "券后", "热销总榜", "促销", "优惠", "补贴", "下单", "首发价"],
    unsafe=[r"\bcreampie\b", r"\bblowjob\b", r"\bsuck (?:your|my) (?:dick|cock)\b", "中出|婊子|吸你的鸡鸡|操虚拟女友"],
    promo=[r"\b(?:nsfw|nudes?|porn(?:ography)?)\b", r"\buncensored pictures?\b", r"\bvirtual girlfriends?\b", r"\bknock her up\b", "未经审查的图片|虚拟女友|色情内容|成人内容"],
    tutorial=["how to", "guide to", "tutorial", "hands-on", "step-by-step", "a coding guide"],
    tutorial_inside=["使用教學", "使用教学", "教學文", "教学文", "入門教學", "入门教学", "新手教學", "新手教学", "保姆級", "保姆级", "教程", "手把手", "實作指南", "实作指南", "sdk guide", "coding guide"],
    labels=[
        ("model_release", ["model", "gpt", "claude", "gemini", "deepseek", "llm", "模型", "大模型", "发布", "release"]),
        ("developer_tool", ["copilot", "codex", "mcp", "api", "sdk", "developer", "开发者", "编程", "代码", "coding"]),
        ("agent_workflow", ["agent", "智能体", "workflow", "工作流", "tool use", "function calling"]),
        ("research_paper", ["paper", "arxiv", "research", "benchmark", "eval", "论文", "研究", "评测", "榜单"]),
        ("infra_compute", ["gpu", "npu", "cuda", "chip", "semiconductor", "算力", "芯片", "推理"]),
        ("robotics", ["robot", "robotics", "embodied", "机器人", "具身"]),
        ("industry_business", ["funding", "acquire", "融资", "收购", "估值", "营收", "公司"]),
        ("ai_product_update", ["openai", "anthropic", "google", "perplexity", "cursor", "产品", "上线", "更新"]),
    ],
)


def any_of(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)) if terms else F.lit(False)


def label(text: Column, rules: Rules, has_tech: Column) -> Column:
    out = None
    for name, terms in rules.labels:
        out = F.when(any_of(text, terms), name) if out is None else out.when(any_of(text, terms), name)
    rest = F.when(has_tech, "ai_tech").otherwise("ai_general")
    return rest if out is None else out.otherwise(rest)


def is_unsafe(text: Column, rules: Rules) -> Column:
    hits = sum((text.rlike(p).cast("int") for p in rules.promo), F.lit(0))
    hard = text.rlike("|".join(rules.unsafe)) if rules.unsafe else F.lit(False)
    return hard | (hits >= 2)


def is_tutorial(title: Column, rules: Rules) -> Column:
    """Whether a lower-cased title opens with a tutorial's phrase or holds one of the unmistakable ones."""
    opens = F.trim(title).rlike(r"^(" + "|".join(rules.tutorial) + r")\b") if rules.tutorial else F.lit(False)
    return opens | any_of(title, rules.tutorial_inside)


def tutorial_signals(title: Column, rules: Rules) -> Column:
    """The phrases that make a lower-cased title a tutorial's, sorted."""
    opens = F.nullif(F.regexp_extract(F.trim(title), r"^(" + "|".join(rules.tutorial) + r")\b", 1), F.lit("")) if rules.tutorial else F.lit(None).cast("string")
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(opens)), matched(title, rules.tutorial_inside))))


def has_signal(text: Column, rules: Rules) -> Column:
    """Whether a lower-cased text holds a term of the subject other than a broad one."""
    narrow = any_of(text, [t for t in rules.signal if t not in rules.broad])
    return narrow | has_word(text, rules.words) if rules.words else narrow


def has_broad(text: Column, rules: Rules) -> Column:
    words = rules.words + rules.broad_words
    return any_of(text, rules.broad) | has_word(text, words) if words else any_of(text, rules.broad)


def verdict(score: Column, name: Column | str, related: Column | bool, reason: Column | str = "") -> Column:
    """struct(score clamped to 0..1 and rounded to 2 digits, label, related, reason)."""
    name, related, reason = (F.lit(x) if isinstance(x, str | bool) else x for x in (name, related, reason))
    return F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"), name.alias("label"), related.alias("related"), reason.alias("reason"))


def relevance(text: Column, prior: Column, rules: Rules = NEWS, title: Column | None = None) -> Column:
    """struct(score double, label string, related boolean, reason string) of a lower-cased text: the first rule that
    holds decides."""
    said = F.struct(text.alias("text"), prior.alias("prior"), (text if title is None else title).alias("title"))
    return bound(said, lambda s: _general(s["text"], s["prior"], rules, s["title"]))


def _general(text: Column, prior: Column, rules: Rules, title: Column) -> Column:
    signals, tech = F.size(matched(text, rules.signal)), F.size(matched(text, rules.tech))
    noise = F.size(matched(text, rules.noise + rules.commerce))
    narrow, broad = has_signal(text, rules), has_broad(text, rules)
    keep = F.greatest(F.lit(KEEP_AT), prior + F.when(narrow, 0.52).otherwise(0.34) + F.least(F.lit(0.18), signals * 0.04) + F.least(F.lit(0.12), tech * 0.03) - F.least(F.lit(0.18), noise * 0.04))
    found = F.when(narrow, "matched_ai_signal").otherwise("matched_broad_ai_plus_tech_signal")
    return (
        F.when(is_unsafe(text, rules), verdict(F.lit(0.0), "unsafe_content", False, UNSAFE))
        .when(is_tutorial(title, rules), verdict(F.lit(0.15), "tutorial_excluded", False, TUTORIAL))
        .when(~narrow & ~(broad & (tech > 0)), verdict(prior + F.when(broad, 0.32).otherwise(0.0) + F.when(tech > 0, 0.08).otherwise(0.0), "not_ai", False, "missing_meaningful_ai_signal"))
        .when(any_of(text, rules.commerce) & ~narrow, verdict(prior + 0.25, "commerce_noise", False, "commerce_noise_without_strong_ai_signal"))
        .when((noise > 0) & ~narrow, verdict(prior + 0.25, "noise", False, "noise_without_strong_ai_signal"))
        .otherwise(verdict(keep, label(text, rules, tech > 0), True, found))
    )


# Reasons that also decide which signals and noise an item shows.
UNSAFE, TUTORIAL, HOT, BOARD, MEDIA, TRUSTED = "unsafe_promotional_content", "tutorial_title_pattern", "zeli_24h_hot_allowlist", "tophub_blocked_channel", "curated_media_source_filter", "trusted_ai_source_default_keep"


@dataclass(frozen=True)
class Scope:
    """What single sites' feeds have to meet before or instead of the cascade's general rules."""

    forwarded: list[str]
    domains: list[str]
    hot_site: str
    hot_source: str
    board_site: str
    board_allow: list[str]
    board_block: list[str]
    media_site: str
    media_trusted: list[str]
    media_research: list[str]
    research: list[str]
    business: list[str]
    trusted_sites: list[str]


# The sites of the news about artificial intelligence.
NEWS_SCOPE = Scope(
    forwarded=["hacker news", "hackernews", "黑客新闻", "黑客新聞", "駭客新聞"],
    domains=["v2ex.com"],
    hot_site="zeli",
    hot_source="24h",
    board_site="tophub",
    board_allow=["readhub · ai", "hacker news", "github", "product hunt", "v2ex", "少数派", "infoq", "36氪", "机器之心", "量子位", "科技", "人工智能", "机器人", "具身", "开源"],
    board_block=["热销总榜", "淘宝", "天猫", "京东", "拼多多", "抖音", "快手", "微博", "小红书"],
    media_site="curated_media",
    media_trusted=["the decoder ai news", "techcrunch ai", "venturebeat ai", "artificial intelligence news", "claude code releases", "lmarena blog", "epoch ai"],
    media_research=["marktechpost research"],
    research=["paper", "arxiv", "research", "benchmark", "bench", "eval", "evaluation", "dataset", "model", "llm", "agent", "diffusion", "transformer", "multimodal", "reasoning", "inference", "training", "open-source", "robot", "governance"],
    business=["funding", "raises", "raised", "startup", "acquire", "acquisition", "merger", "revenue", "enterprise", "ipo", "valuation"],
    trusted_sites=["aibase", "aihot", "aihubtoday"],
)


def media_relevance(source: Column, title: Column, text: Column, prior: Column, rules: Rules, scope: Scope) -> Column:
    """Relevance of a picked medium's item: by its title, or by its feed where that is trusted or of research."""
    trusted, lab = any_of(source, scope.media_trusted), any_of(source, scope.media_research)
    in_title, broad, paper = has_signal(title, rules), has_broad(title, rules), any_of(title, scope.research)
    signals, tech = F.size(matched(text, rules.signal)), F.size(matched(text, rules.tech))
    noise = F.size(matched(text, rules.noise + rules.commerce))
    whole = prior + F.when(trusted, 0.58).otherwise(0.5) + F.least(F.lit(0.12), signals * 0.03) + F.least(F.lit(0.08), tech * 0.02)
    score = F.when(lab, F.least(whole, F.lit(0.76))).otherwise(whole) - F.when((noise > 0) & ~in_title, F.least(F.lit(0.16), noise * 0.04)).otherwise(0.0)
    name = F.when(lab | paper, "research_paper").when(any_of(title, scope.business), "industry_business").otherwise(label(text, rules, tech > 0))
    return (
        F.when(lab & ~in_title & ~paper, verdict(F.lit(0.22), "source_scope_drop", False, "curated_research_source_requires_research_or_ai_title_signal"))
        .when(~trusted & ~lab & ~in_title & ~(broad & (tech > 0)), verdict(prior + F.when(broad, 0.28).otherwise(0.0), "source_scope_drop", False, "curated_media_requires_ai_title_or_trusted_ai_feed"))
        .otherwise(verdict(score, name, score >= KEEP_AT, MEDIA))
    )


def site_relevance(site: Column, source: Column, title: Column, site_name: Column, host: Column, prior: Column, rules: Rules = NEWS, scope: Scope = NEWS_SCOPE) -> Column:
    """The whole cascade over an item: safety, tutorials, the rules of its site, then ``relevance``; with the signals and
    the noise that explain it. Null columns count as empty; of the URL only the host is read, as paths hold terms by
    chance."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    text = F.concat_ws(" ", low(title), low(source), low(site_name), low(host))
    said = F.struct(F.coalesce(site, F.lit("")).alias("site"), low(source).alias("source"), low(title).alias("title"), low(host).alias("host"), text.alias("text"), prior.alias("prior"))
    return bound(said, lambda s: bound(_cascade(s, rules, scope), lambda got: _explained(s, got, rules, scope)))


def _cascade(s: Column, rules: Rules, scope: Scope) -> Column:
    site, source, title, host, text, prior = (s[c] for c in ("site", "source", "title", "host", "text", "prior"))
    tech = F.size(matched(text, rules.tech)) > 0
    drop = lambda score, reason, name="source_scope_drop": verdict(F.lit(score), name, False, reason)
    board, domain = site == scope.board_site, F.lit(False)
    for d in scope.domains:
        domain = domain | (host == d) | host.endswith(f".{d}")
    return (
        F.when(is_unsafe(text, rules), drop(0.0, UNSAFE, "unsafe_content"))
        .when(is_tutorial(title, rules), drop(0.15, TUTORIAL, "tutorial_excluded"))
        .when(any_of(source, scope.forwarded), drop(0.1, "hn_forwarded_source_excluded"))
        .when(domain, drop(0.1, "aggregator_backdoor_domain_excluded"))
        .when((site == scope.hot_site) & F.contains(source, F.lit(scope.hot_source)), verdict(F.greatest(F.lit(KEEP_AT), prior + 0.62), "curated_hotlist", True, HOT))
        .when(site == scope.hot_site, drop(0.2, "zeli_only_keeps_24h_hot_source"))
        .when(board & any_of(source, scope.board_block), drop(0.05, BOARD, "noise"))
        .when(board & ~any_of(source, scope.board_allow), drop(0.12, "tophub_channel_not_in_allowlist"))
        .when(site == scope.media_site, media_relevance(source, title, text, prior, rules, scope))
        .when(site.isin(scope.trusted_sites), verdict(F.greatest(F.lit(KEEP_AT), prior + 0.72), label(text, rules, tech), True, TRUSTED))
        .otherwise(_general(text, prior, rules, title))
    )


def _explained(s: Column, got: Column, rules: Rules, scope: Scope) -> Column:
    site, source, title, text = (s[c] for c in ("site", "source", "title", "text"))
    why, own, none = got["reason"], matched(text, rules.signal), F.array().cast("array<string>")
    all_ = F.concat(own, matched(text, rules.tech))
    disturbing = F.concat(matched(text, rules.noise), matched(text, rules.commerce))
    or_else = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    signals = (
        F.when(why == UNSAFE, none)
        .when(why == HOT, F.array(F.lit("zeli_24h_hot")))
        .when((why == MEDIA) & any_of(source, scope.media_trusted), or_else(all_, F.array(source)))
        .when(why == TRUSTED, or_else(own, F.array(site)))
        .otherwise(all_)
    )
    noise = F.when(why == UNSAFE, F.array(F.lit(UNSAFE))).when(why == TUTORIAL, tutorial_signals(title, rules)).when(why == BOARD, or_else(disturbing, matched(source, scope.board_block))).otherwise(disturbing)
    return F.struct(got["score"].alias("score"), got["label"].alias("label"), got["related"].alias("related"), why.alias("reason"), signals.alias("signals"), noise.alias("noise"))


def with_relevance(items: DataFrame, prior: Column, rules: Rules = NEWS, scope: Scope = NEWS_SCOPE) -> DataFrame:
    """``items`` (site_id, source, title, site_name, url) with ai_is_related, ai_score, ai_label, ai_relevance_reason,
    ai_signals and ai_noise."""
    r = site_relevance(F.col("site_id"), F.col("source"), F.col("title"), F.col("site_name"), host(F.coalesce("url", F.lit(""))), prior, rules, scope)
    names = {"related": "ai_is_related", "score": "ai_score", "label": "ai_label", "reason": "ai_relevance_reason", "signals": "ai_signals", "noise": "ai_noise"}
    return items.select("*", r.alias("_r")).select(*[F.col(c) for c in items.columns if c not in names.values()], *[F.col("_r")[k].alias(v) for k, v in names.items()])


def relevance_score(*scores: Column, related: Column) -> Column:
    """The first given score as a number in 0..1; one that doesn't read as a number, or none: 1 for related items, else 0."""
    read = F.coalesce(*[s.cast("string") for s in scores]).try_cast("double")
    bounded = F.when(read.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), read)))
    return F.coalesce(bounded, F.when(related, 1.0).otherwise(0.0))


def freshness(age_hours: Column, half_life: float = 48.0) -> Column:
    return F.when(age_hours.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_hours) / half_life)))


# Editorial strength of sites that choose what they publish.
EDITORIAL_SITES = {"official_ai": 0.9, "aihot": 0.78}


def editorial(external: Column, related: Column, relevance_score: Column, site: Column | None = None) -> Column:
    """An outside score (percent or share), else the site's own strength, else one from the relevance."""
    share = F.when(external > 1, external / 100).otherwise(external)
    outside = F.when(external.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    own = F.when(related, F.greatest(F.lit(0.45), relevance_score * 0.72)).otherwise(relevance_score * 0.6)
    of_site = F.lit(None).cast("double") if site is None else F.create_map(*[F.lit(x) for pair in EDITORIAL_SITES.items() for x in pair])[site]
    return F.coalesce(outside, of_site, own)


def importance(editorial_: Column, tier: Column, relevance_: Column, fresh: Column, duplicates: Column) -> Column:
    heat = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (duplicates - 1) / 4))
    return editorial_ * 0.30 + tier * 0.22 + relevance_ * 0.20 + fresh * 0.18 + heat * 0.10


# The scale of a creator site's engagement; hours and points of the bonus for what is fresh.
CREATOR_SCALES, CREATOR_SCALE, BONUS_HOURS, BONUS_POINTS = {"tikhub_xiaohongshu": 22.0}, 20.0, 24, 15.0


def creator_ranking(site: Column, likes: Column, comments: Column, collects: Column, shares: Column, age_hours: Column) -> Column:
    """struct(engagement, heat, bonus, hot) of a creator's post, each rounded to 1 digit; a null age has no bonus."""
    count = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    total = count(likes) + count(comments) * 2.0 + count(collects) * 1.5 + count(shares) * 2.0
    scale = F.coalesce(F.create_map(*[F.lit(x) for pair in CREATOR_SCALES.items() for x in pair])[site], F.lit(CREATOR_SCALE))
    heat = F.least(F.lit(100.0), scale * F.log10(1.0 + total))
    bonus = F.when((age_hours >= 0) & (age_hours <= BONUS_HOURS), BONUS_POINTS).otherwise(0.0)
    hot = F.least(F.lit(100.0), heat * 0.85 + bonus)
    return F.struct(*[F.round(c, 1).alias(n) for n, c in (("engagement", total), ("heat", heat), ("bonus", bonus), ("hot", hot))])


def hotness(sources: Column, age_hours: Column) -> Column:
    """(sources - 1) e^(-age / 12 h); nothing below two sources."""
    return F.when(sources < 2, 0.0).otherwise((sources - 1) * F.exp(-F.greatest(F.lit(0.0), age_hours) / 12))
