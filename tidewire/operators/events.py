"""Business events: which of a fixed set of events an item reports, by terms, exclusions and co-occurrence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import terms
from tidewire.functions.times import bound


@dataclass(frozen=True)
class Events:
    """The terms of each event in table order; ``words`` match between word boundaries only, all others anywhere.

    ``exclude``: terms that rule an event out. ``together``: per event pairs of term lists one sentence must hold one of
    each of, where no plain term hits. ``unless``: an event that rests on the first list alone goes if one sentence holds
    a term of the second as well. ``titled``: events that a title's clause reports by a term of each list.
    """

    terms: dict[str, list[str]]
    words: list[str] = field(default_factory=list)
    exclude: dict[str, list[str]] = field(default_factory=dict)
    together: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    unless: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    titled: dict[str, tuple[list[str], ...]] = field(default_factory=dict)
    no_sites: tuple[str, ...] = ()


# The events of business news, their terms in English and traditional Chinese.
NEWS_EVENTS = Events(
    terms={
        "earnings": ["財報", "營收", "季報", "季度財報", "財測", "財務業績", "業績", "獲利", "淨利", "淨利潤", "毛利", "毛利率", "虧損", "營運虧損", "市值", "股價", "股東", "股東大會", "年報", "財政年度", "財年", "每股盈餘", "財報電話會議", "財報會議", "earnings", "revenue", "guidance", "quarter", "quarterly", "fiscal", "profit", "net income", "gross margin", "operating loss", "market cap", "market capitalization", "stock price", "eps", "earnings call", "earnings report", "financial results", "q1", "q2", "q3", "q4", "fiscal year", "shareholder"],
        "market": ["市佔率", "市佔", "市場份額", "收購", "收購案", "併購案", "反壟斷", "反托拉斯", "壟斷", "壟斷調查", "獨佔", "寡佔", "市場格局", "產業整合", "監管調查", "交易案", "競爭格局", "market share", "acquisition", "m&a", "antitrust", "monopoly", "anti-competitive", "regulatory probe", "market dominance", "consolidation", "takeover", "buyout", "hostile takeover", "competition watchdog"],
        "security": ["漏洞", "資安", "資安事件", "資安漏洞", "資料外洩", "洩露", "駭客", "駭客攻擊", "攻擊", "零時差", "零日漏洞", "入侵", "惡意軟體", "勒索軟體", "資安風險", "安全性漏洞", "修補程式", "安全漏洞", "資安通報", "提示注入", "越獄", "cve", "vulnerability", "vulnerabilities", "exploit", "breach", "zero-day", "hacker", "hacking", "malware", "ransomware", "data breach", "security flaw", "patch", "security incident", "remote code execution", "rce", "prompt injection", "jailbreak"],
        "pricing": ["降價", "漲價", "調漲", "調降", "定價", "免費方案", "收費方案", "訂閱方案", "資費", "價格方案", "價格調整", "方案調整", "優惠方案", "折扣", "計費方式", "api 價格", "api定價", "price cut", "price increase", "price hike", "pricing", "discount", "free tier", "subscription plan", "pricing plan", "api pricing", "billing", "price drop", "price change"],
        "benchmark": ["評測", "跑分", "排行榜", "勝率", "基準測試", "評比", "對決", "競技場", "排名", "測試結果", "評測結果", "跑分成績", "benchmark", "benchmarks", "sota", "state of the art", "leaderboard", "win rate", "eval", "evals", "evaluation", "arena", "top score", "ranking"],
    },
    words=["q1", "q2", "q3", "q4", "eps", "rce", "cve", "sota", "eval", "evals", "arena", "m&a", "sdk", "xai", "grok", "glm", "kimi", "phi", "titan", "qwen"],
    exclude={"security": ["駭客馬拉松", "黑客馬拉松", "駭客松", "黑客松", "hackathon"], "benchmark": ["遊戲", "手遊", "版本推送", "rivals"]},
    together={"market": (["merger", "併購", "合併"], ["公司", "企業", "收購", "acquisition", "acquire", "company", "corp", "corporation", "startup", "buyout", "takeover", "m&a", "deal", "股權", "股份", "control of"])},
    unless={"benchmark": (["eval", "evals"], ["sdk", "guide", "how to", "tutorial", "building", "build a", "build an", "教學", "教程", "手把手", "指南"])},
    titled={
        "model_release": (
            ["openai", "anthropic", "claude", "google deepmind", "deepmind", "gemini", "meta ai", "llama", "xai", "grok", "deepseek", "深度求索", "mistral", "thinking machines", "思維機器", "阿里", "qwen", "通義", "nvidia", "英偉達", "microsoft", "phi", "微軟", "moonshot", "kimi", "月之暗面", "智譜", "glm", "minimax", "amazon", "titan", "亞馬遜"],
            ["releases", "released", "releasing", "launches", "launched", "launching", "unveils", "unveiled", "introduces", "introduced", "open-sources", "open sources", "open-sourced", "drops", "dropped", "debuts", "debuted", "發布", "發佈", "釋出", "推出", "開源", "登場"],
            ["model", "models", "parameter", "parameters", "open-weights", "open weights", "multimodal", "模型", "參數", "多模態"],
        )
    },
    no_sites=("juya_daily",),
)
# Simplified characters that occur in the terms above, each over its traditional form.
SIMPLIFIED = "财报营测务业绩获净润亏损价东会余话议场额购并垄断独产监调争资统泄骇击时恶软体险补狱涨订阅费优计评胜准试对决竞结驱马游戏权红学开发释参数态仅义伟达谱亚逊维机"
TRADITIONAL = "財報營測務業績獲淨潤虧損價東會餘話議場額購併壟斷獨產監調爭資統洩駭擊時惡軟體險補獄漲訂閱費優計評勝準試對決競結驅馬遊戲權紅學開發釋參數態僅義偉達譜亞遜維機"

# Where a sentence of a text, and a clause of a title, ends.
MARKS, TITLE_MARKS = r"[。！？.!?\n]+", r"[。！？；;.!?\n]+"


def normalised(text: Column) -> Column:
    """Lower-cased, with the simplified characters of the terms as traditional ones; a full converter is not built."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), SIMPLIFIED, TRADITIONAL)


def _all(lists: Iterable[list[str]]) -> list[str]:
    return [t for terms_ in lists for t in terms_]


def cooccurs(text: Column, groups: tuple[list[str], ...], words: list[str], marks: str = MARKS) -> Column:
    """Whether one sentence holds a term of each group."""
    known = _all(groups)
    return terms.together(terms.hits(text, known, words, marks, known)["sentences"], *groups)


def business_events(site: Column, title: Column, summary: Column, events: Events = NEWS_EVENTS) -> Column:
    """The codes of the events that an item's title and summary report, in table order.

    Each text is read once for the terms of all events.
    """
    text = normalised(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    pairs = [*events.together.values(), *events.unless.values()]
    lists = [*events.terms.values(), *events.exclude.values(), *(g for pair in pairs for g in pair)]
    in_text = terms.hits(text, _all(lists), events.words, MARKS, _all(g for pair in pairs for g in pair))
    titled = _all(g for groups in events.titled.values() for g in groups)
    in_title = terms.hits(normalised(title), titled, events.words, TITLE_MARKS, titled)
    found = bound(F.struct(in_text.alias("text"), in_title.alias("title")), lambda s: _found(s["text"], s["title"], events))
    return F.when(F.coalesce(site, F.lit("")).isin(list(events.no_sites)), F.array().cast("array<string>")).otherwise(found)


def _found(text: Column, title: Column, events: Events) -> Column:
    said, hits = text["terms"], []
    for name, known in events.terms.items():
        hit = terms.some_of(said, known)
        if name in events.unless:
            weak, context = events.unless[name]
            strong = terms.some_of(said, [t for t in known if t not in weak])
            hit = hit & (strong | ~terms.together(text["sentences"], weak, context))
        if name in events.together:
            hit = hit | terms.together(text["sentences"], *events.together[name])
        if name in events.exclude:
            hit = hit & ~terms.some_of(said, events.exclude[name])
        hits.append(F.when(hit, F.lit(name)))
    for name, groups in events.titled.items():
        hits.append(F.when(terms.together(title["sentences"], *groups), F.lit(name)))
    return F.array_compact(F.array(*hits))
