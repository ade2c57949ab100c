"""Text expressions: titles, tokens, entities, repair, redaction, language tests, keyword matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.plans.dims import TITLE_STOPWORDS, VENDORS

# Names of models, with their version.
MODELS = r"\b(gpt[-\s]?\d+(?:\.\d+)?[a-z]*|claude(?:[-\s]?(?:opus|sonnet|haiku))?[-\s]?\d+(?:\.\d+)?|gemini[-\s]?\d+(?:\.\d+)?|llama[-\s]?\d+(?:\.\d+)?|deepseek[-\s]?[a-z0-9.]+|grok[-\s]?\d+(?:\.\d+)?|mistral[-\s]?[a-z0-9.]+)\b"
# What overlap reports drop from titles, and the names that count as entities.
SOURCE_SUFFIXES = ["ai hot", "aihot", "hacker news", "product hunt", "techcrunch", "the verge", "venturebeat"]
DROP_WORDS = ["exclusive", "breaking", "news", "the", "a", "an", "from", "by", "via"]
ENTITIES = ["openai", "anthropic", "claude", "google", "gemini", "deepseek", "qwen", "llama", "meta", "mistral", "perplexity", "cursor", "codex", "copilot", "github", "runway", "kling"]
# Names of sites as readers see them.
SITE_ALIASES = {"Curated Media": "精選媒體", "Official AI Updates": "官方更新", "TW Media": "台灣媒體", "OPML RSS": "OPML"}
# The characters that Windows-1252 has in the place of the control characters 0x80 to 0x9F.
CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}


def first_line_title(text: Column) -> Column:
    return F.split(text, "\n")[0]


def title_tokens(title: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits, or of two or more Han characters, but stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"https?://\S+", " ")
    found = F.regexp_extract_all(plain, F.lit(r"([a-z0-9]+|[一-鿿]{2,})"), 1)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(TITLE_STOPWORDS)))


def vendors(title: Column) -> Column:
    pairs = F.array(*[F.when(F.contains(F.lower(title), F.lit(a)), F.lit(v)) for a, v in VENDORS.items()])
    return F.array_sort(F.array_distinct(F.array_compact(pairs)))


def models(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(MODELS), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, r"\s+", "-"))))


def may_merge(a: Column, b: Column) -> Column:
    """Whether two titles don't contradict each other: both name vendors, or models, and none is the same."""
    parted = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    return ~parted(vendors(a), vendors(b)) & ~parted(models(a), models(b))


def story_title(original: Column, title: Column, bilingual: Column) -> Column:
    """The title that stories compare: the original one, lower-cased, without the part behind " / " of bilingual ones."""
    low = F.lower(F.trim(F.coalesce(F.nullif(original, F.lit("")), title, F.lit(""))))
    cut = F.when(F.coalesce(bilingual, F.lit("")) != "", F.regexp_replace(low, r"\s*/\s*.+$", "")).otherwise(low)
    return F.regexp_replace(cut, r"\s+", " ")


def overlap_title(title: Column) -> Column:
    """A title as overlap reports compare it: without source suffix, labels in brackets, years, marks and fill words."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    parts = F.split(low, r"\s+[—–-]\s+")
    named = (F.size(parts) > 1) & F.btrim(F.element_at(parts, -1), F.lit(" .")).isin(SOURCE_SUFFIXES)
    text = F.when(named, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " — ")).otherwise(low)
    for pattern in (r"\[(exclusive|breaking|update|news)\]", r"\b20\d{2}\b", r"[^a-z0-9一-鿿]+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.array_join(F.filter(F.split(F.trim(text), " "), lambda t: (t != "") & ~t.isin(DROP_WORDS)), " ")


def overlap_tokens(normalised: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda t: F.length(t) > 1))


def overlap_entities(normalised: Column) -> Column:
    return F.array_intersect(F.split(normalised, " "), F.array(*map(F.lit, ENTITIES)))


def redact(text: Column) -> Column:
    """The text without mail addresses and strings that look like secrets (keys, tokens)."""
    mails = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted-email]")
    return F.regexp_replace(mails, r"(?i)\b(sk-(?!hynix\b)[A-Za-z0-9_-]{12,}|(?:api[_-]?key|secret|token)=([^\s&]{6,}))\b", "[redacted-secret]")


def redact_all(value: Column, kind: T.DataType) -> Column:
    """Every string inside a nested column redacted; all else as it is."""
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_all(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redact_all(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[redact_all(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return value


def snippet(text: Column, size: int = 240) -> Column:
    flat = redact(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def compact_title(text: Column, size: int = 96) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def is_mostly_english(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return ~text.rlike("[一-鿿]") & (letters >= F.greatest(F.lit(6), F.floor(F.length(text) / 4)))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[一-鿿]")


def matched(text: Column, terms: list[str]) -> Column:
    """The distinct terms that occur in the text, sorted; overlapping terms all count."""
    return F.filter(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.contains(text, t))


def has_word(text: Column, terms: list[str]) -> Column:
    """Whether a term occurs between ASCII word boundaries."""
    return F.lower(text).rlike("(^|[^a-z0-9])(" + "|".join(terms) + ")([^a-z0-9]|$)")


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again where that gives valid text; else the trimmed text."""
    said = F.trim(F.coalesce(text, F.lit("")))
    read = lambda t: F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string"))
    marks = "".join(CP1252.values())
    latin = F.when(said.rlike("^[\u0000-ÿ]*$"), read(said))
    back = F.translate(said, marks, "".join(map(chr, CP1252)))
    windows = F.when(said.rlike(f"^[\u0000-\u007f -ÿ{marks}]*$"), read(back))
    other = lambda t: F.when((t != "") & (t != said), t)
    return F.when(said.rlike("[Ãâåèæïðçé\u0080-\u009f]"), F.coalesce(other(latin), other(windows), said)).otherwise(said)


def has_mojibake(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("Ã|Â|â€|æ·|�")


def shown_source(site: Column, source: Column, host: Column) -> Column:
    """A source's name for readers: the URL's host for an empty one, and for an aggregator that names only itself."""
    said, where = F.trim(F.coalesce(source, F.lit(""))), F.regexp_replace(F.coalesce(host, F.lit("")), r"^www\.", "")
    named = F.when(where != "", where)
    itself = F.coalesce(site == "buzzing", F.lit(False)) & (F.lower(said) == "buzzing")
    return F.when(said == "", F.coalesce(named, F.lit("未分区"))).when(itself, F.coalesce(named, said)).otherwise(said)


def site_alias(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SITE_ALIASES.items() for x in pair])[name], name)
