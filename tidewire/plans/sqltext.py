"""SQL texts for DuckDB that state the rule tables' meaning apart from the Spark expressions."""

from __future__ import annotations

from tidewire.operators.events import SIMPLIFIED, TRADITIONAL, Events
from tidewire.operators.scoring import Rules, Scope


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def some(terms: list[str], of: str) -> str:
    return "(" + " OR ".join(f"contains({of}, {quoted(t)})" for t in terms) + ")" if terms else "false"


def word(terms: list[str], of: str) -> str:
    return f"regexp_matches({of}, {quoted('(^|[^a-z0-9])(' + '|'.join(t.replace('.', chr(92) + '.') for t in terms) + ')([^a-z0-9]|$)')})" if terms else "false"


def found(terms: list[str], of: str) -> str:
    return f"list_filter([{', '.join(map(quoted, sorted(set(terms))))}]::VARCHAR[], lambda t: contains({of}, t))" if terms else "[]::VARCHAR[]"


def several(terms: list[str], of: str) -> str:
    return f"len({found(terms, of)})"


def _label(r: Rules, of: str) -> str:
    rows = " ".join(f"WHEN {some(t, of)} THEN '{n}'" for n, t in r.labels)
    return f"CASE {rows} WHEN {several(r.tech, of)} > 0 THEN 'ai_tech' ELSE 'ai_general' END"


def _narrow(r: Rules, of: str) -> str:
    return f"({some([t for t in r.signal if t not in r.broad], of)} OR {word(r.words, of)})"


def _broad(r: Rules, of: str) -> str:
    return f"({some(r.broad, of)} OR {word(r.words + r.broad_words, of)})"


def _opening(r: Rules, r_of: str) -> list[tuple[str, str, str, str, str]]:
    unsafe = " OR ".join([f"regexp_matches(low, {quoted('|'.join(r.unsafe))})"] if r.unsafe else ["false"])
    promo = " + ".join(f"regexp_matches(low, {quoted(p)})::INT" for p in r.promo) or "0"
    opens = f"regexp_matches(trim({r_of}), {quoted('^(' + '|'.join(r.tutorial) + ')' + chr(92) + 'b')})" if r.tutorial else "false"
    return [
        (f"({unsafe}) OR {promo} >= 2", "0.0", "'unsafe_content'", "false", "'unsafe_promotional_content'"),
        (f"{opens} OR {some(r.tutorial_inside, r_of)}", "0.15", "'tutorial_excluded'", "false", "'tutorial_title_pattern'"),
    ]


def _general(r: Rules, prior: str) -> list[tuple[str, str, str, str, str]]:
    narrow, broad, tech, noise = _narrow(r, "low"), _broad(r, "low"), several(r.tech, "low"), several(r.noise + r.commerce, "low")
    keep = f"greatest(0.65, {prior} + CASE WHEN {narrow} THEN 0.52 ELSE 0.34 END + least(0.18, {several(r.signal, 'low')} * 0.04) + least(0.12, {tech} * 0.03) - least(0.18, {noise} * 0.04))"
    return [
        (f"NOT {narrow} AND NOT ({broad} AND {tech} > 0)", f"{prior} + CASE WHEN {broad} THEN 0.32 ELSE 0.0 END + CASE WHEN {tech} > 0 THEN 0.08 ELSE 0.0 END", "'not_ai'", "false", "'missing_meaningful_ai_signal'"),
        (f"{some(r.commerce, 'low')} AND NOT {narrow}", f"{prior} + 0.25", "'commerce_noise'", "false", "'commerce_noise_without_strong_ai_signal'"),
        (f"{noise} > 0 AND NOT {narrow}", f"{prior} + 0.25", "'noise'", "false", "'noise_without_strong_ai_signal'"),
        ("true", keep, _label(r, "low"), "true", f"CASE WHEN {narrow} THEN 'matched_ai_signal' ELSE 'matched_broad_ai_plus_tech_signal' END"),
    ]


def _case(rules: list[tuple], i: int) -> str:
    return "CASE " + " ".join(f"WHEN {x[0]} THEN {x[i]}" for x in rules) + " END"


def _columns(rules: list[tuple]) -> str:
    return f"round(greatest(0.0, least(1.0, {_case(rules, 1)}))::DOUBLE, 2) AS score, {_case(rules, 2)} AS label, {_case(rules, 3)} AS related, {_case(rules, 4)} AS reason"


def relevance(r: Rules, prior: str = "0.1") -> str:
    """score, label, related and reason of a row with the lower-cased text ``low``."""
    return _columns(_opening(r, "low") + _general(r, prior))


def site_relevance(r: Rules, s: Scope, prior: str = "0.1") -> str:
    """The same by the sites' rules: rows have site_id, lower-cased src, lt (title), host and low (all together)."""
    lab, trusted, titled, paper = some(s.media_research, "src"), some(s.media_trusted, "src"), _narrow(r, "lt"), some(s.research, "lt")
    tech, noise = several(r.tech, "low"), several(r.noise + r.commerce, "low")
    media = f"{prior} + CASE WHEN {trusted} THEN 0.58 ELSE 0.5 END + least(0.12, {several(r.signal, 'low')} * 0.03) + least(0.08, {tech} * 0.02)"
    media = f"(CASE WHEN {lab} THEN least({media}, 0.76) ELSE {media} END - CASE WHEN {noise} > 0 AND NOT {titled} THEN least(0.16, {noise} * 0.04) ELSE 0.0 END)"
    named = f"CASE WHEN {lab} OR {paper} THEN 'research_paper' WHEN {some(s.business, 'lt')} THEN 'industry_business' ELSE {_label(r, 'low')} END"
    domain = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in s.domains) or "false"
    drop = "'source_scope_drop'"
    rules = [
        (some(s.forwarded, "src"), "0.1", drop, "false", "'hn_forwarded_source_excluded'"),
        (domain, "0.1", drop, "false", "'aggregator_backdoor_domain_excluded'"),
        (f"site_id = '{s.hot_site}' AND contains(src, '{s.hot_source}')", f"greatest(0.65, {prior} + 0.62)", "'curated_hotlist'", "true", "'zeli_24h_hot_allowlist'"),
        (f"site_id = '{s.hot_site}'", "0.2", drop, "false", "'zeli_only_keeps_24h_hot_source'"),
        (f"site_id = '{s.board_site}' AND {some(s.board_block, 'src')}", "0.05", "'noise'", "false", "'tophub_blocked_channel'"),
        (f"site_id = '{s.board_site}' AND NOT {some(s.board_allow, 'src')}", "0.12", drop, "false", "'tophub_channel_not_in_allowlist'"),
        (f"site_id = '{s.media_site}' AND {lab} AND NOT {titled} AND NOT {paper}", "0.22", drop, "false", "'curated_research_source_requires_research_or_ai_title_signal'"),
        (f"site_id = '{s.media_site}' AND NOT {trusted} AND NOT {lab} AND NOT {titled} AND NOT ({_broad(r, 'lt')} AND {tech} > 0)", f"{prior} + CASE WHEN {_broad(r, 'lt')} THEN 0.28 ELSE 0.0 END", drop, "false", "'curated_media_requires_ai_title_or_trusted_ai_feed'"),
        (f"site_id = '{s.media_site}'", media, named, f"{media} >= 0.65", "'curated_media_source_filter'"),
        (f"site_id IN ({', '.join(map(quoted, s.trusted_sites))})", f"greatest(0.65, {prior} + 0.72)", _label(r, "low"), "true", "'trusted_ai_source_default_keep'"),
    ]
    return _columns(_opening(r, "lt") + rules + _general(r, prior))


def _holds(terms: list[str], words: list[str], of: str) -> str:
    return f"({some([t for t in terms if t not in words], of)} OR {word([t for t in terms if t in words], of)})"


def _together(groups, words: list[str], of: str, marks: str = r"[。！？.!?\n]+") -> str:
    return f"len(list_filter(regexp_split_to_array({of}, '{marks}'), lambda s: {' AND '.join(_holds(g, words, 's') for g in groups)})) > 0"


def events(e: Events, title: str = "title", summary: str = "summary", site: str = "site_id") -> str:
    """The list of event codes of a row."""
    plain = lambda x: f"translate(lower({x}), '{SIMPLIFIED}', '{TRADITIONAL}')"
    text, hits = plain(f"coalesce({title}, '') || ' ' || coalesce({summary}, '')"), []
    for name, terms in e.terms.items():
        hit = _holds(terms, e.words, text)
        if name in e.unless:
            weak, context = e.unless[name]
            hit += f" AND ({_holds([t for t in terms if t not in weak], e.words, text)} OR NOT {_together((weak, context), e.words, text)})"
        if name in e.together:
            hit = f"({hit} OR {_together(e.together[name], e.words, text)})"
        if name in e.exclude:
            hit = f"{hit} AND NOT {_holds(e.exclude[name], e.words, text)}"
        hits.append(f"CASE WHEN {hit} THEN '{name}' END")
    for name, groups in e.titled.items():
        hits.append(f"CASE WHEN {_together(groups, e.words, plain(f'coalesce({title}, {quoted(str())})'), r'[。！？；;.!?\n]+')} THEN '{name}' END")
    out = f"list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN coalesce({site}, '') IN ({', '.join(map(quoted, e.no_sites)) or quoted('?')}) THEN []::VARCHAR[] ELSE {out} END"
