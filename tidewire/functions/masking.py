"""Names that a conversion must leave alone, and conversion by a table of phrases; all by longest match from the left."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.times import bound

#: Opens and closes a placeholder; in a text the opening mark is doubled up with a letter first, so that all is reversible.
OPEN, CLOSE, PLAIN = "⟦", "⟧", "⟦p"


def alternation(terms: list[str]) -> str:
    """A pattern that finds the longest of the terms that begins first; ``terms`` are plain strings."""
    return "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)) if t)


def mask(text: Column, names: list[str]) -> Column:
    """struct(masked, held): ``text`` with ⟦0⟧, ⟦1⟧, ... in place of its names, and the names in order.

    A null text stays null. A service may move placeholders, but must keep them whole.
    """
    safe = F.replace(text, F.lit(OPEN), F.lit(PLAIN))
    pattern = f"({alternation(names)})" if any(names) else "((?!))"
    held = F.regexp_extract_all(safe, F.lit(pattern), 1)

    def marked(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p)), "")

    masked = bound(F.split(safe, pattern, -1), marked)
    return F.when(text.isNotNull(), F.struct(masked.alias("masked"), held.alias("held")))


def restore(masked: Column, held: Column) -> Column:
    """The text with its names again, wherever their placeholders stand by now; unknown placeholders stay."""
    def read(s: Column) -> Column:
        pieces = F.regexp_extract_all(s["masked"], F.lit(rf"(?s)({OPEN}[0-9]+{CLOSE}|{PLAIN}|.)"), 1)
        number = lambda p: F.regexp_extract(p, rf"^{OPEN}([0-9]+){CLOSE}$", 1).try_cast("int")
        name = lambda p: F.coalesce(F.get(s["held"], number(p)), p)
        return F.array_join(F.transform(pieces, lambda p: F.when(p == PLAIN, OPEN).when(F.startswith(p, F.lit(OPEN)), name(p)).otherwise(p)), "")

    return bound(F.struct(masked.alias("masked"), held.alias("held")), read)


def converted(text: Column, phrases: dict[str, str], names: list[str] | None = None) -> Column:
    """``text`` with every phrase of the table rewritten, but for ``names``: of all that begin first the longest wins, a
    name before an equal phrase; rewritten text is not read again. The table is part of the plan, so keep it to some
    thousand entries."""
    kept = {n: n for n in names or []}
    table = {k: v for k, v in phrases.items() if k} | kept
    if not table:
        return text
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)({alternation(list(table))}|.)"), 1)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(known, p), p)), "")


def converted_around_names(text: Column, phrases: dict[str, str], names: list[str]) -> Column:
    """The same by way of placeholders, as for a service that converts whole texts: mask, convert, restore."""
    both = mask(text, names)
    return restore(converted(both["masked"], phrases), both["held"])
