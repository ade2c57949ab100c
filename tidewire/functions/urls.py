"""URL identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.plans.dims import TRACKING

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, group)


def _written(value: Column) -> Column:
    """A parameter's name or value read and written as forms do: a space as +, unreserved characters plain."""
    read = F.coalesce(F.try_url_decode(value), value)
    return F.replace(F.replace(F.url_encode(read), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _rebuilt(url: Column, keep) -> Column:
    key = lambda p: F.lower(F.element_at(F.split(p, "="), 1))
    params = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & keep(key(p)))
    at = lambda p: F.locate("=", p)
    pair = lambda p: F.when(at(p) > 0, F.concat(_written(F.substring_index(p, "=", 1)), F.lit("="), _written(F.substr(p, at(p) + 1)))).otherwise(F.concat(_written(p), F.lit("=")))
    query = F.array_join(F.transform(params, pair), "&")
    whole = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), _part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(_part(url, 1) != "", F.rtrim(whole, F.lit("/"))).otherwise(F.trim(url))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host; without fragment, tracking parameters and trailing slashes; parameters written anew,
    so that one value has one form. Text without a scheme is only trimmed."""
    return _rebuilt(url, lambda k: ~k.startswith("utm_") & ~k.isin(TRACKING))


def canonical_url(url: Column) -> Column:
    """The normalised URL with only the parameters that identify a page."""
    return _rebuilt(url, lambda k: k.isin("id", "item", "p"))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def item_id(site: Column, source: Column, title: Column, url: Column) -> Column:
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.sha1(F.concat_ws("||", text(site), text(source), text(title), normalize_url(F.coalesce(url, F.lit("")))).cast("binary"))


def story_id(url: Column, title: Column, key: Column) -> Column:
    first = F.coalesce(F.nullif(canonical_url(F.coalesce(url, F.lit(""))), F.lit("")), F.nullif(title, F.lit("")), key.cast("string"))
    return F.concat(F.lit("story_"), F.substring(F.sha1(first.cast("binary")), 1, 12))
