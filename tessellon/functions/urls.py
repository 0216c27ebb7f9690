"""URL functions. An unparsable URL gives null parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid"]


def authority(url: Column) -> Column:
    """Host with port, case kept; the empty string where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(authority(url))


def bare_host(url: Column) -> Column:
    """Host without port."""
    return F.regexp_replace(host(url), ":[0-9]*$", "")


def strip_tracking(url: Column, names: list[str] | None = None) -> Column:
    """Drops utm_* and other tracking parameters and keeps the rest in place, blank values included."""
    drop = F.array(*map(F.lit, names or TRACKING))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    name = lambda p: F.split(p, "=", 2).getItem(0)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~name(p).startswith("utm_") & ~F.array_contains(drop, name(p)))
    joined = F.array_join(kept, "&")
    return F.concat(base, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")), fragment)


def strip_link(url: Column) -> Column:
    """A link's URL without utm_*, gclid and fbclid, and without parameters that have no value."""
    base, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    parts = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&", -1)
    kept = F.filter(parts, lambda p: p.rlike("^[^=]*=.") & ~p.rlike("^(utm_|(gclid|fbclid)=)"))
    joined = F.array_join(kept, "&")
    return F.concat(base, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")), fragment)


def with_https(url: Column) -> Column:
    return F.regexp_replace(url, "^[A-Za-z]+:", "https:")


def feed_key(url: Column) -> Column:
    """https, without query, fragment, default page and closing slash: what matches a page with its feed entry."""
    bare = F.regexp_replace(with_https(url), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)/default\.aspx$", ""), r"([^/])/$", "$1")


def in_domains(h: Column, roots: list[str]) -> Column:
    """Whether a host is one of the roots or below one."""
    found = F.lit(False)
    for root in roots:
        found = found | (h == root) | h.endswith("." + root)
    return found
