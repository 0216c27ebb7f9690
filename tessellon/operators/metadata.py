"""Ids, titles, days, topics and other facts about documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions import dates, urls
from tessellon.functions import text as tx

# Topics, personas and their key words, in the order in which they are tried.
TOPICS = [
    ("Agentforce", ["agentforce"]),
    ("Agent API", ["agent api"]),
    ("Data Cloud", ["data cloud", "cdp", "unified profiles", "real-time data", "connections"]),
    ("Earnings", ["revenue", "gaap", "non-gaap", "guidance", "outlook", "q1 fy", "q2 fy", "full year", "results", "quarterly", "fiscal"]),
    ("Partnership", ["announce", "expanded", "partnership", "collaborate", "work with", "integration", "google", "aws", "slack", "mulesoft", "informatica", "ferrari"]),
    ("Executive", ["appoints", "chief executive", "chief operating", "president", "board of directors"]),
    ("Security", ["security", "zero trust", "governance"]),
    ("Compliance", ["compliance", "regulatory"]),
    ("GenAI", ["gen ai", "generative", "llm", "prompt"]),
    ("Industry Solutions", ["retail", "financial services", "healthcare", "communications"]),
    ("Platform", ["platform", "apis", "developer"]),
    ("AI", ["ai ", " ai", "artificial intelligence"]),
]
PERSONAS = [
    ("cio", ["data integration", "governance", "security", "tco", "platform", "apis", "real-time"]),
    ("vp_customer_experience", ["nps", "csat", "contact center", "omnichannel", "agent productivity", "self-service", "first contact resolution"]),
    ("vp_sales_ops", ["pipeline", "forecast accuracy", "win rate", "productivity", "automation"]),
]
FILINGS = ["10-k", "10-q", "8-k", "ars_pdf"]
REQUIRED = ["doc_id", "company", "doctype", "title", "publish_date", "url", "final_url", "source_domain", "section", "topic", "persona_tags", "language", "text", "word_count", "token_count", "ingestion_ts", "hash_sha256"]


def doc_id(prefix: Column, doctype: Column, day: Column, title: Column, url: Column) -> Column:
    """prefix::doctype::day or unknown::slug::first eight digits of the url's sha1."""
    return F.concat_ws("::", prefix, doctype, F.coalesce(day.cast("string"), F.lit("unknown")), tx.slugify(title), tx.sha1_8(url))


def id_part(c: Column, k: int) -> Column:
    return F.get(F.split(c, "::"), F.lit(k))


def parent_id(chunk_id: Column) -> Column:
    """A chunk id without its last part."""
    return F.regexp_replace(chunk_id, "::[^:]*$", "")


def haystack(title: Column, text: Column) -> Column:
    return F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def topics(title: Column, text: Column, rules=None) -> Column:
    return F.array_join(tx.tags(haystack(title, text), rules or TOPICS), "|")


def personas(title: Column, text: Column, rules=None) -> Column:
    return F.array_sort(tx.tags(haystack(title, text), rules or PERSONAS))


def pick_title(html_title: Column, title: Column, text: Column, visible: Column, slug: Column) -> Column:
    h1 = F.regexp_extract(text, r"(?im)^h1:[ \t]*(.+)$", 1)
    return F.coalesce(*map(tx.blank_to_null, (html_title, title, h1, visible)), F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))), F.lit(""))


def pick_day(doctype: Column, meta: Column, visible: Column, feed: Column, text: Column, modified: Column, fetched: Column, as_of: Column, old: Column) -> Column:
    """The day by kind of document; days out of bounds count as missing, and a missing day leaves the old one."""
    kind = F.lower(doctype)
    stated = dates.parse_day(F.regexp_extract(text, r"(?i)(?:Updated|Last\s*Updated|Last\s*modified)[:\s]+([A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}|\d{4}-\d{2}-\d{2})", 1))
    day = (
        F.when(kind.isin(FILINGS), F.coalesce(visible, fetched))
        .when(kind == "press", F.coalesce(dates.parse_day(meta), visible, feed))
        .when(kind.isin("product", "dev_docs", "help_docs"), F.coalesce(stated, dates.parse_day(modified), fetched))
        .when(kind == "wiki", dates.parse_day(modified))
    )
    return F.coalesce(dates.sane(day, as_of), old)


def recency_flags(day: Column, as_of: Column, press: Column) -> list[Column]:
    age = dates.age_days(day, as_of)
    return [F.when(press, age <= 365).alias("is_within_12mo"), F.when(press, age <= 730).alias("is_within_24mo")]


def in_window(day: Column, since: Column | None = None, until: Column | None = None) -> Column:
    """Days within the bounds; a missing day passes."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & (day >= since)
    if until is not None:
        ok = ok & (day <= until)
    return day.isNull() | ok


def missing_fields(row_fields: list[str], types: dict[str, str]) -> Column:
    """Names of the fields that are null or blank (empty, for arrays)."""
    gaps = []
    for name in row_fields:
        c = F.col(name)
        blank = c.isNull() | (F.trim(c) == "" if types[name] == "string" else F.size(c) == 0 if types[name].startswith("array") else F.lit(False))
        gaps.append(F.when(blank, F.lit(name)))
    return F.array_compact(F.array(*gaps))


def link_state(docs: DataFrame, roots: list[str]) -> DataFrame:
    """final_url, link_ok and status_code from what is saved, without the network. A sidecar that says 200 counts if the payload was saved
    too; its URL is then the final one. A final URL outside the allowlist gives way to the own URL if that is within, else to the
    sidecar's; such a link is ok. An answer of 200 without a payload isn't confirmed (0). Columns url, side_url, side_status and has_payload."""
    within = lambda c: F.coalesce(urls.in_domains(urls.bare_host(c), roots), F.lit(False))
    confirmed = F.coalesce((F.col("side_status") == 200) & F.col("has_payload"), F.lit(False))
    reached = F.when(confirmed, F.coalesce("side_url", "url")).otherwise(urls.strip_tracking(F.col("url")))
    stays, own, side = within(reached), within(F.col("url")), within(F.col("side_url"))
    final = F.when(stays, reached).when(own, urls.strip_tracking(F.col("url"))).when(side, urls.strip_tracking(F.col("side_url"))).otherwise(reached)
    status = F.when(confirmed, 200).otherwise(F.coalesce(F.when(F.col("side_status") != 200, F.col("side_status")), F.lit(0)))
    return docs.withColumns({"final_url": final, "link_ok": confirmed | (~stays & (own | side)), "status_code": status})


def inventory(docs: DataFrame) -> DataFrame:
    """Flat rows of dated documents; missing texts become empty, tags are joined by commas."""
    flat = []
    for name, kind in docs.dtypes:
        c = F.array_join(name, ",") if kind.startswith("array") else F.col(name)
        flat.append(F.coalesce(c, F.lit("")).alias(name) if kind == "string" or kind.startswith("array") else c.alias(name))
    return docs.where("publish_date is not null").select(*flat)


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Incremental intake: rows whose key isn't there yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def match_feed(pages: DataFrame, feed: DataFrame, url_col: str = "url", link_col: str = "link") -> DataFrame:
    """pages with their feed entry, by normalised URL; of several entries for one URL the first by link stays."""
    one = feed.groupBy(urls.feed_key(F.col(link_col)).alias("feed_key")).agg(F.min_by(F.struct(*feed.columns), link_col).alias("entry"))
    return pages.withColumn("feed_key", urls.feed_key(F.col(url_col))).join(one, "feed_key", "left")
