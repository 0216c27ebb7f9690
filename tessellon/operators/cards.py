"""Insight cards, the e-mail built of them, and its compliance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as tx
from tessellon.operators.retrieval import top_k
from tessellon.plans.session import staged

# Phrases that may not occur and their replacements, and the blocks that a mail must have.
PROHIBITED = ["guaranteed", "free money", "no strings attached", "risk-free", "100% safe"]
REPLACED = [("guaranteed", "designed to"), ("free money", "budget savings"), ("no strings attached", "no additional commitment")]
UNSUBSCRIBE = "You can unsubscribe at any time by replying 'unsubscribe'."
COMPANY = "Sent by ACME AI, 123 Market St, San Francisco, CA."
MAX_WORDS, MAX_GRADE = 160, 10
PREFERRED = ("press", "product", "dev_docs", "help_docs", "wiki")


def candidates(hits: DataFrame) -> DataFrame:
    """hits (session, place, chunk_id, doc_id, snippet, title, html_title, topic, final_url, url, publish_date, source_domain, text) to cards:
    each chunk once, by its first place."""
    once = F.row_number().over(Window.partitionBy("session", "chunk_id").orderBy("place")) == 1
    filled = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c))
    c = hits.withColumn("once", once).where("once").drop("once")
    return c.select(
        "session", "place", F.col("chunk_id").alias("id"), F.substring(F.coalesce(filled("title", "html_title", "topic"), F.lit("Insight")), 1, 120).alias("title"),
        F.substring(F.coalesce(filled("snippet", "text"), F.lit("")), 1, 320).alias("summary"), F.coalesce(filled("final_url", "url"), F.lit("")).alias("url"), F.coalesce("publish_date", F.lit("")).alias("date"),
        F.substring(F.coalesce("snippet", F.lit("")), 1, 320).alias("evidence_snippet"), F.lit(0.7).alias("confidence"), F.coalesce("source_domain", F.lit("")).alias("source_domain"), "doc_id",
    )


CARD = "session string, card_no int, id string, title string, summary string, url string, date string, evidence_snippet string, confidence double, source_domain string, doc_id string"


def _pick(cards: list[dict], spare: list[dict], size: int, domains: int) -> list[dict]:
    chosen: list[dict] = []
    for c in cards:
        seen = {x["source_domain"] for x in chosen}
        if len(chosen) < size and (c["source_domain"] not in seen or len(seen) < domains):
            chosen.append(c)
    have = {c["id"] for c in chosen}
    chosen += [c for c in cards if c["id"] not in have][: size - len(chosen)]
    for c in [*cards, *spare]:
        names = [x["source_domain"] for x in chosen]
        if len(set(names)) >= domains:
            break
        if not c["source_domain"] or c["source_domain"] in names:
            continue
        twice = next((i for i, n in enumerate(names) if names.count(n) > 1), None)
        if twice is not None:
            chosen[twice] = c
        elif len(chosen) < size and c["confidence"] < 0.7:
            chosen.append(c)
    return chosen


def _within_reach(cards: DataFrame, size: int, domains: int) -> DataFrame:
    """The cards of each session that `_pick` can take, staged: the first by place (of one id `size` at most), and the first of each domain, those of low
    confidence apart. Their number hangs on size and domains alone, however many hits a session has. Cards without a place stay."""
    low = (F.col("confidence") < 0.7).alias("_low")
    every = staged(cards.select("*", low, F.row_number().over(Window.partitionBy("session", "id").orderBy("place")).alias("_same")), "cards")
    known = every.where(F.col("place").isNotNull())
    first = top_k(known.where(F.col("_same") <= size), ["session"], [F.col("place"), F.col("id")], size * (size + 1), "_nth")
    heads = top_k(known, ["session", "source_domain", "_low"], [F.col("place"), F.col("id")], 1, "_nth")
    heads = top_k(heads, ["session", "_low"], [F.col("place"), F.col("id")], size + domains + 1, "_nth")
    return first.unionByName(heads).drop("_nth").dropDuplicates().unionByName(every.where(F.col("place").isNull())).drop("_low", "_same")


def select_cards(cards: DataFrame, docs: DataFrame, size: int = 5, domains: int = 4) -> DataFrame:
    """Up to `size` cards a session, from `domains` domains if can be: new domains first, then by place; a card of a repeated domain
    gives way to one of an unseen domain, if need be to a card made from a document of a preferred kind (the first by
    doc_id of each domain). Of a session's candidates only those within reach meet in a group; what is made from documents is one row for each domain."""
    cards = _within_reach(cards, size, domains)
    d = docs.where(F.lower("doctype").isin(*PREFERRED) & (F.coalesce("source_domain", F.lit("")) != ""))
    made = d.groupBy("source_domain").agg(F.min_by(F.struct("doc_id", "title", "url", "publish_date", "text"), "doc_id").alias("d")).select(
        F.concat(F.lit("synth::"), "d.doc_id", F.lit("::card")).alias("id"), F.substring(F.coalesce(F.nullif("d.title", F.lit("")), F.lit("Insight")), 1, 120).alias("title"), F.substring(F.coalesce("d.text", F.lit("")), 1, 320).alias("summary"),
        F.coalesce("d.url", F.lit("")).alias("url"), F.coalesce(F.col("d.publish_date").cast("string"), F.lit("")).alias("date"), F.col("source_domain"), F.col("d.doc_id").alias("doc_id"),
    )
    # at most `size` spare domains can be used in a session
    spare = made.orderBy("doc_id").limit(200).select("*", F.col("summary").alias("evidence_snippet"), F.lit(0.6).alias("confidence"))
    rows = spare.crossJoin(cards.select("session").distinct()).select("session", F.lit(None).cast("int").alias("place"), *[c for c in cards.columns if c not in ("session", "place")])
    every = cards.withColumn("place", F.col("place").cast("int")).unionByName(rows)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.place.notna()].sort_values("place").to_dict("records")
        chosen = _pick(own, pdf[pdf.place.isna()].sort_values("doc_id").to_dict("records"), size, domains)
        out = pd.DataFrame(chosen, columns=pdf.columns)
        out["card_no"] = range(1, len(out) + 1)
        return out[[c.split()[0] for c in CARD.split(", ")]]

    return every.groupBy("session").applyInPandas(one, CARD)


def flags(body: Column, unsubscribe: Column, company: Column, phrases=None, max_words: int = MAX_WORDS, max_grade: float = MAX_GRADE) -> list[Column]:
    """critical and warning: arrays of flags."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    b = F.coalesce(body, F.lit(""))
    claim = b.rlike(r"(?i)(?<![\p{L}\p{N}_])(\d+%(?=[\p{L}\p{N}_])|(double|guarantee|always|never)(?![\p{L}\p{N}_]))")
    critical = F.array_compact(F.array(
        F.when(blank(unsubscribe), "MISSING_UNSUBSCRIBE"), F.when(blank(company), "MISSING_COMPANY_INFO"), F.when(claim, "UNCITED_CLAIM"), F.when(tx.contains_any(F.lower(b), phrases or PROHIBITED), "PROHIBITED_PHRASE"),
    ))
    warning = F.array_compact(F.array(F.when(tx.word_count(b) > max_words, "EXCESS_LENGTH"), F.when(tx.readability_grade(b) > max_grade, "READABILITY")))
    return [critical.alias("critical"), warning.alias("warning")]


def _words(line: Column, k: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(line, r"\s+"), lambda w: w != ""), 1, k), " ")


def _is_bullet(line: Column) -> Column:
    return F.ltrim(line).startswith("- ")


def revised(body: Column, critical: Column, warning: Column, first_title: Column) -> Column:
    """One round of edits for the flags: replacements, a reference, three bullets at most, short lines."""
    b = F.coalesce(body, F.lit(""))
    replaced = b
    for old, new in REPLACED:
        replaced = F.replace(replaced, F.lit(old), F.lit(new))
    b = F.when(F.array_contains(critical, "PROHIBITED_PHRASE"), replaced).otherwise(b)
    b = F.when(F.array_contains(critical, "UNCITED_CLAIM") & first_title.isNotNull(), F.concat(b, F.lit("\n(Reference: "), F.substring(first_title, 1, 60), F.lit(")"))).otherwise(b)
    lines = F.split(b, "\n", -1)
    bullets = F.transform(F.slice(F.filter(lines, _is_bullet), 1, 3), lambda x: _words(x, 18))
    b = F.when(F.array_contains(warning, "EXCESS_LENGTH"), F.array_join(F.concat(F.filter(lines, lambda x: ~_is_bullet(x)), bullets), "\n")).otherwise(b)
    short = F.transform(F.filter(F.split(b, "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.when(_is_bullet(x), _words(x, 10)).otherwise(_words(x, 12)))
    return F.when(F.array_contains(warning, "READABILITY"), F.array_join(short, "\n")).otherwise(b)


def negotiate(mails: DataFrame, rounds: int = 2) -> DataFrame:
    """mails (body, unsubscribe_block, company_info_block, first_title) checked and revised up to `rounds` times, with the last flags."""
    m = mails
    for _ in range(rounds):
        m = m.withColumns(dict(zip(("critical", "warning"), flags(F.col("body"), F.col("unsubscribe_block"), F.col("company_info_block")), strict=True)))
        m = m.withColumn("body", revised(F.col("body"), F.col("critical"), F.col("warning"), F.col("first_title")))
        for column, flag, text in (("unsubscribe_block", "MISSING_UNSUBSCRIBE", UNSUBSCRIBE), ("company_info_block", "MISSING_COMPANY_INFO", COMPANY)):
            m = m.withColumn(column, F.when(F.array_contains("critical", flag), text).otherwise(F.col(column)))
    return m.withColumns(dict(zip(("critical", "warning"), flags(F.col("body"), F.col("unsubscribe_block"), F.col("company_info_block")), strict=True)))


def shortened(body: Column) -> Column:
    """Up to three passes while the text is over its length or grade: lines of ten words, three bullets of eight."""
    for _ in range(3):
        lines = F.split(body, "\n", -1)
        heads = F.filter(F.transform(F.filter(lines, lambda x: ~_is_bullet(x)), lambda x: _words(x, 10)), lambda x: x != "")
        bullets = F.transform(F.slice(F.filter(lines, _is_bullet), 1, 3), lambda x: F.concat(F.lit("- "), F.array_join(F.slice(F.filter(F.split(x, r"\s+"), lambda w: w != ""), 2, 8), " ")))
        again = (tx.readability_grade(body) > MAX_GRADE) | (tx.word_count(body) > MAX_WORDS)
        body = F.when(again, F.array_join(F.concat(heads, bullets), "\n")).otherwise(body)
    return body


def dangling(points: DataFrame, cards: DataFrame) -> DataFrame:
    """Proof points without their card."""
    return points.join(cards, ["session", "id"], "left_anti")
