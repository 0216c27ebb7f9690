"""Personal data by weak supervision (operator 9).

Base detectors find e-mail addresses, IPv4 addresses, card and phone numbers as their patterns say; these spans always stay. A wider
net finds further candidates: phone numbers without "+", spelled-out addresses, matches that fail a check, and secrets given by
name. Five labelers vote on each candidate (1 for, -1 against, 0 silent): the pattern's own check, a gazetteer (domain
endings, number ranges, names of secrets), the words before it, its shape, and its characters' variety.

The votes of all documents' candidates are counted by pattern, and expectation-maximisation estimates each labeler's reliability
and each pattern's probability of being personal data, kind by kind. A logistic classifier learns these probabilities from the
votes and the span's own figures, and a candidate that it gives 0.5 or more, and that overlaps no base span, is added.

The counts have one row for each combination of kind, votes and figures (under 100,000 possible), whatever the input. Null
text is read as empty: no spans. Positions count code points, ends exclusive. Rows that repeat a document count each time and get equal results; texts are
read whole, however long; an empty table gives an empty result, and a model without weights. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "gazetteer", "context", "shape", "variety")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Fixed values of the contract: the base patterns. A possessive or guarded form finds the same spans without retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The wider net.
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,5}")
_SECRET = re.compile(r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}([^\s,;]{6,})")

_NAME = re.compile(r"([a-z_-]+)[ \t]{0,3}[=:][ \t]{0,3}$")
# Endings of domains, words that announce a kind, names that mostly secrets have, and words that speak against numbers being personal.
ENDINGS = frozenset("com org net edu gov info io co us uk de fr es it eu example".split())
CUES = {
    "email": "mail email e-mail contact write address reach".split(),
    "ip": "ip host server address addr client from".split(),
    "card": "card visa mastercard credit payment account pay".split(),
    "phone": "phone tel call fax mobile cell contact telephone".split(),
    "secret": "password login user account credentials key".split(),
}
NAMES = frozenset("password passwd pwd secret apikey api_key api-key accesskey access_key access-key".split())
AGAINST = "version isbn order invoice build serial chapter section page figure total".split()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their @ signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        got = _DOMAIN.match(text, at + 1) if start < at else None
        if got:
            out.append((start, got.end()))
            done = got.end()
        at = text.find("@", max(at + 1, done))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the other candidates, both by kind and start."""
    base, more = [], []
    if "@" in text:
        base += [("email", *s) for s in emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            (base if passes(kind, m[0]) else more).append((kind, m.start(), m.end()))
    # short runs of digits are no candidates: only those that come near the base form
    more = [s for s in more if s[0] == "ip" or len(_digits(text[s[1] : s[2]])) >= (12 if s[0] == "card" else 8)]
    more += [("phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    if "at]" in text or "at)" in text:
        more += [("email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if "=" in text or ":" in text:
        more += [("secret", m.start(2), m.end(2)) for m in _SECRET.finditer(text)]
    return base, sorted(set(more), key=lambda s: (KINDS.index(s[0]), s[1]))


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    n = _digits(s)
    if kind == "card":
        return 13 <= len(n) <= 19 and luhn(n)
    return 9 <= len(n) <= 15


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    s, n = text[start:end], _digits(text[start:end])
    before = re.findall(r"[a-z-]+", text[max(0, start - 48) : start].lower())[-5:]
    pattern = 1 if base else 0 if kind in ("secret", "email") or kind == "phone" and s[0] != "+" else -1
    if kind == "email":
        gazetteer = 1 if re.split(r"[.\])( ]+", s.lower())[-1] in ENDINGS else 0
        shape = 1 if 6 <= len(s) <= 80 else -1
    elif kind == "ip":
        parts = s.split(".")
        gazetteer = -1 if parts[0].lstrip("0") == "" or parts[0] == "255" else 0
        shape = 1 if all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in parts) else -1
    elif kind == "card":
        gazetteer = 1 if n[:1] == "4" or n[:2] in ("34", "37", "51", "52", "53", "54", "55", "65") or n[:4] == "6011" else -1
        shape = 1 if len(n) in (15, 16) else 0 if 13 <= len(n) <= 19 else -1
    elif kind == "phone":
        gazetteer = 1 if s[:2] in ("+1", "+3", "+4") or len(n) == 10 and n[0] in "23456789" and n[3] in "23456789" else 0
        shape = 1 if len(n) in (10, 11, 12) and any(c in s for c in " .-(") else -1 if len(n) > 15 else 0
    else:
        name = _NAME.search(text[max(0, start - 24) : start].lower())
        gazetteer = 1 if name and name[1] in NAMES else 0
        shape = 1 if len(s) >= 8 and any(c.isdigit() for c in s) else -1
    context = 1 if any(w in CUES[kind] for w in before) else -1 if any(w in AGAINST for w in before) else 0
    each = [s.count(c) / len(s) for c in set(s)]
    bits = -sum(p * math.log2(p) for p in each)
    variety = 1 if bits >= 2.2 else -1 if bits < 1.5 else 0
    return pattern, gazetteer, context, shape, variety


def pattern_of(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """Kind, votes and figures (length in eights, whether other marks stand at its sides) as a key for counting."""
    v = "".join("-0+"[x + 1] for x in votes(text, kind, start, end, base))
    sides = "".join("b" if not c or c.isspace() else "w" if c.isalnum() else "m" for c in (text[start - 1 : start], text[end : end + 1]))
    return f"{KINDS.index(kind)}{v}{min(4, (end - start) // 8)}{sides}"


@dataclass
class SpanModel:
    weights: dict[str, float]
    reliability: dict[str, dict[str, float]]

    def probability(self, pattern: str) -> float:
        z = sum(self.weights.get(f, 0.0) for f in features(pattern))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(pattern: str) -> list[str]:
    kind = pattern[0]
    out = ["all", "kind" + kind, f"length{kind}{pattern[6]}", "sides" + pattern[7:]]
    return out + [f"vote{k}{c}" for k, c in enumerate(pattern[1:6])] + [f"vote{kind}{k}{c}" for k, c in enumerate(pattern[1:6])]


def aggregate(counts: dict[str, int], rounds: int = 30) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """P(personal) of every pattern and, by kind, the share of right votes of each labeler: two-class expectation-maximisation
    that starts from the votes' majority, with a prior that keeps each labeler better than chance."""
    p = {q: 1 / (1 + math.exp(-sum("-0+".index(c) - 1 for c in q[1:6]))) for q in counts}
    reliability: dict[str, dict[str, float]] = {}
    for kind in {q[0] for q in counts}:
        mine = {q: n for q, n in counts.items() if q[0] == kind}
        for _ in range(rounds):
            total = sum(mine.values())
            prior = (sum(n * p[q] for q, n in mine.items()) + 1) / (total + 2)
            tables = []
            for k in range(len(LABELERS)):
                table = {}
                for y in (0, 1):
                    seen = {c: 1.0 for c in "-0+"}
                    seen["+" if y else "-"] += 3.0
                    for q, n in mine.items():
                        seen[q[1 + k]] += n * (p[q] if y else 1 - p[q])
                    table[y] = {c: v / sum(seen.values()) for c, v in seen.items()}
                tables.append(table)
            for q in mine:
                z = math.log(prior / (1 - prior)) + sum(math.log(t[1][c] / t[0][c]) for t, c in zip(tables, q[1:6], strict=True))
                p[q] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        reliability[KINDS[int(kind)]] = {name: _right(t, prior) for name, t in zip(LABELERS, tables, strict=True)}
    return p, reliability


def _right(table: dict[int, dict[str, float]], prior: float) -> float:
    """The share of right votes of those that a labeler casts: silence is none."""
    right = table[1]["+"] * prior + table[0]["-"] * (1 - prior)
    return right / (right + table[1]["-"] * prior + table[0]["+"] * (1 - prior))


def train(counts: dict[str, int], steps: int = 300, rate: float = 0.5, l2: float = 1e-3) -> SpanModel:
    soft, reliability = aggregate(counts)
    patterns = sorted(counts)
    if not patterns:
        return SpanModel({}, {})
    names = sorted({f for q in patterns for f in features(q)})
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for i, q in enumerate(patterns):
        x[i, [at[f] for f in features(q)]] = 1
    y = np.array([soft[q] for q in patterns])
    n = np.log1p(np.array([counts[q] for q in patterns], float))
    n /= n.sum()
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(steps):
        g = x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + l2 * w / len(names)
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return SpanModel(dict(zip(names, w.tolist(), strict=True)), reliability)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def count_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen: dict[str, int] = {}
            for text in common.pylist(batch, "text"):
                base, more = spans(text)
                for is_base, found in ((True, base), (False, more)):
                    for s in found:
                        q = pattern_of(text, *s, is_base)
                        seen[q] = seen.get(q, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    found = _texts(docs, id_col, text_col).select("text").mapInArrow(run, "pattern string, n long")
    return {r["pattern"]: r["n"] for r in found.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: counts of base spans by kind, their digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for text in common.pylist(batch, "text"):
                base, more = spans(text)
                taken = sorted((a, b) for _, a, b in base)
                added = []
                for s in more:
                    q = pattern_of(text, *s, False)
                    if q not in known:
                        known[q] = shared.value.probability(q) >= threshold
                    if known[q] and all(s[2] <= a or b <= s[1] for a, b in taken):
                        added.append(s)
                        taken.append((s[1], s[2]))
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(count_patterns(docs)))
