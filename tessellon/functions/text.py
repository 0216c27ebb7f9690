"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
_EMPTY = "array<string>"

def _plain(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


#: Characters that Unicode's compatibility decomposition brings to one ASCII character, and to several.
_KNOWN = {c: d for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1F200))) if (d := _plain(c))}
ACCENTED = "".join(c for c, d in _KNOWN.items() if len(d) == 1)
PLAIN = "".join(d for d in _KNOWN.values() if len(d) == 1)
SEVERAL = {c: d for c, d in _KNOWN.items() if len(d) > 1}


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def sha1_8(c: Column) -> Column:
    return F.left(F.sha1(c), F.lit(8))


def slugify(c: Column, most: int = 80) -> Column:
    """Lower-case; runs of other characters become one hyphen; no hyphens at the ends; cut to `most`."""
    dashed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(most))


def words(c: Column) -> Column:
    """Unicode words."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def token_count(c: Column) -> Column:
    """Number of parts between white space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\s\p{Z}]+")).cast("long")


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(0))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct runs of k words, joined by blanks; none if there are fewer words."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        every = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " "))
        return F.when(n >= k, F.array_distinct(every)).otherwise(F.array().cast(_EMPTY))

    return let(tokens, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without duplicates; 0 for two empty ones."""
    every = lambda shared: F.size(a) + F.size(b) - shared
    return let(F.size(F.array_intersect(a, b)), lambda shared: F.when(every(shared) > 0, shared / every(shared)).otherwise(F.lit(0.0)))


def sentences(c: Column) -> Column:
    """Number of parts between runs of full stops and other end marks, blank parts left out; 1 at least."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "[.!?]+", -1), lambda s: F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " ")) != "")
    return F.greatest(F.size(parts), F.lit(1)).cast("long")


def readability_grade(c: Column) -> Column:
    """0.39 words/sentences + 11.8 syllables/words - 15.59; a word has as many syllables as vowel letters, 1 at least."""

    def grade(w: Column) -> Column:
        vowels = F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1), F.length(F.regexp_replace(x, "[^aeiouyAEIOUY]", ""))).cast("long"))
        n = F.greatest(F.size(w), F.lit(1))
        return F.lit(0.39) * (n / sentences(c)) + F.lit(11.8) * (F.greatest(vowels, F.lit(1)) / n) - F.lit(15.59)

    return let(words(c), grade)


def to_ascii(c: Column) -> Column:
    """Compatibility forms and accents to ASCII letters, other non-ASCII dropped."""
    several = F.create_map(*(F.lit(x) for pair in SEVERAL.items() for x in pair))
    long = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(several, x), x)), "")
    spelt_out = F.when(c.rlike(f"[{''.join(SEVERAL)}]"), long).otherwise(c)
    plain = F.regexp_replace(F.translate(spelt_out, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    # most texts are ASCII already, and the class of hundreds of characters is tried at every place of a text
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Lower case, then ASCII; hyphens and slashes to blanks, a run of digits to one 0, white space to one blank."""
    plain = to_ascii(F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[-/]", " "), "[0-9]+", "0"), r"\s+", " "))


def terms(c: Column) -> Column:
    """Tokens of 2 to 20 characters of the normalised text, then "bg:a_b" for neighbours."""

    def with_pairs(t: Column) -> Column:
        n = F.size(t)
        pairs = F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1), lambda a, b: F.concat(F.lit("bg:"), a, F.lit("_"), b))
        return F.when(n > 1, F.concat(t, pairs)).otherwise(t)

    return let(F.regexp_extract_all(normalize_text(c), F.lit("([a-z0-9]{2,20})"), F.lit(0)), with_pairs)


_TO_ASCII = str.maketrans(_KNOWN)
_DIGITS, _TOKEN = re.compile("[0-9]+"), re.compile("[a-z0-9]{2,20}")


def terms_of(low: str | None) -> list[str]:
    """`terms` of a text in lower case, for tasks that go on with the terms in Python."""
    low = low or ""
    if not low.isascii():
        low = low.translate(_TO_ASCII).encode("ascii", "ignore").decode()
    t = _TOKEN.findall(_DIGITS.sub("0", low))
    return t + [f"bg:{a}_{b}" for a, b in zip(t, t[1:])]


def contains_any(c: Column, keys: list[str]) -> Column:
    found = F.lit(False)
    for key in keys:
        found = found | c.contains(key)
    return found


def tags(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Names of the rules of which a key occurs in the text, in the rules' order."""
    return F.array_compact(F.array(*(F.when(contains_any(c, keys), F.lit(name)) for name, keys in rules)))


# Words left out of neighbouring chunks' similarity; these and the further ones are no key phrases.
STOP = (
    "the a an and or of for to in on by with from at as is are was were be been being this that those these it its their our your you "
    "we they i not no so if then than into out over under about above below after before during while up down off near far per via within without"
).split()
NO_PHRASES = [*STOP, *"data salesforce press release results fiscal quarter year revenue agentforce api".split()]


def keyphrases(title: Column, text: Column, stop: list[str] | None = None) -> Column:
    """The first four different words of four letters or more that the text holds, stop words left out; from the text alone if
    fewer than two are found."""
    avoid = F.array(*map(F.lit, stop or NO_PHRASES))

    def pick(low: Column) -> Column:
        raw = F.regexp_extract_all(F.concat_ws("\n", F.lower(F.coalesce(title, F.lit(""))), low), F.lit("([a-z0-9-]{4,})"), F.lit(0))
        bare = F.array_distinct(F.transform(raw, lambda w: F.regexp_replace(w, "^-+|-+$", "")))
        found = F.slice(F.filter(bare, lambda w: (F.length(w) >= 4) & ~F.array_contains(avoid, w) & F.contains(low, w)), 1, 4)
        more = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9]{4,})"), F.lit(0)), lambda w: ~F.array_contains(avoid, w))
        return let(found, lambda f: F.when(F.size(f) >= 2, f).otherwise(F.slice(F.array_distinct(F.concat(f, more)), 1, 2)))

    return let(F.lower(F.coalesce(text, F.lit(""))), pick)
