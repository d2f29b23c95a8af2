"""Column functions shared by the civic queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity, as floor(x + 0.5)."""
    return F.floor(c + 0.5)


def dollars(cents: Column) -> Column:
    return (cents / F.lit(100.0)).cast("double")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def donation_strength(cents: Column) -> Column:
    """0 up to $1,000, then a quarter per power of ten, 1 from $10 million; 0 for null, zero and negative amounts."""
    return F.when(cents > 0, clamp01(F.log10(cents / F.lit(100_000.0)) / 4)).otherwise(F.lit(0.0))


def us_fiscal_year(d: Column) -> Column:
    """FY of a date, which begins in October; 'Unknown' for null."""
    return F.when(d.isNull(), "Unknown").otherwise(F.concat(F.lit("FY"), F.year(F.add_months(d, 3)).cast("string")))


def coarse(x: Column) -> Column:
    """A coordinate rounded to two decimals, about a kilometre."""
    return half_up(x * 100) / 100


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of the words of a text, each padded by two blanks before and one behind, in lower case."""
    words = F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the trigrams; 0 where both have none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule whose regular expression is found in the lower-cased text."""
    low = F.lower(text)
    hit = F.coalesce(*[F.when(low.rlike(pattern), label) for label, pattern in rules])
    return F.coalesce(hit, F.lit(default)) if default is not None else hit


def all_matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of all rules whose regular expression is found in the lower-cased text, in the order of the rules."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(pattern), label) for label, pattern in rules]))


def rank_of(c: Column, order: list[str]) -> Column:
    """Position of a value in a declared order; values that are not in it come last."""
    return F.coalesce(*[F.when(c == v, i) for i, v in enumerate(order)], F.lit(len(order)))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct x, y; closed or not), by the parity of edges to its right.

    A null or empty ring holds nothing; points on an edge may fall on either side.
    """
    n = F.size(ring)
    at = lambda i: F.get(ring, i)

    def crossing(i):
        a, b = at(i), at((i + 1) % n)
        cuts = (a["y"] > y) != (b["y"] > y)
        right = x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(cuts & right, 1).otherwise(0)

    count = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crossing), F.lit(0), lambda s, v: s + v)
    return F.when(n >= 3, count % 2 == 1).otherwise(F.lit(False))


#: Keywords of up to so many characters must stand as words; longer ones may be part of one.
SHORT_WORD = 4
#: Rules that a table of keywords may have; its patterns are literals of the plan.
MAX_RULES = 5_000


def rules(table: DataFrame) -> list[tuple[str, str]]:
    """A table of rules (place, label, keyword) as (label, pattern) in the order of places, for first_match and all_matches.

    Labels without a keyword, and null or empty keywords, are left out. The table is counted before it is read.
    """
    rows = table.select("place", "label", F.lower("keyword").alias("keyword")).where("keyword <> ''").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.place, r.label, r.keyword)):
        word = re.sub(r"([^\w\s])", r"\\\1", r.keyword)
        out.setdefault(r.label, []).append(rf"\b{word}\b" if len(r.keyword) <= SHORT_WORD else word)
    return [(label, "|".join(words)) for label, words in out.items()]


def mapped(c: Column, codes: dict[str, str], default: str | None = None) -> Column:
    """A code by a map of codes, else the default."""
    got = F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)
    return F.coalesce(got, F.lit(default)) if default is not None else got


def compact_usd(cents: Column) -> Column:
    """$1.2B, $3.4M, $5K, else whole dollars with commas."""
    d = cents / F.lit(100.0)
    one = lambda size: F.format_string("%.1f", half_up(d / (size / 10)) / 10.0)
    whole = lambda x: F.format_number(half_up(x), 0)
    return (
        F.when(d >= 1e9, F.concat(F.lit("$"), one(1e9), F.lit("B"))).when(d >= 1e6, F.concat(F.lit("$"), one(1e6), F.lit("M"))).when(d >= 1e3, F.concat(F.lit("$"), half_up(d / 1e3).cast("string"), F.lit("K")))
        .when(d < 0, F.concat(F.lit("-$"), whole(-d))).otherwise(F.concat(F.lit("$"), whole(d)))
    )


def bytes_text(n: Column) -> Column:
    """A number of bytes in KB, MB, GB or TB of 1024."""
    parts = [(1 << 40, "TB", "%.1f"), (1 << 30, "GB", "%.1f"), (1 << 20, "MB", "%.1f")]
    out = F.concat(F.format_string("%.0f", n / 1024.0), F.lit(" KB"))
    for size, unit, form in reversed(parts):
        out = F.when(n >= size, F.concat(F.format_string(form, n / float(size)), F.lit(f" {unit}"))).otherwise(out)
    return out


def ago(at: Column, now: Column) -> Column:
    """How long an instant lies back: just now, minutes, hours, days, else month and day; Never for null."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    steps = F.when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).when(s < 86_400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
    return F.when(at.isNull(), "Never").otherwise(steps.when(s < 7 * 86_400, F.concat(F.floor(s / 86_400).cast("string"), F.lit("d ago"))).otherwise(F.date_format(at, "MMM d")))


def agent_class(agent: Column) -> Column:
    """bot, mobile, tablet or desktop of a user agent; bot where it names one, desktop where it says nothing."""
    low = F.lower(agent)
    return F.when(low.rlike("bot|crawl|spider|slurp|preview"), "bot").when(low.rlike("ipad|tablet"), "tablet").when(low.rlike("mobi|iphone|android"), "mobile").otherwise("desktop")


def stem(word: Column) -> Column:
    """A word without its usual English endings: rules, ruled and ruling are one."""
    w = F.regexp_replace(word, "(ies)$", "y")
    w = F.when(F.length(w) > 4, F.regexp_replace(w, "(ing|ed|es)$", "")).otherwise(w)
    return F.when(F.length(w) > 3, F.regexp_replace(w, "(?<!s)s$|e$", "")).otherwise(w)


def lexemes(c: Column) -> Column:
    """The stems of the words of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.transform(words, stem)
