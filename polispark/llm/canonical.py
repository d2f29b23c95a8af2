"""Free entries mapped to a canonical list.

Canonical labels and their aliases form one multi-pattern automaton per kind. The longest of the non-overlapping mentions that it
finds in a value wins, however much of the value it covers, which is its confidence; a value without any goes to the token-set similarity, whose tokens
may be misspelt or abbreviated. What reaches neither stays unmatched. Only distinct values are looked at. A list of up to MAX_ENTRIES phrases goes to
every task; a longer one is cut into shards, and blocks of values meet each shard in a task of their own.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polispark.operators.skew import skew_join
from polispark.session import durable

#: Phrases (labels and aliases) that are broadcast to every task, that a shard of a longer list holds, and values of a block that meets a shard.
MAX_ENTRIES = SHARD_ROWS = BLOCK_ROWS = 100_000
#: The least token-set similarity, and the one from which a whole value is a phrase with slips.
SIMILAR, MISSPELT = 0.75, 0.9

#: Other spellings of single words.
SPELLINGS = {"employees": ("employes",), "holdings": ("holding",), "cooperative": ("coop",), "university": ("u",)}
#: Words that carry no meaning here.
STOP = {"and", "of", "the", "for", "at", "inc", "incorporated", "co", "company", "corp", "corporation", "llc"}


def clean(value: str) -> str:
    """Lower case without accents, apostrophes, punctuation, numbering in brackets and blanks in a row."""
    s = "".join(c for c in unicodedata.normalize("NFD", value.lower()) if unicodedata.category(c) != "Mn")
    s = re.sub(r"\(\d+\)\s*$", "", s.strip()).replace("&", " and ")
    s = " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub(r"['’.](?=[a-z])|(?<=[a-z])['’]", "", s)).split())
    s = re.sub(r"\b([a-z]) (?=[a-z]\b)", r"\1", s)  # letters that stand alone make one word
    return re.sub(r"\bco op\b", "coop", s)


def tokens(phrase: str) -> list[str]:
    return [t for t in phrase.split() if t not in STOP] or phrase.split()


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours at most turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1:]
    return a[i + 1:] == b[i + 1:] or (a[i: i + 2] == b[i: i + 2][::-1] and a[i + 2:] == b[i + 2:])


def slips(word: str) -> set[str]:
    """The word and what is left of it without one letter: words one slip apart share one of these."""
    return {word} | {word[:i] + word[i + 1:] for i in range(len(word))}


def abbreviates(short: str, word: str) -> bool:
    """Whether short starts as word does and its letters follow in order: dntl, dent, engg."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short)


@functools.lru_cache(maxsize=500_000)
def token_likeness(t: str, u: str) -> float:
    """t as typed, u as in the list."""
    if t == u:
        return 1.0
    if min(len(t), len(u)) >= 3 and max(len(t), len(u)) >= 4 and one_slip(t, u):
        return 0.92
    if abbreviates(t, u) or t in SPELLINGS.get(u, ()):
        return 0.9
    if any(len(v) >= 3 and len(t) >= 4 and one_slip(t, v) for v in SPELLINGS.get(u, ())):
        return 0.85
    if len(t) >= 4 and any(abbreviates(t[:i] + t[i + 1:], u) for i in range(1, len(t))):
        return 0.8
    return 0.0


class Matcher:
    """The automaton and the indexes of one kind's phrases: (entry_id, text, whether it is the label)."""

    def __init__(self, entries: list[tuple[int, str, bool]]):
        self.automaton, self.phrases = ahocorasick.Automaton(), []
        self.by_token, self.by_whole = defaultdict(set), defaultdict(set)
        seen: dict[str, int] = {}
        for entry, text, own in sorted(entries, key=lambda e: (e[0], not e[2], e[1])):
            phrase = phrase_of(text)
            if not phrase or phrase in seen:
                continue
            seen[phrase] = at = len(self.phrases)
            self.phrases.append((entry, phrase.split(), own))
            self.automaton.add_word(f" {phrase} ", (at, len(phrase)))
            for t in phrase.split():
                for v in slips(t) if len(t) >= 4 else {t}:
                    self.by_token[v].add(at)
            whole = phrase.replace(" ", "")
            for v in slips(whole) if len(whole) >= 5 else {whole}:
                self.by_whole[v].add(at)
        self.vocabulary = {t for _, phrase, _ in self.phrases for t in phrase}
        if self.phrases:
            self.automaton.make_automaton()

    def mention(self, text: str) -> tuple[int, int, int] | None:
        """(length, first character, phrase) of the longest mention in a text, the leftmost of several: nothing that overlaps it is longer."""
        found = ((n, -(end - n - 1), at) for end, (at, n) in self.automaton.iter(f" {text} ")) if self.phrases else ()
        best = max(found, default=None)
        return best and (best[0], -best[1], best[2])

    def similar(self, words: list[str]) -> tuple[int, float]:
        near: set[int] = set()
        whole = "".join(words)
        for v in slips(whole) if len(whole) >= 5 else {whole}:
            near |= self.by_whole.get(v, set())
        for t in words:
            for v in slips(t) if len(t) >= 4 else {t}:
                near |= self.by_token.get(v, set())
        best, top = 0, 0.0
        for at in sorted(near):
            entry, phrase, own = self.phrases[at]
            pairs = sorted(((token_likeness(t, u), i, j) for i, t in enumerate(words) for j, u in enumerate(phrase)), reverse=True)
            used_t, used_u, total = set(), set(), 0.0
            for x, i, j in pairs:
                if x > 0 and i not in used_t and j not in used_u:
                    used_t.add(i)
                    used_u.add(j)
                    total += x
            score = total / (len(words) + len(phrase) - len(used_t))
            joined = "".join(phrase)
            if len(whole) >= 5 and len(joined) >= 5 and one_slip(whole, joined):
                score = max(score, 0.9)
            score += 0.001 * own
            if score > top:
                best, top = entry, score
        return best, top

    def look(self, words: list[str]) -> tuple[int, int, int, float, int, float]:
        """Length, first character, entry and coverage of the longest mention, and entry and score of the most similar phrase (unless
        the mention is all of the value)."""
        if not words or not self.phrases:
            return 0, 0, 0, 0.0, 0, 0.0
        text = " ".join(words)
        found = self.mention(text)
        if not found:
            return 0, 0, 0, 0.0, *self.similar(words)
        n, start, at = found
        return n, start, self.phrases[at][0], n / len(text), *((0, 0.0) if n == len(text) else self.similar(words))

    def match(self, value: str) -> tuple[int, float, str]:
        """Entry (0 if none), confidence, and the way: mention, similarity or none."""
        return decided(*self.look(merge(tokens(clean(value)), self.vocabulary)))


def phrase_of(text: str) -> str:
    return " ".join(tokens(clean(text)))


def decided(n: int, start: int, entry: int, cover: float, alike: int, score: float) -> tuple[int, float, str]:
    """A mention wins, but where it is a part of a longer phrase that the whole value misspells (animl doctor), that one is the longer mention."""
    score = min(score, 1.0)
    if n and not (score >= MISSPELT and score > cover):
        return entry, cover, "mention"
    return (alike, score, "similarity") if score >= SIMILAR else (0, score, "none")


def merge(words: list[str], vocabulary: set[str] | frozenset[str]) -> list[str]:
    """Words of the list that were typed in two, or together with "and"; a misspelt "and" is left out."""
    split: list[str] = []
    for w in words:
        if w not in vocabulary and len(words) + len(split) > 1:
            if 1 < len(w) < 5 and set(w) <= set("and") and one_slip(w, "and"):
                continue
            ends = [(w[:-3], w.endswith("and")), (w[3:], w.startswith("and"))]
            w = next((x for x, there in ends if there and x in vocabulary), w)
        split.append(w)
    out: list[str] = []
    for w in split:
        if out and out[-1] + w in vocabulary and out[-1] not in vocabulary:
            out[-1] += w
        else:
            out.append(w)
    return out or words


def _asked(words: list[str]) -> set[str]:
    """The words that merge() may look up, whatever it finds: parts without "and", and neighbours in a row."""
    parts = [x for w in words for x in (w, w[:-3], w[3:])]
    longest = 1 + max(map(len, words), default=0)
    rows = set()
    for i in range(len(words)):
        row = ""
        for w in words[i : i + 4]:
            row += w
            if len(row) > 4 * longest:
                break
            rows.add(row)
    return {*parts, *rows} - {""}


def phrases(entries: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """entry_id, kind, text, own of labels and of the aliases (kind, label, alias) of those labels; incomplete rows are left out."""
    got = entries.select("entry_id", "kind", F.col("label").alias("text")).dropna()
    out = got.withColumn("own", F.lit(True))
    if aliases is not None:
        more = aliases.select("kind", F.col("label").alias("text"), "alias").dropna()
        out = out.unionByName(got.join(more, ["kind", "text"]).select("entry_id", "kind", F.col("alias").alias("text"), F.lit(False).alias("own")))
    return out.distinct()


_RESULT = "kind string, raw_value string, entry_id bigint, confidence double, way string"


def map_values(values: DataFrame, entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """values (kind, raw_value) -> kind, raw_value, entry_id, confidence, way: one row per distinct value that is not null.

    entries: entry_id, kind, label; aliases: kind, label, alias. entry_id is 0 where nothing is meant, as for an empty or blank value, or a kind without
    entries. Ties go to the leftmost mention, to the label before an alias, then to the smallest entry_id.
    """
    distinct = values.select("kind", "raw_value").where(F.col("raw_value").isNotNull()).distinct()
    spark = values.sparkSession
    listed = durable(phrases(entries, aliases), "phrases")
    rows = listed.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        return _in_shards(distinct, listed)
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r.kind].append((r.entry_id, r.text, r.own))
    shared = spark.sparkContext.broadcast(dict(by))  # MAX_ENTRIES phrases at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Matcher] = {}
        for pdf in batches:
            out = []
            for kind, value in zip(pdf["kind"], pdf["raw_value"]):
                if kind not in made:
                    made[kind] = Matcher(shared.value.get(kind, []))
                out.append((kind, value, *made[kind].match(value)))
            yield pd.DataFrame(out, columns=["kind", "raw_value", "entry_id", "confidence", "way"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    return distinct.repartition(tasks, "raw_value").mapInPandas(run, _RESULT)


def _in_shards(distinct: DataFrame, listed: DataFrame) -> DataFrame:
    """map_values for a list of any length: every block of values meets every shard of phrases, and the best of all shards wins.

    Which words the list knows is looked up by a join first, so that a value is cut into words as with one automaton.
    """
    n_values, n_phrases = distinct.count(), listed.count()
    shards, blocks = max(1, math.ceil(n_phrases / SHARD_ROWS)), max(1, math.ceil(n_values / BLOCK_ROWS))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, v, w) for k, v in zip(pdf["kind"], pdf["raw_value"]) for w in _asked(tokens(clean(v)))], columns=["kind", "raw_value", "word"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, w) for k, t in zip(pdf["kind"], pdf["text"]) for w in phrase_of(t).split()], columns=["kind", "word"])

    words = durable(distinct.mapInPandas(asked, "kind string, raw_value string, word string"), "asked")
    known = skew_join(words, listed.select("kind", "text").mapInPandas(parts, "kind string, word string").distinct(), ["kind", "word"], "left_semi")
    known = known.groupBy("kind", "raw_value").agg(F.collect_set("word").alias("known"))  # words of one value
    values = distinct.join(known, ["kind", "raw_value"], "left").withColumn("block", F.pmod(F.xxhash64("kind", "raw_value"), F.lit(blocks)))
    values = values.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = listed.withColumn("shard", F.pmod(F.xxhash64("kind", "entry_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = {k: Matcher(list(zip(g["entry_id"], g["text"], g["own"]))) for k, g in right.groupby("kind")} if len(right) else {}
        none, out = Matcher([]), []
        for kind, value, known in zip(left["kind"], left["raw_value"], left["known"]):
            out.append((kind, value, *made.get(kind, none).look(merge(tokens(clean(value)), frozenset(() if known is None else known)))))
        return pd.DataFrame(out, columns=["kind", "raw_value", "n", "start", "entry", "cover", "alike", "score"])

    seen = values.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(meet, "kind string, raw_value string, n int, start int, entry bigint, cover double, alike bigint, score double")
    best = seen.groupBy("kind", "raw_value").agg(F.max(F.struct("n", (-F.col("start")).alias("left"), (-F.col("entry")).alias("least"), "cover")).alias("m"), F.max(F.struct("score", (-F.col("alike")).alias("least"))).alias("s"))
    score = F.least(F.col("s.score"), F.lit(1.0))
    met, alike = (F.col("m.n") > 0) & ~((score >= MISSPELT) & (score > F.col("m.cover"))), score >= SIMILAR
    entry = F.when(met, -F.col("m.least")).when(alike, -F.col("s.least")).otherwise(0)
    return best.select("kind", "raw_value", entry.alias("entry_id"), F.when(met, F.col("m.cover")).otherwise(score).alias("confidence"), F.when(met, "mention").when(alike, "similarity").otherwise("none").alias("way"))
