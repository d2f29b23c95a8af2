"""Languages of documents and of passages, by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over all
ways of cutting it into pieces, which a forward pass computes for all languages at once; so no particular segmentation,
and no trained tokenizer, matters. The piece probabilities are learnt by expectation maximisation from a bounded sample
of labelled documents, whose sentences are labelled anew by the model once, because labels can be wrong.

A document is a sequence of words of any script. A Viterbi pass over it finds the passages: changing the language costs little between
sentences and much within one. One more class, OTHER, gives every piece of the vocabulary the same small probability; what it
explains better than every language that was learnt is in none of them.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default file of the vocabulary, the same path on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bounds of the training sample: documents, and characters of one of them.
TRAIN_DOCS, TRAIN_CHARS = 4000, 20_000
#: Rounds of labelling anew, iterations in each, and the share of the pooled distribution in each language's.
ROUNDS, ITERATIONS, POOLED = 2, 2, 0.05
#: Cost, in nats, of changing the language between sentences and within one.
BETWEEN, WITHIN = 3.0, 10.0
#: A passage counts as a whole sentence from so many words (two Han characters make a word) and nats of evidence.
MIN_WORDS, MIN_NATS = 5, 20.0
#: Code of what is in no language that was learnt, and by how many nats a piece is less likely there than under a uniform distribution.
OTHER, DISCOUNT = "und", 2.0
#: Bytes of a word from which its forward pass runs on logarithms, as products would vanish.
LOG_BYTES = 64

LANGUAGES = ("de", "en", "es", "fr", "it", "pt", "ru", "zh")
#: Notations of the languages besides the two-letter codes.
NAMES = {
    "de": ("deu", "ger", "german", "deutsch"), "en": ("eng", "english"), "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"), "it": ("ita", "italian", "italiano"),
    "pt": ("por", "portuguese", "português", "portugues"), "ru": ("rus", "russian", "русский"), "zh": ("zho", "chi", "cmn", "chinese", "mandarin", "中文"),
}
_NAMED = {n: k for k, v in NAMES.items() for n in (k, *v)}

_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&#?[0-9a-zA-Z]{1,12};|https?://\S+|\S+@\S+")
#: A word, or the end of a sentence.
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*|[.!?…]+(?=\s|$)|[。!?;\r\n\x00]")
#: Scripts written without blanks: two of their characters make a word.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003134f]")


def label_language(label: str | None) -> str | None:
    """The language that a label names (code, name or region variant), None if it names none of LANGUAGES."""
    if not label:
        return None
    s = label.strip().lower()
    return _NAMED.get(s) or _NAMED.get(re.split(r"[-_ (]", s)[0])


def tokens(text: str | None) -> tuple[list[str], list[int]]:
    """Words in lower case, of any script and length, and the place of the first word of each sentence; numbers, markup and addresses are left out."""
    if not text:
        return [], []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "<" in text or "&" in text or "@" in text or "://" in text:
        text = _MARKUP.sub("\x00", text)
    words: list[str] = []
    starts: list[int] = []
    fresh = True
    for w in _TOKEN.findall(text.lower()):
        if w[0].isalpha():
            if fresh:
                starts.append(len(words))
                fresh = False
            words.append(w)
        else:
            fresh = True
    return words, starts


def sentences(text: str | None) -> list[list[str]]:
    words, starts = tokens(text)
    return [words[i:j] for i, j in zip(starts, [*starts[1:], len(words)])]


def n_words(w: str) -> float:
    return len(w) / 2 if _DENSE.match(w) else 1.0


class Vocabulary(dict):
    """Pieces -> numbers, and all beginnings of pieces."""

    def __init__(self, found):
        super().__init__(found)
        self.beginnings = {p[:i] for p in self for i in range(1, len(p) + 1)}


@functools.lru_cache(maxsize=2)
def pieces(path: str = VOCABULARY) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def lattice(word: str, vocab: dict[bytes, int]) -> tuple[int, list[tuple[int, int, int]]]:
    """Length in bytes and the edges (from, to, piece) of all segmentations, in the order of their beginnings. From each byte on, pieces are
    followed as long as some piece begins so."""
    if not isinstance(vocab, Vocabulary):
        vocab = Vocabulary(vocab)
    b = word.encode("utf-8") if _DENSE.match(word) else b" " + word.encode("utf-8")
    edges, get, beginnings, n = [], vocab.get, vocab.beginnings, len(b)
    for i in range(n):
        for j in range(i + 1, n + 1):
            piece = b[i:j]
            if piece not in beginnings:
                break
            p = get(piece)
            if p is not None:
                edges.append((i, j, p))
    return n, edges


def forward(n: int, edges: list[tuple[int, int, int]], prob: np.ndarray) -> np.ndarray:
    """[n + 1, languages]: probability of each prefix, summed over its segmentations."""
    a = np.zeros((n + 1, prob.shape[1]))
    a[0] = 1.0
    for i, j, p in edges:
        a[j] += a[i] * prob[p]
    return a


def forward_log(n: int, edges: list[tuple[int, int, int]], prob: np.ndarray) -> np.ndarray:
    """The logarithms of forward()."""
    a = np.full((n + 1, prob.shape[1]), -np.inf)
    a[0] = 0.0
    for i, j, p in edges:
        a[j] = np.logaddexp(a[j], a[i] + np.log(prob[p]))
    return a


def log_word(word: str, vocab: dict[bytes, int], prob: np.ndarray) -> np.ndarray:
    n, edges = lattice(word, vocab)
    return np.log(np.maximum(forward(n, edges, prob)[n], 1e-300)) if n <= LOG_BYTES else forward_log(n, edges, prob)[n]


def _maximise(counts: dict[str, np.ndarray], prob: np.ndarray, vocab: dict[bytes, int], grids: dict) -> np.ndarray:
    """One expectation-maximisation step; counts: word -> occurrences per language."""
    soft = np.zeros_like(prob)
    for w, c in counts.items():
        if w not in grids:
            grids[w] = lattice(w, vocab)
        n, edges = grids[w]
        if n > LOG_BYTES:
            a = forward_log(n, edges, prob)
            b = np.full_like(a, -np.inf)
            b[n] = 0.0
            for i, j, p in reversed(edges):
                b[i] = np.logaddexp(b[i], np.log(prob[p]) + b[j])
            for i, j, p in edges:
                soft[p] += np.exp(a[i] + b[j] + np.log(prob[p]) - a[n]) * c
            continue
        a = forward(n, edges, prob)
        b = np.zeros_like(a)
        b[n] = 1.0
        for i, j, p in reversed(edges):
            b[i] += prob[p] * b[j]
        scale = c / np.maximum(a[n], 1e-300)
        for i, j, p in edges:
            soft[p] += a[i] * b[j] * prob[p] * scale
    return _mix(soft)


def with_other(prob: np.ndarray) -> np.ndarray:
    """The model with one more column, for OTHER."""
    return np.column_stack([prob, np.full(len(prob), np.exp(-DISCOUNT) / max(len(prob), 1))])


def _mix(soft: np.ndarray) -> np.ndarray:
    own = soft / np.maximum(soft.sum(0), 1.0)
    pooled = own.mean(1) + 1e-7
    pooled /= pooled.sum()
    return (1 - POOLED) * own + POOLED * pooled[:, None]


def _count(rows: list[tuple[int, list[str]]]) -> dict[str, np.ndarray]:
    """Counts of words and, at a third of the weight, of the words without their accents."""
    raw = Counter((w, k) for k, ws in rows for w in ws)
    out: dict[str, np.ndarray] = {}
    for (w, k), n in raw.items():
        bare = "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")
        for form, weight in ((w, n), (bare, n / 3)) if bare != w else ((w, n),):
            out.setdefault(form, np.zeros(len(LANGUAGES)))[k] += weight
    return out


def train(docs: list[tuple[str, str]], path: str = VOCABULARY) -> np.ndarray:
    """(text, language) of a sample -> [pieces, languages] probabilities. A language without a document keeps the pool."""
    vocab = pieces(path)
    own = [(LANGUAGES.index(k), s) for text, k in docs for s in sentences(text)]
    prob = None
    for _ in range(ROUNDS):
        if prob is not None:
            cache: dict[str, np.ndarray] = {}
            again = []
            for k, s in own:
                for w in s:
                    if w not in cache:
                        cache[w] = log_word(w, vocab, prob)
                score = sum(cache[w] for w in s)
                score[k] += 1.0
                again.append((int(np.argmax(score)), s))
            own = again
        counts = _count(own)
        grids: dict = {}
        if prob is None:
            flat = np.zeros((len(vocab), len(LANGUAGES)))
            for w, c in counts.items():
                grids[w] = lattice(w, vocab)
                for i, j, p in grids[w][1]:
                    flat[p] += c * (j - i) ** 2
            prob = _mix(flat)
        for _ in range(ITERATIONS):
            prob = _maximise(counts, prob, vocab, grids)
    return prob


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """At most TRAIN_DOCS labelled documents of at most TRAIN_CHARS characters, by the hash of their keys.

    Documents are counted first; then a range of hashes is read that holds about twice the sample, so that what reaches the
    driver does not grow with the corpus.
    """
    codes = F.udf(lambda x: label_language(x), "string")
    labels = docs.select(lang).where(F.col(lang).isNotNull()).distinct().select(F.col(lang).alias("_label"), codes(lang).alias("_lang")).where("_lang is not null")
    rows = docs.select(key, text, F.col(lang).alias("_label"), F.xxhash64(key).alias("_hash")).where(F.length(text).between(1, TRAIN_CHARS) & F.col(lang).isNotNull())
    n = rows.count()
    top = -(2**63) + int(2**64 * min(1.0, 2 * TRAIN_DOCS / max(n, 1))) - 1
    got = rows.where(F.col("_hash") <= F.lit(top)).join(labels, "_label").orderBy("_hash", key).limit(TRAIN_DOCS).select(text, "_lang").collect()
    return [(r[0], r[1]) for r in got]


class Scorer:
    """Log-likelihoods of words in all languages and in none of them, kept in rows of one matrix."""

    def __init__(self, prob: np.ndarray, path: str = VOCABULARY, most: int = 300_000):
        self.prob, self.vocab, self.most = with_other(prob), pieces(path), most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows, self.sizes = np.zeros((1024, len(LANGUAGES) + 1)), np.zeros(1024)

    def _add(self, w: str) -> int:
        i = self.at[w] = len(self.at)
        if i == len(self.sizes):
            self.rows, self.sizes = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.rows[i], self.sizes[i] = log_word(w, self.vocab, self.prob), n_words(w)
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.most:
            self.clear()
        get = self.at.get
        found = [get(w) for w in words]
        if None in found:
            found = [i if i is not None else get(w, -1) if get(w, -1) >= 0 else self._add(w) for i, w in zip(found, words)]
        return np.array(found, dtype=np.int64)


def passages(words: list[str], starts: list[int], scorer: Scorer) -> list[tuple[int, float, float, int, int]]:
    """Viterbi over a document -> (language, words, nats over the next best language, first and last sentence).

    A sentence is one unit where no best path can change the language within it, in others each word is one. A path that changes
    it there gains at most what the best single change gains, or, with more changes, what each word's best language gives; against it
    stands a path that keeps one language and changes at both borders. If the units all favour one language, that is the best path.
    """
    if not words:
        return []
    ids = scorer.ids(words)
    e, size = scorer.rows[ids], scorer.sizes[ids]
    first = np.array(starts)
    total, amount = np.add.reduceat(e, first), np.add.reduceat(size, first)
    ends = np.append(first[1:], len(ids))
    most = np.add.reduceat(e.max(1), first) - total.max(1)  # any number of changes
    open_ = (most > WITHIN - 2 * BETWEEN) & (ends - first > 1)
    if open_.any():  # one change gains no more than any number, so the finer bound is looked at here only
        so_far = np.cumsum(e, 0) - np.repeat(np.concatenate([np.zeros((1, e.shape[1])), np.cumsum(total, 0)[:-1]]), ends - first, 0)
        once = np.maximum.reduceat(so_far.max(1) + (np.repeat(total, ends - first, 0) - so_far).max(1), first) - total.max(1)
        open_ &= (once > WITHIN - 2 * BETWEEN) | (most > 2 * WITHIN - 2 * BETWEEN)
    if not open_.any():
        units, costs, sizes, where = total, np.full(len(first), BETWEEN), amount, np.arange(len(first))
        best = units.argmax(1)
        if (best == best[0]).all():
            return [_passage(units, sizes, where, int(best[0]), 0, len(units))]
    else:
        parts = [(e[i:j], size[i:j]) if o else (total[k: k + 1], amount[k: k + 1]) for k, (i, j, o) in enumerate(zip(first, ends, open_))]
        units, sizes = np.concatenate([u for u, _ in parts]), np.concatenate([z for _, z in parts])
        where = np.repeat(np.arange(len(parts)), [len(u) for u, _ in parts])
        costs = np.where(np.diff(where, prepend=-1) > 0, BETWEEN, WITHIN)
    v, back = units[0].copy(), []
    for u, cost in zip(units[1:], costs[1:]):
        k = int(v.argmax())
        move = v[k] - cost > v
        back.append((k, move))
        v = np.where(move, v[k] - cost, v) + u
    k = int(v.argmax())
    path = [k]
    for best, move in reversed(back):
        k = best if move[k] else k
        path.append(k)
    path.reverse()
    out, i = [], 0
    while i < len(path):
        j = i
        while j < len(path) and path[j] == path[i]:
            j += 1
        out.append(_passage(units, sizes, where, path[i], i, j))
        i = j
    return out


def _passage(units: np.ndarray, sizes: np.ndarray, where: np.ndarray, k: int, i: int, j: int) -> tuple[int, float, float, int, int]:
    total = units[i:j].sum(0)
    own = total[k]
    total[k] = -np.inf
    return k, float(sizes[i:j].sum()), float(own - total.max()), int(where[i]), int(where[j - 1])


_SEGMENTS = "lang string, words double, nats double, confidence double, first int, last int, seg int, whole boolean"


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str = VOCABULARY, labelled: DataFrame | None = None) -> DataFrame:
    """key, label_lang and, per passage: seg, lang, words, nats, confidence, first and last sentence, whole.

    The model is learnt from `labelled`, by default from docs themselves. lang is OTHER for passages in no language of the model.
    confidence is the posterior of the language against the next best one. whole is true if the passage holds at least one
    whole sentence by MIN_WORDS and MIN_NATS. Texts without words (null, empty, blank, symbols) have no passage; other
    columns are ignored; whole texts are read. Without any labelled document there is no model, hence no passage.
    """
    model = train(sample(docs if labelled is None else labelled, text, lang, key), path).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # pieces x languages, whatever the corpus holds
    kind = dict(docs.dtypes)[key]
    known = bool(model.std(1).max() > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, codes = Scorer(shared.value.astype(np.float64), path), (*LANGUAGES, OTHER)
        for pdf in batches:
            rows = []
            for k, t, label in zip(pdf["key"], pdf["text"], pdf["lang"]):
                if not known or not isinstance(t, str):
                    continue
                named = label_language(label if isinstance(label, str) else None)
                for n, (at, words, nats, first, last) in enumerate(passages(*tokens(t), scorer)):
                    whole = words >= MIN_WORDS and nats >= MIN_NATS
                    rows.append((k, named, codes[at], words, nats, 1 / (1 + np.exp(-min(nats, 50.0))), first, last, n, whole))
            yield pd.DataFrame(rows, columns=["key", "label_lang", "lang", "words", "nats", "confidence", "first", "last", "seg", "whole"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    got = rows.mapInPandas(run, f"key {kind}, label_lang string, {_SEGMENTS}")
    return got.withColumnRenamed("key", key)


def unnamed(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang of whole passages in a language that the document's label does not name; OTHER is no language."""
    return found.where(f"whole AND lang <> '{OTHER}' AND (label_lang IS NULL OR label_lang <> lang)").select(key, "lang").distinct()


def documents(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang, confidence, n_langs: the language of most words (ties: first by name) and its share of the words, weighed
    by the confidence of the passages."""
    per = found.groupBy(key, "lang").agg(F.sum("words").alias("w"), F.sum(F.col("words") * F.col("confidence")).alias("c"), F.max("whole").alias("whole"))
    return per.groupBy(key).agg(F.max_by("lang", F.struct("w", F.expr("-ascii(lang) * 256 - ascii(substring(lang, 2))"))).alias("lang"), (F.max_by("c", F.struct("w", F.expr("-ascii(lang) * 256 - ascii(substring(lang, 2))"))) / F.sum("w")).alias("confidence"), F.count_if("whole").alias("n_langs"))
