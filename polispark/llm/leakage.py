"""Evaluation passages inside corpus documents, found by spaced-seed hashing.

Both sides are cut into words, and every window of SPAN words is hashed once per mask. A mask ignores fixed positions, so a
window with substituted words at ignored positions still meets its item. The hashes of the evaluation side are joined
with those of the corpus; a filter sized by the evaluation side lets the corpus side send only windows that may have a partner.
Each hit is verified on its words: the number of differing words in the window is the hit's `slips`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polispark.operators.skew import skew_join
from polispark.session import durable

#: Words of a window: the shortest passage that counts.
SPAN = 10
#: Fixed masks; 0 is an ignored position. Every position is ignored by one of them, so any one substitution is survived.
MASKS = ("1101110101", "1011011011", "0111101110", "1110110111")
#: Differing words up to which a window counts as an overlap.
SLIPS = SPAN // 3
#: The Steiner system S(3, 4, 10) as ignored positions: any three positions are ignored by one of the masks, so any SLIPS substitutions are survived.
COVER = tuple("".join("0" if (k - i) % SPAN in base else "1" for k in range(SPAN)) for base in ({0, 1, 3, 4}, {0, 1, 2, 6}, {0, 2, 4, 7}) for i in range(SPAN))
#: Bits of the filter for each evaluation hash, and the least and the most that it may have (1 and 64 MB); beyond the most it passes more, and the join stays exact.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 29
#: Hashes that a task holds at once, but at least those of one text.
HELD = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&#?[0-9a-zA-Z]{1,12};")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case and accents; format characters (soft hyphens, joiners) are dropped."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))
    return _WORD.findall(text.lower())


#: Odd factors and offsets by which the hash of a window tells positions and masks apart.
_FACTORS = np.array([2 * (0x9E3779B97F4A7C15 * (k + 1) % (1 << 62)) + 1 for k in range(SPAN)], dtype=np.uint64)
_OFFSETS = np.array([(m + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64) for m in range(max(len(MASKS), len(COVER)))], dtype=np.uint64)


def _hashes(h: np.ndarray, masks: tuple[str, ...] = MASKS) -> np.ndarray:
    """uint64 [masks, windows] of the hashes of at least SPAN words."""
    n = len(h) - SPAN + 1
    out = np.repeat(_OFFSETS[: len(masks), None], n, axis=1)
    for k in range(SPAN):
        part = h[k : k + n] * _FACTORS[k]
        part ^= part >> np.uint64(29)
        for m, mask in enumerate(masks):
            if mask[k] == "1":
                out[m] += part
    return out


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(bits - 1)
    h = h ^ (h >> np.uint64(33))
    return (h & low).astype(np.int64), ((h >> np.uint64(24)) & low).astype(np.int64)


def _passing(h: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Which hashes have both of their bits set; the second is looked up for those only that have the first."""
    a, b = _slots(h, len(keep) << 3)
    hit = ((keep[a >> 3] >> (a & 7).astype(np.uint8)) & 1).astype(bool)
    some = np.nonzero(hit)
    b = b[some]
    hit[some] = ((keep[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
    return hit


_WINDOWS = "key bigint, pos int, hash bigint, window string"


def windows(df: DataFrame, key: str, text: str, keep=None, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """key, pos, hash, window (its words) per mask and window; with `keep` (the broadcast filter), only those that pass it.

    Texts with fewer than SPAN words, and null or empty ones, have none. Where a text holds markup, its windows
    without the markup are added.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}

        def solve(keys: list, flat: list[str], ends: list[int]) -> pd.DataFrame:
            """The windows of some texts: their keys, the words of all in a row, and where each text ends."""
            for w in set(flat).difference(cache):
                cache[w] = xxhash.xxh64_intdigest(w)
            h = _hashes(np.fromiter(map(cache.__getitem__, flat), dtype=np.uint64, count=len(flat)), masks)
            own = np.searchsorted(np.array(ends), np.arange(h.shape[1]), side="right")
            inside = np.arange(h.shape[1]) + SPAN <= np.array(ends)[own]
            hit = (np.ones(h.shape, dtype=bool) if keep is None else _passing(h, keep.value)) & inside
            begin, rows = [0, *ends], []
            for m, p in zip(*(x.tolist() for x in np.nonzero(hit))):
                rows.append((keys[own[p]], p - begin[own[p]], int(h[m, p].astype(np.int64)), " ".join(flat[p : p + SPAN])))
            if len(cache) > 1_000_000:
                cache.clear()
            return pd.DataFrame(rows, columns=["key", "pos", "hash", "window"])

        for pdf in batches:
            keys, flat, ends = [], [], []
            for k, t in zip(pdf["key"], pdf["text"]):
                forms = [t]
                if "<" in t or "&" in t:
                    bare = _MARKUP.sub(" ", t)
                    forms += [bare] if bare != t else []
                for form in forms:
                    tokens = words(form)
                    if len(tokens) >= SPAN:
                        flat += tokens
                        keys.append(k)
                        ends.append(len(flat))
                if len(flat) * len(masks) >= HELD:
                    yield solve(keys, flat, ends)
                    keys, flat, ends = [], [], []
            if flat:
                yield solve(keys, flat, ends)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInPandas(run, _WINDOWS)


def _filter(tests: DataFrame) -> np.ndarray:
    """The bits of all evaluation hashes, sized by their number: every task sets the bits of a part of the filter, and the parts reach the driver in a row."""
    n = tests.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))
    part = LEAST_BITS  # bits of a part: 1 MB a row

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = np.unique(np.concatenate(_slots(pdf["hash"].to_numpy(np.int64).view(np.uint64), bits)))
            yield pd.DataFrame({"part": both // part, "slot": both % part})

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(part >> 3, dtype=np.uint8)
        at = pdf["slot"].to_numpy()
        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [own.tobytes()]})

    rows = tests.select("hash").mapInPandas(slots, "part bigint, slot bigint").distinct().groupBy("part").applyInPandas(filled, "part bigint, bits binary").collect()  # MOST_BITS at most
    out = np.zeros(bits >> 3, dtype=np.uint8)
    for row in rows:
        out[row.part * (part >> 3) : (row.part + 1) * (part >> 3)] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def hits(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_key, item_key, pos (of the window in the document), item_pos, slips: every window that meets an item's.

    With MASKS, all windows of at most one differing word are met, and some of up to SLIPS; with COVER, all of up to SLIPS.

    Each (document, item, pos, item_pos) comes once, however many masks met. Empty tables give an empty result.
    """
    tests = durable(windows(items, item_key, text, masks=masks), "tests")
    found = durable(windows(docs, doc_key, text, docs.sparkSession.sparkContext.broadcast(_filter(tests)), masks), "windows")
    right = tests.select(F.col("hash"), F.col("key").alias(item_key), F.col("pos").alias("item_pos"), F.col("window").alias("item_window"))
    met = skew_join(found.withColumnRenamed("key", doc_key), right, ["hash"], "inner", many=True)
    a, b = F.split("window", " "), F.split("item_window", " ")
    slips = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    met = met.select(doc_key, item_key, "pos", "item_pos", slips.alias("slips"))
    return met.where(F.col("slips") <= SLIPS).groupBy(doc_key, item_key, "pos", "item_pos").agg(F.min("slips").alias("slips"))


def leaked(met: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """hits() -> one row per document and item: n_windows, first and last word of the passage, exact, slips (least)."""
    return met.groupBy(doc_key, item_key).agg(F.count("*").alias("n_windows"), F.min("pos").alias("first_word"), (F.max("pos") + SPAN - 1).alias("last_word"), F.min("slips").alias("slips"), (F.min("slips") == 0).alias("exact"))
