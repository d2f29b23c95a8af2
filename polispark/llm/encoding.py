"""Encoding of whole texts with a public byte-level BPE, as a tree reduction over a monoid.

An element is a piece of text as its pre-tokens and their ids. A text is halved until a piece is small (a leaf); two
neighbours are joined by encoding a window around their border anew. The scan that cuts
pre-tokens runs from left to right, and what it does from the start of a pre-token depends on the text from there on
only. So the left neighbour's pre-tokens hold up to the first one whose decision could have seen the border, and the
right neighbour's ids hold from the first start on which the window's scan and the right neighbour's agree; the window
grows until there is one. Everything outside is provably what encoding the whole would give. Every text takes this way:
there is one encoder, that of the leaf.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default file of the tokenizer, the same path on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The same vocabulary as ranks, by which a leaf merges the bytes of a pre-token.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters up to which a piece is a leaf.
LEAF = 256
#: Characters of the first window behind a border.
WINDOW = 16
#: Characters that the scan can look beyond the end of a pre-token or, for contractions, beyond its start.
LOOK = 3
#: Characters from which one text is spread over several tasks.
SPREAD = 1_000_000
#: Pre-tokens (short ones) whose ids a task remembers.
KEPT = 1_000_000

_SCAN = regex.compile(PATTERN)


@functools.lru_cache(maxsize=4)
def load(path: str = TOKENIZER):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


@functools.lru_cache(maxsize=4)
def ranked(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Codes(dict):
    """The ids of single pre-tokens, merged when they are first asked for. Either form of the vocabulary may merge them."""

    def __init__(self, tok):
        self.merge = tok.encode_ordinary if hasattr(tok, "encode_ordinary") else lambda w: tok.encode(w, add_special_tokens=False).ids

    def __missing__(self, w: str) -> tuple[int, ...]:
        ids = tuple(self.merge(w))
        if len(w) <= WINDOW * 4:
            if len(self) >= KEPT:
                self.clear()
            self[w] = ids
        return ids


_codes = functools.lru_cache(maxsize=4)(_Codes)


@dataclass
class Piece:
    words: list[str]  # pre-tokens
    codes: list[tuple[int, ...]]  # the ids of each

    @property
    def text(self) -> str:
        return "".join(self.words)

    @property
    def ids(self) -> np.ndarray:
        return np.fromiter(itertools.chain.from_iterable(self.codes), dtype=np.int32)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0, *map(len, self.words)])[:-1]


def leaf(text: str, tok) -> Piece:
    """One piece, scanned and merged. The empty text is the monoid's neutral element."""
    words, codes = _SCAN.findall(text), _codes(tok)
    return Piece(words, [codes[w] for w in words])


def join(a: Piece, b: Piece, tok, window: int = WINDOW) -> Piece:
    """The element of a.text + b.text."""
    if not a.words or not b.words:
        return a if a.words else b
    i, back = len(a.words) - 1, len(a.words[-1])
    while i > 0 and back < LOOK:  # pre-tokens before i ended so early that they never saw the border
        i -= 1
        back += len(a.words[i])
    while i > 0 and back - len(a.words[i]) < LOOK:
        i -= 1
        back += len(a.words[i])
    tail = "".join(a.words[i:])
    size = window
    while True:
        head, k = [], 0
        for w in b.words:
            head.append(w)
            k += len(w)
            if k >= size:
                break
        whole = len(head) == len(b.words)
        mid = leaf(tail + "".join(head), tok)
        own = dict(zip(itertools.accumulate([len(tail), *map(len, head)]), range(len(head) + 1)))  # starts of b -> number of its pre-token
        last, at = len(tail) + k - LOOK, 0
        for m, w in enumerate(mid.words):
            if at in own and (m == 0 or whole or at <= last):  # the pre-tokens before it ended before they could see the window's end
                r = own[at]
                return Piece(a.words[:i] + mid.words[:m] + b.words[r:], a.codes[:i] + mid.codes[:m] + b.codes[r:])
            at += len(w)
        if whole:
            return Piece(a.words[:i] + mid.words, a.codes[:i] + mid.codes)
        size *= 2


def reduce_tree(text: str, tok, size: int = LEAF, window: int = WINDOW) -> Piece:
    """The element of a text by halves."""
    if len(text) <= size:
        return leaf(text, tok)
    half = len(text) // 2
    return join(reduce_tree(text[:half], tok, size, window), reduce_tree(text[half:], tok, size, window), tok, window)


def _join_all(pieces: list[Piece], tok) -> Piece:
    while len(pieces) > 1:
        pieces = [join(pieces[i], pieces[i + 1], tok) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _cuts(text: str, lengths) -> list:
    ends = np.cumsum(lengths).tolist()
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, spread: int = SPREAD, size: int = LEAF) -> DataFrame:
    """key, ids (array<int>) of every row, without special tokens; strings of special tokens are ordinary text.

    A null or empty text has an empty list. Every text is reduced by the tree. Texts beyond `spread` characters are cut into rows of that size that any task may
    encode, and the tree's upper part joins them per text; all others are encoded where they are read, without a shuffle. Rows with the same
    key must not both be longer than `spread`; other columns are ignored.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, ids array<int>"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ranked(ranks)
        for batch in batches:
            out = [reduce_tree(x or "", tok, size).ids for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*out, np.zeros(0, np.int32)])))], ["key", "ids"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf["key"], pdf["text"]):
                for i in range(0, len(t), spread):
                    yield pd.DataFrame({"key": [k], "part": [i // spread], "text": [t[i : i + spread]]})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = ranked(ranks)
        for pdf in batches:
            got = [reduce_tree(x, tok, size) for x in pdf["text"]]
            yield pdf.assign(ids=[p.ids for p in got], lengths=[list(map(len, p.words)) for p in got], counts=[list(map(len, p.codes)) for p in got])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        pieces = []
        for t, ids, lengths, counts in zip(pdf["text"], pdf["ids"], pdf["lengths"], pdf["counts"]):
            ends = np.cumsum(counts).tolist()
            flat = ids.tolist()
            pieces.append(Piece(_cuts(t, lengths), [tuple(flat[i:j]) for i, j in zip([0, *ends], ends)]))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "ids": [_join_all(pieces, ranked(ranks)).ids]})

    length = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(length <= spread).mapInArrow(near, schema)
    parts = rows.where(length > spread).mapInPandas(cut, f"key {kind}, part int, text string").repartition("key", "part")
    far = parts.mapInPandas(part, f"key {kind}, part int, text string, ids array<int>, lengths array<int>, counts array<int>")
    return short.unionByName(far.groupBy("key").applyInPandas(whole, schema)).withColumnRenamed("key", key)


@functools.lru_cache(maxsize=2)
def _bytes(path: str) -> list[bytes]:
    """The bytes of every id: the byte-level alphabet maps each byte to a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    tok = load(path)
    return [bytes(chars[c] for c in tok.id_to_token(i)) if i < 50_256 else b"" for i in range(tok.get_vocab_size())]


def concatenate(parts: list[bytes]) -> bytes:
    """The bytes of halves, joined up the tree."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = TOKENIZER, size: int = LEAF) -> DataFrame:
    """key, text of encoded rows: leaves of `size` ids become bytes, which are concatenated up the tree. A character may be cut by the
    border of two leaves, so only the root is read as text. An empty or null list gives the empty text."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes(path)
        for batch in batches:
            out = [concatenate([b"".join(map(table.__getitem__, x[i : i + size])) for i in range(0, len(x), size)]).decode("utf-8", "replace") for x in (x or [] for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(one, f"{key} {dict(df.dtypes)[key]}, text string")
