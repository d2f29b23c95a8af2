"""A few keys that hold most rows: heavy hitters, balanced per-key results, skew-proof joins.

A key is *heavy* when it would fill a good part of a shuffle partition, or holds more rows than a task should. One pass
of a frequent-items sketch over the hashes of the keys, aggregated on the map side, finds them; hashes make keys of any
type and number of columns alike. There are at most 2 / LEAST_SHARE such keys, so whatever is kept per heavy key is
bounded and may be collected or broadcast. Results never depend on the sketch or on a collision of hashes: they only choose
the plan that a key takes, and all plans are exact.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task should hold at most.
TASK_ROWS = 1_000_000
#: Bounds of the share of rows from which a key is heavy: the least keeps the list of heavy keys bounded.
LEAST_SHARE, MOST_SHARE = 1e-4, 0.01
#: Items that the sketch tracks; its error is about 3.5 / TRACKED of the rows, well below LEAST_SHARE.
TRACKED = 100_000
#: Rows on the other side of a heavy join that may be broadcast; beyond it, both sides are salted.
BROADCAST_ROWS = 100_000


#: Estimated bytes of a side that one task holds easily: no key in it can be too heavy, so none is sought.
SMALL_BYTES = 16 << 20


class Heavy(NamedTuple):
    hash: int
    rows: int


def key_hash(cols: list[str]) -> Column:
    """The hash of a key, null where any of its columns is null: such a key is never heavy and matches nothing."""
    return F.when(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]), F.xxhash64(*cols))


def heavy_share(df: DataFrame, n: int, most: int | None = None) -> float:
    """The share of n rows from which a key is heavy: half a shuffle partition, or TASK_ROWS, whichever is less; or `most` rows."""
    if most is not None:
        return min(1.0, max(LEAST_SHARE, most / max(n, 1)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_SHARE, max(LEAST_SHARE, min(0.5 / max(parts, 1), TASK_ROWS / max(n, 1))))


def heavy_hashes(df: DataFrame, cols: list[str], share: float | None = None, tracked: int = TRACKED, most: int | None = None) -> list[Heavy]:
    """Hashes of the keys that a sketch estimates at `share` of the rows (or `most` rows) or more, with their rows; at most 2 / share of them."""
    k = math.ceil(2 / (share or LEAST_SHARE))
    got = df.select(key_hash(cols).alias("h")).where("h IS NOT NULL").agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {k}, {max(tracked, k)})").alias("top")).first()
    if not got or not got.n:
        return []
    least = 0.9 * (share or heavy_share(df, got.n, most)) * got.n
    return [Heavy(x["item"], x["count"]) for x in got.top or [] if x["count"] >= least]


def heavy_keys(df: DataFrame, cols: list[str], share: float | None = None, tracked: int = TRACKED) -> list[tuple]:
    """The heavy keys themselves, as tuples of `cols` in their own types. Null in any column is no key. An empty table has none."""
    found = heavy_hashes(df, cols, share, tracked)
    if not found:
        return []
    return [tuple(r) for r in df.select(*cols).where(_is(found, cols)).distinct().collect()]  # as many as hashes


def _small(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of a table is small. It never estimates a join or an aggregate too low, only too high."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def _is(found: list[Heavy], cols: list[str]) -> Column:
    return F.coalesce(key_hash(cols).isin([x.hash for x in found]), F.lit(False)) if found else F.lit(False)


def _like(right: DataFrame, left: DataFrame, on: list[str]) -> DataFrame:
    """right with its key columns in the types of left, so that equal keys have equal hashes."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return right.withColumns({c: F.col(c).cast(a[c]) for c in on if a[c] != b[c]})


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", share: float | None = None, sketch: DataFrame | None = None, many: bool = False, most: int | None = None) -> DataFrame:
    """`left` joined with `right` on `on`, balanced whatever the distribution of the keys.

    `sketch` may give a cheaper table with about left's distribution of keys (the scan that left starts from), so that heavy
    keys are found without computing left twice; it only chooses the plan. `many` says that a key may hold many rows of
    right, too, whose heavy keys are then sought as well (a semi- or anti-join needs each key of right once, so it never
    has to).

    Rows of light keys join by an ordinary shuffle. Rows of heavy keys stay where they are: the right side's rows of
    those keys are broadcast once they are counted and are few, else both sides are salted, each key by its number of rows.
    how: inner, left, left_semi or left_anti. Null keys match nothing. Other columns must not clash.
    """
    right = _like(right, left, on)
    if how in ("left_semi", "left_anti"):
        right = right.select(*on).distinct()
    seek = lambda df: [] if share is None and most is None and _small(df) else heavy_hashes(df, on, share, most=most)
    heavy = seek(left if sketch is None else sketch)
    wide = seek(right) if many and how in ("inner", "left") else []
    wide = [x for x in wide if x.hash not in {y.hash for y in heavy}]
    parts = [left.where(~_is([*heavy, *wide], on)).join(right.where(~_is([*heavy, *wide], on)), on, how)] if heavy or wide else [left.join(right, on, how)]
    if heavy:
        own, other = left.where(_is(heavy, on)), right.where(_is(heavy, on))
        if other.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            parts.append(own.join(F.broadcast(other), on, how))
        else:
            parts.append(_salted(own, other, on, how, heavy, True))
    if wide:
        own, other = left.where(_is(wide, on)), right.where(_is(wide, on))
        if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            parts.append(other.join(F.broadcast(own), on, "inner").select(*parts[0].columns))
        else:
            parts.append(_salted(own, other, on, "inner", wide, False))
        if how == "left":  # a hash may stand for a key that right lacks
            bare = own.join(other.select(*on).distinct(), on, "left_anti")
            parts.append(bare.select(*[F.col(c) if c in bare.columns else F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in parts[0].columns]))
    return functools.reduce(DataFrame.unionByName, parts)


def _salted(left: DataFrame, right: DataFrame, on: list[str], how: str, heavy: list[Heavy], deal_left: bool) -> DataFrame:
    """One side's rows of a key are dealt to as many salts as its rows fill tasks (and 16 at least), by the hash of the row;
    the other side's rows go to all of them."""
    share = max(1, min(TASK_ROWS, min(x.rows for x in heavy)))
    salts = F.broadcast(left.sparkSession.createDataFrame([(x.hash, max(16, math.ceil(x.rows / share))) for x in heavy], "_hash bigint, _salts int"))  # at most 2 / LEAST_SHARE rows
    a = left.withColumn("_hash", key_hash(on)).join(salts, "_hash")
    b = right.withColumn("_hash", key_hash(on)).join(salts, "_hash")
    dealt = F.pmod(F.xxhash64(*left.columns) if deal_left else F.xxhash64(*right.columns), F.col("_salts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    a, b = (a.withColumn("_salt", dealt if deal_left else every), b.withColumn("_salt", every if deal_left else dealt))
    return a.drop("_hash", "_salts").join(b.drop("_hash", "_salts"), [*on, "_salt"], how).drop("_salt")


def per_key_stats(df: DataFrame, key: str, other: str, amount: str, share: float | None = None, by: list[str] = ()) -> DataFrame:
    """For every key: n_rows, amount (sum, null when no row has one), n_other (distinct other ends), is_heavy.

    Light keys take ordinary aggregates, combined on the map side before they shuffle. The rows of heavy keys are recognised
    by a broadcast join with the list of heavy keys, are combined per (key, other end) before and after a shuffle on both, which spreads
    one key over all tasks, and only those sums meet per key. `by` holds columns that belong to the key (the side, the
    table); rows with a null key are left out; a null other end is not counted; repeated rows count as rows.
    """
    by = list(by)
    cols = [*by, key]
    rows = df.select(*cols, F.col(other).alias("_other"), F.col(amount).alias("_amount")).where(F.col(key).isNotNull())
    heavy = heavy_hashes(rows, cols, share)
    listed = F.broadcast(df.sparkSession.createDataFrame([(x.hash,) for x in heavy], "_hash bigint"))  # at most 2 / share rows
    light = rows.where(~_is(heavy, cols)).groupBy(*cols).agg(F.count("*").alias("n_rows"), F.sum("_amount").alias("amount"), F.count_distinct("_other").alias("n_other"), F.lit(False).alias("is_heavy"))
    pairs = rows.withColumn("_hash", key_hash(cols)).join(listed, "_hash", "left_semi").groupBy(*cols, "_other").agg(F.count("*").alias("n"), F.sum("_amount").alias("a"))
    return light.unionByName(pairs.groupBy(*cols).agg(F.sum("n").alias("n_rows"), F.sum("a").alias("amount"), F.count("_other").alias("n_other"), F.lit(True).alias("is_heavy")))
