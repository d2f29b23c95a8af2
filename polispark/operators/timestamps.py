"""Mixed timestamp formats and zones, normalised to one UTC instant.

A value is split by one pattern per layout into a date, a time and a zone. What names its zone, or is an epoch number, is an
instant at once. What names none is a local time of an unknown zone. estimate_histories() aligns the local times of each
series with the order of its own sequence and with the times at which they were ingested: per month it counts, for each zone (with its
daylight-saving changes), the local times that would break that order or be later than their ingestion, and
chooses the history of zones with the fewest violations, where leaving the declared zone must pay clearly. Parsing is built-in expressions only.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polispark.operators.skew import skew_join
from polispark.session import durable, table

#: Names of months and zones.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
REGION_ZONES = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
FIXED_ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600}

#: Zone of a time without one, where nothing speaks against it.
DEFAULT_ZONE = "America/New_York"
CANDIDATE_ZONES = (DEFAULT_ZONE, "America/Chicago", "America/Denver", "America/Los_Angeles", "UTC", "-05:00", "-04:00")
#: Positions of the sequence that are neighbours.
NEIGHBOURS = 64
#: Years in which a value counts as a real date.
YEARS = (1900, 2099)

#: Violations by which a zone of its own must pay, in standard deviations of the series' number under the declared zone.
CLEAR = 4.0

_REST = r"(.*)$"
_LAYOUTS = [  # pattern, numbers of the groups of year, month, day, rest
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _REST, (1, 2, 3, 4)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?!\d)" + _REST, (3, 1, 2, 4)),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?!\d)" + _REST, (3, 2, 1, 4)),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[- ]([A-Za-z]{3,9})\.?[- ,]+(\d{4}|\d{2})(?!\d)" + _REST, (3, 2, 1, 4)),
    (r"^(?:[A-Za-z]{3,9},\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?!\d)" + _REST, (3, 1, 2, 4)),
]
_TIME = r"^(?:\s*[Tt,]\s*|\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:([AaPp])\.?[Mm]\.?)?\s*([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?)?$"


#: Put between the groups of a match.
_MARK = "\u0001"


def _marked(c: Column, pattern: str, order: tuple[int, ...]) -> Column:
    """The groups of a pattern's match in the given order, each behind a mark, an empty text for one that took no part; the text itself where it
    doesn't match. So patterns can follow each other, as none matches a mark, and each runs once."""
    return F.regexp_replace(c, pattern, _MARK + _MARK.join(f"${i}" for i in order))


def _groups(c: Column) -> Column:
    """The groups of a marked text, null where nothing matched."""
    return F.when(c.startswith(_MARK), F.split(F.substring(c, 2, 1_000_000), _MARK))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date in YEARS, null if there is no such day: arithmetic of the calendar whose years begin in March."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    whole = lambda c: F.floor(c).cast("int")
    days = y2 * 365 + whole(y2 / 4) - whole(y2 / 100) + whole(y2 / 400) + whole((153 * ((m + 9) % 12) + 2) / 5) + d - 719_469
    return F.when(y.between(*YEARS) & m.between(1, 12) & (d >= 1) & (d <= length), days)


def _num(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _lookup(c: Column, items: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in items.items() for x in kv]), c)


def parse(df: DataFrame, value: str) -> DataFrame:
    """Adds epoch_ms and local_ms: epoch_ms where the value names its instant, else local_ms, the wall time as if in UTC.

    A date without a time is midnight UTC and so an instant. Both are null where the value is null, blank or no real
    date or time (impossible days, hours or zones, words, years outside YEARS). Fractions of a millisecond are cut.
    The steps are separate projections, so that no expression is computed twice. Columns of df with the names
    epoch_ms and local_ms are replaced.
    """
    kept = [c for c in df.columns if c not in ("epoch_ms", "local_ms")]
    cols, s = [F.col("_row")], F.col("_s")  # the row travels as a struct, so that no name of it can clash
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.trim(F.translate(F.col(f"`{value}`"), _MARK, "?"), F.lit(" \t\r\n")).alias("_s"))
    digits = F.when(s.rlike(r"^\d{7,8}$"), F.lpad(s, 8, "0"))
    monthfirst = _num(F.substring(digits, 1, 2)).between(1, 12)
    packed = F.when(monthfirst, F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 1, 2), F.substring(digits, 3, 2))).otherwise(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))
    df = df.select(*cols, s, F.when(digits.isNotNull(), packed).otherwise(s).alias("_text"))
    text = F.col("_text")

    marked = functools.reduce(lambda c, layout: _marked(c, *layout), _LAYOUTS, text)
    df = df.select(*cols, s, marked.alias("_text")).select(*cols, s, _groups(text).alias("_g"))
    g = lambda i: F.get("_g", F.lit(i))
    months = {name: i + 1 for i, name in enumerate(MONTHS)} | {name[:3]: i + 1 for i, name in enumerate(MONTHS)} | {"sept": 9}
    year = F.when(F.length(g(0)) == 2, _num(g(0)) + 2000).otherwise(_num(g(0)))
    month = F.coalesce(_num(g(1)), _lookup(F.lower(g(1)), months))
    df = df.select(*cols, s, year.alias("_y"), month.alias("_mo"), _num(g(2)).alias("_d"), F.rtrim(g(3)).alias("_rest"))
    rest = F.col("_rest")
    df = df.select(*cols, s, (_days(F.col("_y"), F.col("_mo"), F.col("_d")).cast("bigint") * 86_400_000).alias("_day"), (rest == "").alias("_bare"), _marked(rest, _TIME, (1, 2, 3, 4, 5, 6)).alias("_rest"))
    df = df.select(*cols, s, "_day", "_bare", _groups(rest).alias("_t"))

    t = lambda i: F.get("_t", F.lit(i - 1))
    hour, half = _num(t(1)), F.lower(t(5))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    ms = F.coalesce(_num(F.substring(F.rpad(t(4), 3, "0"), 1, 3)), F.lit(0))
    df = df.select(*cols, s, "_day", "_bare", hour24.alias("_h"), _num(t(2)).alias("_m"), F.coalesce(_num(t(3)), F.lit(0)).alias("_sec"), ms.alias("_ms"), F.upper(t(6)).alias("_zone"))
    clock = F.when((F.col("_h") <= 23) & (F.col("_m") <= 59) & (F.col("_sec") <= 59), ((F.col("_h") * 60 + F.col("_m")) * 60 + F.col("_sec")).cast("bigint") * 1000 + F.col("_ms"))
    zone = F.col("_zone")
    shift = F.regexp_replace(zone, ":", "")
    hours, minutes = _num(F.substring(shift, 2, 2)), F.coalesce(_num(F.substring(shift, 4, 2)), F.lit(0))
    signed = F.when((hours <= 18) & (minutes <= 59), F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
    offset = F.when(zone.rlike(r"^[+-]"), signed).otherwise(_lookup(zone, FIXED_ZONES)).cast("bigint")
    df = df.select(*cols, s, "_day", "_bare", zone, (F.col("_day") + clock).alias("_local"), offset.alias("_offset"), _lookup(zone, REGION_ZONES).alias("_region"))

    local = F.col("_local")
    at = F.when(F.col("_offset").isNotNull(), local - F.col("_offset") * 60_000).when(F.col("_region").isNotNull(), to_instant(local, F.col("_region")))
    lo, hi = _epoch_ms(YEARS[0]), _epoch_ms(YEARS[1] + 1)
    number = F.when(s.rlike(r"^\d{10}$"), s.try_cast("bigint") * 1000).when(s.rlike(r"^\d{13}$"), s.try_cast("bigint"))
    dated = F.when(F.col("_bare"), F.col("_day")).when(zone != "", at)
    return df.select(*[F.col(f"_row.`{c}`") for c in kept], F.coalesce(F.when((number >= lo) & (number < hi), number), dated).alias("epoch_ms"), F.when(zone == "", local).alias("local_ms"))


def _epoch_ms(year: int) -> int:
    import datetime

    return int(datetime.datetime(year, 1, 1, tzinfo=datetime.UTC).timestamp() * 1000)


def to_instant(local_ms: Column, zone: Column | str) -> Column:
    """The instant of a wall time in a zone. A repeated time is its first occurrence; a skipped one counts with the
    offset before the change. Independent of the session's time zone."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local_ms), zone))


def estimate_zone(rows: DataFrame, candidates: tuple[str, ...] = CANDIDATE_ZONES, default: str = DEFAULT_ZONE, width: int = NEIGHBOURS) -> str:
    """The offset history of the local times in rows (series, seq, epoch_ms, local_ms).

    Rows of one series whose seq lies in the same stretch of `width` are neighbours. A local time violates a history if it
    would come before the last instant known ahead of it or after the first one known behind it. The default wins unless
    another history has fewer violations by more than three standard deviations of their number. Rows without a seq say
    nothing. Windows run over the distinct numbers of a stretch, so never over more than `width` rows, and one count per
    candidate reaches the driver.
    """
    at = rows.where(F.col("seq").isNotNull())
    local = at.where(F.col("local_ms").isNotNull()).select("series", "seq", "local_ms").distinct().join(_bounds(rows, width), ["series", "seq"])

    def broken(zone: str):
        t = to_instant(F.col("local_ms"), zone)
        return F.sum(F.when((t < F.col("lo")) | (t > F.col("hi")), 1).otherwise(0))

    got = local.agg(*[broken(z).alias(f"z{i}") for i, z in enumerate(candidates)]).first()
    counts = {z: got[f"z{i}"] or 0 for i, z in enumerate(candidates)}
    best = min(candidates, key=lambda z: counts[z])
    return best if counts[default] - counts[best] > 3 * math.sqrt(counts[default] + 1) else default


def _month(local_ms: Column) -> Column:
    """Months since the year 0 of a wall time."""
    at = F.date_from_unix_date(F.floor(local_ms / 86_400_000).cast("int"))
    return (F.year(at) * 12 + F.month(at)).cast("int")


def _bounds(rows: DataFrame, width: int) -> DataFrame:
    """series, seq, lo, hi: the last instant known ahead of a place of the sequence and the first one known behind it, among its neighbours."""
    per = rows.where(F.col("seq").isNotNull()).groupBy("series", "seq").agg(F.min("epoch_ms").alias("first"), F.max("epoch_ms").alias("last"))
    w = Window.partitionBy("series", F.floor(F.col("seq") / width)).orderBy("seq")
    ahead = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return per.select("series", "seq", ahead.alias("lo"), behind.alias("hi")).where("lo IS NOT NULL OR hi IS NOT NULL")


def estimate_histories(rows: DataFrame, candidates: tuple[str, ...] = CANDIDATE_ZONES, default: str = DEFAULT_ZONE, width: int = NEIGHBOURS, delay_ms: int | None = None) -> DataFrame:
    """series, month, zone of all months of a series whose local times are in another zone than the default.

    rows: series, seq, epoch_ms, local_ms, ingested_ms (either of seq and ingested_ms may be null). A local time violates a zone if it would come before
    the last instant known ahead of it in the sequence (its neighbours are the same stretch of `width`), after the first one behind it, after its ingestion,
    or, with delay_ms, longer than that before it. Violations are counted per series, month and zone; the history of a series is
    the sequence of zones with the least sum of violations and of changes, each of which costs CLEAR standard deviations of the violations under
    the default zone, as do a first and a last zone other than the default. Equal sums keep the default. A month of a series is one row of
    counts, so a series has at most 12 a year, however many its rows.
    """
    local = rows.where(F.col("local_ms").isNotNull()).select("series", "seq", "local_ms", "ingested_ms").distinct()
    local = skew_join(local, _bounds(rows, width), ["series", "seq"], "left").where("lo IS NOT NULL OR hi IS NOT NULL OR ingested_ms IS NOT NULL")

    names = [f"t{i}" for i in range(len(candidates))]
    local = local.select("series", "lo", "hi", "ingested_ms", _month(F.col("local_ms")).alias("month"), *[to_instant(F.col("local_ms"), z).alias(n) for z, n in zip(candidates, names)])

    def broken(t: Column) -> Column:
        late = (t > F.col("ingested_ms")) if delay_ms is None else (t > F.col("ingested_ms")) | (t < F.col("ingested_ms") - delay_ms)
        return F.count_if(t < F.col("lo")) + F.count_if(t > F.col("hi")) + F.count_if(late)

    counts = local.groupBy("series", "month").agg(F.array(*[broken(F.col(n)) for n in names]).alias("broken"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        n = np.array([list(x) for x in pdf["broken"]], dtype=float)
        k = candidates.index(default)
        change = CLEAR * math.sqrt(n[:, k].sum() + 1)
        edge = np.where(np.arange(len(candidates)) == k, 0.0, change)
        tie = np.where(np.arange(len(candidates)) == k, 0.0, 1e-6)
        cost, back = edge + n[0] + tie, []
        for row in n[1:]:
            best = int(cost.argmin())
            move = cost[best] + change < cost
            back.append(np.where(move, best, np.arange(len(candidates))))
            cost = np.where(move, cost[best] + change, cost) + row + tie
        at = int((cost + edge).argmin())
        path = [at]
        for step in reversed(back):
            at = int(step[at])
            path.append(at)
        path.reverse()
        out = [(s, m, candidates[z]) for s, m, z in zip(pdf["series"], pdf["month"], path) if z != k]
        return pd.DataFrame(out, columns=["series", "month", "zone"])

    return counts.groupBy("series").applyInPandas(choose, "series string, month int, zone string")


def normalise(df: DataFrame, value: str, series: list[str] = (), seq: str | None = None, candidates: tuple[str, ...] = CANDIDATE_ZONES, default: str = DEFAULT_ZONE, ingested: str | None = None) -> DataFrame:
    """Adds epoch_ms (bigint, UTC milliseconds; null for what is no real date) to df.

    series and seq name the columns by which the source numbers its rows in time, ingested the timestamp at which a row arrived; without either, the default zone
    holds. df keeps its columns but those named epoch_ms or local_ms. Empty tables give empty results.
    """
    kept = [c for c in df.columns if c not in ("epoch_ms", "local_ms")]
    # written, as it is read several times, and as a filter that is pushed into the steps of parsing would repeat them
    parsed = durable(parse(df, value).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "epoch_ms", "local_ms"), "parsed")
    if seq is None and ingested is None:
        return parsed.select(*[F.col(f"_row.`{c}`") for c in kept], F.coalesce("epoch_ms", to_instant(F.col("local_ms"), default)).alias("epoch_ms"))
    part = lambda c: F.coalesce(F.col(f"_row.`{c}`").cast("string"), F.lit(""))
    rows = parsed.select(
        "_row", "epoch_ms", "local_ms", (F.concat_ws("\u0001", *map(part, series)) if series else F.lit("")).alias("series"),
        (F.col(f"_row.`{seq}`").cast("bigint") if seq else F.lit(None).cast("bigint")).alias("seq"),
        (F.unix_millis(F.col(f"_row.`{ingested}`")) if ingested else F.lit(None).cast("bigint")).alias("ingested_ms"),
    )
    zones = durable(estimate_histories(rows.drop("_row"), candidates, default), "zones")
    if zones.limit(1).count():
        local = skew_join(rows.where("local_ms IS NOT NULL").withColumn("month", _month(F.col("local_ms"))), zones, ["series", "month"], "left")
        rows = rows.where("local_ms IS NULL").select("_row", "epoch_ms").unionByName(local.select("_row", to_instant(F.col("local_ms"), F.coalesce("zone", F.lit(default))).alias("epoch_ms")))
    else:
        rows = rows.select("_row", F.coalesce("epoch_ms", to_instant(F.col("local_ms"), default)).alias("epoch_ms"))
    return rows.select(*[F.col(f"_row.`{c}`") for c in kept], "epoch_ms")


#: The three sources of typed dates: table, value, key columns, series, sequence.
SOURCES = (
    ("pac_aggregations", "latestdate", ("cmteid", "candid"), (), None),
    ("fec_contributions", "receipt_date", ("sub_id",), (), "sub_id"),
    ("vote_list_items", "date", ("congress", "chamber", "rollnumber"), ("congress", "chamber"), "rollnumber"),
)


def typed_dates(spark, sf_dir: str) -> DataFrame:
    """src, row_key, value, epoch_ms of all typed dates, null where unreadable; repeated rows stay. A series never spans two sources."""
    parts = []
    for name, value, key, series, seq in SOURCES:
        part = F.concat_ws("|", F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in series])
        row = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("src"), row.alias("row_key"), F.col(value).alias("value"), part.alias("series"), (F.col(seq) if seq else F.lit(None)).cast("bigint").alias("seq")))
    return normalise(functools.reduce(DataFrame.unionByName, parts), "value", ["series"], "seq").select("src", "row_key", "value", "epoch_ms")
