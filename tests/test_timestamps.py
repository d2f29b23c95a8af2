import datetime as dt
import re
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from polispark.operators import timestamps as T

REGIONS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
FIXED = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "Z": 0, "UTC": 0, "GMT": 0}
EPOCH = dt.datetime(1970, 1, 1)


def brute(v):
    """Another way to the same instants, on the standard library."""
    if v is None:
        return None
    s = v.strip()
    if re.fullmatch(r"\d{13}", s):
        return int(s) if -2208988800000 <= int(s) < 4102444800000 else None
    if re.fullmatch(r"\d{10}", s):
        return int(s) * 1000 if int(s) < 4102444800 else None
    m = re.fullmatch(r"(?P<d>.*?)(?:[T,]?\s*(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:\.(?P<f>\d+))?)?\s*(?P<ap>AM|PM)?\s*(?P<z>[A-Z]+|[+-]\d\d:?\d\d|[+-]\d\d)?)?", s)
    day = None
    text = re.sub(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "", m["d"].strip())
    forms = ["%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y", "%d.%m.%Y", "%d-%b-%Y", "%d %b %Y", "%b %d, %Y", "%B %d, %Y"]
    if re.fullmatch(r"\d{7,8}", text):
        text, forms = text.zfill(8), ["%m%d%Y", "%Y%m%d"]
    for f in forms:
        try:
            day = dt.datetime.strptime(text.title() if "%b" in f else text, f)
        except ValueError:
            continue
        if 1900 <= day.year <= 2099:
            break
        day = None
    if day is None:
        return None
    if m["h"] is None:
        return int((day - EPOCH).total_seconds()) * 1000
    h = int(m["h"])
    if m["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (m["ap"] == "PM")
    if h > 23 or int(m["mi"]) > 59 or int(m["s"] or 0) > 59:
        return None
    at = day + dt.timedelta(hours=h, minutes=int(m["mi"]), seconds=int(m["s"] or 0))
    ms = int(((m["f"] or "") + "000")[:3])
    z = m["z"]
    if z and z[0] in "+-":
        off = dt.timedelta(hours=int(z[1:3]), minutes=int(z[3:].replace(":", "") or 0)) * (-1 if z[0] == "-" else 1)
    elif z in FIXED:
        off = dt.timedelta(hours=FIXED[z])
    elif z and z not in REGIONS:
        return None
    else:
        off = at.replace(tzinfo=ZoneInfo(REGIONS[z or "ET"]), fold=0).utcoffset()
    return int((at - off - EPOCH).total_seconds()) * 1000 + ms


CASES = [
    "03092015", "20241224", "6122017", "99999999", "2012-02-29", "2013-02-29", "09/14/2011", "3/25/14", "24.06.2024", "31.04.2024", "1270008910", "1684708772733", "9999999999",
    "Oct 5, 2023", "27-MAR-2024", "2-Jan-2024 1:07 AM", "2013-03-03T06:13:57-1000", "2017-05-10 18:21:27+05:30", "2020-10-05 16:19:43-06", "2019-01-03T19:04:32.5Z", "2020-11-01 01:30:00", "2020-03-08 02:30:00",
    "2020-11-01 01:30 ET", "2020-03-08 02:30 PT", "02/13/2014 12:57 AM MST", "01/01/2020 12:41 PM CT", "December 11, 2015, 08:53 PM", "April 12, 2009, 10:41 AM CDT", "Mon, 07 Dec 2020 06:14:48 -0500", "Fri, March 24, 2017",
    "2009-03-03 03:21:22.508129+00", "1969-12-31T23:59:59.9999Z", "2020-13-01", "2020-01-01 25:00:00", "2020-01-01 10:61", "13:30", "unknown", "N/A", "", "   ", " 02282021", "2020-01-01 10:00 XYZ", "00/00/0000", "2021-06-15 13:00 PM", None,
]


def test_cases(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "i int, v string").selectExpr("*", "1 AS epoch_ms", "'a' AS local_ms", "2 AS _s", "3 AS _row", "4 AS `a.b`")
    got = {r.i: r.epoch_ms for r in T.normalise(df, "v").collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES)] == [(c, brute(c)) for c in CASES]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_tables_equal_brute_force(spark, sf, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = T.typed_dates(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows and [(r.value, r.epoch_ms) for r in rows if r.epoch_ms != brute(r.value)] == []


def test_zone_is_estimated_from_the_sequence(spark):
    base = dt.datetime(2021, 1, 5, 8)
    rows = []
    for i in range(600):
        at = base + dt.timedelta(minutes=50 * i)  # closer than the zones are
        ms = int((at - EPOCH).total_seconds()) * 1000
        if i % 3:
            rows.append(("s", 30 * i, ms, None))
        else:
            local = at.replace(tzinfo=dt.UTC).astimezone(ZoneInfo("America/Los_Angeles")).replace(tzinfo=None)
            rows.append(("s", 30 * i, None, int((local - EPOCH).total_seconds()) * 1000))
    df = spark.createDataFrame(rows, "series string, seq bigint, epoch_ms bigint, local_ms bigint")
    assert T.estimate_zone(df, width=300) == "America/Los_Angeles"
    scattered = df.withColumn("seq", F.abs(F.hash("seq")).cast("bigint"))
    assert T.estimate_zone(scattered) == T.DEFAULT_ZONE
    assert T.estimate_zone(df.limit(0)) == T.DEFAULT_ZONE


def _history(zones, n=120, every=dt.timedelta(minutes=20)):
    """Rows of a series whose local times (two of three) are in zones[i] in month i; sequence and ingestion follow the true order."""
    rows, true, seq = [], {}, 0
    for i, zone in enumerate(zones):
        base = dt.datetime(2021, 1 + i, 5, 0)
        for j in range(n):
            at = base + j * every
            ms = int((at - EPOCH).total_seconds()) * 1000
            if j % 3 == 0:
                rows.append((seq, at.strftime("%Y-%m-%dT%H:%M:%SZ"), ms + 60_000))
            else:
                rows.append((seq, at.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), ms + 60_000))
            true[seq] = ms
            seq += 1
    return rows, true


def test_histories_per_series_and_period(spark):
    """Zones differ between series and change within one; each is found from the sequence alone, and from ingestion with a bound of the delay alone."""
    plans = {"west": ["America/Los_Angeles"] * 4, "moves": ["America/New_York", "America/New_York", "UTC", "UTC", "America/Denver", "America/Denver"], "east": ["America/New_York"] * 3}
    rows, true = [], {}
    for name, zones in plans.items():
        found, want = _history(zones)
        rows += [(name, seq, v, ingested) for seq, v, ingested in found]
        true |= {(name, k): v for k, v in want.items()}
    df = spark.createDataFrame(rows, "series string, seq bigint, v string, at bigint").withColumn("ingested", F.timestamp_millis("at"))
    got = {(r.series, r.seq): r.epoch_ms for r in T.normalise(df, "v", ["series"], "seq").collect()}
    assert got == true
    bare = T.parse(df, "v").selectExpr("series", "CAST(NULL AS BIGINT) AS seq", "epoch_ms", "local_ms", "at AS ingested_ms")
    zones = {(r.series, r.month): r.zone for r in T.estimate_histories(bare, delay_ms=3_000_000).collect()}
    assert {s for s, _ in zones} == {"west", "moves"} and zones["moves", 2021 * 12 + 3] == "UTC" and zones["moves", 2021 * 12 + 5] == "America/Denver" and ("moves", 2021 * 12 + 1) not in zones
    by_arrival = T.normalise(df.where("series = 'west'").selectExpr("series", "v", "seq", "ingested"), "v", ["series"], ingested="ingested")
    assert by_arrival.count() == 480
    shuffled = df.withColumn("seq", F.abs(F.hash("seq")).cast("bigint")).selectExpr("series", "seq", "v")
    east = {(r.series, r.v): r.epoch_ms for r in T.normalise(shuffled, "v", ["series"], "seq").collect()}
    assert all(east[s, v] == brute(v) for s, v in east)  # no order, no evidence: the declared zone holds
    assert T.normalise(df.limit(0), "v", ["series"], "seq").count() == 0
