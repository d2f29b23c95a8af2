import datetime as dt
import random
from collections import deque

from pyspark.sql import functions as F

from polispark.functions import civic as C
from polispark.operators import graph as G
from polispark.operators import matching as M
from polispark.operators import places as P
from polispark.operators import upsert as U
from polispark.sources import files, sinks

EDGE = "id string, from_type string, from_id string, to_type string, to_id string, connection_type string, strength double, amount_cents bigint, occurred_at date"


def graph(spark, seed=3, n=60, m=150):
    rng = random.Random(seed)
    rows = [(f"e{i:03d}", "official", f"n{rng.randrange(n)}", "proposal", f"n{rng.randrange(n)}", rng.choice(["donation", "vote_yes", "oversight"]), 0.5, i, dt.date(2020, 1, 1) + dt.timedelta(i)) for i in range(m)]
    rows += [(f"h{i:03d}", "official", "hub", "proposal", f"n{i % n}", "donation", None, None, None) for i in range(60)]
    return rows, spark.createDataFrame(rows, EDGE)


def bfs(rows, a, b):
    nbr = {}
    for r in rows:
        nbr.setdefault(r[2], set()).add(r[4])
        nbr.setdefault(r[4], set()).add(r[2])
    dist, todo = {a: 0}, deque([a])
    while todo:
        x = todo.popleft()
        for y in nbr.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist.get(b)


def test_paths(spark):
    rows, df = graph(spark)
    for a, b in (("n1", "n7"), ("n3", "hub"), ("n5", "n5"), ("n1", "nowhere")):
        want = bfs(rows, a, b)
        path = G.shortest_path(df, a, b, 6).orderBy("hop").collect()
        if want is None:
            assert path == []
        else:
            assert len(path) == want + 1 and path[0].node == a and path[-1].node == b
            ids = {r[0]: {r[2], r[4]} for r in rows}
            assert all(ids[q.edge_id] == {p.node, q.node} or p.node == q.node for p, q in zip(path, path[1:]))
    assert G.shortest_path(df.limit(0), "a", "b").count() == 0


def test_long_lists_are_joined(spark, monkeypatch):
    rows, df = graph(spark)
    some = spark.createDataFrame([("hub",), ("n1",), (None,), ("n1",)], "node string")
    few, rest = G.touching(df, some).count(), G.without(df, some).count()
    path = G.shortest_path(df, "n1", "n7").collect()
    assert few + rest == len(rows)
    monkeypatch.setattr(G, "LISTED", 0)
    assert (G.touching(df, some).count(), G.without(df, some).count()) == (few, rest) and G.shortest_path(df, "n1", "n7").collect() == path


def test_ego_collapses_hubs(spark):
    rows, df = graph(spark)
    edges, near = G.ego_two(df, "n1", 2)
    hub = {r.node: (r.degree, r.collapsed) for r in near.collect()}
    assert hub["hub"] == (60, True) and all(not c for k, (_, c) in hub.items() if k != "hub")
    first = [r for r in rows if "n1" in (r[2], r[4])]
    votes = sorted((r for r in first if r[5] == "vote_yes"), key=lambda r: r[8], reverse=True)[:2]
    one = {r[0] for r in first if r[5] != "vote_yes"} | {r[0] for r in votes}
    assert {r.id for r in G.ego_one(df, "n1", 2).collect()} == one
    open_ = {k for k, (_, c) in hub.items() if not c}
    assert {r.id for r in edges.collect()} == one | {r[0] for r in rows if r[2] in open_ or r[4] in open_}


def test_degree_and_merge(spark):
    rows, df = graph(spark)
    deg = {r.node: r.degree for r in G.degree(df).collect()}
    assert deg["hub"] == 60 and sum(deg.values()) == 2 * len(rows)
    merged = G.merge([df, df.withColumn("id", F.concat(F.lit("z"), "id"))])
    assert merged.count() == len({(r[2], r[4], r[5]) for r in rows}) and merged.where("id LIKE 'z%'").count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 9, None), ("a", 8, "q"), ("c", 5, "n"), (None, 7, "m")], "k string, v int, s string")
    got = {r.k: (r.v, r.s, r.action) for r in U.upsert(old, new, ["k"], keep=["s"]).collect()}
    assert got == {"a": (9, "x", "update"), "b": (2, "y", "none"), "c": (5, "n", "insert"), None: (7, "z", "update")}
    assert U.upsert(old.limit(0), new, ["k"]).count() == 3 and U.upsert(old, new.limit(0), ["k"]).count() == 3
    assert {r.k for r in U.insert_missing(old, new, ["k"]).collect()} >= {"a", "b", "c"}


def test_narrowing(spark):
    left = spark.createDataFrame([(1, "x", "AL", "joh"), (2, "y", "AL", "joh"), (3, "y", None, "ann"), (4, None, "AL", "joh"), (5, "z", "OH", "bob")], "l int, last string, st string, f3 string")
    right = spark.createDataFrame([("a", "x", "GA", "zed"), ("b", "y", "AL", "joh"), ("c", "y", "AL", "jim"), ("d", "z", "OH", "bob"), ("e", "z", "OH", "bob")], "r string, last string, st string, f3 string")
    got = {x.l: (x.r, x.stage) for x in M.narrow(left, right, ["last"], ["st", "f3"], "l", "r").collect()}
    assert got == {1: ("a", 0), 2: ("b", 2)}
    two = M.in_passes([spark.createDataFrame([(1, "a")], "l int, r string"), spark.createDataFrame([(1, "b"), (2, "c")], "l int, r string")], "l")
    assert {(x.l, x.r, x["pass"]) for x in two.collect()} == {(1, "a", 1), (2, "c", 2)}


def test_points(spark):
    rng = random.Random(8)
    ring = [(0.0, 0.0), (9.0, 1.0), (5.0, 3.0), (8.0, 9.0), (1.0, 7.0)]
    pts = [(i, rng.uniform(-1, 10), rng.uniform(-1, 10)) for i in range(300)] + [(999, None, 1.0)]

    def brute(x, y):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    points = spark.createDataFrame(pts, "id int, x double, y double")
    areas = spark.createDataFrame([("a", ring), ("b", ring[:2]), ("c", [])], "area_id string, ring array<struct<x: double, y: double>>")
    got = {(r.id, r.area_id) for r in P.contained(points, areas).collect()}
    assert got == {(i, "a") for i, x, y in pts if x is not None and brute(x, y)}


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    cents = [(-5, 0), (0, 0), (99_900, 0), (1_000_000, 0.25), (10_000_000, 0.5), (100_000_000, 0.75), (10**9, 1), (10**11, 1)]
    for c, want in cents:
        assert abs(one(C.donation_strength(F.lit(c))) - want) < 1e-9
    assert one(C.donation_strength(F.lit(None).cast("bigint"))) == 0
    fy = lambda d: one(C.us_fiscal_year(F.lit(d).cast("date")))
    assert (fy("2023-09-30"), fy("2023-10-01"), fy(None)) == ("FY2023", "FY2024", "Unknown")
    assert abs(one(C.similarity(F.lit("Elizabeth Warren"), F.lit("warren"))) - 7 / 17) < 1e-9
    assert one(C.similarity(F.lit(""), F.lit("!!"))) == 0
    assert one(C.half_up(F.lit(-2.5))) == -2


def test_sources(spark, tmp_path):
    p = tmp_path / "cm.txt"
    p.write_bytes("C1|Añb|x|12.5|more\n\nC2|short\n|nokey|x|1|\nC1|later|y|abc|\n".encode("latin-1"))
    df = files.delimited(spark, str(p), {"id": 0, "name": 1, "kind": 2, "amount": 3}, "id", ("amount",))
    assert sorted(tuple(r) for r in df.collect()) == sorted([("C1", "Añb", "x", 12.5), ("C2", "short", None, 0.0), ("C1", "later", "y", 0.0)])
    assert {r.id: r.name for r in files.lookup(df, "id", "name").collect()} == {"C1": "later", "C2": "short"}
    h = tmp_path / "h.xml"
    h.write_text('<rollcall-vote><vote-data><recorded-vote><legislator name-id="A1" party="D">Ab</legislator><vote>Yea</vote></recorded-vote></vote-data></rollcall-vote>')
    assert [(r.member, r.vote) for r in files.house_votes(spark, str(h)).collect()] == [("A1", "yea")]
    s = tmp_path / "s.xml"
    s.write_text("<roll_call_vote><members><member><last_name>Fo</last_name><state>al</state><vote_cast>Nay</vote_cast></member></members></roll_call_vote>")
    assert [(r.name_key, r.vote) for r in files.senate_votes(spark, str(s)).collect()] == [("fo:AL", "nay")]
    j = tmp_path / "j"
    j.mkdir()
    (j / "1.json").write_text('{"members": [{"id": "a", "n": 1}, {"id": "b"}]}')
    (j / "2.json").write_text('{"other": 1}')
    assert {(r.id, r.n) for r in files.pages(spark, str(j), "struct<id: string, n: int>", "members").collect()} == {("a", 1), ("b", None)}
    n = tmp_path / "n.json"
    n.write_text('{"k": "a", "v": 1}\nbroken{\n{"k": "b", "v": 2}\n')
    assert {(r.k, r.v) for r in files.lines(spark, str(n), "k string, v int").collect()} == {("a", 1), ("b", 2)}


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    sinks.log_run(spark, f"{root}/log", "r1", "p", "running")
    sinks.log_run(spark, f"{root}/log", "r1", "p", "complete", 5)
    assert {r.pipeline: r.status for r in sinks.last_runs(spark, f"{root}/log", ["p", "q"]).collect()} == {"p": "complete", "q": "pending"}
    sinks.put_state(spark, f"{root}/state", "cursor", "1")
    sinks.put_state(spark, f"{root}/state", "cursor", "2")
    assert sinks.get_state(spark, f"{root}/state", "cursor") == "2" and sinks.get_state(spark, f"{root}/state", "none") is None


def test_streams(spark, tmp_path):
    from polispark.streaming import events as S

    src, root = tmp_path / "in", str(tmp_path / "out")
    rows = [(1, dt.datetime(2024, 1, 1, 10), 7, "view", 1.0, None), (2, dt.datetime(2024, 1, 1, 10, 20), 7, "view", 2.0, None), (3, dt.datetime(2024, 1, 2, 9), 7, "click", 3.0, None)]
    spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    take = lambda: S.incremental_upsert(S.read_events(spark, str(src)), root, ["event_id"], f"{tmp_path}/cp", "ts")
    assert take() == 1 and S.upserted(spark, root, S.EVENTS).count() == 3
    spark.createDataFrame([(3, dt.datetime(2024, 1, 2, 9), 8, "click", 9.0, None), (3, dt.datetime(2024, 1, 2, 8), 8, "click", 99.0, None), (4, dt.datetime(2024, 1, 3), 8, "view", 1.0, None)], S.EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    assert take() == 2
    assert {r.event_id: r.value for r in S.upserted(spark, root, S.EVENTS).collect()} == {1: 1.0, 2: 2.0, 3: 9.0, 4: 1.0}
    assert take() is None
    again = S.incremental_upsert(S.read_events(spark, str(src)), root, ["event_id"], f"{tmp_path}/cp2", "ts")  # a new checkpoint counts its batches anew
    assert again == 3 and S.upserted(spark, root, S.EVENTS).count() == 4
    limited = S.drained(spark, str(src), lambda x: S.over_limit(x, 1, "1 hour"), "limited")
    assert sorted((r.user_id, r.n) for r in limited.collect()) == [(7, 2)]


def test_streams_read_files_and_folders(spark, sf, tmp_path):
    from polispark.streaming import events as S

    folder = str(tmp_path / "events.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(folder)
    want = sorted(map(str, events.groupBy("user_id").count().collect()))
    for path in (f"{sf}/events.parquet", folder):
        got = S.drained(spark, path, lambda x: S.sessions(x, "6 hours"), "s")
        assert sorted(map(str, got.groupBy("user_id").agg(F.sum("n").alias("count")).collect())) == want
    assert S.drained(spark, folder, lambda x: S.windowed(x.where("event_id < 0")), "none").count() == 0


def test_json_is_merged(spark):
    old = spark.createDataFrame([("a", '{"x": 1, "y": {"z": [1, 2]}}'), ("b", None), ("c", "broken{"), ("d", '{"k": "v"}')], "id string, j string")
    new = spark.createDataFrame([("a", '{"x": 2, "w": null}'), ("b", '{"q": "r"}'), ("c", "{}")], "id string, p string")
    got = {r.id: r.j for r in U.merge_json(old, "j", new, ["id"], "p").collect()}
    import json

    assert json.loads(got["a"]) == {"x": 2, "w": None, "y": {"z": [1, 2]}} and json.loads(got["b"]) == {"q": "r"} and json.loads(got["c"]) == {} and got["d"] == '{"k": "v"}'


def test_last_write_and_pages(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9, 1), ("a", 2, 2)], "k string, v int, seq int")
    assert [(r.k, r.v) for r in U.upsert(old, new, ["k"], order="seq").collect()] == [("a", 2)]
    df = spark.range(25)
    seen, after = [], None
    while got := [r.id for r in U.keyset_page(df, "id", after, 10).collect()]:
        seen, after = seen + got, got[-1]
    assert seen == list(range(25))
    assert [r.id for r in U.changed_page(df.selectExpr("id", "-id AS at"), "at", -5, 0, 3).collect()] == [4, 3, 2]


def test_archives_and_roll_calls(spark, tmp_path):
    import zipfile

    a = tmp_path / "pas.zip"
    with zipfile.ZipFile(a, "w") as z:
        z.writestr("itpas2.txt", "C1|x|10\nC2|y|20\n")
        z.writestr("other.txt", "no")
    assert [r.value for r in files.zipped_lines(spark, str(a)).collect()] == ["C1|x|10", "C2|y|20"] and files.zipped_lines(spark, str(a), "other.txt").count() == 1
    h = tmp_path / "h.xml"
    h.write_text("<rollcall-vote><vote-metadata><congress>118</congress><rollcall-num>7</rollcall-num><legis-num>H R 5</legis-num><action-date>9-Jan-2023</action-date><vote-question>On Passage</vote-question><vote-result>Passed</vote-result></vote-metadata></rollcall-vote>")
    assert [(r.congress, r.roll, r.bill, r["at"], r.question) for r in files.house_roll(spark, str(h)).collect()] == [(118, 7, "H R 5", "9-Jan-2023", "On Passage")]
    s = tmp_path / "s.xml"
    s.write_text("<roll_call_vote><congress>118</congress><vote_number>3</vote_number><vote_date>January 9, 2023, 02:54 PM</vote_date><question>On the Nomination</question><vote_result>Confirmed</vote_result><document><document_type>PN</document_type><document_number>12</document_number></document></roll_call_vote>")
    assert [(r.roll, r.bill, r.question, r.chamber) for r in files.senate_roll(spark, str(s)).collect()] == [(3, "PN 12", "On the Nomination", "Senate")]
    c = tmp_path / "c.txt"
    c.write_text("1|C1|500|IND\n2|C1|499|IND\n3|C2|900|ORG\n4|C3|900|PAC\n|C1|900|IND\n")
    ok = spark.createDataFrame([("C1",), ("C3",)], "cm string")
    got = files.contributions(spark, str(c), {"id": 0, "cm": 1, "amount": 2, "kind": 3}, "id", "amount", 500.0, ("kind", ("IND", "ORG")), ("cm", ok))
    assert [r.id for r in got.collect()] == ["1"]


def test_texts_and_codes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(C.compact_usd(F.lit(x))) for x in (1_234_567_890_000, 1_250_000_00, 5_500_00, 99_900, -1_234, 0)] == ["$12.3B", "$1.3M", "$6K", "$999", "-$12", "$0"]
    assert [one(C.bytes_text(F.lit(x))) for x in (2048, 5 << 20, 3 << 30, 1 << 40)] == ["2 KB", "5.0 MB", "3.0 GB", "1.0 TB"]
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    assert [one(C.ago(F.lit(x).cast("timestamp"), now)) for x in (None, "2024-03-10 11:59:30", "2024-03-10 11:20:00", "2024-03-10 02:00:00", "2024-03-07 12:00:00", "2024-01-05 00:00:00")] == ["Never", "just now", "40m ago", "10h ago", "3d ago", "Jan 5"]
    assert [one(C.agent_class(F.lit(x))) for x in ("Googlebot/2.1", "Mozilla (iPhone; Mobile)", "Mozilla (iPad)", "Mozilla (X11)", None)] == ["bot", "mobile", "tablet", "desktop", "desktop"]
    assert one(C.lexemes(F.lit("Bridges repaired, rules ruled ruling: policies"))) == ["bridg", "repair", "rul", "rul", "rul", "policy"]
    table = spark.createDataFrame([(1, "oil", "gas"), (1, "oil", "petroleum"), (2, "farm", "crop insurance"), (3, "none", None)], "place int, label string, keyword string")
    found = C.rules(table)
    assert [one(C.first_match(F.lit(x), found, "other")) for x in ("Gas Pumps", "Gaston", "Petroleums", "the crop insurance fund")] == ["oil", "other", "oil", "farm"]


def test_full_text_and_ranks(spark):
    from polispark.plans import lookup as L

    df = spark.createDataFrame([(1, "Act on repairing bridges", "schools"), (2, "Notice of school meals", ""), (3, "School lunch", "act"), (4, None, None)], "id int, title string, summary string")
    ask = lambda q: {r.id: r["rank"] for r in L.fulltext(df, {"title": "A", "summary": "C"}, q).collect()}
    assert ask("school") == {1: 0.2, 2: 1.0, 3: 1.0} and ask('"repaired bridge"') == {1: 1.0} and ask("school -notices") == {1: 0.2, 3: 1.0}
    assert set(ask("bridge or lunch")) == {1, 3} and ask("acts schools") == {1: 1.2, 3: 1.2} and L.fulltext(df.limit(0), {"title": "A"}, "x").count() == 0


def test_bill_status(spark):
    from polispark.plans.records import bill_status

    cases = {
        "Became Public Law No: 118-1.": "enacted", "Signed by the President": "signed", "Vetoed by President.": "vetoed", "Passed Senate and House": "passed_both_chambers", "Passed House by voice vote": "passed_chamber",
        "Ordered to be Reported": "passed_committee", "Referred to the Committee": "in_committee", "Introduced": "introduced", None: "introduced",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string").withColumn("s", bill_status(F.col("a")))
    assert {r.a: r.s for r in df.collect()} == cases
