import random

import numpy as np
from pyspark.sql import functions as F

from polispark.llm import linkage as K

ROW = "src string, key string, name string, state string, district string, level string, party string, year int"


def people(spark, n=160, seed=6):
    """Namesakes in other states are other people; the true pairs are those of one index."""
    rng = random.Random(seed)
    last = ["Farnishrude", "Calverundhurst", "Tamathton", "Ostoondottir", "Weximkamp", "Pendleston", "Marshelby", "Lorickgate"]
    first = [("Robert", "Bob"), ("Katherine", "Kate"), ("Anthony", "Tony"), ("Kofi", "Kofi")]
    states = list(K.STATES)
    rows, truth = [], set()
    used = set()
    for i in range(n):
        while True:
            ln, (fn, nk), st = rng.choice(last), rng.choice(first), rng.choice(states)
            if (ln, fn, st) not in used:
                used.add((ln, fn, st))
                break
        party, year, dist = rng.choice("DR"), rng.randrange(1990, 2020), str(rng.randrange(1, 40))
        j = rng.randrange(2, len(ln) - 2)
        typo = ln[:j] + ln[j + 1] + ln[j] + ln[j + 2:] if rng.random() < 0.2 else ln
        rows.append(("a", f"a{i:03d}", f"{fn} {ln}", st if rng.random() < 0.95 else None, dist, "fl", party, year))
        rows.append(("b", f"b{i:03d}", f"{typo.upper()}, {rng.choice([fn, nk]).upper()}", st, dist if rng.random() < 0.8 else None, "fl", party if rng.random() < 0.9 else None, year))
        truth.add((f"a{i:03d}", f"b{i:03d}"))
    return spark.createDataFrame(rows + rows[:5], ROW), truth


def test_accuracy(spark):
    df, truth = people(spark)
    got = {(r.key_a, r.key_b): r.confidence for r in K.link(K.records(df.selectExpr("*", "1 AS votes"))).collect()}
    hit = len(truth & set(got))
    assert hit >= 0.93 * len(truth) and hit >= 0.97 * len(got)
    assert all(0.5 <= c <= 1 for c in got.values())


def test_hot_blocks_are_split(spark, monkeypatch):
    """One name in one state for many people: told apart by district, year or initial."""
    rows = []
    for i in range(60):
        rows.append(("a", f"h{i:03d}", "Kofi Farnishrude", "OH", str(i), "fl", "D", 1900 + i % 7))
        rows.append(("b", f"i{i:03d}", "FARNISHRUDE, KOFI", "OH", str(i), "fl", "D", 1900 + i % 7))
    df, _ = people(spark, 120)
    recs = K.records(df.unionByName(spark.createDataFrame(rows, ROW)))
    plain = {(r.key_a, r.key_b) for r in K.link(recs).collect()}
    monkeypatch.setattr(K, "SPLIT_ROWS", 40)
    pairs = K.candidates(recs).collect()
    assert len(pairs) == len({(r.key_a, r.key_b) for r in pairs})
    split = {(r.key_a, r.key_b) for r in K.link(recs).collect()}
    hot = {(f"h{i:03d}", f"i{i:03d}") for i in range(60)}
    assert hot <= split and len(plain ^ split) <= 0.05 * len(plain)


def test_split_blocks_keep_every_pair(spark, monkeypatch):
    """A source without district, party and year, years that differ by one, records without a state: as without a split."""
    rows = []
    for i in range(50):
        rows.append(("a", f"h{i:03d}", "Kofi Farnishrude" if i % 2 else f"Kofi {chr(65 + i % 26)} Farnishrude", "OH", str(i), "fl", "D", 1950 + i))
        rows.append(("b", f"i{i:03d}", "FARNISHRUDE, KOFI", "OH" if i % 5 else None, None, "fl", None, None))
        rows.append(("c", f"j{i:03d}", f"FARNISHRUDE, KOFI {chr(65 + i % 26)}", "OH", None, "fl", "R", 1951 + i))
    df, _ = people(spark, 60)
    recs = K.records(df.unionByName(spark.createDataFrame(rows, ROW)))
    plain = sorted(map(tuple, K.candidates(recs).collect()))
    monkeypatch.setattr(K, "SPLIT_ROWS", 40)
    monkeypatch.setattr(K, "OUT_PAIRS", 700, raising=False)
    assert sorted(map(tuple, K.candidates(recs).collect())) == plain
    assert len({p[:2] for p in plain if p[0][0] in "hij" and p[1][0] in "hij"}) == 3 * 50 * 50


def test_generations_and_nulls(spark):
    rows = [
        ("a", "1", "Lars Farnishrude Sr.", "OH", "3", "fl", "D", 2000), ("b", "2", "FARNISHRUDE, LARS JR", "OH", "3", "fl", "D", 2000), ("a", "3", None, "OH", None, None, None, None),
        ("b", None, "Lars Farnishrude", "OH", None, None, None, None), ("b", "4", "", None, None, None, None, None), ("a", "5", "x" * 9000, None, None, None, None, None),
    ]
    df, _ = people(spark, 60)
    got = K.link(K.records(df.unionByName(spark.createDataFrame(rows, ROW)))).collect()
    assert not {"1", "2", "3", "4", "5"} & {k for r in got for k in (r.key_a, r.key_b)}


def test_no_given_name_is_cut_from_the_lexicon(spark, monkeypatch):
    monkeypatch.setattr(K, "LEXICON", 1, raising=False)
    names = [f"{s}, {g}" for s in ("Anders", "Bolton", "Carver") for g in ("Ulva", "Kwabena")] + ["Dalton, Ulva", "Yarooque Kwabena"]
    df = spark.createDataFrame([("a", str(i), n, "OH", None, None, None, None) for i, n in enumerate(names)], ROW)
    assert {r.key: (r.surname, r.given) for r in K.records(df).collect()}[str(len(names) - 1)] == ("yarooque", "kwabena")


def test_empty(spark):
    assert K.link(K.records(spark.createDataFrame([], ROW))).count() == 0


def test_label_model_learns_who_is_right():
    """Two functions that copy each other and one that is better: the better one must win where they differ."""
    rng = np.random.default_rng(1)
    counts = {}
    names = list(K.VOTES)
    for _ in range(20_000):
        y = rng.random() < 0.3
        v = ["0"] * len(names)
        for f, acc in (("surname", 0.97), ("given", 0.95), ("state", 0.98), ("district", 0.9), ("year", 0.7)):
            v[names.index(f)] = "+" if (rng.random() < acc) == y else "-"
        v[names.index("party")] = v[names.index("year")]
        counts["".join(v)] = counts.get("".join(v), 0) + 1
    pats = sorted(counts)
    post = dict(zip(pats, K.LabelModel(pats, [counts[p] for p in pats]).posterior()))
    pick = lambda **kw: "".join(kw.get(n, "0") for n in names)
    assert post[pick(surname="+", given="+", state="+", district="+", party="-", year="-")] > 0.9
    assert post[pick(surname="-", given="-", state="-", district="-", party="+", year="+")] < 0.1


def test_links_do_not_depend_on_the_split(spark, monkeypatch):
    """Records without district, year and middle initial stay in hot blocks, and so do their links."""
    df, truth = people(spark, 60)
    recs = K.records(df.withColumn("district", F.when(F.col("src") == "b", None).otherwise(F.col("district"))).withColumn("year", F.when(F.col("src") == "b", None).otherwise(F.col("year"))))
    out = []
    for rows in (5_000, 40, 3):
        monkeypatch.setattr(K, "SPLIT_ROWS", rows)
        out.append(sorted((r.key_a, r.key_b, round(r.confidence, 6)) for r in K.link(recs).collect()))
    assert out[0] == out[1] == out[2] and len({p[:2] for p in out[0]} & truth) >= 0.9 * len(truth)


def test_equal_records_are_compared_once(spark):
    """A thousand records of one name: one profile a source, no match, and as many candidates as pairs of records."""
    rows = [(s, f"{s}{i:04d}", "Kofi Farnishrude", "OH", None, "fl", None, None) for s in "xy" for i in range(40)]
    df, _ = people(spark, 40)
    recs = K.records(df.unionByName(spark.createDataFrame(rows, ROW)))
    prof = K.profiles(recs)
    assert prof.where("src IN ('x', 'y')").agg(F.sum("n")).first()[0] == 80 and prof.where("src IN ('x', 'y')").count() == 2
    assert K.candidates(recs).where("src_a = 'x' AND src_b = 'y'").count() == 1600
    assert K.link(recs).where("src_a = 'x' AND src_b = 'y'").count() == 0
    assert K.link(recs, many=("y",)).where("src_a = 'x' AND src_b = 'y'").count() == 0


def test_links_through_two_records(spark):
    kept = [("a1", "b1", "a", "b", 0.9), ("b1", "c1", "b", "c", 0.9), ("c1", "d1", "c", "d", 0.9)]
    df = spark.createDataFrame(kept, "key_a string, key_b string, src_a string, src_b string, confidence double")
    facts = spark.createDataFrame([(f"{x}1", x, "OH", "", "") for x in "abcd"], "key string, src string, state string, middle string, tag string")
    once = df.unionByName(K._through(df, facts)).distinct()
    twice = {(r.key_a, r.key_b) for r in once.unionByName(K._through(once, facts)).collect()}
    assert ("a1", "d1") in twice and ("a1", "d1") not in {(r.key_a, r.key_b) for r in once.collect()}
