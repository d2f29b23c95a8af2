import random

from polispark.llm import aliases as A
from polispark.llm import canonical as K

ENTRIES = [(1, "industry", "Crop Farming"), (2, "industry", "Oil, Gas and Pipelines"), (3, "industry", "Retail Stores"), (10, "organization", "Kestim Records Employees Federation"), (11, "organization", "Kestim Dental Employees Federation"), (12, "organization", "Polan Casinos Holdings")]
CASES = {
    ("industry", "Crop Farming"): 1, ("industry", " GROWERS (9)"): 1, ("industry", "crop-framing"): 1, ("industry", "Oil Gas/Pipelines;"): 2, ("industry", "petroleuum"): 2, ("industry", "shoppping"): 3,
    ("industry", "antique clocks"): 0, ("industry", ""): 0, ("industry", "  "): 0, ("industry", "x" * 50_000): 0, ("industry", "stores " * 4000): 0, ("other", "Crop Farming"): 0,
    ("organization", "KESTIM RECS EMP. FED."): 10, ("organization", "Employees Federation of Kestim Dntl, Inc."): 11, ("organization", "The Kestmi Records Employes Federation"): 10,
    ("organization", "Kestim Glass Employees Federation"): 0, ("organization", "Polan Csno Holding Co"): 12, ("organization", "Polan Casinos Institute"): 0,
}


def test_cases(spark):
    rows = [*CASES, *CASES, ("industry", None)]
    values = spark.createDataFrame(rows, "kind string, raw_value string").selectExpr("*", "7 AS entry_id", "'z' AS way")
    entries = spark.createDataFrame(ENTRIES, "entry_id bigint, kind string, label string")
    got = {(r.kind, r.raw_value): r.entry_id for r in K.map_values(values, entries, A.table(spark)).collect()}
    assert got == CASES


def test_empty(spark):
    values = spark.createDataFrame([("industry", "Crop Farming")], "kind string, raw_value string")
    entries = spark.createDataFrame([], "entry_id bigint, kind string, label string")
    assert [r.entry_id for r in K.map_values(values, entries).collect()] == [0]
    assert K.map_values(values.limit(0), entries).count() == 0


def test_every_label_survives_one_slip(spark, sf):
    rng = random.Random(2)
    entries = spark.read.parquet(f"{sf}/canonical_entries.parquet").collect()
    for kind in ("industry", "occupation", "organization"):
        own = [(r.entry_id, r.label) for r in entries if r.kind == kind]
        named = {r.label: r.entry_id for r in entries if r.kind == kind}
        m = K.Matcher([(e, label, True) for e, label in own] + [(named[r.label], r.alias, False) for r in A.table(spark).collect() if r.kind == kind and r.label in named])
        right = total = 0
        for entry, label in own:
            assert m.match(label)[0] == entry and m.match(label.upper() + ".")[0] == entry
            i = rng.randrange(1, len(label) - 1)
            total, right = total + 1, right + (m.match(label[:i] + label[i + 1:])[0] == entry)
        assert right >= 0.97 * total


def test_longest_mention_wins():
    m = K.Matcher([(1, "Bus Driver", True), (2, "School Bus Driver", True), (3, "Driver", True)])
    assert m.match("school bus driver")[0] == 2 and m.match("bus driver")[0] == 1
    assert K.one_slip("abcd", "abdc") and K.one_slip("abcd", "abd") and K.one_slip("abd", "abcd") and not K.one_slip("abcd", "badc")
    assert K.abbreviates("dntl", "dental") and not K.abbreviates("dental", "dental") and not K.abbreviates("xd", "dental")


def test_embedded_mentions_win(spark, sf):
    """A mention counts however little of the value it covers; a part of a misspelt phrase does not."""
    entries = spark.read.parquet(f"{sf}/canonical_entries.parquet")
    want = {
        ("occupation", "senior partner and attorney in private practice"): "Attorney", ("occupation", "self employed software engineer contractor"): "Software Engineer",
        ("occupation", "veterinarian large animal clinic"): "Veterinarian", ("occupation", "head of the civil engineer department"): "Civil Engineer",
        ("industry", "manufacturers of beer wine and spirits worldwide"): "Beer, Wine and Spirits", ("occupation", "animl doctor"): "Veterinarian",
    }
    values = spark.createDataFrame(list(want), "kind string, raw_value string")
    labels = {r.entry_id: r.label for r in entries.collect()}
    got = {(r.kind, r.raw_value): (labels.get(r.entry_id), r.confidence) for r in K.map_values(values, entries, A.table(spark)).collect()}
    assert {k: v for k, (v, _) in got.items()} == want and all(0 < c < 1 for _, c in got.values())


def test_long_lists_in_shards(spark, sf, monkeypatch):
    """The same result from any number of shards and blocks."""
    values = spark.read.parquet(f"{sf}/financial_relationships.parquet").selectExpr("'industry' AS kind", "industry AS raw_value")
    values = values.unionByName(spark.read.parquet(f"{sf}/fec_contributions.parquet").selectExpr("'occupation' AS kind", "contributor_occupation AS raw_value"))
    values = values.unionByName(spark.createDataFrame([*CASES, ("industry", None)], "kind string, raw_value string"))
    entries = spark.read.parquet(f"{sf}/canonical_entries.parquet")
    rows = lambda: sorted(tuple(r)[:3] + (round(r.confidence, 6), r.way) for r in K.map_values(values, entries, A.table(spark)).collect())
    plain = rows()
    monkeypatch.setattr(K, "MAX_ENTRIES", 10)
    monkeypatch.setattr(K, "SHARD_ROWS", 90)
    monkeypatch.setattr(K, "BLOCK_ROWS", 200)
    assert rows() == plain and len(plain) > 300
