import itertools

import numpy as np
from pyspark.sql import functions as F

from polispark.llm import leakage as L
from polispark.llm import queries as Q


def grams(text):
    forms = {text, L._MARKUP.sub(" ", text)}
    return {tuple(w[i : i + 10]) for f in forms for w in [L.words(f)] for i in range(len(w) - 9)}


def test_found_equals_brute_force(spark, sf):
    docs = [(r.doc_id, grams(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    items = [(r.item_id, grams(r.text)) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    want = {(d, i) for d, g in docs for i, h in items if g & h}
    got = {tuple(r) for r in Q.p9_found(spark, sf).collect()}
    assert got == want and want


def test_forms(spark):
    item = "One two three four five six seven eight nine ten eleven"
    rows = [
        (1, item.upper().replace(" ", ", ")), (2, "One two three four five six seven eight nine"), (3, None), (4, ""), (5, "x " * 40),
        (6, "öne two thrée fo­ur five <p>six</p> seven eight nine ten"), (7, "one two three FOUR five sick seven eight nine ten eleven"), (8, item), (8, item),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS pos")
    items = spark.createDataFrame([(10, item), (11, None), (12, "short")], "item_id bigint, text string")
    met = L.hits(docs, items)
    assert {(r.doc_id, r.item_id) for r in met.where("slips = 0").collect()} == {(1, 10), (6, 10), (8, 10)}
    sums = {r.doc_id: (r.slips, r.exact, r.first_word, r.last_word) for r in L.leaked(met).collect()}
    assert sums[7] == (1, False, 0, 10) and sums[8] == (0, True, 0, 10) and 2 not in sums


def test_every_single_substitution_is_met():
    for at in range(L.SPAN):
        assert any(mask[at] == "0" for mask in L.MASKS)


def test_every_placement_of_three_substitutions_is_met(spark):
    item = [f"w{i}" for i in range(L.SPAN)]
    at = list(itertools.combinations(range(L.SPAN), 3))
    rows = [(n, " ".join("other" if i in gone else w for i, w in enumerate(item))) for n, gone in enumerate(at)]
    rows.append((len(at), " ".join(w if i > 3 else "other" for i, w in enumerate(item))))  # four are too many
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    met = L.hits(docs, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"), masks=L.COVER).collect()
    assert sorted((r.doc_id, r.slips) for r in met) == [(n, 3) for n in range(len(at))]


def test_overlaps_equal_brute_force(spark, sf):
    """n_windows and slips of some documents, compared window by window."""
    forms = lambda t: dict.fromkeys((t, L._MARKUP.sub(" ", t)))
    grams = lambda t: {(i, tuple(w[i : i + L.SPAN])) for f in forms(t) for w in [L.words(f)] for i in range(len(w) - L.SPAN + 1)}
    items = [(r.item_id, np.array([w for _, w in grams(r.text)]), [i for i, _ in grams(r.text)]) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect() if len(L.words(r.text)) >= L.SPAN]
    want = {}
    some = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").where("text IS NOT NULL").limit(12).collect()
    for d in some:
        for i, words, at in items:
            found = [(pos, q, n) for pos, w in grams(d.text) for q, n in zip(at, (words != np.array(w)).sum(axis=1).tolist()) if n <= L.SPAN // 3]
            if found:
                want[d.doc_id, i] = (len({f[:2] for f in found}), min(f[2] for f in found))
    got = Q.p9_overlaps(spark, sf).where(F.col("doc_id").isin([d.doc_id for d in some])).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.slips) for r in got} == want and want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert L.hits(docs, items).count() == 0
