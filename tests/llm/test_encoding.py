import random

from hypothesis import given, settings
from hypothesis import strategies as st

from polispark.llm import encoding as E

TOK = E.load()
MIXED = st.text(alphabet=st.sampled_from(list("abc'strevmld 0129  \n\t.,<|>éß没有人ж 　")), max_size=300)


def direct(text):
    return TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(MIXED, st.integers(1, 9), st.integers(1, 5))
def test_tree_equals_direct(text, size, window):
    got = E.reduce_tree(text, TOK, size, window)
    assert got.text == text
    assert got.ids.tolist() == direct(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(MIXED, st.text(max_size=60)))
def test_ranks_equal_merges(text):
    assert E.ranked().encode_ordinary(text) == direct(text)


@settings(max_examples=150, deadline=None)
@given(MIXED, MIXED, MIXED)
def test_join_is_associative(a, b, c):
    x, y, z = (E.leaf(t, TOK) for t in (a, b, c))
    left, right = E.join(E.join(x, y, TOK, 2), z, TOK, 2), E.join(x, E.join(y, z, TOK, 2), TOK, 2)
    assert left.ids.tolist() == right.ids.tolist() == direct(a + b + c)
    assert left.starts.tolist() == right.starts.tolist()


def test_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice(["word ", "don't ", "没有人问过", "  \n", "12345 ", "é"]) for _ in range(3000))
    run = "x" * 5000 + " " * 3000
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, long), (5, long), (6, run), (7, "tie"), (8, "tie")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS ids", "1 AS part")
    got = {r.doc_id: list(r.ids) for r in E.encode(df, spread=2000, size=256).collect()}
    assert got == {k: direct(t) if t else [] for k, t in rows}
    back = E.decode(E.encode(df, spread=2000)).collect()
    assert {r.doc_id: r.text for r in back} == {k: t or "" for k, t in rows}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert E.encode(df).count() == 0
    assert E.decode(E.encode(df)).count() == 0


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: direct(r.text) if r.text else [] for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in E.encode(docs, size=64).collect()} == want
