import itertools

import numpy as np

from polispark.llm import language as L
from polispark.llm import queries as Q

TEXT = {
    "en": "Nobody asked local shop owners what they think about flood insurance.", "es": "Nadie preguntó a nuestros vecinos qué opinan sobre la privacidad de los datos.",
    "de": "Wir halten diese Maßnahme für gerecht und bitten um eine neue Beratung.", "pt": "Acreditamos que esta medida é confusa e deve ser revista.",
    "ru": "Мы просим, чтобы надзорный орган опубликовал все счета.", "zh": "没有人问过护士对饮用水的看法。",
}


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    vocab = {b" ": 0, b"a": 1, b"b": 2, b" a": 3, b"ab": 4, b"ba": 5, b"aba": 6}
    prob = rng.random((7, len(L.LANGUAGES)))
    for word in ("a", "ab", "abab", "babab"):
        text = b" " + word.encode()
        total = np.zeros(len(L.LANGUAGES))
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(at)]
            if all(p in vocab for p in parts):
                total += np.prod([prob[vocab[p]] for p in parts], axis=0)
        assert np.allclose(L.log_word(word, vocab, prob), np.log(total))


def test_labels():
    for label, want in {"en": "en", "EN_us": "en", "es-MX": "es", "German": "de", "zho": "zh", "zh-Hans": "zh", " fra ": "fr", "nl": None, "und": None, "": None, None: None, "??": None}.items():
        assert L.label_language(label) == want


def test_passages(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [
        (-1, TEXT["en"] + " " + TEXT["es"], "en"), (-2, TEXT["en"].upper(), "de"), (-3, TEXT["en"] + ' (the "Casa Aberta" desk) "Русский дом"', "English"), (-4, None, "en"), (-5, "", None), (-6, " \n\t", "fr"), (-7, "123 !!! $$", "fr"),
        (-8, TEXT["zh"] + TEXT["ru"], None), (-9, (TEXT["pt"] + " ") * 3000, "es-ES"), (-10, TEXT["de"], "??"), (-10, TEXT["de"], "??"),
    ]
    docs = base.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).selectExpr("*", "'q' AS label_lang", "1 AS seg")
    found = L.segments(docs).cache()
    got = {}
    for r in L.unnamed(found).where("doc_id < 0").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == {-1: {"es"}, -2: {"en"}, -8: {"zh", "ru"}, -9: {"pt"}, -10: {"de"}}
    docs = {r.doc_id: (r.lang, r.n_langs) for r in L.documents(found).where("doc_id < 0").collect()}
    assert docs[-2] == ("en", 1) and docs[-9] == ("pt", 1) and docs[-8][1] == 2 and -4 not in docs
    assert found.where("confidence < 0.5 OR confidence > 1").count() == 0


def test_held_out_labels(spark):
    """Most labels are right: a model learnt from half of the documents must agree with nearly all of those of the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").collect()
    held = docs.where("doc_id % 2 = 1")
    main = {r.doc_id: r.lang for r in L.documents(L.segments(held, labelled=learn)).collect()}
    pairs = [(L.label_language(r.lang), main[r.doc_id]) for r in rest if L.label_language(r.lang) and r.doc_id in main]
    assert len(pairs) > 300 and sum(a == b for a, b in pairs) > 0.85 * len(pairs)


def test_words_of_any_script_and_length(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [
        (-1, "قرر مجلس المدينة أمس أن الجسر الجديد لن يبنى قبل العام المقبل.", None), (-2, "Το δημοτικό συμβούλιο αποφάσισε χθες ότι η νέα γέφυρα θα χτιστεί του χρόνου.", None),
        (-3, "시의회는 어제 새 다리를 내년까지 짓지 않기로 결정했습니다.", "en"), (-4, TEXT["zh"].replace("。", "") * 40, None), (-5, "x" * 30_000 + " " + TEXT["de"], None), (-6, "市議会は昨日、新しい橋を来年まで建設しないことを決定しました。", None),
    ]
    found = L.segments(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labelled=base).cache()
    main = {r.doc_id: r.lang for r in L.documents(found).collect()}
    assert main[-1] == main[-2] == main[-3] == L.OTHER and main[-4] == "zh" and -6 in main
    assert {(r.doc_id, r.lang) for r in L.unnamed(found).collect()} >= {(-4, "zh"), (-5, "de")} and L.unnamed(found).where(f"lang = '{L.OTHER}'").count() == 0


def test_every_piece_is_tried():
    """A word is summed over its segmentations into pieces of any length, on logarithms where it is long."""
    vocab = L.pieces()
    longest = max(vocab, key=lambda p: (len(p), p))
    assert any(longest == longest[i:j] for i, j, p in [(0, len(longest), 0)]) and len(longest) > 16
    n, edges = L.lattice("ab" * 20, L.Vocabulary({b" ": 0, b"a": 1, b"b": 2, b"ab" * 20: 3}))
    assert (1, 41, 3) in edges
    rng = np.random.default_rng(4)
    prob = rng.random((len(vocab), len(L.LANGUAGES))) / len(vocab)
    for word in ("verantwortung", "没有人问过护士"):
        n, edges = L.lattice(word, vocab)
        assert np.allclose(np.log(L.forward(n, edges, prob)[n]), L.forward_log(n, edges, prob)[n])
    assert np.isfinite(L.log_word("没有人问过护士" * 300, vocab, prob)).all()


class _Fixed:
    def __init__(self, rows):
        self.rows, self.sizes = rows, np.ones(len(rows))

    def ids(self, words):
        return np.arange(len(words))


def test_shortcut_is_exact():
    """The best path equals that of a Viterbi pass over single words, also where changes within sentences nearly pay."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        sizes = rng.integers(1, 14, rng.integers(1, 5))
        starts = [0, *np.cumsum(sizes)[:-1].tolist()]
        n, k = int(sizes.sum()), 4
        e = rng.normal(0, 1.2, (n, k)) + 2.0 * (rng.integers(0, k, n // 5 + 1)[np.arange(n) // 5][:, None] == np.arange(k))
        v = e[0].copy()
        for t in range(1, n):
            cost = L.BETWEEN if t in starts else L.WITHIN
            v = np.maximum(v, v.max() - cost) + e[t]
        got, total, last = L.passages(["w"] * n, starts, _Fixed(e)), 0.0, None
        at = 0
        for lang, words, _, _, _ in got:
            m = round(words)
            total += e[at : at + m, lang].sum() - (0 if last is None else L.BETWEEN if at in starts else L.WITHIN)
            at, last = at + m, lang
        assert at == n and abs(total - v.max()) < 1e-9


def test_no_labels(spark, sf):
    docs = spark.createDataFrame([(1, TEXT["en"], None)], "doc_id bigint, text string, lang string")
    assert L.segments(docs).count() == 0 and L.segments(docs.limit(0)).count() == 0


def test_queries(spark, sf):
    assert Q.p10_found(spark, sf).count() > 0 and Q.p10_documents(spark, sf).count() > 0
