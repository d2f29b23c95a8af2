"""Records of one person in several sources, linked by a label model.

Records that say the same are one profile. Profiles that share a family name up to one slip, an initial and a state (or lack the
state) are candidates. On each pair, labelling functions compare single attributes and vote match (+), no match (-) or abstain (0). Nothing is labelled: a
generative model explains the votes by a hidden class and learns, per class, how each function votes and on which other
function its vote depends (a maximum spanning tree of their conditional mutual information, learnt anew in every
iteration of expectation maximisation). Its posterior is the confidence. Vote patterns are few, whatever the pairs; only
their counts reach the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polispark.llm import names as N
from polispark.llm.variants import _given_slot, with_known
from polispark.operators.skew import skew_join
from polispark.session import durable

#: Confidence from which a pair is a match.
MATCH = 0.5
ITERATIONS = 60

#: States by their postal codes.
STATES = dict(x.split(":") for x in (
    "AL:alabama AK:alaska AZ:arizona AR:arkansas CA:california CO:colorado CT:connecticut DE:delaware DC:district_of_columbia FL:florida GA:georgia HI:hawaii ID:idaho IL:illinois IN:indiana IA:iowa KS:kansas "
    "KY:kentucky LA:louisiana ME:maine MD:maryland MA:massachusetts MI:michigan MN:minnesota MS:mississippi MO:missouri MT:montana NE:nebraska NV:nevada NH:new_hampshire NJ:new_jersey NM:new_mexico NY:new_york "
    "NC:north_carolina ND:north_dakota OH:ohio OK:oklahoma OR:oregon PA:pennsylvania RI:rhode_island SC:south_carolina SD:south_dakota TN:tennessee TX:texas UT:utah VT:vermont VA:virginia WA:washington "
    "WV:west_virginia WI:wisconsin WY:wyoming PR:puerto_rico"
).split())

#: Profiles of a block from which its pairs are spread over several tasks.
SPLIT_ROWS = 5_000

ATTRIBUTES = ["surname", "given", "middle", "tag", "nick", "state", "district", "level", "party", "year"]
_RECORD = "src string, key string, surname string, given string, middle string, tag string, nick string, state string, district string, level string, party string, year int, forms array<string>"


def records(rows: DataFrame) -> DataFrame:
    """rows (src, key, name, state, district, level, party, year) with the name parsed, and `forms`, the given names that it may
    stand for; rows without a name or key are left out, repeated rows are merged. Null attributes stay null."""
    rows = rows.where(F.col("name").isNotNull() & F.col("key").isNotNull()).distinct()

    def slot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": [w for w in map(_given_slot, pdf["name"]) if w]})

    top = rows.select("name").mapInPandas(slot, "word string").groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")
    lex = top.select("word", F.lit(True).alias("given"), F.lit(False).alias("trade"))
    known = durable(with_known(rows.select("name", F.lit(False).alias("is_org")).distinct(), lex).select("name", F.col("given").alias("_known")), "known")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, key, name, state, district, level, party, year, known in pdf.itertuples(index=False, name=None):
                x = N.person(name, frozenset(() if known is None else known))
                if x.kind != "none" and x.surname:
                    forms = sorted(N.formal(x.core) | (N.formal(x.nick) if x.nick else set()))
                    out.append((src, key, x.surname, x.core, x.middle, x.tag, x.nick, state, district, level, party, None if pd.isna(year) else int(year), forms))
            yield pd.DataFrame(out, columns=["src", "key", *ATTRIBUTES, "forms"]).astype({"year": "Int64"})

    rows = skew_join(rows.select("src", "key", "name", "state", "district", "level", "party", "year"), known, ["name"], "left")
    return rows.select("src", "key", "name", "state", "district", "level", "party", "year", "_known").mapInPandas(run, _RECORD)


def _signature() -> Column:
    return F.md5(F.to_json(F.struct("src", *ATTRIBUTES)))


def profiles(recs: DataFrame) -> DataFrame:
    """pid, sig, src, ATTRIBUTES, forms, n: what one or more (n) records of a source say. Records that say the same are compared once."""
    got = recs.groupBy(_signature().alias("sig"), "src", *ATTRIBUTES, "forms").agg(F.count_distinct("key").alias("n"))
    return durable(got.withColumn("pid", F.monotonically_increasing_id()), "profiles")  # written, so the numbers stay


def _near() -> Column:
    """Hashes of the family name, and of what is left of it without one letter, with each initial of the given names."""
    name, n = F.col("surname"), F.length("surname")
    less = F.when(n >= 5, F.sequence(F.lit(0), n)).otherwise(F.array(F.lit(0)))  # 0 leaves no letter out
    cut = lambda i: F.when(i == 0, name).otherwise(F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, n)))
    initials = F.array_distinct(F.transform("forms", lambda f: F.substring(f, 1, 1)))
    return F.array_distinct(F.flatten(F.transform(initials, lambda x: F.transform(less, lambda i: F.xxhash64(cut(i), x)))))


def candidate_pairs(prof: DataFrame) -> DataFrame:
    """pid_a, pid_b of profiles of different sources (src_a < src_b) that share a family name up to one slip and an initial, and
    the state, or one of which lacks the state. Each pair once.

    Pairs come from joins on the hashed name, with the state where both have it; blocks of more than SPLIT_ROWS are salted. Only
    numbers travel.
    """
    keyed = durable(prof.select("pid", "src", "state", F.explode(_near()).alias("near")), "keyed")
    named = lambda df, end, *cols: df.select(*cols, F.col("pid").alias(f"pid_{end}"), F.col("src").alias(f"src_{end}"))
    full, lack = keyed.where("state IS NOT NULL"), keyed.where("state IS NULL")
    same = skew_join(named(full, "a", "near", "state"), named(full, "b", "near", "state"), ["near", "state"], "inner", most=SPLIT_ROWS)
    open_ = skew_join(named(keyed, "a", "near"), named(lack, "b", "near"), ["near"], "inner", most=SPLIT_ROWS)
    back = open_.select(F.col("pid_b").alias("pid_a"), F.col("src_b").alias("src_a"), F.col("pid_a").alias("pid_b"), F.col("src_a").alias("src_b"))
    cols = ["pid_a", "src_a", "pid_b", "src_b"]
    return same.select(cols).unionByName(open_.select(cols)).unionByName(back).where("src_a < src_b").select("pid_a", "pid_b").distinct()


def _sign(plus: Column, known: Column) -> Column:
    return F.when(~known, "0").when(plus, "+").otherwise("-")


def _votes() -> dict[str, Column]:
    """What each function says of the profiles a and b: + match, - no match, 0 abstains; of generations 1: only one has any."""
    a, b = (lambda f, e=e: F.col(f"{e}.{f}") for e in "ab")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    equal = lambda f: _sign(a(f) == b(f), ~blank(a(f)) & ~blank(b(f)))
    initials = lambda c: F.transform(c("forms"), lambda f: F.substring(f, 1, 1))
    written = F.least(F.length(a("given")), F.length(b("given"))) > 1
    where, chamber = (lambda c: F.substring(c("level"), 1, 1)), (lambda c: F.substring(c("level"), 2, 1))  # level: where (f, s or o for others) and chamber (l, u or ?)
    office = F.when(blank(a("level")) | blank(b("level")), "0").when(where(a) != where(b), "-").when((chamber(a) == "?") | (chamber(b) == "?") | (chamber(a) != chamber(b)), "0").otherwise("+")
    return {
        "surname": F.when(a("surname") == b("surname"), "+").otherwise("-"),
        "given": F.when(written, F.when(F.arrays_overlap(a("forms"), b("forms")), "+").otherwise("-")).when(F.arrays_overlap(initials(a), initials(b)), "0").otherwise("-"),
        "middle": equal("middle"),
        "generation": F.when(blank(a("tag")) & blank(b("tag")), "0").when(blank(a("tag")) | blank(b("tag")), "1").when(a("tag") == b("tag"), "+").otherwise("-"),
        "state": equal("state"), "district": equal("district"), "office": office, "party": equal("party"),
        "year": _sign(F.abs(a("year") - b("year")) <= 2, a("year").isNotNull() & b("year").isNotNull()),
    }


#: The functions, in the order of their signs.
VOTES = ("surname", "given", "middle", "generation", "state", "district", "office", "party", "year")


def voted(prof: DataFrame) -> DataFrame:
    """candidate_pairs with src_a, src_b, n_a, n_b and votes, the signs of all functions in a row."""
    pairs = found = durable(candidate_pairs(prof), "candidates")
    cols = F.struct("src", "n", *ATTRIBUTES, "forms")
    for end in "ab":
        pairs = skew_join(pairs, prof.select(F.col("pid").alias(f"pid_{end}"), cols.alias(end)), [f"pid_{end}"], "inner", sketch=found)
    signs = _votes()
    return pairs.select("pid_a", "pid_b", F.col("a.src").alias("src_a"), F.col("b.src").alias("src_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.concat(*[signs[v] for v in VOTES]).alias("votes"))


def members(recs: DataFrame, prof: DataFrame) -> DataFrame:
    """pid, key of all records."""
    return skew_join(recs.select(_signature().alias("sig"), "key").distinct(), prof.select("sig", "pid"), ["sig"], "inner").select("pid", "key")


def expanded(pairs: DataFrame, recs: DataFrame, prof: DataFrame) -> DataFrame:
    """Pairs of profiles as pairs of records: key_a < key_b, src_a, src_b and the other columns."""
    at = durable(members(recs, prof), "members")
    for end in "ab":
        pairs = durable(pairs, "side")  # read for its hot profiles and for the join
        pairs = skew_join(at.select(F.col("pid").alias(f"pid_{end}"), F.col("key").alias(f"key_{end}")), pairs, [f"pid_{end}"], "inner", many=True)
    turn = F.col("key_a") > F.col("key_b")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    rest = [c for c in pairs.columns if c not in ("pid_a", "pid_b", "key_a", "key_b", "src_a", "src_b", "n_a", "n_b")]
    return pairs.where("key_a <> key_b").select(pick("key_a", "key_b").alias("key_a"), pick("key_b", "key_a").alias("key_b"), pick("src_a", "src_b").alias("src_a"), pick("src_b", "src_a").alias("src_b"), *rest)


def candidates(recs: DataFrame) -> DataFrame:
    """All candidate pairs of records with their votes: key_a < key_b, src_a, src_b, votes. link() never writes them out."""
    prof = profiles(recs)
    return expanded(voted(prof), recs, prof).distinct()


class LabelModel:
    """Two classes; each class has a tree of functions, in which a vote depends on its parent's vote."""

    def __init__(self, patterns: list[str], counts: list[int]):
        self.x = np.array([["-0+1".index(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), len(VOTES))
        self.n = np.array(counts, dtype=float)

    def _tree(self, w: np.ndarray) -> list[tuple[int, int | None]]:
        """Chow-Liu: functions in an order in which parents come first."""
        m = self.x.shape[1]
        total = w.sum() + 1e-9
        info = np.zeros((m, m))
        for i, j in itertools.combinations(range(m), 2):
            joint = np.zeros((4, 4))
            np.add.at(joint, (self.x[:, i], self.x[:, j]), w)
            p = (joint + 0.1) / (total + 1.6)
            info[i, j] = info[j, i] = float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
        order, seen = [(0, None)], {0}
        while len(seen) < m:
            i, j = max(((a, b) for a in seen for b in range(m) if b not in seen), key=lambda e: info[e])
            order.append((j, i))
            seen.add(j)
        return order

    def _fit_class(self, w: np.ndarray) -> np.ndarray:
        """Log-likelihood of every pattern."""
        out = np.zeros(len(self.x))
        for j, i in self._tree(w):
            if i is None:
                c = np.bincount(self.x[:, j], w, 4) + 1.0
                out += np.log(c / c.sum())[self.x[:, j]]
            else:
                c = np.zeros((4, 4))
                np.add.at(c, (self.x[:, i], self.x[:, j]), w)
                marginal = c.sum(0) + 1.0
                c += 3.0 * marginal / marginal.sum()  # a rare parent's vote falls back on the function's own
                out += np.log(c / c.sum(1, keepdims=True))[self.x[:, i], self.x[:, j]]
        return out

    def posterior(self) -> np.ndarray:
        """Of the match, per pattern. The first guess is the balance of votes. Two different generations are two persons, by the
        statement of the problem; what it means that only one record has any is learnt."""
        if not len(self.x):
            return np.zeros(0)
        balance = np.array([-1.0, 0.0, 1.0, 0.0])[self.x].sum(1)
        post = 1 / (1 + np.exp(-1.5 * (balance - 1.5)))
        barred = self.x[:, list(VOTES).index("generation")] == 0
        post[barred] = 0.0
        for _ in range(ITERATIONS):
            prior = (post @ self.n + 1) / (self.n.sum() + 2)
            score = self._fit_class(post * self.n) - self._fit_class((1 - post) * self.n) + np.log(prior / (1 - prior))
            post = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            post[barred] = 0.0
        return post


def link(recs: DataFrame, many: tuple[str, ...] = ()) -> DataFrame:
    """records() -> key_a < key_b, src_a, src_b, confidence of all pairs of different sources that match.

    A record matches at most its best partners in each other source (all of those that tie share the confidence), except in
    the sources `many`, where one person may have several records. Records that are linked through one or two others match each other,
    unless their states, initials or generations differ. Of a key with several different rows each counts as a record.
    Empty tables give an empty result.

    Profiles are compared, not records; the best are chosen by the numbers of records that the profiles stand for; what is
    chosen is few per record, and only that becomes pairs of records.
    """
    prof = profiles(recs)
    found = durable(voted(prof), "pairs")
    counts = found.groupBy("votes").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n")).collect()  # at most 4 ** len(VOTES) patterns
    patterns = sorted((r.votes, r.n) for r in counts)
    post = LabelModel([p for p, _ in patterns], [n for _, n in patterns]).posterior()
    spark = recs.sparkSession
    scores = spark.createDataFrame([(p, round(float(x), 9)) for (p, _), x in zip(patterns, post)], "votes string, confidence double")
    scored = durable(found.join(F.broadcast(scores), "votes").where(F.col("confidence") >= MATCH), "scored")

    def best(own: str, other: str) -> DataFrame:
        """The highest confidence of a profile in another source, and the records that reach it."""
        per = scored.groupBy(f"pid_{own}", f"src_{other}", "confidence").agg(F.sum(f"n_{other}").alias("n"))
        top = per.groupBy(f"pid_{own}", f"src_{other}").agg(F.max(F.struct("confidence", "n")).alias("top"))
        return top.select(f"pid_{own}", f"src_{other}", F.col("top.confidence").alias(f"top_{own}"), F.col("top.n").alias(f"ties_{own}"))

    both = scored.join(best("a", "b"), ["pid_a", "src_b"]).join(best("b", "a"), ["pid_b", "src_a"])
    loose = lambda c: F.col(c).isin(list(many)) if many else F.lit(False)
    chosen = (loose("src_b") | (F.col("confidence") >= F.col("top_a"))) & (loose("src_a") | (F.col("confidence") >= F.col("top_b")))
    ties = F.greatest(F.when(loose("src_b"), 1).otherwise(F.col("ties_a")), F.when(loose("src_a"), 1).otherwise(F.col("ties_b")))
    kept = both.where(chosen).select("pid_a", "pid_b", "src_a", "src_b", (F.col("confidence") / ties).alias("confidence")).where(F.col("confidence") >= MATCH)
    kept = durable(expanded(kept, recs, prof), "kept")
    facts = durable(recs.select("key", "src", "state", "middle", "tag"), "facts")
    for _ in range(2):
        kept = durable(kept.unionByName(_through(kept, facts)).groupBy("key_a", "key_b", "src_a", "src_b").agg(F.max("confidence").alias("confidence")), "closed")
    return kept


def _through(kept: DataFrame, recs: DataFrame) -> DataFrame:
    """Pairs of two partners of one record, from different sources, that do not contradict each other."""
    x = kept.select(F.col("key_a").alias("k"), F.col("key_b").alias("o"), F.col("src_b").alias("s"), "confidence")
    x = x.unionByName(kept.select(F.col("key_b").alias("k"), F.col("key_a").alias("o"), F.col("src_a").alias("s"), "confidence"))
    p, q = x.select("k", F.col("o").alias("key_a"), F.col("s").alias("src_a"), F.col("confidence").alias("c1")), x.select("k", F.col("o").alias("key_b"), F.col("s").alias("src_b"), F.col("confidence").alias("c2"))
    third = p.join(q, "k").where((F.col("key_a") < F.col("key_b")) & (F.col("src_a") != F.col("src_b")))
    facts = lambda end: recs.select(F.col("key").alias(f"key_{end}"), F.col("src").alias(f"src_{end}"), F.struct("state", "middle", "tag").alias(f"f_{end}"))
    third = third.join(facts("a"), ["key_a", "src_a"]).join(facts("b"), ["key_b", "src_b"])
    clash = lambda f: F.coalesce((F.col(f"f_a.{f}") != F.col(f"f_b.{f}")) & (F.col(f"f_a.{f}") != "") & (F.col(f"f_b.{f}") != ""), F.lit(False))
    third = third.where(~clash("state") & ~clash("middle") & ~clash("tag"))
    return third.select("key_a", "key_b", "src_a", "src_b", (F.col("c1") * F.col("c2")).alias("confidence"))
