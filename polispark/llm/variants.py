"""Variant spellings of names, attributed by a noisy channel.

Every distinct string is parsed to a *unit*: family name, given name or trade, generation or committee. A unit's type
frequency is the number of distinct strings that spell it so. Units that share a family name up to one slip and a given name
up to nicknames, one slip or its initial (a trade up to abbreviations) are candidates for each other; the prior of a canonical unit is its type
frequency, the channel gives the likelihood of a slip, a nickname or an abbreviation, learnt from the attachments themselves, and a unit is attached to the
candidate of maximum posterior, or stays canonical itself. Attachments only lead to higher ranks, so they form a
forest, whose roots are the entities. Middle initials then part namesakes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polispark.llm import names as N
from polispark.operators.hierarchy import resolve_roots
from polispark.operators.skew import skew_join
from polispark.session import durable

#: First guess of the log-likelihoods of the channel, which are learnt, and the log-prior of a unit being an entity of its own.
SLIP, NICKNAME, ABBREVIATION, OWN = math.log(0.03), math.log(0.15), math.log(0.2), -6.0
#: Rounds of learning, and the bounds of what is learnt.
ROUNDS, LEAST, MOST = 3, 0.005, 0.3
#: Units of a block from which its pairs are spread over several tasks.
SPLIT_ROWS = 5_000
#: Share of another given name's family names up to which a given name may be a slip of it; one family name always may.
RARE = math.exp(SLIP)
#: Strings from which a word belongs to the learned lexicons of given names and trades.
LEXICON_LEAST = 2


def _given_slot(raw: str) -> str:
    """The given name where the form tells its place: after a comma, or beside a middle initial."""
    parts = [[w for w in N._words(p) if w not in N.TITLES and w not in N.GENERATIONS] for p in N.fold(raw).split(",")]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        return next((w for w in parts[1] if len(w) > 1), "")
    shape = [len(w) > 1 for w in parts[0]] if parts else []
    return parts[0][0] if shape == [True, False, True] else parts[0][1] if shape == [True, True, False] else ""


def lexicon(strings: DataFrame) -> DataFrame:
    """word, given, trade: given names (from the forms that show their place) and trades (the last word of an organisation) of
    strings (name, is_org)."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, org in zip(pdf["name"], pdf["is_org"]):
                org = N.looks_legal(name) if pd.isna(org) else org
                w = N.organisation(name).core if org and "," not in name else "" if org else _given_slot(name)
                if w:
                    rows.append((bool(org), w))
            yield pd.DataFrame(rows, columns=["is_org", "word"])

    found = strings.mapInPandas(slots, "is_org boolean, word string").groupBy("is_org", "word").agg(F.count("*").alias("n")).where(F.col("n") >= LEXICON_LEAST)
    return found.groupBy("word").agg(F.max(~F.col("is_org")).alias("given"), F.max("is_org").alias("trade"))


class _Asked(set):
    """Stands for a lexicon and keeps the words that are looked up in it."""

    def __contains__(self, word) -> bool:
        self.add(word)
        return False


def _asked(name: str, org: bool | None) -> list[str]:
    """The words by whose place in the lexicons a name is parsed. A parse that finds a word asks for no others than one that finds none."""
    words = _Asked()
    if org is None:
        words.add(N.organisation(name, words).core)
    elif org:
        N.organisation(name, words)
    if not org:
        N.person(name, words)
    return sorted(words - {""})


def with_known(names: DataFrame, lex: DataFrame) -> DataFrame:
    """names (name, is_org; distinct) joined with lex (word, given, trade): name, given and trades, its words that are in the
    lexicons; names without any are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(n, w) for n, o in zip(pdf["name"], pdf["is_org"]) for w in _asked(n, None if pd.isna(o) else bool(o))], columns=["name", "word"])

    words = durable(names.select("name", "is_org").mapInPandas(run, "name string, word string"), "words")
    met = skew_join(words, durable(lex, "lexicon"), ["word"], "inner")
    pick = lambda c: F.collect_set(F.when(F.col(c), F.col("word"))).alias(c)
    return met.groupBy("name").agg(pick("given"), pick("trade").alias("trades"))  # few words a name


def parse(strings: DataFrame) -> DataFrame:
    """strings (name, n, is_org or null; distinct) -> name, n, kind, surname, core, middle, tag; those that name nobody left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, n, org, given, trades in zip(pdf["name"], pdf["n"], pdf["is_org"], pdf["given"], pdf["trades"]):
                if N.nobody(name):
                    continue
                given, trades = (frozenset(() if x is None else x) for x in (given, trades))
                if pd.isna(org):
                    org = N.looks_legal(name) or N.organisation(name, trades).core in trades - given
                x = N.organisation(name, trades) if org else N.person(name, given)
                if x.kind != "none" and x.surname:
                    rows.append((name, n, x.kind, x.surname, x.core, x.middle, x.tag))
            yield pd.DataFrame(rows, columns=["name", "n", "kind", "surname", "core", "middle", "tag"])

    known = with_known(strings, lexicon(strings))
    return strings.select("name", "n", "is_org").join(known, "name", "left").mapInPandas(run, "name string, n bigint, kind string, surname string, core string, middle string, tag string")


def _blocks(kind: str, surname: str, core: str, tag: str) -> list[str]:
    """Keys under which a unit meets its candidates: a slip of the family name, and what the rest may stand for.

    Persons also meet by the given name's initial and, under one family name, by its slips, which may change the initial.
    """
    forms = {f[:1] for f in [core]} if kind == "org" else N.formal(core) | {f"~{core[:1]}"}
    keys = [f"{kind}|{tag}|{s}|{f}" for s in slips_of(surname) for f in forms]
    return keys + ([f"{kind}|{tag}|={surname}|{f}" for f in N.slips(core)] if kind == "person" and len(core) >= 4 else [])


def slips_of(surname: str) -> set[str]:
    return N.slips(surname) if len(surname) >= 4 else {surname}


class Ways(NamedTuple):
    """How often each way of the channel is taken from one unit to another."""

    slips: float
    nicknames: int
    abbreviations: int


def ways(kind: str, v: tuple[str, str], c: tuple[str, str], types: int, rare: bool = True, rare_family: bool = True) -> Ways | None:
    """How (family name, core) c was typed as v in all of `types` strings; None if it can't have been.

    A given name is a slip of another only if it is rare beside it: Maria is no slip of Mario. So is a family name of four letters.
    """
    slips, nicknames, abbreviations = 0.0, 0, 0
    if v[0] != c[0]:
        short = min(len(v[0]), len(c[0]))
        if short < 4 or (short == 4 and not rare_family) or not N.one_slip(v[0], c[0]):
            return None
        slips += 1 + 0.5 * (types - 1)
    if v[1] != c[1]:
        if kind == "person":
            if N.formal(v[1]) & N.formal(c[1]):
                nicknames = 1 if c[1] in N.formal(v[1]) or v[1] in N.formal(c[1]) else 2
            elif len(v[1]) == 1 and v[1] == c[1][:1]:
                abbreviations = 1
            elif rare and v[1] not in N.NICKNAMES and v[1] not in N._FORMAL and min(len(v[1]), len(c[1])) >= 4 and N.one_slip(v[1], c[1]):
                slips += 1 + 0.5 * (types - 1)
            else:
                return None
        elif N.abbreviates(v[1], c[1]) or N.abbreviates(c[1], v[1]) or (min(len(v[1]), len(c[1])) == 1 and v[1][:1] == c[1][:1]):
            abbreviations = 1
        elif min(len(v[1]), len(c[1])) >= 4 and N.one_slip(v[1], c[1]):
            slips += 1
        else:
            return None
    return Ways(slips, nicknames, abbreviations)


def channel(kind: str, v: tuple[str, str], c: tuple[str, str], types: int, rare: bool = True) -> float | None:
    """Log-likelihood of ways() under the first guess."""
    w = ways(kind, v, c, types, rare)
    return None if w is None else w.slips * SLIP + w.nicknames * NICKNAME + w.abbreviations * ABBREVIATION


def _rare(own: int, other: int) -> bool:
    return own <= max(1, RARE * other)


def _unclear(units: DataFrame) -> DataFrame:
    """id of persons' initials that may stand for several given names of the family: for one that is no spelling of the most frequent."""
    first = F.substring("core", 1, 1)
    persons = units.where("kind = 'person'").select("id", "tag", "surname", first.alias("initial"), "core", "t", "n", "bearers")
    single = persons.where(F.length("core") == 1).select("tag", "surname", "initial", "id")
    named = skew_join(persons.where(F.length("core") > 1).drop("id"), single, ["tag", "surname", "initial"], "inner")
    named = durable(named.select("id", "surname", "core", "t", "n", "bearers"), "named")
    top = named.groupBy("id").agg(F.max(F.struct("t", "n", "core", "bearers")).alias("top")).select("id", F.col("top.core").alias("core0"), F.col("top.bearers").alias("bearers0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [i for i, s, c, t, b, c0, b0 in pdf.itertuples(index=False, name=None) if ways("person", (s, c), (s, c0), t, _rare(b, b0)) is None]
            yield pd.DataFrame({"id": out})

    met = skew_join(named, top, ["id"], "inner").select("id", "surname", "core", "t", "bearers", "core0", "bearers0")
    return met.mapInPandas(run, "id string").distinct()


def candidates(units: DataFrame) -> DataFrame:
    """id, parent, t, t2, n2, slips, nicknames, abbreviations: units and those of higher rank (type frequency, then rows, then name) whose spellings they may be.

    Units meet in joins on hashed blocks, of which those of more than SPLIT_ROWS are salted; each pair is looked at once.
    """
    keys = F.pandas_udf(lambda k, s, c, t: pd.Series([_blocks(*x) for x in zip(k, s, c, t)]), "array<string>")
    facts = ["id", "t", "n", "bearers", "families"]
    keyed = units.select(keys("kind", "surname", "core", "tag").alias("keys"), *facts)
    keyed = durable(keyed.select(F.explode(F.array_distinct(F.transform("keys", lambda k: F.xxhash64(k)))).alias("block"), *facts), "keyed")
    other = keyed.select("block", *[F.col(c).alias(f"{c}2") for c in facts])
    met = skew_join(keyed, other, ["block"], "inner", most=SPLIT_ROWS).where(F.struct("t2", "n2", "id2") > F.struct("t", "n", "id")).drop("block").distinct()
    met = skew_join(met, _unclear(units), ["id"], "left_anti", sketch=keyed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, b, f, i2, t2, n2, b2, f2 in pdf.itertuples(index=False, name=None):
                (kind, tag, s, c), (kind2, tag2, s2, c2) = i.split("|"), i2.split("|")
                w = ways(kind, (s, c), (s2, c2), t, _rare(b, b2), _rare(f, f2)) if (kind, tag) == (kind2, tag2) else None
                if w is not None:
                    out.append((i, i2, t, t2, n2, *w))
            yield pd.DataFrame(out, columns=["id", "parent", "t", "t2", "n2", "slips", "nicknames", "abbreviations"])

    met = met.select("id", "t", "bearers", "families", "id2", "t2", "n2", "bearers2", "families2")
    return met.mapInPandas(run, "id string, parent string, t bigint, t2 bigint, n2 bigint, slips double, nicknames int, abbreviations int")


def attach(found: DataFrame, types: int) -> DataFrame:
    """candidates() -> id, parent: the candidate of maximum posterior, where it beats the unit being an entity of its own.

    The likelihoods are learnt: each round attaches all units and takes the share of the strings that went each way (of all
    `types` strings) as the next round's likelihood, kept within LEAST and MOST. Only those three numbers reach the driver.
    """
    logs = {"slips": SLIP, "nicknames": NICKNAME, "abbreviations": ABBREVIATION}
    best = None
    for step in range(ROUNDS):
        like = functools.reduce(lambda a, b: a + b, [F.col(c) * F.lit(x) for c, x in logs.items()])
        scored = found.withColumn("score", F.log("t2") + like).where(F.col("score") > F.log("t") + OWN)
        best = scored.groupBy("id").agg(F.max_by(F.struct("parent", "t", *logs), F.struct("score", "t2", "n2", "parent")).alias("b")).select("id", "b.*")
        if step + 1 < ROUNDS:
            got = best.agg(*[F.sum(F.when(F.col(c) > 0, F.col("t"))).alias(c) for c in logs]).first()
            logs = {c: math.log(min(MOST, max(LEAST, (got[c] or 0) / max(types, 1)))) for c in logs}
    return best.select("id", "parent")


def _middles(combos: list[tuple[str, int]]) -> dict[str, str]:
    """Middle initial -> that of its entity: none joins the most frequent one."""
    own = sorted(((n, m) for m, n in combos if m), reverse=True)
    return {m: m or (own[0][1] if own else "") for m, _ in combos}


def cluster(strings: DataFrame) -> DataFrame:
    """strings (name, n, is_org; distinct names) -> name, entity: equal for spellings of one person or organisation.

    Strings that name nobody (null, empty, fillers, aggregates) are left out. A single spelling is an entity of one.
    Persons of different generations, organisations of different trades, and committees and companies are kept apart.
    """
    parsed = durable(parse(strings.where(F.col("name").isNotNull())).withColumn("id", F.concat_ws("|", "kind", "tag", "surname", "core")), "parsed")
    units = durable(parsed.groupBy("id", "kind", "tag", "surname", "core").agg(F.count("*").alias("t"), F.sum("n").alias("n")), "units")
    cores = durable(units.groupBy("kind", "core").agg(F.count_distinct("surname").alias("bearers")), "cores")
    families = durable(units.groupBy("kind", "surname").agg(F.count_distinct("core").alias("families")), "families")
    full = skew_join(skew_join(units, cores, ["kind", "core"], "inner", sketch=units), families, ["kind", "surname"], "inner", sketch=units)
    found = durable(candidates(durable(full, "full")), "candidates")
    best = attach(found, units.agg(F.sum("t").alias("t")).first().t or 0)
    roots = resolve_roots(durable(units.select("id").join(best, "id", "left"), "attached"))
    entity = parsed.join(roots.select("id", "root_id"), "id")
    combos = entity.groupBy("root_id", "middle").agg(F.count("*").alias("c")).groupBy("root_id").agg(F.collect_list(F.struct("middle", "c")).alias("combos"))  # one per letter at most
    pick = F.pandas_udf(lambda x: pd.Series([_middles([(m["middle"], m["c"]) for m in row]) for row in x]), "map<string,string>")
    chosen = combos.select("root_id", pick("combos").alias("of"))
    return entity.join(chosen, "root_id").select("name", F.concat_ws("|", "root_id", F.element_at("of", F.col("middle"))).alias("entity"))


def pairs(clusters: DataFrame) -> DataFrame:
    """name_a < name_b of one entity: the result that is asked for. An entity has few spellings, whatever its rows."""
    a, b = clusters.select("entity", F.col("name").alias("name_a")), clusters.select("entity", F.col("name").alias("name_b"))
    return skew_join(a, b, ["entity"], "inner").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
