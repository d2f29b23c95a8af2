"""Lookups with arguments: graph, search, places, matching, files; each function takes its parameters, each query calls one and has its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.functions import civic as C
from polispark.operators import graph as G
from polispark.operators.matching import in_passes, narrow
from polispark.operators.places import contained
from polispark.operators.skew import skew_join
from polispark.plans.civics import keys, nodes, rows, sql
from polispark.plans.derive import _AGE, agencies_now
from polispark.plans.more import View
from polispark.plans.reference import _DEG, _GRAMS
from polispark.session import durable, shared_dir, table
from polispark.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return register


# -- graph ------------------------------------------------------------------------------------------------------------

_EDGE = "id from_type from_id to_type to_id connection_type strength amount_cents occurred_at"
_HOT = "(SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1)"


def _hot(spark, d) -> str:
    """The best connected node of all, whatever its degree."""
    top = G.top_connected(rows(spark, d, "con", "from_id to_id connection_type"), 1).collect()
    return top[0].node if top else ""


def edges_of(con: DataFrame, node: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Edges out of, into or at a node, of one kind if given, the strongest first. A loop comes once."""
    ends = {"out": F.col("from_id") == node, "in": F.col("to_id") == node}
    con = con.where(ends["out"] | ends["in"] if direction == "both" else ends[direction])
    return (con if kind is None else con.where(F.col("connection_type") == kind)).orderBy(F.col("strength").desc_nulls_last(), "id")


@query(_DEG + f", h AS {_HOT} SELECT 'out' AS way, id, strength FROM con WHERE from_id = (SELECT node FROM h) UNION ALL SELECT 'in', id, strength FROM con WHERE to_id = (SELECT node FROM h) UNION ALL SELECT 'oversight', id, strength FROM con WHERE (from_id = (SELECT node FROM h) OR to_id = (SELECT node FROM h)) AND connection_type = 'oversight'")
def edges_at_hub(spark, d):
    """All edges of the best connected node by direction, and those of one kind."""
    con, hub = rows(spark, d, "con", "from_id to_id connection_type strength"), _hot(spark, d)
    one = lambda way, *args: edges_of(con, hub, *args).select(F.lit(way).alias("way"), "id", "strength")
    return one("out", "out").unionByName(one("in", "in")).unionByName(one("oversight", "both", "oversight"))


@query(sql("con") + "SELECT id, strength FROM con WHERE connection_type = 'donation' ORDER BY strength DESC NULLS LAST, id LIMIT 100")
def strongest_of_kind(spark, d):
    return rows(spark, d, "con", "connection_type strength").where("connection_type = 'donation'").orderBy(F.col("strength").desc_nulls_last(), "id").limit(100).select("id", "strength")


def diagnostic_ego(con: DataFrame, node: str, limit: int = 100, depth: int = 2, expand: int = 20) -> DataFrame:
    """id, hop: the strongest `limit` edges at a node; at depth 2 the first `expand` neighbours (in the order of those edges), each side's strongest limit / 2."""
    best = lambda df, n: df.orderBy(F.col("strength").desc_nulls_last(), "id").limit(n)
    first = durable(best(G.at_any(con, [node]), min(max(limit, 1), 500)), "first")
    out = first.select("id", F.lit(1).alias("hop"))
    if depth < 2:
        return out
    near = first.select(F.when(F.col("from_id") == node, F.col("to_id")).otherwise(F.col("from_id")).alias("n"), "strength", "id").where(F.col("n") != node)
    near = near.groupBy("n").agg(F.min(F.struct((-F.coalesce("strength", F.lit(-1.0))).alias("s"), "id")).alias("o")).orderBy("o").limit(expand)
    ids = [r.n for r in near.collect()]  # at most `expand`
    for end in ("from_id", "to_id"):
        out = out.unionByName(best(con.where(F.col(end).isin(ids)), limit // 2).select("id", F.lit(2).alias("hop")))
    return out.groupBy("id").agg(F.min("hop").alias("hop"))


@query(_DEG + f""", h AS {_HOT}, e1 AS (SELECT id, from_id, to_id, strength FROM con WHERE from_id = (SELECT node FROM h) OR to_id = (SELECT node FROM h) ORDER BY strength DESC NULLS LAST, id LIMIT 100),
  nb AS (SELECT n FROM (SELECT CASE WHEN from_id = (SELECT node FROM h) THEN to_id ELSE from_id END AS n, -coalesce(strength, -1) AS s, id FROM e1) WHERE n <> (SELECT node FROM h) GROUP BY n ORDER BY min({{'s': s, 'id': id}}) LIMIT 20),
  e2 AS ((SELECT id FROM con WHERE from_id IN (SELECT n FROM nb) ORDER BY strength DESC NULLS LAST, id LIMIT 50) UNION ALL (SELECT id FROM con WHERE to_id IN (SELECT n FROM nb) ORDER BY strength DESC NULLS LAST, id LIMIT 50))
  SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT id, 1 AS hop FROM e1 UNION ALL SELECT id, 2 FROM e2) GROUP BY id""")
def ego_diagnostic(spark, d):
    return diagnostic_ego(rows(spark, d, "con", "from_id to_id strength"), _hot(spark, d))


_EGO = _DEG + f""", h AS {_HOT}, own AS (SELECT * FROM con WHERE from_id = (SELECT node FROM h) OR to_id = (SELECT node FROM h)),
  e1 AS (SELECT id, from_id, to_id FROM own WHERE connection_type NOT LIKE 'vote%' UNION ALL (SELECT id, from_id, to_id FROM own WHERE connection_type LIKE 'vote%' ORDER BY occurred_at DESC NULLS LAST, id LIMIT 50)),
  nb AS (SELECT DISTINCT n FROM (SELECT from_id AS n FROM e1 UNION ALL SELECT to_id FROM e1) WHERE n <> (SELECT node FROM h)), ex AS (SELECT n FROM nb JOIN deg ON node = n WHERE degree < 50)
"""


@query(_EGO + "SELECT id FROM e1 UNION SELECT id FROM con WHERE from_id IN (SELECT n FROM ex) OR to_id IN (SELECT n FROM ex)")
def ego_of_hub(spark, d):
    """Two hops around the best connected node of all, with its latest fifty votes."""
    return G.ego_two(rows(spark, d, "con", "from_id to_id connection_type occurred_at"), _hot(spark, d))[0].select("id")


@query(sql("con", "nod") + """SELECT con.id, from_type || ':' || from_id AS source, to_type || ':' || to_id AS target, amount_cents / 100.0::DOUBLE AS usd FROM con JOIN nod a ON a.type = from_type AND a.id = from_id JOIN nod b ON b.type = to_type AND b.id = to_id""")
def drawn_edges(spark, d):
    """Edges as they are drawn: names of both nodes, dollars; an edge with a missing node is dropped."""
    con = rows(spark, d, "con", "from_type from_id to_type to_id amount_cents")
    out = con
    for end in ("from", "to"):
        known = nodes(spark, d).select(F.col("type").alias(f"{end}_type"), F.col("id").alias(f"{end}_id"))
        out = skew_join(out, known, [f"{end}_type", f"{end}_id"], "left_semi", sketch=con)
    name = lambda end: F.concat_ws(":", f"{end}_type", f"{end}_id")
    return out.select("id", name("from").alias("source"), name("to").alias("target"), C.dollars(F.col("amount_cents")).alias("usd"))


@query(sql("con") + "SELECT id, round(CASE WHEN amount_cents > 100000 THEN log10(amount_cents / 100000.0) * coalesce(strength, 0.5) * 3 ELSE coalesce(strength, 0.5) END, 6)::DOUBLE AS width FROM con")
def edge_widths(spark, d):
    """Widths of edges: by the logarithm of the dollars, else by strength."""
    base = F.coalesce("strength", F.lit(0.5))
    return rows(spark, d, "con", "strength amount_cents").select("id", F.round(F.when(F.col("amount_cents") > 100_000, F.log10(F.col("amount_cents") / 100_000.0) * base * 3).otherwise(base), 6).alias("width"))


#: Named views and the kinds of edges that they show; None shows all.
VIEWS = {
    "follow-the-money": View(("donation",)), "votes-and-bills": View(("vote_yes", "vote_no", "co_sponsorship"), 2), "nominations": View(("nomination_vote_yes", "nomination_vote_no"), 2),
    "revolving-door": View(("revolving_door", "appointment")), "oversight": View(("oversight", "appointment"), 2), "lobbying": View(("lobbying", "donation")), "contracts": View(("contract_award",)),
    "endorsements": View(("endorsement",)), "sponsors": View(("co_sponsorship",), 2), "large-gifts": View(("donation",), least_cents=5_000_000), "recent": View(None, first="2023-01-01"), "everything": View(None, 2),
    "money-and-votes": View(("donation", "vote_yes", "vote_no")),
}


def _view_sql(name: str, v: View) -> str:
    terms = ["true"] + ([f"connection_type IN ({', '.join(repr(k) for k in v.kinds)})"] if v.kinds else []) + ([f"amount_cents >= {v.least_cents}"] if v.least_cents else []) + ([f"occurred_at >= DATE '{v.first}'"] if v.first else [])
    return f"SELECT '{name}' AS view, count(*) AS n, count(DISTINCT from_id) AS sources FROM con WHERE {' AND '.join(terms)}"


@query(sql("con") + " UNION ALL ".join(_view_sql(k, v) for k, v in VIEWS.items()))
def named_views(spark, d):
    """Edges and sources of each named view, all from one scan: an edge counts in every view that shows it."""
    con = rows(spark, d, "con", "from_id connection_type amount_cents occurred_at").withColumn("_true", F.lit(True))
    shows = F.array_compact(F.array(*[F.when(_shown(v), name) for name, v in VIEWS.items()]))
    got = con.select("from_id", F.explode(shows).alias("view")).groupBy("view").agg(F.count("*").alias("n"), F.count_distinct("from_id").alias("sources"))
    every = spark.createDataFrame([(k,) for k in VIEWS], "view string")
    return every.join(got, "view", "left").select("view", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sources", F.lit(0)).alias("sources"))


def _shown(v: View) -> Column:
    out = F.lit(True)
    if v.kinds is not None:
        out = out & F.col("connection_type").isin(*v.kinds)
    if v.least_cents is not None:
        out = out & (F.col("amount_cents") >= v.least_cents)
    return out & (F.col("occurred_at") >= F.lit(v.first).cast("date")) if v.first is not None else out


_ENDS = "(SELECT node FROM deg WHERE has_votes = 1 AND degree >= 5 AND degree < 50 ORDER BY degree DESC, node LIMIT 1)", "(SELECT node FROM deg WHERE has_donations = 1 AND degree < 5 ORDER BY degree DESC, node LIMIT 1)"


def _path_sql(hops: int = 4) -> str:
    """Distances from the goal by rounds, then from the start always the smallest neighbour that is one nearer."""
    out = _DEG + f""", adj AS (SELECT from_id AS a, to_id AS b, id, connection_type AS kind FROM con UNION ALL SELECT to_id, from_id, id, connection_type FROM con), d0 AS (SELECT {_ENDS[1]} AS node)"""
    for i in range(1, hops + 1):
        out += f", d{i} AS (SELECT DISTINCT b AS node FROM d{i - 1} JOIN adj ON a = node WHERE b NOT IN ({' UNION ALL '.join(f'SELECT node FROM d{j}' for j in range(i))}))"
    out += ", dist AS (" + " UNION ALL ".join(f"SELECT node, {i} AS far FROM d{i}" for i in range(hops + 1)) + f"), s0 AS (SELECT 0 AS hop, node, NULL AS edge_id, NULL AS kind, far FROM dist WHERE node = {_ENDS[0]})"
    for i in range(1, hops + 1):
        out += f", s{i} AS (SELECT {i} AS hop, adj.b AS node, adj.id AS edge_id, adj.kind, dist.far FROM s{i - 1} JOIN adj ON a = node JOIN dist ON dist.node = adj.b AND dist.far = s{i - 1}.far - 1 ORDER BY adj.b, adj.id LIMIT 1)"
    return out + ", p AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(hops + 1)) + "), n AS (SELECT id, min(label) AS label FROM nod GROUP BY 1) SELECT CAST(hop AS INTEGER) AS hop, node, label, edge_id, kind FROM p LEFT JOIN n ON n.id = node"


@query(_path_sql().replace("WITH con AS", sql("nod").rstrip() + ", con AS", 1))
def path_nodes(spark, d):
    """The shortest path between two entities: its nodes with labels, and the edges with their kinds."""
    con = rows(spark, d, "con", "from_id to_id connection_type")
    deg = durable(G.degree(con), "degree")
    pick = lambda where, *order: next((r.node for r in deg.where(where).orderBy(*order, "node").limit(1).collect()), "")
    path = G.shortest_path(con, pick("has_votes = 1 AND degree >= 5 AND degree < 50", F.desc("degree")), pick("has_donations = 1 AND degree < 5", F.desc("degree")), 4).collect()  # a few rows
    steps = spark.createDataFrame([tuple(r) for r in path], "hop int, node string, edge_id string")
    label = nodes(spark, d).where(F.col("id").isin([r.node for r in path])).groupBy(F.col("id").alias("node")).agg(F.min("label").alias("label"))
    kind = con.where(F.col("id").isin([r.edge_id for r in path if r.edge_id])).select(F.col("id").alias("edge_id"), F.col("connection_type").alias("kind"))
    return steps.join(label, "node", "left").join(kind, "edge_id", "left").select("hop", "node", "label", "edge_id", "kind")


@query(sql("off", "fin") + """SELECT o.id, o.full_name, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n, round(least(sum(amount_cents) / 100.0 / 100000.0, 1.0), 6)::DOUBLE AS strength FROM fin JOIN off o ON o.id = official_id WHERE donor_type = 'pac' AND industry ILIKE '%farming%'
  GROUP BY 1, 2 ORDER BY cents DESC, o.id LIMIT 25""")
def pac_group_strength(spark, d):
    return pac_group(spark, d, "%farming%", 25)


def pac_group(spark, d, industry: str, limit: int) -> DataFrame:
    """Officials whom the committees of an industry paid most, with the strength of the edge. Summed before the join."""
    fin = rows(spark, d, "fin", "official_id donor_type industry amount_cents").where((F.col("donor_type") == "pac") & F.col("industry").ilike(industry))
    g = fin.groupBy(F.col("official_id").alias("id")).agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("n"))
    got = g.join(rows(spark, d, "off", "full_name").select("id", "full_name"), "id").orderBy(F.desc("cents"), "id").limit(limit)
    return got.withColumn("strength", F.round(F.least(C.dollars(F.col("cents")) / 100_000.0, F.lit(1.0)), 6))


# -- search ------------------------------------------------------------------------------------------------------------


def entity_hits(spark, d, q: str, limit: int = 20) -> DataFrame:
    """type, id, label, sim: active officials and donors by similarity (a family name that is the query counts as 1) or containment,
    agencies and proposals by containment; at most `limit` of each type."""
    low, like = q.lower(), F.col("label").ilike(f"%{q}%")
    off = rows(spark, d, "off", "full_name is_active").where("is_active").select(F.lit("official").alias("type"), "id", F.col("full_name").alias("label"))
    sim = F.round(C.similarity(F.col("label"), F.lit(q)), 6)
    off = off.withColumn("near", sim).where(like | (F.col("near") > 0.3)).withColumn("sim", F.when(F.lower(F.element_at(F.split("label", " "), -1)) == low, 1.0).otherwise(F.col("near"))).drop("near")
    ent = rows(spark, d, "ent", "name").select(F.lit("financial_entity").alias("type"), "id", F.col("name").alias("label")).withColumn("sim", sim).where(like | (F.col("sim") > 0.3))
    age = agencies_now(spark, d).where(F.col("name").ilike(f"%{q}%") | F.col("acronym").ilike(f"%{q}%")).select(F.lit("agency").alias("type"), "id", F.col("name").alias("label"), F.lit(1.0).alias("sim"))
    pro = rows(spark, d, "pro", "title").select(F.lit("proposal").alias("type"), "id", F.col("title").alias("label"), F.lit(1.0).alias("sim")).where(F.col("label").ilike(f"%{q}%"))
    every = off.unionByName(ent).unionByName(age).unionByName(pro)
    return G.top_per_group(every, ["type"], [F.desc("sim"), F.col("label"), F.col("id")], limit)


_Q = "frost"
_SIM = f"round(len(list_intersect({_GRAMS('label')}, {_GRAMS(repr(_Q))})) / nullif(len(list_distinct(list_concat({_GRAMS('label')}, {_GRAMS(repr(_Q))}))), 0), 6)::DOUBLE"
_HITS = f""", {_AGE}, raw AS (SELECT 'official' AS type, id, full_name AS label FROM off WHERE is_active UNION ALL SELECT 'financial_entity', id, name FROM ent), near AS (SELECT *, coalesce({_SIM}, 0) AS s FROM raw),
  hits AS (SELECT type, id, label, CASE WHEN type = 'official' AND lower(list_last(string_split(label, ' '))) = '{_Q}' THEN 1.0 ELSE s END AS sim FROM near WHERE label ILIKE '%{_Q}%' OR s > 0.3
  UNION ALL SELECT 'agency', id, name, 1.0 FROM age WHERE name ILIKE '%{_Q}%' OR acronym ILIKE '%{_Q}%' UNION ALL SELECT 'proposal', id, title, 1.0 FROM pro WHERE title ILIKE '%{_Q}%'),
  top AS (SELECT type, id, label, sim FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY sim DESC, label, id) AS rn FROM hits) WHERE rn <= 20)
"""


@query(sql("off", "ent", "pro") + _HITS + "SELECT type, id, label, round(sim, 6)::DOUBLE AS sim FROM top")
def entity_hits_by_name(spark, d):
    return entity_hits(spark, d, _Q)


def ranked_hits(spark, d, q: str) -> DataFrame:
    """entity_hits in seven tiers (label, family name, beginning, federal with edges, federal, with edges, rest), then by degree and label.

    Federal are officials without a state body's title. Degrees are counted for the hits only.
    """
    hit = durable(entity_hits(spark, d, q), "hits")
    near = G.touching(rows(spark, d, "con", "from_id to_id connection_type"), hit.select(F.col("id").alias("node")))
    federal = rows(spark, d, "off", "role_title").where(~F.col("role_title").like("State%")).groupBy("id").agg(F.lit(True).alias("federal"))
    got = hit.join(G.degree(near).select(F.col("node").alias("id"), "degree"), "id", "left").join(federal, "id", "left")
    low, deg = F.lower("label"), F.coalesce("degree", F.lit(0))
    fed = (F.col("type") == "official") & F.coalesce("federal", F.lit(False))
    tier = F.when(low == q.lower(), 0).when(F.element_at(F.split(low, " "), -1) == q.lower(), 1).when(low.startswith(q.lower()), 2).when(fed & (deg > 0), 3).when(fed, 4).when(deg > 0, 5).otherwise(6)
    return got.select("type", "id", "label", deg.alias("degree"), tier.alias("tier")).orderBy("tier", F.desc("degree"), "label", "id")


@query(sql("off", "ent", "pro") + _HITS + ", " + _DEG[5:] + f""", fed AS (SELECT DISTINCT id FROM off WHERE role_title NOT LIKE 'State%'), r AS (SELECT type, top.id, label, coalesce(degree, 0) AS degree, type = 'official' AND top.id IN (SELECT id FROM fed) AS f FROM top LEFT JOIN deg ON node = top.id)
  SELECT type, id, label, degree, CAST(CASE WHEN lower(label) = '{_Q}' THEN 0 WHEN list_last(string_split(lower(label), ' ')) = '{_Q}' THEN 1 WHEN lower(label) LIKE '{_Q}%' THEN 2 WHEN f AND degree > 0 THEN 3 WHEN f THEN 4 WHEN degree > 0 THEN 5 ELSE 6 END AS INTEGER) AS tier FROM r""")
def ranked_entities(spark, d):
    return ranked_hits(spark, d, _Q)


#: Words of a query that name a party or a role.
PARTY_WORDS = {"democrat": "democrat", "democratic": "democrat", "dem": "democrat", "republican": "republican", "rep": "republican", "gop": "republican", "independent": "independent", "ind": "independent"}
ROLE_WORDS = {"senator": "Senator", "senators": "Senator", "representative": "Representative", "representatives": "Representative", "congressman": "Representative", "congresswoman": "Representative"}


def search_all(spark, d, text: str, limit: int = 50) -> DataFrame:
    """kind, id, label of four kinds. Of officials the text may mean a party, a role or a state, else a part of the name; of the others a part of
    name, acronym or title. Agencies whose acronym is the text come first."""
    t, q = text.strip().lower(), text.strip()
    off = rows(spark, d, "off", "full_name role_title party state is_active").where("is_active")
    states = {r.state for r in off.select("state").distinct().where("state IS NOT NULL").collect()} if len(t) == 2 else set()  # some fifty
    if t in PARTY_WORDS:
        off = off.where(F.col("party") == PARTY_WORDS[t])
    elif t in ROLE_WORDS:
        off = off.where(F.col("role_title").ilike(f"%{ROLE_WORDS[t]}%"))
    elif t.upper() in states:
        off = off.where(F.col("state") == t.upper())
    else:
        off = off.where(F.col("full_name").ilike(f"%{q}%"))
    one = lambda df, kind, label, *order: df.orderBy(*order, label, "id").limit(limit).select(F.lit(kind).alias("kind"), "id", F.col(label).alias("label"))
    age = agencies_now(spark, d).where(F.col("name").ilike(f"%{q}%") | F.col("acronym").ilike(f"%{q}%")).withColumn("exact", F.coalesce(F.lower("acronym") == t, F.lit(False)))
    out = one(off, "official", "full_name").unionByName(one(age, "agency", "name", F.desc("exact")))
    out = out.unionByName(one(rows(spark, d, "pro", "title").where(F.col("title").ilike(f"%{q}%")), "proposal", "title"))
    return out.unionByName(one(rows(spark, d, "ent", "name").where(F.col("name").ilike(f"%{q}%")), "financial_entity", "name"))


def _all_sql(text: str, officials: str) -> str:
    t = text.lower()
    return f"""SELECT '{text}' AS text, * FROM ((SELECT 'official' AS kind, id, full_name AS label FROM off WHERE is_active AND {officials} ORDER BY full_name, id LIMIT 50)
  UNION ALL (SELECT 'agency', id, name FROM age WHERE name ILIKE '%{text}%' OR acronym ILIKE '%{text}%' ORDER BY coalesce(lower(acronym) = '{t}', false) DESC, name, id LIMIT 50)
  UNION ALL (SELECT 'proposal', id, title FROM pro WHERE title ILIKE '%{text}%' ORDER BY title, id LIMIT 50) UNION ALL (SELECT 'financial_entity', id, name FROM ent WHERE name ILIKE '%{text}%' ORDER BY name, id LIMIT 50))"""


@query(sql("off", "pro", "ent") + f", {_AGE} " + " UNION ALL ".join([_all_sql("gop", "party = 'republican'"), _all_sql("senators", "role_title ILIKE '%Senator%'"), _all_sql("oh", "state = 'OH'"), _all_sql("water", "full_name ILIKE '%water%'"), _all_sql("BDP", "full_name ILIKE '%BDP%'")]))
def search_everything(spark, d):
    """Queries that mean a party, a role, a state, a word and an acronym, over all kinds."""
    parts = [search_all(spark, d, text).select(F.lit(text).alias("text"), "kind", "id", "label") for text in ("gop", "senators", "oh", "water", "BDP")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fulltext(df: DataFrame, fields: dict[str, str], text: str) -> DataFrame:
    """df with `rank`, where the weighted stems of the fields match a web query: words must all occur, "several words" in a row, -word must not; `or` parts
    alternatives. Fields: column -> weight A (1.0), B (0.4) or C (0.2); the rank is the sum of the weights of the words' best fields."""
    import re

    weight = {"A": 1.0, "B": 0.4, "C": 0.2}
    lex = {c: C.lexemes(F.col(c)) for c in fields}
    hit, rank = F.lit(False), F.lit(0.0)
    for part in re.split(r"\s+or\s+", text.strip(), flags=re.I):
        ok = F.lit(True)
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]+)"|(\S+))', part):
            words = C.lexemes(F.lit(phrase or word))
            row = lambda x, w=words: F.exists(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1))), lambda i: F.slice(x, i, F.size(w)) == w)
            found = [row(x) for x in lex.values()]
            some = found[0]
            for f in found[1:]:
                some = some | f
            ok = ok & (~some if minus else some)
            if not minus:
                rank = rank + F.coalesce(*[F.when(f, weight[w]) for f, w in zip(found, fields.values())], F.lit(0.0))
        hit = hit | ok
    return df.where(hit).withColumn("rank", F.round(rank, 4))


_S1 = "regexp_replace(w, '(ies)$', 'y')"
_S2 = f"CASE WHEN length({_S1}) > 4 THEN regexp_replace({_S1}, '(ing|ed|es)$', '') ELSE {_S1} END"
_S3 = f"CASE WHEN length({_S2}) > 3 THEN CASE WHEN regexp_matches({_S2}, '[^s]s$') THEN regexp_replace({_S2}, 's$', '') ELSE regexp_replace({_S2}, 'e$', '') END ELSE {_S2} END"


@query(sql("pro") + f""", l AS (SELECT id, ' ' || array_to_string(list_transform(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {_S3}), ' ') || ' ' AS x FROM pro)
  SELECT id FROM l WHERE (contains(x, ' bridg repair ') AND contains(x, ' act ')) OR (contains(x, ' school ') AND contains(x, ' meal ') AND NOT contains(x, ' notic '))""")
def fulltext_web(spark, d):
    """A phrase and a word, or two words without a third: by stems, so that bridges and repairs are met."""
    return fulltext(rows(spark, d, "pro", "title"), {"title": "A"}, '"bridges repaired" acts or school meals -notices').select("id")


@query(sql("pro") + f"SELECT id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {_S3}) AS lexemes FROM pro")
def search_column(spark, d):
    """The search column that is derived when proposals are written."""
    return rows(spark, d, "pro", "title").select("id", F.array_join(C.lexemes(F.col("title")), " ").alias("lexemes"))


ORACLE["search_column"] = ORACLE["search_column"].replace(" AS lexemes FROM pro", " AS l FROM pro").replace(sql("pro") + "SELECT", sql("pro") + "SELECT id, array_to_string(l, ' ') AS lexemes FROM (SELECT") + ")"


# -- places, matching, files --------------------------------------------------------------------------------------------

#: Kinds of areas, the most specific first.
AREA_RANKS = ("precinct", "district", "city", "county", "state", "country", "supranational", "global")


def areas_at(points: DataFrame, areas: DataFrame, cell: float = 10.0) -> DataFrame:
    """points joined with the areas (area_id, type, ring) that hold them, and `place`, the rank of the area among those of the point: the most specific first, unknown types last."""
    from pyspark.sql import Window

    got = contained(points, areas, cell)
    order = Window.partitionBy(*points.columns).orderBy(C.rank_of(F.col("type"), list(AREA_RANKS)), "area_id")  # areas of one point
    return got.withColumn("place", F.row_number().over(order))


def _squares(spark) -> DataFrame:
    """Nested areas by a rule: the whole plane, quarters, strips."""
    box = lambda a, b, c, e: [(a, b), (c, b), (c, e), (a, e)]
    found = [("plane", "country", box(-100.0, -1.0, 200.0, 101.0))] + [(f"q{i}{j}", "state", box(i * 50.0, j * 50.0, i * 50.0 + 50, j * 50.0 + 50)) for i in range(2) for j in range(2)]
    found += [(f"s{i}", "city", box(i * 20.0, 0.0, i * 20.0 + 20, 100.0)) for i in range(5)] + [("odd", "ward", box(0.0, 0.0, 100.0, 100.0))]
    return spark.createDataFrame(found, "area_id string, type string, ring array<struct<x: double, y: double>>")


_BOXES = """box AS (SELECT * FROM (VALUES ('plane', 'country', 6, -100.0, -1.0, 200.0, 101.0), ('odd', 'ward', 9, 0.0, 0.0, 100.0, 100.0)) v(area_id, type, r, x0, y0, x1, y1) UNION ALL SELECT 'q' || i || j, 'state', 5, i * 50.0, j * 50.0, i * 50.0 + 50, j * 50.0 + 50 FROM range(2) a(i), range(2) b(j)
  UNION ALL SELECT 's' || i, 'city', 3, i * 20.0, 0.0, i * 20.0 + 20, 100.0 FROM range(5) a(i))"""


@query(f"WITH p AS (SELECT c_custkey, c_acctbal / 100.0 + 0.001 AS x, c_custkey % 97 + 0.5 AS y FROM customer), {_BOXES} SELECT c_custkey, area_id, type, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY r, area_id) AS INTEGER) AS place FROM p JOIN box ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def areas_of_points(spark, d):
    """All areas around each point, from the most specific to the least."""
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100.0 + 0.001).alias("x"), (F.col("c_custkey") % 97 + 0.5).alias("y"))
    return areas_at(p, _squares(spark)).select("c_custkey", "area_id", "type", "place")


_LAST = "upper(regexp_replace({}, '[^A-Za-z]', '', 'g'))".format
_NAME = "list_filter(string_split(trim(candname), ' '), lambda w: w <> '')"


@query(f"""WITH l0 AS (SELECT DISTINCT candid, candname FROM weball_rows WHERE candname IS NOT NULL), l AS (SELECT DISTINCT candid, CASE WHEN contains(candname, ',') THEN {_LAST("split_part(candname, ',', 1)")} ELSE {_LAST(f"{_NAME}[-1]")} END AS last, substr(candid, 3, 2) AS st,
  substr(CASE WHEN contains(candname, ',') THEN {_LAST("split_part(candname, ',', 2)")} ELSE {_LAST(f"{_NAME}[1]")} END, 1, 3) AS f3 FROM l0),
  r AS (SELECT DISTINCT lower(trim(id)) AS id, {_LAST("last_name")} AS last, state AS st, substr({_LAST("first_name")}, 1, 3) AS f3, json_extract_string(source_ids, '$.fec_id') AS fec FROM officials WHERE last_name IS NOT NULL),
  x AS (SELECT candid, min(id) AS id, 'id' AS way FROM l JOIN r ON fec = candid GROUP BY 1),
  p AS (SELECT candid, id, (l.st = r.st) IS TRUE AS a, (l.st = r.st AND l.f3 = r.f3) IS TRUE AS b FROM l JOIN r USING (last)),
  c AS (SELECT candid, count(*) AS n0, min(id) AS m0, count(*) FILTER (WHERE a) AS n1, min(id) FILTER (WHERE a) AS m1, count(*) FILTER (WHERE b) AS n2, min(id) FILTER (WHERE b) AS m2 FROM p GROUP BY candid),
  y AS (SELECT candid, CASE WHEN n0 = 1 THEN m0 WHEN n1 = 1 THEN m1 ELSE m2 END AS id, 'name' AS way FROM c WHERE n0 = 1 OR n1 = 1 OR n2 = 1)
  SELECT candid, id, way FROM x UNION ALL SELECT candid, id, way FROM y WHERE candid NOT IN (SELECT candid FROM x)""")
def resolved_candidates(spark, d):
    """Candidates matched with officials in passes: the exact id first, then the family name narrowed by state and given name. Names with and without a comma enter."""
    letters = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    words = F.filter(F.split(F.trim("candname"), " "), lambda w: w != "")
    comma = F.col("candname").contains(",")
    part = lambda i: F.coalesce(F.get(F.split("candname", ","), F.lit(i)), F.lit(""))
    last, first = F.when(comma, part(0)).otherwise(F.try_element_at(words, F.lit(-1))), F.when(comma, part(1)).otherwise(F.try_element_at(words, F.lit(1)))
    left = durable(table(spark, d, "weball_rows").where("candname IS NOT NULL").select("candid", letters(last).alias("last"), F.substring("candid", 3, 2).alias("st"), F.substring(letters(first), 1, 3).alias("f3")).distinct(), "left")
    off = table(spark, d, "officials").where("last_name IS NOT NULL")
    right = off.select(F.lower(F.trim("id")).alias("id"), letters(F.col("last_name")).alias("last"), F.col("state").alias("st"), F.substring(letters(F.col("first_name")), 1, 3).alias("f3"), F.get_json_object("source_ids", "$.fec_id").alias("candid")).distinct()
    exact = skew_join(left.select("candid").distinct(), right.where("candid IS NOT NULL").groupBy("candid").agg(F.min("id").alias("id")), ["candid"], "inner").withColumn("way", F.lit("id"))
    named = narrow(left, right.drop("candid").distinct(), ["last"], ["st", "f3"], "candid", "id").select("candid", "id", F.lit("name").alias("way"))
    return in_passes([exact, named], "candid").drop("pass")


@query("""SELECT committee_id, count(*) AS n, CAST(sum(CAST(floor(contribution_receipt_amount * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT DISTINCT sub_id, committee_id, contribution_receipt_amount, entity_type, contributor_state FROM fec_contributions) f
  WHERE upper(entity_type) IN ('IND', 'ORG') AND contribution_receipt_amount >= 500 AND committee_id IN (SELECT cmteid FROM committee_master WHERE type = 'Q') GROUP BY 1""")
def contribution_file(spark, d):
    """A delimited contribution file as it lands, read with its filters: kinds of contributors, a least amount, committees of the master file; then summed."""
    path = f"{shared_dir(spark)}/polispark/{spark.sparkContext.applicationId}/landed-{uuid.uuid4().hex}"
    f = table(spark, d, "fec_contributions").select("sub_id", "committee_id", "contribution_receipt_amount", "entity_type", "contributor_state").distinct()
    f.select(*[F.col(c).cast("string") for c in f.columns]).write.csv(path, sep="|", quote="", emptyValue="", nullValue="")
    read = files.contributions(spark, path, {"sub_id": 0, "committee_id": 1, "amount": 2, "entity_type": 3}, "sub_id", "amount", least=500.0, kinds=("entity_type", ("IND", "ORG")), among=("committee_id", table(spark, d, "committee_master").where("type = 'Q'").select(F.col("cmteid").alias("committee_id"))))
    return read.groupBy("committee_id").agg(F.count("*").alias("n"), F.sum(C.half_up(F.col("amount") * 100)).alias("cents"))


@query(sql("fin") + "SELECT official_id, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n FROM fin WHERE official_id IS NOT NULL GROUP BY 1")
def running_totals(spark, d):
    """Landed files taken one at a time by a stream that keeps running totals, one row of state per official."""
    from polispark.streaming import events as S

    path = f"{shared_dir(spark)}/polispark/{spark.sparkContext.applicationId}/landed-{uuid.uuid4().hex}"
    rows(spark, d, "fin", "official_id amount_cents").where("official_id IS NOT NULL").repartition(3, "id").write.parquet(path)
    return S.running(spark, path, "id string, official_id string, amount_cents bigint", ["official_id"], {"cents": F.sum("amount_cents"), "n": F.count("*")}, "totals")
