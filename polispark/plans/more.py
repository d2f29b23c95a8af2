"""Further civic queries: traffic, rings, profiles, presets and checks, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.functions import civic as C
from polispark.operators import graph as G
from polispark.operators.skew import skew_join
from polispark.plans.civics import keys, nodes, rows, sql
from polispark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return register


@dataclass(frozen=True)
class View:
    """A named view of the graph: kinds of edges, depth, least amount and period; None is no limit."""

    kinds: tuple[str, ...] | None = None
    depth: int = 1
    least_cents: int | None = None
    first: str | None = None
    last: str | None = None

    def edges(self, con: DataFrame) -> DataFrame:
        if self.kinds is not None:
            con = con.where(F.col("connection_type").isin(*self.kinds))
        if self.least_cents is not None:
            con = con.where(F.col("amount_cents") >= self.least_cents)
        if self.first is not None:
            con = con.where(F.col("occurred_at") >= F.lit(self.first).cast("date"))
        if self.last is not None:
            con = con.where(F.col("occurred_at") <= F.lit(self.last).cast("date"))
        return con


MONEY = View(("donation", "contract_award"), least_cents=1_000_000, first="2020-01-01", last="2023-12-31")


@query(sql("con") + "SELECT id FROM con WHERE connection_type IN ('donation', 'contract_award') AND amount_cents >= 1000000 AND occurred_at BETWEEN DATE '2020-01-01' AND DATE '2023-12-31'")
def view_edges(spark, d):
    return MONEY.edges(rows(spark, d, "con", "from_id to_id connection_type amount_cents occurred_at")).select("id")


@query(sql("con") + ", e AS (SELECT * FROM con WHERE connection_type IN ('donation', 'contract_award') AND amount_cents >= 1000000 AND occurred_at BETWEEN DATE '2020-01-01' AND DATE '2023-12-31') SELECT DISTINCT node FROM (SELECT from_id AS node FROM e UNION ALL SELECT to_id FROM e)")
def view_nodes(spark, d):
    """The nodes that the kept edges name."""
    return MONEY.edges(rows(spark, d, "con", "from_id to_id connection_type amount_cents occurred_at")).select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()


@query(sql("con") + """, deg AS (SELECT node, count(*) AS n, sum(coalesce(cents, 0)) AS cents FROM (SELECT from_id AS node, amount_cents AS cents FROM con UNION ALL SELECT to_id, amount_cents FROM con) GROUP BY node)
  SELECT node, round(CASE WHEN cents > 0 THEN sqrt(cents / 100.0 / 100000.0) * 2 ELSE sqrt(n) * 2 END, 4)::DOUBLE AS size FROM deg""")
def node_sizes(spark, d):
    ends = rows(spark, d, "con", "from_id to_id amount_cents").select(F.explode(F.array("from_id", "to_id")).alias("node"), "amount_cents")
    g = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.coalesce("amount_cents", F.lit(0))).alias("cents"))
    return g.select("node", F.round(F.when(F.col("cents") > 0, F.sqrt(F.col("cents") / 100.0 / 100000.0) * 2).otherwise(F.sqrt("n") * 2), 4).alias("size"))


@query(sql("con", "nod") + """, ends AS (SELECT from_type AS t, from_id AS i FROM con UNION ALL SELECT to_type, to_id FROM con), d AS (SELECT t, i, count(*) AS n FROM ends GROUP BY 1, 2)
  SELECT t AS type, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS ends, count(*) FILTER (WHERE nod.id IS NULL) AS orphans FROM d LEFT JOIN nod ON nod.type = t AND nod.id = i GROUP BY 1""")
def force_stats(spark, d):
    """Per kind of node: nodes, ends, and nodes of the edges that no table has."""
    con = rows(spark, d, "con", "from_type from_id to_type to_id")
    ends = con.select(F.inline(F.array(F.struct(F.col("from_type").alias("type"), F.col("from_id").alias("id")), F.struct(F.col("to_type").alias("type"), F.col("to_id").alias("id")))))
    deg = ends.groupBy("type", "id").agg(F.count("*").alias("n"))
    got = deg.join(nodes(spark, d).select("type", "id", F.lit(1).alias("there")), ["type", "id"], "left")
    return got.groupBy("type").agg(F.count("*").alias("nodes"), F.sum("n").alias("ends"), F.count_if(F.col("there").isNull()).alias("orphans"))


@query("""SELECT DISTINCT lower(trim(governing_body_id)) AS from_id, lower(trim(id)) AS to_id, 'oversight' AS connection_type FROM agencies WHERE governing_body_id IS NOT NULL AND id IS NOT NULL""")
def oversight_edges(spark, d):
    a = table(spark, d, "agencies").where("governing_body_id IS NOT NULL AND id IS NOT NULL")
    return a.select(F.lower(F.trim("governing_body_id")).alias("from_id"), F.lower(F.trim("id")).alias("to_id"), F.lit("oversight").alias("connection_type")).distinct()


_ISSUES = [("water", r"water|flood"), ("schools", r"school|teacher"), ("health", r"clinic|prescription"), ("housing", r"housing|tenant"), ("transport", r"bridge|freight|port "), ("elections", r"ballot")]
_ISSUE_SQL = " UNION ALL ".join(f"SELECT id, '{k}' AS issue FROM pro WHERE regexp_matches(lower(title), '{p}')" for k, p in _ISSUES)


@query(sql("pro", "con") + f""", i AS ({_ISSUE_SQL}), v AS (SELECT DISTINCT from_id, to_id, connection_type FROM con WHERE connection_type IN ('vote_yes', 'vote_no'))
  SELECT issue, count(*) FILTER (WHERE connection_type = 'vote_yes') AS yes, count(*) FILTER (WHERE connection_type = 'vote_no') AS no, round(count(*) FILTER (WHERE connection_type = 'vote_yes') / count(*), 6)::DOUBLE AS yes_rate
  FROM v JOIN i ON i.id = v.to_id GROUP BY 1""")
def issue_stats(spark, d):
    """A title can name several issues; proposals are exploded, votes are not."""
    issue = rows(spark, d, "pro", "title").select(F.col("id").alias("to_id"), F.explode(C.all_matches(F.col("title"), _ISSUES)).alias("issue"))
    v = rows(spark, d, "con", "from_id to_id connection_type").where(F.col("connection_type").isin("vote_yes", "vote_no")).select("from_id", "to_id", "connection_type").distinct()
    g = skew_join(v, issue, ["to_id"], "inner").groupBy("issue").agg(F.count_if(F.col("connection_type") == "vote_yes").alias("yes"), F.count_if(F.col("connection_type") == "vote_no").alias("no"))
    return g.withColumn("yes_rate", F.round(F.col("yes") / (F.col("yes") + F.col("no")), 6))


@query(sql("con", "pro") + """SELECT from_id, count(*) FILTER (WHERE connection_type = 'vote_yes') AS yes, count(*) FILTER (WHERE connection_type = 'vote_no') AS no, count(*) FILTER (WHERE connection_type = 'vote_abstain') AS abstain,
  count(*) FILTER (WHERE vote_category = 'procedural') AS procedural, count(*) FILTER (WHERE vote_category = 'substantive') AS substantive
  FROM con LEFT JOIN (SELECT id, min(vote_category) AS vote_category FROM pro GROUP BY id) p ON p.id = to_id WHERE connection_type LIKE 'vote%' GROUP BY 1""")
def vote_breakdown(spark, d):
    cat = rows(spark, d, "pro", "vote_category").groupBy(F.col("id").alias("to_id")).agg(F.min("vote_category").alias("cat"))
    v = skew_join(rows(spark, d, "con", "from_id to_id connection_type").where(F.col("connection_type").startswith("vote")).select("from_id", "to_id", "connection_type"), cat, ["to_id"], "left")
    n = lambda c, x: F.count_if(F.col(c) == x)
    return v.groupBy("from_id").agg(n("connection_type", "vote_yes").alias("yes"), n("connection_type", "vote_no").alias("no"), n("connection_type", "vote_abstain").alias("abstain"), n("cat", "procedural").alias("procedural"), n("cat", "substantive").alias("substantive"))


@query(sql("fin") + """, s AS (SELECT official_id, coalesce(industry, 'Other') AS sector, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fin WHERE official_id IS NOT NULL GROUP BY 1, 2)
  SELECT official_id, sector, cents FROM (SELECT *, row_number() OVER (PARTITION BY official_id ORDER BY cents DESC, sector) AS rn FROM s) WHERE rn <= 3""")
def sunburst_industries(spark, d):
    g = rows(spark, d, "fin", "official_id industry amount_cents").where("official_id IS NOT NULL").groupBy("official_id", F.coalesce("industry", F.lit("Other")).alias("sector")).agg(F.sum("amount_cents").alias("cents"))
    return G.top_per_group(g, ["official_id"], [F.desc("cents"), F.col("sector")], 3)


@query(sql("con", "off") + """SELECT connection_type, to_id, CAST(sum(amount_cents) AS BIGINT) AS cents, max(strength) AS strength FROM con WHERE from_id IN (SELECT id FROM off WHERE state = 'AL') GROUP BY 1, 2""")
def sunburst_group(spark, d):
    m = rows(spark, d, "off", "state").where("state = 'AL'").select(F.col("id").alias("from_id"))
    return skew_join(rows(spark, d, "con", "from_id to_id connection_type strength amount_cents"), m, ["from_id"], "left_semi", sketch=keys(spark, d, "con", "from_id")).groupBy("connection_type", "to_id").agg(F.sum("amount_cents").alias("cents"), F.max("strength").alias("strength"))


@query(sql("fin") + """, t AS (SELECT official_id, donor_type, count(*) AS n FROM fin WHERE official_id IS NOT NULL AND donor_type IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY official_id ORDER BY n DESC, donor_type) AS rn FROM t) SELECT official_id, string_agg(donor_type, ', ' ORDER BY n DESC, donor_type) AS types FROM k WHERE rn <= 3 GROUP BY 1""")
def donor_type_profile(spark, d):
    """The three most frequent donor types in one string; a group has as many types as there are."""
    t = rows(spark, d, "fin", "official_id donor_type").where("official_id IS NOT NULL AND donor_type IS NOT NULL").groupBy("official_id", "donor_type").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("donor_type").alias("t"))))
    return t.groupBy("official_id").agg(F.array_join(F.transform(F.slice(order, 1, 3), lambda x: x["t"]), ", ").alias("types"))


@query(sql("fin") + """SELECT donor_name, CASE WHEN m < 500000 THEN 'small' WHEN m < 5000000 THEN 'medium' ELSE 'large' END AS size FROM (SELECT donor_name, max(amount_cents) AS m FROM fin WHERE donor_name IS NOT NULL GROUP BY 1)""")
def donation_size(spark, d):
    m = rows(spark, d, "fin", "donor_name amount_cents").where("donor_name IS NOT NULL").groupBy("donor_name").agg(F.max("amount_cents").alias("m"))
    return m.select("donor_name", F.when(F.col("m") < 500_000, "small").when(F.col("m") < 5_000_000, "medium").otherwise("large").alias("size"))


@query(sql("fin") + """, g AS (SELECT official_id, donor_name, min(donor_type) AS donor_type, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fin WHERE official_id IS NOT NULL AND donor_name IS NOT NULL GROUP BY 1, 2)
  SELECT official_id, donor_name, donor_type, cents FROM (SELECT *, row_number() OVER (PARTITION BY official_id ORDER BY cents DESC, donor_name) AS rn FROM g) WHERE rn <= 20""")
def top_donors(spark, d):
    g = rows(spark, d, "fin", "official_id donor_name donor_type amount_cents").where("official_id IS NOT NULL AND donor_name IS NOT NULL").groupBy("official_id", "donor_name").agg(F.min("donor_type").alias("donor_type"), F.sum("amount_cents").alias("cents"))
    return G.top_per_group(g, ["official_id"], [F.desc("cents"), F.col("donor_name")], 20)


@query(sql("nod") + """SELECT 'key' AS way, type, id, label FROM nod WHERE id = (SELECT min(id) FROM nod) UNION ALL SELECT 'name', type, id, label FROM nod WHERE lower(label) = (SELECT min(lower(label)) FROM nod WHERE type = 'official')""")
def entity_resolve(spark, d):
    """An entity by its key, and by its name whatever the case."""
    n = nodes(spark, d)
    least = n.agg(F.min("id").alias("k"), F.min(F.when(F.col("type") == "official", F.lower("label"))).alias("l")).first()
    cols = ["type", "id", "label"]
    return n.where(F.col("id") == F.lit(least.k)).select(F.lit("key").alias("way"), *cols).unionByName(n.where(F.lower("label") == F.lit(least.l)).select(F.lit("name").alias("way"), *cols))


@query(sql("con") + """SELECT 'strength_in_range' AS name, count(*) FILTER (WHERE strength < 0 OR strength > 1) = 0 AS passed FROM con UNION ALL SELECT 'has_votes', count(*) FILTER (WHERE connection_type LIKE 'vote%') > 10 FROM con
  UNION ALL SELECT 'no_self_edges', count(*) FILTER (WHERE from_id = to_id) = 0 FROM con UNION ALL SELECT 'ids_unique', count(*) = count(DISTINCT id) FROM con""")
def self_tests(spark, d):
    """Named checks from one pass."""
    con = rows(spark, d, "con", "from_id to_id connection_type strength")
    one = con.agg((F.count_if(~F.col("strength").between(0, 1)) == 0).alias("strength_in_range"), (F.count_if(F.col("connection_type").startswith("vote")) > 10).alias("has_votes"), (F.count_if(F.col("from_id") == F.col("to_id")) == 0).alias("no_self_edges"), (F.count("*") == F.countDistinct("id")).alias("ids_unique"))
    return one.unpivot([], ["strength_in_range", "has_votes", "no_self_edges", "ids_unique"], "name", "passed")


@query(sql("con") + """SELECT CASE connection_type WHEN 'vote_yes' THEN 'voted' WHEN 'vote_no' THEN 'voted' WHEN 'donation' THEN 'money' WHEN 'contract_award' THEN 'money' ELSE 'other' END AS kind, count(*) AS n FROM con GROUP BY 1""")
def edge_kinds(spark, d):
    """Database kinds mapped to shown kinds, with a fallback."""
    shown = F.create_map(*[F.lit(x) for x in ("vote_yes", "voted", "vote_no", "voted", "donation", "money", "contract_award", "money")])
    return rows(spark, d, "con", "connection_type").groupBy(F.coalesce(F.try_element_at(shown, F.col("connection_type")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


_EV = "WITH e AS (SELECT event_id, ts, user_id, event_type = 'error' AS is_bot, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'crawler' END AS bot, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'c' || CAST(user_id % 4 AS VARCHAR) END AS country, CASE WHEN user_id % 5 = 0 THEN 'direct' WHEN user_id % 5 < 3 THEN 'search' ELSE 'internal' END AS referrer FROM events)\n"


def _ev(spark, d) -> DataFrame:
    u = F.col("user_id")
    return table(spark, d, "events").select("event_id", "ts", "user_id", (F.col("event_type") == "error").alias("is_bot"), F.when((F.col("event_type") == "error") & (u % 2 == 0), "crawler").alias("bot"), F.when(u % 4 != 0, F.concat(F.lit("c"), (u % 4).cast("string"))).alias("country"), F.when(u % 5 == 0, "direct").when(u % 5 < 3, "search").otherwise("internal").alias("referrer"))


@query(_EV + "SELECT referrer, count(*) AS n FROM e WHERE NOT is_bot GROUP BY 1")
def pv_sources(spark, d):
    return _ev(spark, d).where("NOT is_bot").groupBy("referrer").agg(F.count("*").alias("n"))


@query(_EV + "SELECT country, count(*) AS n FROM e WHERE country IS NOT NULL AND NOT is_bot GROUP BY 1 ORDER BY n DESC, country LIMIT 20")
def pv_countries(spark, d):
    return _ev(spark, d).where("country IS NOT NULL AND NOT is_bot").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(20)


@query(_EV + "SELECT CASE WHEN is_bot THEN coalesce(bot, 'Unknown bot') ELSE 'Human' END AS agent, count(*) AS n FROM e GROUP BY 1")
def pv_bots(spark, d):
    return _ev(spark, d).groupBy(F.when(F.col("is_bot"), F.coalesce("bot", F.lit("Unknown bot"))).otherwise("Human").alias("agent")).agg(F.count("*").alias("n"))


@query(_EV + "SELECT s_name, count(*) AS n FROM e JOIN supplier ON s_suppkey = user_id WHERE ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1 ORDER BY n DESC, s_name LIMIT 5")
def pv_top_entities(spark, d):
    """Counts before the join with the names."""
    n = _ev(spark, d).where(F.col("ts") > F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy(F.col("user_id").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return n.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").groupBy("s_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s_name").limit(5)


@query("SELECT event_type, strftime(ts, '%Y-%m') AS period, count(*) AS n FROM events GROUP BY 1, 2")
def usage_counters(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).where("k IS NOT NULL")


@query(sql("off", "fin", "con") + """, v AS (SELECT from_id AS id, max(created_at) AS born FROM con WHERE connection_type LIKE 'vote%' GROUP BY 1 UNION ALL SELECT official_id, max(created_at) FROM fin WHERE official_id IS NOT NULL GROUP BY 1),
  c AS (SELECT DISTINCT id FROM v WHERE born > TIMESTAMPTZ '2024-09-01 00:00:00+00') SELECT off.id, count(fin.id) AS gifts, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS cents FROM off JOIN c USING (id) LEFT JOIN fin ON official_id = off.id GROUP BY 1""")
def delta_totals(spark, d):
    """Incremental run: totals of the officials that changed, from all of their rows and not from the new ones only."""
    at = F.lit("2024-09-01 00:00:00").cast("timestamp")
    con, fin = rows(spark, d, "con", "from_id connection_type amount_cents created_at"), rows(spark, d, "fin", "official_id amount_cents created_at").where("official_id IS NOT NULL")
    new = con.where(F.col("connection_type").startswith("vote") & (F.col("created_at") > at)).select(F.col("from_id").alias("id"))
    new = new.unionByName(fin.where(F.col("created_at") > at).select(F.col("official_id").alias("id"))).distinct()
    off = rows(spark, d, "off", "created_at").select("id").join(new, "id", "left_semi")
    total = skew_join(fin, off.withColumnRenamed("id", "official_id"), ["official_id"], "left_semi").groupBy(F.col("official_id").alias("id")).agg(F.count("*").alias("gifts"), F.sum("amount_cents").alias("cents"))
    return off.join(total, "id", "left").select("id", F.coalesce("gifts", F.lit(0)).alias("gifts"), F.coalesce("cents", F.lit(0)).alias("cents"))
