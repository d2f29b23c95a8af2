"""Graph, money, profile, search and traffic queries over the civic tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polispark.functions import civic as C
from polispark.operators import graph as G
from polispark.operators import upsert as U
from polispark.operators.skew import skew_join
from polispark.plans.civics import keys, nodes, rows, sql
from polispark.session import durable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Instant to which relative times refer.
AS_OF = "2024-01-31 00:00:00"
#: A hub and an ordinary entity of the graph, chosen by rule: the official with most edges, and the donor with fewest.


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return register


def _fin_off(spark, d, columns: str) -> DataFrame:
    """Contributions with their official; skew-proof, as one official may hold a large share."""
    off = rows(spark, d, "off", "full_name role_title party state is_active").select(F.col("id").alias("official_id"), "full_name", "party", "role_title", "state", "is_active")
    return skew_join(rows(spark, d, "fin", f"official_id {columns}"), off, ["official_id"], "inner", sketch=keys(spark, d, "fin", "official_id"))


# -- officials and money ---------------------------------------------------------------------------------------------


@query(sql("off") + "SELECT id FROM off WHERE role_title ILIKE '%representative%' AND party = 'democrat' AND state = 'AL' ORDER BY id LIMIT 1000")
def officials_by_filter(spark, d):
    """Optional filters become predicates only where given; a total order comes before the limit."""
    off = rows(spark, d, "off", "role_title party state")
    return off.where(F.col("role_title").ilike("%representative%") & (F.col("party") == "democrat") & (F.col("state") == "AL")).select("id").orderBy("id").limit(1000)


@query(sql("off") + "SELECT CASE WHEN json_extract_string(source_ids, '$.roster') IS NOT NULL THEN 'rostered' WHEN role_title LIKE 'State%' THEN 'state' ELSE 'other' END AS level, count(*) AS n FROM off GROUP BY 1")
def officials_breakdown(spark, d):
    """Grouped by the presence of a key in a JSON column, then by title."""
    level = F.when(F.get_json_object("source_ids", "$.roster").isNotNull(), "rostered").when(F.col("role_title").like("State%"), "state").otherwise("other")
    return rows(spark, d, "off", "full_name role_title party state is_active source_ids").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


_TREEMAP = sql("off", "fin") + """, tree AS (SELECT o.id, o.full_name AS name, coalesce(o.party, 'nonpartisan') AS party, coalesce(o.state, 'Unknown') AS state,
  CASE WHEN o.role_title ILIKE '%senator%' THEN 'senate' WHEN o.role_title ILIKE '%representative%' THEN 'house' ELSE 'unknown' END AS chamber,
  CAST(sum(f.amount_cents) AS BIGINT) AS total_cents FROM off o LEFT JOIN fin f ON f.official_id = o.id WHERE o.is_active
  GROUP BY o.id, o.full_name, o.party, o.state, o.role_title HAVING sum(f.amount_cents) > 0 ORDER BY total_cents DESC, o.id LIMIT 200)
"""


def _treemap(spark, d, limit=200):
    off = rows(spark, d, "off", "full_name role_title party state is_active").where("is_active")
    total = rows(spark, d, "fin", "official_id amount_cents").groupBy("official_id").agg(F.sum("amount_cents").alias("total_cents")).where("total_cents > 0")  # before the join
    chamber = F.when(F.col("role_title").ilike("%senator%"), "senate").when(F.col("role_title").ilike("%representative%"), "house").otherwise("unknown")
    got = off.join(total, off.id == total.official_id).select("id", F.col("full_name").alias("name"), F.coalesce("party", F.lit("nonpartisan")).alias("party"), F.coalesce("state", F.lit("Unknown")).alias("state"), chamber.alias("chamber"), "total_cents")
    return got.orderBy(F.desc("total_cents"), "id").limit(limit)


@query(_TREEMAP + "SELECT * FROM tree")
def treemap_officials(spark, d):
    return _treemap(spark, d)


@query(_TREEMAP + "SELECT * FROM tree WHERE party = 'democrat' AND chamber = 'senate'")
def treemap_filtered(spark, d):
    """The limit comes before the filter."""
    return _treemap(spark, d).where("party = 'democrat' AND chamber = 'senate'")


@query(_TREEMAP + "SELECT party, count(*) AS n, CAST(sum(total_cents) AS BIGINT) AS total_cents, max_by(name, total_cents) AS top_name FROM tree GROUP BY party")
def treemap_by_party(spark, d):
    return _treemap(spark, d).groupBy("party").agg(F.count("*").alias("n"), F.sum("total_cents").alias("total_cents"), F.max_by("name", "total_cents").alias("top_name"))


_TOP1 = "(SELECT official_id FROM fin WHERE official_id IS NOT NULL GROUP BY 1 ORDER BY sum(amount_cents) DESC, official_id LIMIT 1)"


def _top_official(fin: DataFrame) -> DataFrame:
    return fin.where("official_id IS NOT NULL").groupBy("official_id").agg(F.sum("amount_cents").alias("s")).orderBy(F.desc("s"), "official_id").limit(1).select("official_id")


@query(sql("fin") + f"""SELECT donor_name, donor_type, coalesce(min(industry), 'Other') AS industry, CAST(sum(amount_cents) AS BIGINT) / 100.0::DOUBLE AS usd, count(*) AS n
  FROM fin WHERE official_id = {_TOP1} GROUP BY 1, 2 ORDER BY usd DESC, donor_name, donor_type LIMIT 100""")
def official_donors(spark, d):
    """Donors of the official who received most; the first industry by name stands for the group."""
    fin = rows(spark, d, "fin", "official_id donor_name donor_type industry amount_cents")
    own = fin.join(F.broadcast(_top_official(fin)), "official_id", "left_semi")  # a single key
    got = own.groupBy("donor_name", "donor_type").agg(F.coalesce(F.min("industry"), F.lit("Other")).alias("industry"), C.dollars(F.sum("amount_cents")).alias("usd"), F.count("*").alias("n"))
    return got.orderBy(F.desc("usd"), "donor_name", "donor_type").limit(100)


@query(sql("fin") + f"""SELECT coalesce(industry, donor_type, 'Other') AS sector, CAST(sum(amount_cents) AS BIGINT) AS cents, round(100.0 * sum(amount_cents) / sum(sum(amount_cents)) OVER (), 6)::DOUBLE AS pct
  FROM fin WHERE official_id = {_TOP1} GROUP BY 1 ORDER BY cents DESC, sector LIMIT 8""")
def profile_sector_share(spark, d):
    """Share of the total over all groups, then the top ones; the window runs over groups, not rows."""
    fin = rows(spark, d, "fin", "official_id donor_type industry amount_cents")
    own = fin.join(F.broadcast(_top_official(fin)), "official_id", "left_semi")
    got = own.groupBy(F.coalesce("industry", "donor_type", F.lit("Other")).alias("sector")).agg(F.sum("amount_cents").alias("cents"))
    total = got.agg(F.sum("cents").alias("all")).first().all or 1
    return got.select("sector", "cents", F.round(F.lit(100.0) * F.col("cents") / F.lit(total), 6).alias("pct")).orderBy(F.desc("cents"), "sector").limit(8)


@query(sql("fin") + "SELECT coalesce(industry, 'Unknown') AS industry, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n FROM fin GROUP BY 1")
def donations_by_industry(spark, d):
    return rows(spark, d, "fin", "donor_name donor_type industry amount_cents").groupBy(F.coalesce("industry", F.lit("Unknown")).alias("industry")).agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("n"))


_AGG = "f.donor_type = 'pac' AND f.donor_name NOT ILIKE '%aggregate%' AND f.donor_name NOT ILIKE '%unitemized%'"


@query(sql("off", "fin") + f"SELECT coalesce(o.party, 'other') AS party, f.donor_name, CAST(sum(f.amount_cents) AS BIGINT) AS cents, count(*) AS n FROM fin f JOIN off o ON o.id = f.official_id WHERE {_AGG} GROUP BY o.party, f.donor_name")
def pac_by_party(spark, d):
    """Grouped by the raw party, shown with a default: a null party is a group of its own."""
    got = _fin_off(spark, d, "donor_type donor_name amount_cents").where((F.col("donor_type") == "pac") & ~F.col("donor_name").ilike("%aggregate%") & ~F.col("donor_name").ilike("%unitemized%"))
    return got.groupBy("party", "donor_name").agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("n")).select(F.coalesce("party", F.lit("other")).alias("party"), "donor_name", "cents", "n")


@query(sql("off", "fin") + f""", leaf AS (SELECT coalesce(o.party, 'other') AS party, f.donor_name, CAST(sum(f.amount_cents) AS BIGINT) AS cents FROM fin f JOIN off o ON o.id = f.official_id
  WHERE {_AGG} GROUP BY 1, 2), kept AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY cents DESC, donor_name) AS rn FROM leaf WHERE cents > 1000000)
  SELECT party, count(*) AS leaves, CAST(sum(cents) AS BIGINT) AS cents FROM kept WHERE rn <= 50 GROUP BY party ORDER BY cents DESC, party LIMIT 3""")
def pac_hierarchy_party(spark, d):
    """Two rings: totals are sums over the kept leaves only."""
    got = pac_by_party(spark, d).groupBy("party", "donor_name").agg(F.sum("cents").alias("cents")).where("cents > 1000000")
    kept = G.top_per_group(got, ["party"], [F.desc("cents"), F.col("donor_name")], 50)
    return kept.groupBy("party").agg(F.count("*").alias("leaves"), F.sum("cents").alias("cents")).orderBy(F.desc("cents"), "party").limit(3)


@query(sql("fin") + """, leaf AS (SELECT coalesce(industry, 'Other') AS sector, donor_name, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fin WHERE donor_type = 'pac' GROUP BY 1, 2),
  kept AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY cents DESC, donor_name) AS rn FROM leaf)
  SELECT sector, donor_name, cents FROM kept WHERE rn <= 20 AND sector IN (SELECT sector FROM kept WHERE rn <= 20 GROUP BY sector ORDER BY sum(cents) DESC, sector LIMIT 15)""")
def pac_hierarchy_sector(spark, d):
    got = rows(spark, d, "fin", "official_id donor_name donor_type industry amount_cents").where("donor_type = 'pac'").groupBy(F.coalesce("industry", F.lit("Other")).alias("sector"), "donor_name").agg(F.sum("amount_cents").alias("cents"))
    kept = G.top_per_group(got, ["sector"], [F.desc("cents"), F.col("donor_name")], 20)
    top = kept.groupBy("sector").agg(F.sum("cents").alias("s")).orderBy(F.desc("s"), "sector").limit(15).select("sector")
    return kept.join(F.broadcast(top), "sector", "left_semi").select("sector", "donor_name", "cents")  # 15 rows


_CHORD = sql("off", "fin", "ent") + """, cell AS (SELECT coalesce(e.entity_type, 'untagged') AS industry, coalesce(o.party, 'other') || '-' || CASE WHEN o.role_title ILIKE '%representative%' THEN 'House' ELSE 'Senate' END AS party_chamber,
  CAST(sum(f.amount_cents) AS BIGINT) AS total_cents, count(DISTINCT o.id) AS official_count, count(DISTINCT f.donor_name) AS donor_count
  FROM fin f JOIN off o ON o.id = f.official_id LEFT JOIN ent e ON e.name = f.donor_name WHERE f.amount_cents > 0 GROUP BY 1, 2)
"""


def _chord(spark, d):
    """Several entities of one name count the amount once per match, as a join does; donors of no entity are untagged."""
    ent = rows(spark, d, "ent", "name entity_type").select(F.col("name").alias("donor_name"), "entity_type")
    money = _fin_off(spark, d, "donor_name amount_cents").where("amount_cents > 0")
    tagged = skew_join(money, ent, ["donor_name"], "left", sketch=keys(spark, d, "fin", "donor_name"))
    chamber = F.when(F.col("role_title").ilike("%representative%"), "House").otherwise("Senate")
    cell = (F.coalesce("entity_type", F.lit("untagged")).alias("industry"), F.concat_ws("-", F.coalesce("party", F.lit("other")), chamber).alias("party_chamber"))
    return tagged.groupBy(*cell).agg(F.sum("amount_cents").alias("total_cents"), F.countDistinct("official_id").alias("official_count"), F.countDistinct("donor_name").alias("donor_count"))


@query(_CHORD + "SELECT * FROM cell")
def chord_flows(spark, d):
    return _chord(spark, d)


@query(_CHORD + """SELECT industry, CAST(sum(CASE WHEN party_chamber = 'democrat-House' THEN total_cents END) AS BIGINT) AS dem_house, CAST(sum(CASE WHEN party_chamber = 'democrat-Senate' THEN total_cents END) AS BIGINT) AS dem_senate,
  CAST(sum(CASE WHEN party_chamber = 'republican-House' THEN total_cents END) AS BIGINT) AS rep_house, CAST(sum(CASE WHEN party_chamber = 'republican-Senate' THEN total_cents END) AS BIGINT) AS rep_senate FROM cell GROUP BY industry""")
def chord_matrix(spark, d):
    names = {"democrat-House": "dem_house", "democrat-Senate": "dem_senate", "republican-House": "rep_house", "republican-Senate": "rep_senate"}
    got = _chord(spark, d).groupBy("industry").pivot("party_chamber", list(names)).agg(F.sum("total_cents"))
    return got.select("industry", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query(_CHORD + """, sym AS (SELECT industry AS a, party_chamber AS b, total_cents AS v FROM cell UNION ALL SELECT party_chamber, industry, total_cents FROM cell)
  SELECT a, b, v, round(v / sum(v) OVER (PARTITION BY a), 6)::DOUBLE AS share FROM sym""")
def chord_normalised(spark, d):
    """The symmetric square matrix in long form, each row divided by its total."""
    cell = durable(_chord(spark, d), "chord")
    sym = cell.select(F.col("industry").alias("a"), F.col("party_chamber").alias("b"), F.col("total_cents").alias("v")).unionByName(cell.select(F.col("party_chamber").alias("a"), F.col("industry").alias("b"), F.col("total_cents").alias("v")))
    return sym.withColumn("share", F.round(F.col("v") / F.sum("v").over(Window.partitionBy("a")), 6))


@query(sql("off", "fin") + """SELECT industry AS sector, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fin WHERE official_id IN (SELECT id FROM off WHERE state = 'AL') AND industry IS NOT NULL AND lower(industry) <> 'other'
  GROUP BY 1 HAVING sum(amount_cents) >= 100000 ORDER BY cents DESC, sector LIMIT 12""")
def group_sector_totals(spark, d):
    """A group is a stored predicate: its members are a semi-join, not a list of ids."""
    members = rows(spark, d, "off", "state").where("state = 'AL'").select(F.col("id").alias("official_id"))
    money = rows(spark, d, "fin", "official_id industry amount_cents").where("industry IS NOT NULL AND lower(industry) <> 'other'")
    got = skew_join(money, members, ["official_id"], "left_semi", sketch=keys(spark, d, "fin", "official_id")).groupBy(F.col("industry").alias("sector")).agg(F.sum("amount_cents").alias("cents"))
    return got.where("cents >= 100000").orderBy(F.desc("cents"), "sector").limit(12)


@query(sql("off", "fin") + """, g AS (SELECT id, state = 'AL' AS a, party = 'democrat' AS b FROM off)
  SELECT industry AS sector, CAST(sum(CASE WHEN a THEN amount_cents ELSE 0 END) AS BIGINT) AS a_cents, CAST(sum(CASE WHEN b THEN amount_cents ELSE 0 END) AS BIGINT) AS b_cents
  FROM fin JOIN g ON g.id = official_id WHERE (a OR b) AND industry IS NOT NULL GROUP BY 1 ORDER BY a_cents + b_cents DESC, sector LIMIT 12""")
def crossgroup_sector_totals(spark, d):
    """A member of both groups counts in both."""
    got = _fin_off(spark, d, "industry amount_cents").where("(state = 'AL' OR party = 'democrat') AND industry IS NOT NULL")
    part = lambda p: F.sum(F.when(F.expr(p), F.col("amount_cents")).otherwise(0))
    got = got.groupBy(F.col("industry").alias("sector")).agg(part("state = 'AL'").alias("a_cents"), part("party = 'democrat'").alias("b_cents"))
    return got.orderBy((F.col("a_cents") + F.col("b_cents")).desc(), "sector").limit(12)


@query(sql("fin") + """SELECT upper(trim(donor_name)) AS donor, donor_type, official_id, CAST(sum(amount_cents) AS BIGINT) AS cents, coalesce(array_to_string(list_sort(list(DISTINCT cycle_year) FILTER (WHERE cycle_year IS NOT NULL)), ','), '') AS cycles
  FROM fin WHERE official_id IS NOT NULL AND donor_name IS NOT NULL GROUP BY 1, 2, 3""")
def donor_rollup(spark, d):
    fin = rows(spark, d, "fin", "official_id donor_name donor_type amount_cents cycle_year").where("official_id IS NOT NULL AND donor_name IS NOT NULL")
    got = fin.groupBy(F.upper(F.trim("donor_name")).alias("donor"), "donor_type", "official_id").agg(F.sum("amount_cents").alias("cents"), F.collect_set("cycle_year").alias("c"))
    return got.select("donor", "donor_type", "official_id", "cents", F.array_join(F.transform(F.sort_array("c"), lambda x: x.cast("string")), ",").alias("cycles"))


@query(sql("fin") + """, r AS (SELECT donor_name AS name, donor_type, industry, CAST(sum(amount_cents) AS BIGINT) AS cents, count(DISTINCT official_id) AS officials FROM fin WHERE donor_name IS NOT NULL GROUP BY 1, 2, 3),
  p AS (SELECT *, row_number() OVER (PARTITION BY name, donor_type ORDER BY cents DESC, coalesce(industry, '') DESC) AS rn, sum(cents) OVER (PARTITION BY name, donor_type) AS total FROM r)
  SELECT name, donor_type, industry, CAST(total AS BIGINT) AS cents FROM p WHERE rn = 1""")
def donor_entities(spark, d):
    """One entity per name and type; its industry is that of the largest amount."""
    r = rows(spark, d, "fin", "donor_name donor_type industry amount_cents").where("donor_name IS NOT NULL").groupBy(F.col("donor_name").alias("name"), "donor_type", "industry").agg(F.sum("amount_cents").alias("cents"))
    return r.groupBy("name", "donor_type").agg(F.max_by("industry", F.struct("cents", F.coalesce("industry", F.lit("")))).alias("industry"), F.sum("cents").alias("cents"))


@query(sql("fin", "ent") + """, p AS (SELECT upper(trim(donor_name)) AS donor, official_id, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fin WHERE official_id IS NOT NULL AND donor_name IS NOT NULL GROUP BY 1, 2),
  e AS (SELECT upper(trim(name)) AS donor, min(id) AS entity FROM ent GROUP BY 1)
  SELECT entity AS from_id, official_id AS to_id, cents, round(CASE WHEN cents > 0 THEN greatest(0.0, least(1.0, log10(cents / 100000.0) / 4)) ELSE 0.0 END, 6)::DOUBLE AS strength FROM p JOIN e USING (donor)""")
def donation_edges(spark, d):
    """Contributions rolled up per donor and official before they meet the entities."""
    pairs = rows(spark, d, "fin", "official_id donor_name amount_cents").where("official_id IS NOT NULL AND donor_name IS NOT NULL").groupBy(F.upper(F.trim("donor_name")).alias("donor"), "official_id").agg(F.sum("amount_cents").alias("cents"))
    ent = rows(spark, d, "ent", "name").groupBy(F.upper(F.trim("name")).alias("donor")).agg(F.min("id").alias("from_id"))
    return skew_join(pairs, ent, ["donor"], "inner").select("from_id", F.col("official_id").alias("to_id"), "cents", F.round(C.donation_strength(F.col("cents")), 6).alias("strength"))


@query(sql("fin") + "SELECT official_id, count(*) AS n FROM fin WHERE created_at > TIMESTAMP '2024-06-01 00:00:00' AND official_id IS NOT NULL GROUP BY 1")
def delta_officials(spark, d):
    """Incremental run: officials with rows after the watermark; the filter is pushed to the scan."""
    got = U.changed_since(rows(spark, d, "fin", "official_id created_at"), "created_at", "2024-06-01 00:00:00").where("official_id IS NOT NULL")
    return got.groupBy("official_id").agg(F.count("*").alias("n"))


@query("""SELECT candid, kind, CAST(floor(amount * 100 + 0.5) AS BIGINT) AS cents FROM (SELECT DISTINCT candid, indivcontrib, polptycontrib, candcontrib, ttlreceipts FROM weball_rows)
  CROSS JOIN LATERAL (VALUES ('individual', indivcontrib), ('party', polptycontrib), ('self', candcontrib)) AS v(kind, amount) WHERE amount > 0""")
def candidate_totals(spark, d):
    """One wide row per candidate unpivoted to one row per positive kind."""
    wide = table(spark, d, "weball_rows").select("candid", "indivcontrib", "polptycontrib", "candcontrib", "ttlreceipts").distinct()
    long = wide.unpivot(["candid"], ["indivcontrib", "polptycontrib", "candcontrib"], "source", "amount").where("amount > 0")
    kind = F.create_map(*[F.lit(x) for x in ("indivcontrib", "individual", "polptycontrib", "party", "candcontrib", "self")])[F.col("source")]
    return long.select("candid", kind.alias("kind"), C.half_up(F.col("amount") * 100).alias("cents"))


@query("""SELECT cmteid, candid, CAST(sum(totalcents) AS BIGINT) AS cents, CAST(sum(txcount) AS BIGINT) AS n FROM (SELECT DISTINCT * FROM pac_aggregations) p
  WHERE cmteid IN (SELECT cmteid FROM committee_master) GROUP BY 1, 2 HAVING sum(totalcents) >= 500000""")
def pac_candidates(spark, d):
    """Committee by candidate, kept where the committee is in the master file."""
    master = table(spark, d, "committee_master").select("cmteid").distinct()
    got = table(spark, d, "pac_aggregations").distinct().join(master, "cmteid", "left_semi").groupBy("cmteid", "candid").agg(F.sum("totalcents").alias("cents"), F.sum("txcount").alias("n"))
    return got.where("cents >= 500000")


# -- the graph -------------------------------------------------------------------------------------------------------

_DEG = sql("con") + """, deg AS (SELECT node, count(*) AS degree, max(CAST(connection_type = 'donation' AS INT)) AS has_donations, max(CAST(connection_type LIKE 'vote%' AS INT)) AS has_votes
  FROM (SELECT from_id AS node, connection_type FROM con UNION ALL SELECT to_id, connection_type FROM con) GROUP BY node)
"""


@query(_DEG + "SELECT * FROM deg")
def degree(spark, d):
    return G.degree(rows(spark, d, "con", "from_id to_id connection_type"))


@query(_DEG + ", top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 10) SELECT con.id FROM con WHERE from_id IN (SELECT node FROM top) OR to_id IN (SELECT node FROM top)")
def top_connected(spark, d):
    """The ten best connected nodes and all their edges."""
    con = rows(spark, d, "con", "from_id to_id connection_type")
    return G.at_any(con, [r.node for r in G.top_connected(con, 10).collect()]).select("id")


_MID = "(SELECT node FROM deg WHERE degree >= 5 AND degree < 50 AND has_votes = 1 ORDER BY degree DESC, node LIMIT 1)"


def _middle(con: DataFrame) -> str:
    """A start for the ego queries: the best connected voter below the hubs."""
    got = G.degree(con).where("degree >= 5 AND degree < 50 AND has_votes = 1").orderBy(F.desc("degree"), "node").limit(1).collect()
    return got[0].node if got else ""


_EGO1 = _DEG + f""", own AS (SELECT * FROM con WHERE from_id = {_MID} OR to_id = {_MID}),
  e1 AS (SELECT id, from_id, to_id FROM own WHERE connection_type NOT LIKE 'vote%' UNION ALL (SELECT id, from_id, to_id FROM own WHERE connection_type LIKE 'vote%' ORDER BY occurred_at DESC NULLS LAST, id LIMIT 20))
"""


@query(_EGO1 + "SELECT id FROM e1")
def ego_depth1(spark, d):
    con = rows(spark, d, "con", "from_id to_id connection_type occurred_at")
    return G.ego_one(con, _middle(con), 20).select("id")


_EGO2 = _EGO1 + f""", nb AS (SELECT DISTINCT n FROM (SELECT from_id AS n FROM e1 UNION ALL SELECT to_id FROM e1) WHERE n <> {_MID}),
  ex AS (SELECT n FROM nb JOIN deg ON node = n WHERE degree < 50)
"""


@query(_EGO2 + "SELECT id FROM e1 UNION SELECT id FROM con WHERE from_id IN (SELECT n FROM ex) OR to_id IN (SELECT n FROM ex)")
def ego_depth2(spark, d):
    """Hubs among the neighbours are not expanded; nobody expands a node before its degree is known."""
    con = rows(spark, d, "con", "from_id to_id connection_type occurred_at")
    return G.ego_two(con, _middle(con), 20)[0].select("id")


@query(_EGO2 + "SELECT n AS node, degree, degree >= 50 AS collapsed FROM nb JOIN deg ON node = n")
def ego_neighbours(spark, d):
    con = rows(spark, d, "con", "from_id to_id connection_type occurred_at")
    return G.ego_two(con, _middle(con), 20)[1]


_FAR = "(SELECT node FROM deg WHERE has_donations = 1 AND node <> " + _MID + " ORDER BY degree, node LIMIT 1)"


@query("WITH RECURSIVE" + _DEG[4:] + f""", adj AS (SELECT from_id AS a, to_id AS b FROM con UNION SELECT to_id, from_id FROM con),
  bfs AS (SELECT {_MID} AS node, 0 AS hop UNION SELECT b, hop + 1 FROM bfs JOIN adj ON a = node WHERE hop < 4)
  SELECT CAST(min(hop) AS INTEGER) AS hops FROM bfs WHERE node = {_FAR} HAVING min(hop) IS NOT NULL""")
def path_hops(spark, d):
    """Length of a shortest path between two entities."""
    con = rows(spark, d, "con", "from_id to_id connection_type")
    start = _middle(con)
    goal = G.degree(con).where("has_donations = 1").where(F.col("node") != start).orderBy("degree", "node").limit(1).collect()
    path = G.shortest_path(con, start, goal[0].node if goal else "", 4)
    return path.agg(F.max("hop").alias("hops")).where("hops IS NOT NULL")


@query(sql("con", "off") + "SELECT id, to_id, amount_cents, strength FROM con WHERE from_id IN (SELECT id FROM off WHERE state = 'AL') ORDER BY amount_cents DESC NULLS LAST, strength DESC NULLS LAST, id LIMIT 500")
def group_connections(spark, d):
    members = rows(spark, d, "off", "state").where("state = 'AL'").select(F.col("id").alias("from_id"))
    got = skew_join(rows(spark, d, "con", "from_id to_id strength amount_cents"), members, ["from_id"], "left_semi", sketch=keys(spark, d, "con", "from_id"))
    return got.select("id", "to_id", "amount_cents", "strength").orderBy(F.col("amount_cents").desc_nulls_last(), F.col("strength").desc_nulls_last(), "id").limit(500)


@query(sql("off", "fin") + """, m AS (SELECT id FROM off WHERE state = 'AL'), g AS (SELECT donor_name, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n, count(DISTINCT official_id) AS members FROM fin
  WHERE official_id IN (SELECT id FROM m) AND donor_name IS NOT NULL GROUP BY 1 ORDER BY cents DESC, donor_name LIMIT 25)
  SELECT donor_name, cents, n, members, round(least(cents / 100.0 / 1000000.0, 1.0), 6)::DOUBLE AS strength, CAST(floor(100.0 * n / (SELECT count(*) FROM m) + 0.5) AS BIGINT) AS pct FROM g""")
def group_network(spark, d):
    """A virtual group node with its top donors."""
    m = rows(spark, d, "off", "state").where("state = 'AL'").select(F.col("id").alias("official_id"))
    money = skew_join(rows(spark, d, "fin", "official_id donor_name amount_cents").where("donor_name IS NOT NULL"), m, ["official_id"], "left_semi", sketch=keys(spark, d, "fin", "official_id"))
    g = money.groupBy("donor_name").agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("n"), F.countDistinct("official_id").alias("members")).orderBy(F.desc("cents"), "donor_name").limit(25)
    size = max(m.count(), 1)
    return g.select("donor_name", "cents", "n", "members", F.round(F.least(C.dollars(F.col("cents")) / 1_000_000.0, F.lit(1.0)), 6).alias("strength"), C.half_up(F.lit(100.0) * F.col("n") / size).alias("pct"))


@query(sql("off", "fin") + """SELECT o.id, o.full_name, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n FROM fin JOIN off o ON o.id = official_id WHERE donor_type = 'pac' AND industry = 'Crop Farming'
  GROUP BY 1, 2 ORDER BY cents DESC, o.id LIMIT 25""")
def pac_group_network(spark, d):
    got = _fin_off(spark, d, "donor_type industry amount_cents").where("donor_type = 'pac' AND industry = 'Crop Farming'")
    return got.groupBy(F.col("official_id").alias("id"), "full_name").agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("n")).orderBy(F.desc("cents"), "id").limit(25)


@query(sql("con", "nod") + """SELECT con.id, coalesce(a.label, 'Unknown ' || from_type) AS from_label, coalesce(b.label, 'Unknown ' || to_type) AS to_label
  FROM con LEFT JOIN nod a ON a.type = from_type AND a.id = from_id LEFT JOIN nod b ON b.type = to_type AND b.id = to_id""")
def node_labels(spark, d):
    """Both ends of every edge resolved against the table that their type names."""
    return G.labelled(rows(spark, d, "con", "from_type from_id to_type to_id connection_type"), nodes(spark, d)).select("id", "from_label", "to_label")


@query(sql("con") + "SELECT connection_type, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents, round(avg(strength), 6) AS mean_strength FROM con GROUP BY 1")
def graph_metadata(spark, d):
    return rows(spark, d, "con", "connection_type strength amount_cents").groupBy("connection_type").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"), F.round(F.avg("strength"), 6).alias("mean_strength"))


@query(sql("con", "pro") + "SELECT con.id FROM con WHERE NOT (to_type = 'proposal' AND to_id IN (SELECT id FROM pro WHERE vote_category = 'procedural'))")
def substantive_edges(spark, d):
    """Edges to procedural proposals are left out by an anti-join that only proposals enter."""
    con = rows(spark, d, "con", "to_type to_id")
    dull = rows(spark, d, "pro", "vote_category").where("vote_category = 'procedural'").select(F.col("id").alias("to_id")).distinct()
    votes = skew_join(con.where("to_type = 'proposal'"), dull, ["to_id"], "left_anti", sketch=keys(spark, d, "con", "to_id"))
    return con.where("to_type IS NULL OR to_type <> 'proposal'").unionByName(votes.select(*con.columns)).select("id")


@query(sql("con") + """, r AS (SELECT connection_type, to_id, CAST(coalesce(sum(amount_cents), floor(max(strength) * 1000000 + 0.5)) AS BIGINT) AS v FROM con GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY connection_type ORDER BY v DESC NULLS LAST, to_id) AS rn FROM r) SELECT connection_type, to_id, v FROM k WHERE rn <= 10""")
def sunburst_types(spark, d):
    """Two rings: type, and the ten largest targets of each."""
    got = rows(spark, d, "con", "from_id to_id connection_type strength amount_cents").groupBy("connection_type", "to_id").agg(F.coalesce(F.sum("amount_cents"), C.half_up(F.max("strength") * 1_000_000)).alias("v"))
    return G.top_per_group(got, ["connection_type"], [F.col("v").desc_nulls_last(), F.col("to_id")], 10)


@query(sql("con") + "SELECT connection_type, count(*) AS children, count(DISTINCT to_id) AS targets FROM con WHERE connection_type LIKE 'vote%' GROUP BY 1")
def sunburst_votes(spark, d):
    return rows(spark, d, "con", "to_id connection_type").where(F.col("connection_type").startswith("vote")).groupBy("connection_type").agg(F.count("*").alias("children"), F.countDistinct("to_id").alias("targets"))


@query(sql("con") + """, t AS (SELECT from_id, to_id, connection_type, min(id) AS id, count(*) AS n FROM con GROUP BY 1, 2, 3) SELECT id, n FROM t WHERE n > 1""")
def parallel_edges(spark, d):
    """Triples that occur more than once; the merge keeps the smallest id."""
    return rows(spark, d, "con", "from_id to_id connection_type").groupBy("from_id", "to_id", "connection_type").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", "n")


@query(sql("con") + "SELECT min(id) AS id FROM con WHERE connection_type IN ('donation', 'lobbying') GROUP BY from_id, to_id, connection_type")
def merged_graph(spark, d):
    con = rows(spark, d, "con", "from_id to_id connection_type")
    return G.merge([con.where("connection_type = 'donation'"), con.where("connection_type = 'lobbying'"), con.where("connection_type = 'donation'")]).select("id")


# -- derivations, tags ---------------------------------------------------------------------------------------------------


@query(sql("con") + """SELECT DISTINCT ON (from_id, to_id, connection_type) from_id, to_id, connection_type, id FROM con WHERE connection_type LIKE 'vote%' AND to_type = 'proposal'
  ORDER BY from_id, to_id, connection_type, occurred_at DESC NULLS LAST, id""")
def vote_edges(spark, d):
    """One edge per official, proposal and vote: the latest; partial aggregation instead of a window."""
    con = rows(spark, d, "con", "from_id to_type to_id connection_type occurred_at").where(F.col("connection_type").startswith("vote") & (F.col("to_type") == "proposal"))
    first = F.min_by("id", F.struct(F.coalesce(-F.unix_date("occurred_at"), F.lit(10**9)), F.col("id")))
    return con.groupBy("from_id", "to_id", "connection_type").agg(first.alias("id"))


@query(sql("off") + """, b AS (SELECT DISTINCT lower(trim(id)) AS agency_id, lower(trim(governing_body_id)) AS body FROM agencies)
  SELECT DISTINCT off.id AS from_id, agency_id AS to_id FROM off JOIN b ON body = lower(trim(off.governing_body_id)) WHERE role_title IN ('Secretary', 'Commissioner', 'Mayor')""")
def appointment_edges(spark, d):
    """Leaders and the agencies of their governing body."""
    b = table(spark, d, "agencies").select(F.lower(F.trim("id")).alias("to_id"), F.lower(F.trim("governing_body_id")).alias("body")).distinct()
    lead = rows(spark, d, "off", "role_title governing_body_id").where(F.col("role_title").isin("Secretary", "Commissioner", "Mayor")).select(F.col("id").alias("from_id"), F.lower(F.trim("governing_body_id")).alias("body"))
    return skew_join(b, lead, ["body"], "inner").select("from_id", "to_id").distinct()


@query(sql("con", "off") + """, v AS (SELECT DISTINCT from_id, to_id FROM con WHERE connection_type = 'vote_yes'), p AS (SELECT DISTINCT to_id, party FROM v JOIN off ON off.id = from_id WHERE party IS NOT NULL),
  c AS (SELECT to_id, count(*) AS parties, min(party) AS sole FROM p GROUP BY 1)
  SELECT off.id, count(*) AS yes, count(*) FILTER (WHERE parties > 1 OR sole <> off.party) AS crossed FROM v JOIN off ON off.id = v.from_id JOIN c ON c.to_id = v.to_id WHERE party IS NOT NULL GROUP BY 1""")
def bipartisan(spark, d):
    """Whether anyone of another party agreed: votes are reduced to (proposal, party) before they meet, voters are not paired."""
    party = rows(spark, d, "off", "party").where("party IS NOT NULL").select(F.col("id").alias("from_id"), "party")
    v = skew_join(rows(spark, d, "con", "from_id to_id connection_type").where("connection_type = 'vote_yes'").select("from_id", "to_id").distinct(), party, ["from_id"], "inner")
    c = v.groupBy("to_id").agg(F.countDistinct("party").alias("parties"), F.min("party").alias("only"))
    crossed = (F.col("parties") > 1) | (F.col("only") != F.col("party"))
    return skew_join(v, c, ["to_id"], "inner").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("yes"), F.count_if(crossed).alias("crossed"))


@query(sql("fin") + """SELECT official_id, count(*) AS n, round(sum(CASE WHEN donor_type = 'pac' THEN amount_cents ELSE 0 END) / nullif(sum(amount_cents), 0), 6)::DOUBLE + 0.0 AS pac_share, round(avg(amount_cents), 4) AS mean_cents
  FROM fin WHERE official_id IS NOT NULL GROUP BY 1""")
def donor_pattern(spark, d):
    g = rows(spark, d, "fin", "official_id donor_type amount_cents").where("official_id IS NOT NULL").groupBy("official_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("donor_type") == "pac", F.col("amount_cents")).otherwise(0)).alias("p"), F.sum("amount_cents").alias("s"), F.round(F.avg("amount_cents"), 4).alias("mean_cents"))
    return g.select("official_id", "n", F.round(F.try_divide("p", "s"), 6).alias("pac_share"), "mean_cents")


@query(sql("fin", "con") + """, g AS (SELECT official_id, donor_name, contribution_date AS d, sum(amount_cents) AS c FROM fin WHERE official_id IS NOT NULL AND contribution_date IS NOT NULL AND donor_name IS NOT NULL GROUP BY 1, 2, 3),
  v AS (SELECT DISTINCT from_id, occurred_at AS v FROM con WHERE connection_type LIKE 'vote%' AND occurred_at IS NOT NULL)
  SELECT official_id, donor_name, CAST(min(datediff('day', d, v)) AS INTEGER) AS days_before FROM g JOIN v ON from_id = official_id AND datediff('day', d, v) BETWEEN 1 AND 90 GROUP BY 1, 2""")
def prevote_donations(spark, d):
    """Band join: donations 1 to 90 days before a vote of the same official. Both sides are reduced to days first, and days are
    bucketed by 90, so that a pair meets in one of two buckets and no official's rows are all paired."""
    width = 90
    g = rows(spark, d, "fin", "official_id donor_name contribution_date").where("official_id IS NOT NULL AND contribution_date IS NOT NULL AND donor_name IS NOT NULL").select("official_id", "donor_name", F.unix_date("contribution_date").alias("g")).distinct()
    v = rows(spark, d, "con", "from_id connection_type occurred_at").where(F.col("connection_type").startswith("vote") & F.col("occurred_at").isNotNull()).select(F.col("from_id").alias("official_id"), F.unix_date("occurred_at").alias("v")).distinct()
    g = g.withColumn("bucket", F.explode(F.array(F.floor(F.col("g") / width), F.floor(F.col("g") / width) + 1)))
    v = v.withColumn("bucket", F.floor(F.col("v") / width))
    near = skew_join(g, v, ["official_id", "bucket"], "inner").where((F.col("v") - F.col("g")).between(1, 90))
    return near.groupBy("official_id", "donor_name").agg(F.min(F.col("v") - F.col("g")).alias("days_before"))


_RULES = [("labor", r"union|teachers"), ("finance", r"\bbank|insur|securities|mortgage"), ("energy", r"\boil\b|\bgas\b|petrol|solar|energy"), ("health", r"hospital|pharma|dental|clinic"), ("transport", r"airline|railway|truck|shipping|ferries")]


@query(sql("ent") + "SELECT id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(name), '{p}') THEN '{k}' END" for k, p in _RULES) + ", 'other') AS sector FROM ent")
def sector_classify(spark, d):
    """First matching rule in the declared order."""
    return rows(spark, d, "ent", "name").select("id", C.first_match(F.col("name"), _RULES, "other").alias("sector"))


@query(sql("ent") + " SELECT tag, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS tag FROM ent WHERE regexp_matches(lower(name), '{p}')" for k, p in _RULES) + ") GROUP BY tag")
def industry_tags(spark, d):
    """All matching rules, one row each."""
    return rows(spark, d, "ent", "name").select(F.explode(C.all_matches(F.col("name"), _RULES)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(sql("pro") + f"""SELECT id, CAST(datediff('day', DATE '{AS_OF[:10]}', CAST(comment_period_end AS DATE)) AS INTEGER) AS days FROM pro WHERE comment_period_end >= TIMESTAMPTZ '{AS_OF}+00' AND comment_period_end < TIMESTAMPTZ '2024-07-30 00:00:00+00'""")
def closing_soon(spark, d):
    """Relative times take an explicit instant; the range predicate reaches the scan."""
    p = rows(spark, d, "pro", "comment_period_end").where((F.col("comment_period_end") >= F.lit(AS_OF).cast("timestamp")) & (F.col("comment_period_end") < F.lit("2024-07-30 00:00:00").cast("timestamp")))
    return p.select("id", F.datediff(F.col("comment_period_end"), F.lit(AS_OF[:10]).cast("date")).alias("days"))


@query(sql("off") + f"SELECT id, round(datediff('day', term_start, DATE '{AS_OF[:10]}') / 365.25, 4)::DOUBLE AS years FROM off WHERE term_start IS NOT NULL")
def tenure(spark, d):
    return rows(spark, d, "off", "term_start").where("term_start IS NOT NULL").select("id", F.round(F.datediff(F.lit(AS_OF[:10]).cast("date"), "term_start") / 365.25, 4).alias("years"))


@query(sql("con") + """SELECT to_id, count(*) FILTER (WHERE connection_type = 'vote_yes') AS yes, count(*) FILTER (WHERE connection_type = 'vote_no') AS no, count(*) FILTER (WHERE connection_type = 'vote_abstain') AS abstain
  FROM con WHERE connection_type LIKE 'vote%' GROUP BY 1""")
def vote_summary(spark, d):
    k = F.col("connection_type")
    return rows(spark, d, "con", "to_id connection_type").where(k.startswith("vote")).groupBy("to_id").agg(F.count_if(k == "vote_yes").alias("yes"), F.count_if(k == "vote_no").alias("no"), F.count_if(k == "vote_abstain").alias("abstain"))


@query(sql("pro") + "SELECT governing_body_id AS body, count(*) AS n, count(*) FILTER (WHERE status = 'open_comment') AS open FROM pro GROUP BY 1")
def body_counts(spark, d):
    return rows(spark, d, "pro", "governing_body_id status").groupBy(F.col("governing_body_id").alias("body")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open_comment").alias("open"))


@query(sql("pro") + "SELECT id, title, (SELECT count(*) FROM pro) AS total, CAST(ceil((SELECT count(*) FROM pro) / 20.0) AS BIGINT) AS pages FROM pro ORDER BY introduced_at DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def proposals_page(spark, d):
    return U.page(rows(spark, d, "pro", "title introduced_at"), [F.col("introduced_at").desc_nulls_last(), F.col("id")], 2).select("id", "title", "total", "pages")


@query(sql("pro", "bod") + "SELECT pro.id, bod.name AS body, bod.state FROM pro LEFT JOIN bod ON bod.id = lower(trim(pro.governing_body_id))")
def embedded_parent(spark, d):
    """A parent row fetched with each child. The parents are few and fixed; their number is checked by the optimizer's size."""
    bod = rows(spark, d, "bod", "name state").select(F.col("id").alias("k"), F.col("name").alias("body"), "state")
    pro = rows(spark, d, "pro", "governing_body_id").withColumn("k", F.lower(F.trim("governing_body_id")))
    return skew_join(pro, bod, ["k"], "left").select("id", "body", "state")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("officials", "agencies", "proposals", "financial_entities", "financial_relationships", "entity_connections")))
def table_counts(spark, d):
    """Count-only scans in one plan."""
    out = None
    for t in ("officials", "agencies", "proposals", "financial_entities", "financial_relationships", "entity_connections"):
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("off", "con") + """SELECT (SELECT round(100.0 * count(*) FILTER (WHERE state IS NULL) / count(*), 4)::DOUBLE FROM off) AS no_state_pct,
  (SELECT count(*) FROM con WHERE connection_type LIKE 'vote%') AS vote_edges, (SELECT count(*) FROM con WHERE strength < 0 OR strength > 1) AS bad_strength""")
def quality_ratios(spark, d):
    con = rows(spark, d, "con", "connection_type strength").agg(F.count_if(F.col("connection_type").startswith("vote")).alias("votes"), F.count_if(~F.col("strength").between(0, 1)).alias("bad")).first()
    off = rows(spark, d, "off", "state").agg(F.round(F.lit(100.0) * F.count_if(F.col("state").isNull()) / F.count("*"), 4).alias("no_state_pct"))
    return off.select("no_state_pct", F.lit(con.votes).cast("bigint").alias("vote_edges"), F.lit(con.bad).cast("bigint").alias("bad_strength"))


# -- upsert --------------------------------------------------------------------------------------------------------------


@query(sql("ent") + """, old AS (SELECT DISTINCT name, entity_type, total_donated_cents AS cents FROM (SELECT *, row_number() OVER (PARTITION BY name, entity_type ORDER BY id) AS rn FROM ent) WHERE rn = 1 AND entity_type <> 'pac'),
  new AS (SELECT name, entity_type, max(total_donated_cents) + 1 AS cents FROM ent WHERE entity_type IN ('pac', 'corporation') GROUP BY 1, 2)
  SELECT coalesce(o.name, n.name) AS name, coalesce(o.entity_type, n.entity_type) AS entity_type, coalesce(n.cents, o.cents) AS cents, CASE WHEN o.name IS NULL THEN 'insert' WHEN n.name IS NULL THEN 'none' ELSE 'update' END AS action
  FROM old o FULL JOIN new n ON n.name = o.name AND n.entity_type = o.entity_type""")
def upsert_entities(spark, d):
    ent = rows(spark, d, "ent", "name entity_type total_donated_cents")
    old = ent.where("entity_type <> 'pac'").groupBy("name", "entity_type").agg(F.min_by("total_donated_cents", "id").alias("cents"))
    new = ent.where("entity_type IN ('pac', 'corporation')").select("name", "entity_type", (F.col("total_donated_cents") + 1).alias("cents"))
    return U.upsert(old, new, ["name", "entity_type"])


@query(sql("con") + "SELECT from_id, to_id, connection_type FROM con WHERE connection_type = 'oversight' UNION SELECT from_id, to_id, connection_type FROM con WHERE connection_type IN ('oversight', 'appointment')")
def insert_missing_edges(spark, d):
    keys = ["from_id", "to_id", "connection_type"]
    con = rows(spark, d, "con", "from_id to_id connection_type")
    old = con.where("connection_type = 'oversight'").select(*keys).distinct()
    return U.insert_missing(old, con.where("connection_type IN ('oversight', 'appointment')").select(*keys), keys)


# -- search ------------------------------------------------------------------------------------------------------------

_Q = "frost"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))".format
_LABELS = sql("nod") + f""", s AS (SELECT type, id, label, {_GRAMS('label')} AS g, {_GRAMS("'" + _Q + "'")} AS q FROM nod WHERE type IN ('official', 'agency', 'financial_entity', 'governing_body') AND label IS NOT NULL),
  sim AS (SELECT type, id, label, round(len(list_intersect(g, q)) / nullif(len(list_distinct(list_concat(g, q))), 0), 6)::DOUBLE AS score FROM s)
"""


def _scored(spark, d) -> DataFrame:
    n = nodes(spark, d).where("type IN ('official', 'agency', 'financial_entity', 'governing_body') AND label IS NOT NULL")
    return n.withColumn("score", F.round(C.similarity(F.col("label"), F.lit(_Q)), 6))


@query(_LABELS + f""", k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, label, id) AS rn FROM sim WHERE score > 0.2 OR label ILIKE '%{_Q}%') SELECT type, id, label, score FROM k WHERE rn <= 20""")
def entity_search(spark, d):
    """Trigram similarity or containment, limited per kind of entity."""
    hit = _scored(spark, d).where((F.col("score") > 0.2) | F.col("label").ilike(f"%{_Q}%"))
    return G.top_per_group(hit, ["type"], [F.desc("score"), F.col("label"), F.col("id")], 20)


@query(_LABELS + ", " + _DEG[5:] + f"""SELECT type, sim.id, label, coalesce(degree, 0) AS degree, CAST(CASE WHEN lower(label) = '{_Q}' THEN 0 WHEN lower(label) LIKE '{_Q}%' THEN 1 WHEN degree > 0 THEN 2 ELSE 3 END AS INTEGER) AS tier
  FROM sim LEFT JOIN deg ON node = sim.id WHERE label ILIKE '%{_Q}%' ORDER BY tier, coalesce(degree, 0) DESC, label, sim.id LIMIT 50""")
def ranked_search(spark, d):
    """Tiers of relevance, then degree; only what matched is joined with the degrees."""
    hit = _scored(spark, d).where(F.col("label").ilike(f"%{_Q}%"))
    hit = durable(hit, "hits")
    near = G.touching(rows(spark, d, "con", "from_id to_id connection_type"), hit.select(F.col("id").alias("node")))
    got = hit.join(G.degree(near).select(F.col("node").alias("id"), "degree"), "id", "left")
    low = F.lower("label")
    tier = F.when(low == _Q, 0).when(low.startswith(_Q), 1).when(F.col("degree") > 0, 2).otherwise(3)
    return got.select("type", "id", "label", F.coalesce("degree", F.lit(0)).alias("degree"), tier.alias("tier")).orderBy("tier", F.desc("degree"), "label", "id").limit(50)


@query(sql("pro") + """SELECT id FROM pro WHERE list_contains(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), 'wildfire') AND list_contains(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), 'act')""")
def fulltext_search(spark, d):
    """All query words must occur as words; there is no stemming."""
    words = F.split(F.lower("title"), "[^\\p{L}\\p{N}]+")
    return rows(spark, d, "pro", "title").where(F.array_contains(words, "wildfire") & F.array_contains(words, "act")).select("id")


# -- traffic, spending, usage -----------------------------------------------------------------------------------------------

_PV = "WITH pv AS (SELECT event_id, event_type AS page, user_id AS session_id, event_type = 'error' AS is_bot, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'desktop' ELSE 'mobile' END AS device, ts FROM events)\n"


def _views(spark, d) -> DataFrame:
    u = F.col("user_id")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("page"), u.alias("session_id"), (F.col("event_type") == "error").alias("is_bot"), F.when(u % 3 == 0, None).when(u % 3 == 1, "desktop").otherwise("mobile").alias("device"), "ts")


@query(_PV + "SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_bot) AS human, count(*) FILTER (WHERE is_bot) AS bot FROM pv WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'")
def pv_summary(spark, d):
    return _views(spark, d).where(F.col("ts") >= F.lit("2024-01-01 00:00:00").cast("timestamp")).agg(F.count("*").alias("total"), F.count_if(~F.col("is_bot")).alias("human"), F.count_if("is_bot").alias("bot"))


@query(_PV + "SELECT page, count(*) AS views, count(DISTINCT session_id) AS sessions FROM pv WHERE NOT is_bot GROUP BY page ORDER BY views DESC, page LIMIT 10")
def pv_top_pages(spark, d):
    return _views(spark, d).where("NOT is_bot").groupBy("page").agg(F.count("*").alias("views"), F.countDistinct("session_id").alias("sessions")).orderBy(F.desc("views"), "page").limit(10)


@query(_PV + "SELECT coalesce(device, 'desktop') AS device_type, count(*) AS views FROM pv GROUP BY device")
def pv_devices(spark, d):
    """Grouped by the column, shown with a default: two rows read 'desktop'."""
    return _views(spark, d).groupBy("device").agg(F.count("*").alias("views")).select(F.coalesce("device", F.lit("desktop")).alias("device_type"), "views")


@query(_PV + "SELECT date_trunc('day', ts)::TIMESTAMP AS day, page, count(*) AS views FROM pv GROUP BY 1, 2")
def pv_daily(spark, d):
    return _views(spark, d).groupBy(F.date_trunc("day", "ts").alias("day"), "page").agg(F.count("*").alias("views"))


@query("""WITH s AS (SELECT 'FY' || year(o_orderdate + INTERVAL 3 MONTH) AS fy, c_name, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey)
  SELECT fy, c_name, o_orderstatus, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY 1, 2, 3 ORDER BY cents DESC, c_name, fy, o_orderstatus LIMIT 10""")
def spending_groups(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", C.us_fiscal_year(F.to_date("o_orderdate")).alias("fy"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    g = o.groupBy("o_custkey", "fy", "o_orderstatus").agg(F.sum("cents").alias("cents"))  # before the join
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    got = g.join(c, "o_custkey").groupBy("fy", "c_name", "o_orderstatus").agg(F.sum("cents").alias("cents"))
    return got.orderBy(F.desc("cents"), "c_name", "fy", "o_orderstatus").limit(10)


@query("""SELECT user_id % 2 = 0 AS small, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS tokens FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def usage_by_model(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.groupBy((F.col("user_id") % 2 == 0).alias("small")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).cast("bigint").alias("tokens"))


@query("""SELECT event_type, event_id, ts::TIMESTAMP AS ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def latest_runs(spark, d):
    """The last five rows of each key."""
    return G.top_per_group(table(spark, d, "events").select("event_type", "event_id", "ts"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 5)


# -- streams, matching, places, more search ----------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_daily(spark, d):
    """The event files as a stream: daily windows, drained once."""
    from polispark.streaming import events as S

    return S.drained(spark, f"{d}/events.parquet", S.windowed, "daily").withColumn("value", F.round("value", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    from polispark.streaming import events as S

    return S.drained(spark, f"{d}/events.parquet", lambda stream: S.sessions(stream, "6 hours"), "sessions").select("user_id", "start", "n")


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 100.0 AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer)
  SELECT c_custkey FROM p WHERE 10 * x - 60 * y < 0 AND 70 * (x - 60) + 40 * (y - 10) < 0 AND -80 * x + 20 * y < 0""")
def points_in_area(spark, d):
    """Points of a plane in a triangle, by grid cells and ray casting."""
    from polispark.operators.places import contained

    points = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100.0).alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (60.0, 10.0), (20.0, 80.0))])
    area = spark.range(1).select(F.lit("triangle").alias("area_id"), ring.alias("ring"))
    return contained(points, area, 10.0).select("c_custkey")


@query("SELECT c_custkey, floor(c_acctbal / 7.0 * 100 + 0.5) / 100 AS x FROM customer")
def coarse_points(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.coarse(F.col("c_acctbal") / 7.0).alias("x"))


def universal(off: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Officials by what the text says: a party, a role, a two-letter state, else a part of the name."""
    t = text.strip().lower()
    roles = {"senator": "%senator%", "representative": "%representative%", "mayor": "%mayor%"}
    if t in ("democrat", "republican", "independent", "green", "libertarian"):
        hit = F.col("party") == t
    elif t in roles:
        hit = F.col("role_title").ilike(roles[t])
    elif len(t) == 2:
        hit = F.col("state") == t.upper()
    else:
        hit = F.lower("full_name").contains(t)
    return off.where(hit).orderBy("full_name", "id").limit(limit).select("id", "full_name")


@query(sql("off") + """(SELECT 'role' AS intent, id, full_name FROM off WHERE role_title ILIKE '%mayor%' ORDER BY full_name, id LIMIT 50) UNION ALL (SELECT 'state', id, full_name FROM off WHERE state = 'OH' ORDER BY full_name, id LIMIT 50)
  UNION ALL (SELECT 'name', id, full_name FROM off WHERE contains(lower(full_name), 'frost') ORDER BY full_name, id LIMIT 50)""")
def universal_search(spark, d):
    off = rows(spark, d, "off", "full_name state")
    one = lambda intent, text: universal(off, text).select(F.lit(intent).alias("intent"), "id", "full_name")
    return one("role", "mayor").unionByName(one("state", "oh")).unionByName(one("name", "frost"))


@query(sql("ent", "con") + "SELECT id, name FROM ent WHERE NOT EXISTS (SELECT 1 FROM con WHERE from_id = ent.id) AND NOT EXISTS (SELECT 1 FROM con WHERE to_id = ent.id)")
def unconnected_donors(spark, d):
    """Anti-joins against either end."""
    con = rows(spark, d, "con", "from_id to_id")
    ent = rows(spark, d, "ent", "name").select("id", "name")
    for end in ("from_id", "to_id"):
        ent = ent.join(con.select(F.col(end).alias("id")).distinct(), "id", "left_anti")
    return ent


@query(sql("off") + """, o AS (SELECT id, full_name, CASE party WHEN 'democrat' THEN 0 WHEN 'republican' THEN 1 ELSE 2 END AS r FROM off WHERE is_active)
  SELECT id, CAST(row_number() OVER (ORDER BY r, lower(full_name), id) AS INTEGER) AS place FROM o ORDER BY place LIMIT 100""")
def officials_ranked(spark, d):
    """Order by a declared rank of values, then by name. Places are given to the kept rows only."""
    off = rows(spark, d, "off", "full_name party is_active").where("is_active").select("id", C.rank_of(F.col("party"), ["democrat", "republican"]).alias("r"), F.lower("full_name").alias("n"))
    top = off.orderBy("r", "n", "id").limit(100)
    return top.select("id", F.row_number().over(Window.orderBy("r", "n", "id")).alias("place"))


@query("""SELECT committee_id, donor, cents, n FROM (SELECT *, row_number() OVER (PARTITION BY committee_id ORDER BY cents DESC, donor) AS rn FROM (SELECT committee_id, upper(trim(contributor_name)) AS donor,
  CAST(sum(CAST(floor(contribution_receipt_amount * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM (SELECT DISTINCT * FROM fec_contributions) f WHERE contributor_name IS NOT NULL GROUP BY 1, 2) g) k WHERE rn <= 5""")
def committee_donors(spark, d):
    f = table(spark, d, "fec_contributions").distinct().where("contributor_name IS NOT NULL")
    g = f.groupBy("committee_id", F.upper(F.trim("contributor_name")).alias("donor")).agg(F.sum(C.half_up(F.col("contribution_receipt_amount") * 100)).alias("cents"), F.count("*").alias("n"))
    return G.top_per_group(g, ["committee_id"], [F.desc("cents"), F.col("donor")], 5)


@query("""SELECT DISTINCT lower(trim(id)) AS id, lower(regexp_extract(regexp_replace(bill_number, '[. ]', '', 'g'), '^([A-Za-z]+)0*([0-9]+)$', 1)) || '-' || regexp_extract(regexp_replace(bill_number, '[. ]', '', 'g'), '^([A-Za-z]+)0*([0-9]+)$', 2) AS bill
  FROM proposals WHERE regexp_matches(regexp_replace(bill_number, '[. ]', '', 'g'), '^[A-Za-z]+[0-9]+$')""")
def bill_numbers(spark, d):
    """Dotted, spaced and plain notations of one bill in one form."""
    flat = F.regexp_replace("bill_number", "[. ]", "")
    pattern = "^([A-Za-z]+)0*([0-9]+)$"
    bill = F.concat_ws("-", F.lower(F.regexp_extract(flat, pattern, 1)), F.regexp_extract(flat, pattern, 2))
    return table(spark, d, "proposals").where(flat.rlike("^[A-Za-z]+[0-9]+$")).select(F.lower(F.trim("id")).alias("id"), bill.alias("bill")).distinct()


@query(sql("off", "con") + """, v AS (SELECT from_id, count(*) AS n FROM con WHERE connection_type LIKE 'vote%' GROUP BY 1) SELECT id, full_name, n FROM off JOIN v ON from_id = id WHERE is_active ORDER BY n DESC, id LIMIT 4""")
def home_officials(spark, d):
    v = rows(spark, d, "con", "from_id connection_type").where(F.col("connection_type").startswith("vote")).groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"))
    return rows(spark, d, "off", "full_name is_active").where("is_active").join(v, "id").select("id", "full_name", "n").orderBy(F.desc("n"), "id").limit(4)


@query(sql("con") + "SELECT id FROM con WHERE from_id NOT IN (SELECT node FROM (SELECT from_id AS node FROM con UNION ALL SELECT to_id FROM con) GROUP BY node ORDER BY count(*) DESC, node LIMIT 3) AND to_id NOT IN (SELECT node FROM (SELECT from_id AS node FROM con UNION ALL SELECT to_id FROM con) GROUP BY node ORDER BY count(*) DESC, node LIMIT 3)")
def graph_without_hubs(spark, d):
    """The edges left when focus entities are removed."""
    con = rows(spark, d, "con", "from_id to_id connection_type")
    return G.without(con, G.top_connected(con, 3)).select("id")
