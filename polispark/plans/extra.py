"""Last civic queries: fallbacks, name parts, profile graphs, semi-joins by tag, whole-table numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.functions import civic as C
from polispark.operators import graph as G
from polispark.operators.skew import skew_join
from polispark.plans.civics import rows, sql
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


_VALID = "SELECT DISTINCT state FROM officials WHERE state IS NOT NULL"


@query(f"""WITH v AS ({_VALID}), w AS (SELECT DISTINCT candid, candofficest FROM weball_rows)
  SELECT candid, coalesce(CASE WHEN nullif(trim(candofficest), '') IN (SELECT state FROM v) THEN trim(candofficest) END, CASE WHEN regexp_matches(candid, '^[HS][0-9][A-Z]{{2}}') AND substr(candid, 3, 2) IN (SELECT state FROM v) THEN substr(candid, 3, 2) END, 'Unknown') AS state FROM w""")
def derived_state(spark, d):
    """A state from the first valid of several places. The valid ones are a distinct list joined to distinct candidates."""
    w = table(spark, d, "weball_rows").select("candid", "candofficest").distinct()
    own = F.nullif(F.trim("candofficest"), F.lit(""))
    fec = F.when(F.col("candid").rlike("^[HS][0-9][A-Z]{2}"), F.substring("candid", 3, 2))
    places = w.select("candid", F.inline(F.array(F.struct(F.lit(0).alias("place"), own.alias("state")), F.struct(F.lit(1).alias("place"), fec.alias("state")))))
    valid = table(spark, d, "officials").where("state IS NOT NULL").select("state").distinct()
    got = places.join(valid, "state", "left_semi").groupBy("candid").agg(F.min_by("state", "place").alias("state"))
    return w.select("candid").distinct().join(got, "candid", "left").select("candid", F.coalesce("state", F.lit("Unknown")).alias("state"))


@query("""SELECT DISTINCT bioguideid, CASE WHEN contains(name, ',') THEN trim(split_part(name, ',', 1)) ELSE w[-1] END AS last, CASE WHEN contains(name, ',') THEN split_part(trim(split_part(name, ',', 2)), ' ', 1) ELSE w[1] END AS first
  FROM (SELECT bioguideid, name, list_filter(string_split(name, ' '), lambda x: x <> '') AS w FROM congress_members WHERE name IS NOT NULL)""")
def name_parts(spark, d):
    """Family and given name of all names: around the comma, else the last and the first word."""
    part = lambda i: F.trim(F.get(F.split("name", ","), F.lit(i)))
    m, comma = table(spark, d, "congress_members").where("name IS NOT NULL"), F.col("name").contains(",")
    words = F.filter(F.split("name", " "), lambda w: w != "")
    last, first = F.when(comma, part(0)).otherwise(F.try_element_at(words, F.lit(-1))), F.when(comma, F.get(F.split(part(1), " "), F.lit(0))).otherwise(F.try_element_at(words, F.lit(1)))
    return m.select("bioguideid", last.alias("last"), first.alias("first")).distinct()


_HOT = "(SELECT from_id FROM con WHERE connection_type LIKE 'vote%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(sql("con") + f""", own AS (SELECT * FROM con WHERE from_id = {_HOT}), v AS (SELECT DISTINCT ON (to_id) id, to_id, occurred_at FROM own WHERE connection_type LIKE 'vote%' ORDER BY to_id, occurred_at DESC NULLS LAST, id)
  SELECT id FROM (SELECT id FROM v ORDER BY occurred_at DESC NULLS LAST, id LIMIT 40) UNION ALL SELECT id FROM (SELECT id FROM own WHERE connection_type NOT LIKE 'vote%' ORDER BY coalesce(nullif(strength, 0), 0.5) DESC, id LIMIT 200)""")
def profile_ego(spark, d):
    """A profile's graph: one edge per proposal, the latest, and the strongest other edges."""
    con = rows(spark, d, "con", "from_id to_id connection_type strength occurred_at")
    vote = F.col("connection_type").startswith("vote")
    top = con.where(vote).groupBy("from_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_id").limit(1).collect()
    own = con.where(F.col("from_id") == (top[0].from_id if top else ""))
    day = F.coalesce(-F.unix_date("occurred_at"), F.lit(10**9))
    votes = own.where(vote).groupBy("to_id").agg(F.min(F.struct(day.alias("day"), "id")).alias("v")).select("v.*").orderBy("day", "id").limit(40).select("id")
    rest = own.where(~vote).orderBy(F.coalesce(F.nullif("strength", F.lit(0.0)), F.lit(0.5)).desc(), "id").limit(200).select("id")
    return votes.unionByName(rest)


@query(sql("pro", "con") + """SELECT id FROM pro WHERE id IN (SELECT to_id FROM con WHERE connection_type = 'vote_no') AND regexp_matches(lower(title), 'water|ballot')""")
def contested_topics(spark, d):
    """Proposals of some topic with a vote against: a semi-join; no match gives no row."""
    pro = rows(spark, d, "pro", "title").where(F.size(C.all_matches(F.col("title"), [("water", "water"), ("ballot", "ballot")])) > 0)
    against = rows(spark, d, "con", "to_id connection_type").where("connection_type = 'vote_no'").select(F.col("to_id").alias("id")).distinct()
    return pro.join(against, "id", "left_semi").select("id")


@query(sql("con") + """, e AS (SELECT from_id AS node, connection_type FROM con UNION ALL SELECT to_id, connection_type FROM con), k AS (SELECT node, connection_type, count(*) AS n FROM e GROUP BY 1, 2)
  SELECT connection_type, node, n FROM (SELECT *, row_number() OVER (PARTITION BY connection_type ORDER BY n DESC, node) AS rn FROM k) WHERE rn <= 5""")
def hubs_by_kind(spark, d):
    k = rows(spark, d, "con", "from_id to_id connection_type").select(F.explode(F.array("from_id", "to_id")).alias("node"), "connection_type").groupBy("connection_type", "node").agg(F.count("*").alias("n"))
    return G.top_per_group(k, ["connection_type"], [F.desc("n"), F.col("node")], 5)


@query(sql("con", "off") + """SELECT c1.to_id, count(*) AS pairs FROM (SELECT DISTINCT from_id, to_id FROM con WHERE connection_type = 'vote_yes') c1 JOIN off ON off.id = c1.from_id GROUP BY 1 HAVING count(DISTINCT party) >= 2""")
def shared_votes(spark, d):
    """Proposals that at least two parties agreed to, with the number of voters."""
    v = rows(spark, d, "con", "from_id to_id connection_type").where("connection_type = 'vote_yes'").select("from_id", "to_id").distinct()
    party = rows(spark, d, "off", "party").select(F.col("id").alias("from_id"), "party")
    return skew_join(v, party, ["from_id"], "inner").groupBy("to_id").agg(F.count("*").alias("pairs"), F.countDistinct("party").alias("p")).where("p >= 2").select("to_id", "pairs")
