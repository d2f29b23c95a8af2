"""Landed records turned into civic rows, run logs and usage: codes, statuses, keys and roll-ups, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.functions import civic as C
from polispark.operators import graph as G
from polispark.operators import timestamps as T
from polispark.operators.skew import skew_join
from polispark.plans.civics import rows, sql
from polispark.plans.problems import _TYPED
from polispark.session import durable, shared_dir, table
from polispark.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return register


def _case(expr: str, codes: dict[str, str], default: str) -> str:
    return f"CASE {expr} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in codes.items())} ELSE {default} END"


#: Codes of committees, parties and votes.
COMMITTEES = {"H": "house", "S": "senate", "P": "presidential", "N": "pac", "Q": "pac", "O": "super_pac", "V": "pac", "W": "pac", "X": "party", "Y": "party", "Z": "party"}
PARTIES = {"d": "democrat", "r": "republican", "i": "independent", "l": "libertarian", "g": "green"}
VOTE_WORDS = {"yea": "yes", "aye": "yes", "yes": "yes", "nay": "no", "no": "no", "present": "present", "not voting": "not voting"}
RESULTS = {"passed": "passed", "agreed to": "passed", "confirmed": "passed", "failed": "failed", "rejected": "failed"}


@query(f"SELECT cmteid, name, {_case('type', COMMITTEES, repr('other'))} AS kind FROM (SELECT cmteid, max(name) AS name, max(type) AS type FROM committee_master GROUP BY 1)")
def committees(spark, d):
    """The committee file as a lookup: one row per committee, its type spelt out."""
    m = table(spark, d, "committee_master").groupBy("cmteid").agg(F.max("name").alias("name"), F.max("type").alias("type"))
    return m.select("cmteid", "name", C.mapped(F.col("type"), COMMITTEES, "other").alias("kind"))


def official_of_member(party: Column) -> Column:
    """A party of any notation by its first letter."""
    return C.mapped(F.lower(F.substring(F.trim(party), 1, 1)), PARTIES, "nonpartisan")


@query(f"""SELECT DISTINCT bioguideid AS id, {_case("lower(trim(partyname)[1])", PARTIES, repr('nonpartisan'))} AS party, CASE WHEN lower(chamber) LIKE 'sen%' THEN 'Senator' ELSE 'Representative' END AS role_title,
  CASE WHEN startyear IS NULL THEN NULL ELSE CAST(startyear || '-01-03' AS DATE) END AS term_start FROM congress_members""")
def members_as_officials(spark, d):
    """Members of the congress as officials: party, title and the first day of their term."""
    m = table(spark, d, "congress_members")
    title = F.when(F.lower("chamber").like("sen%"), "Senator").otherwise("Representative")
    return m.select(F.col("bioguideid").alias("id"), official_of_member(F.col("partyname")).alias("party"), title.alias("role_title"), F.make_date("startyear", F.lit(1), F.lit(3)).alias("term_start")).distinct()


@query("""SELECT DISTINCT id, CASE WHEN contains(lower(party), 'democrat') THEN 'democrat' WHEN contains(lower(party), 'republican') THEN 'republican' WHEN contains(lower(party), 'independent') THEN 'independent' WHEN party IS NULL THEN 'nonpartisan' ELSE 'other' END AS party,
  CASE WHEN org_classification = 'upper' THEN 'State Senator' WHEN org_classification = 'lower' THEN 'State Representative' ELSE title END AS role_title, upper(nullif(regexp_extract(division_id, 'state:([a-z]{2})', 1), '')) AS state FROM os_people""")
def legislators_as_officials(spark, d):
    """State legislators: party by a part of its name, title by chamber, state by division."""
    p = F.lower("party")
    party = F.when(p.contains("democrat"), "democrat").when(p.contains("republican"), "republican").when(p.contains("independent"), "independent").when(p.isNull(), "nonpartisan").otherwise("other")
    title = F.when(F.col("org_classification") == "upper", "State Senator").when(F.col("org_classification") == "lower", "State Representative").otherwise(F.col("title"))
    state = F.upper(F.nullif(F.regexp_extract("division_id", "state:([a-z]{2})", 1), F.lit("")))
    return table(spark, d, "os_people").select("id", party.alias("party"), title.alias("role_title"), state.alias("state")).distinct()


def bill_status(action: Column) -> Column:
    """The status that the text of the latest action tells: the first rule that holds."""
    t = F.lower(F.coalesce(action, F.lit("")))
    has = lambda *words: F.lit(True) if not words else t.contains(words[0]) & has(*words[1:])
    passed = has("passed") & (has("senate") | has("house"))
    return (
        F.when(has("became public law") | has("signed by president"), "enacted").when(has("signed", "president"), "signed").when(has("vetoed"), "vetoed")
        .when(passed & (has("both") | has("senate", "house")), "passed_both_chambers").when(passed, "passed_chamber").when(has("reported"), "passed_committee").when(has("referred to"), "in_committee").otherwise("introduced")
    )


#: Paths of kinds of bills, and the kinds of the upper house.
BILL_PATHS = {
    "HR": "house-bill", "S": "senate-bill", "HJRES": "house-joint-resolution", "SJRES": "senate-joint-resolution", "HRES": "house-resolution", "SRES": "senate-resolution", "HCONRES": "house-concurrent-resolution",
    "SCONRES": "senate-concurrent-resolution", "HAMDT": "house-amendment", "SAMDT": "senate-amendment",
}
UPPER = ("S", "SJRES", "SRES", "SCONRES", "SAMDT")
_FLAT = "regexp_replace(upper(bill_number), '[. ]', '', 'g')"


@query(f"""SELECT DISTINCT lower(trim(id)) AS id, '118-' || lower(k) || '-' || n AS key, CASE WHEN k IN ({', '.join(repr(x) for x in UPPER)}) THEN 'senate' ELSE 'house' END AS chamber, {_case('k', BILL_PATHS, repr('other'))} AS path, left(title, 500) AS title
  FROM (SELECT id, title, regexp_extract({_FLAT}, '^([A-Z]+)0*([0-9]+)$', 1) AS k, regexp_extract({_FLAT}, '^([A-Z]+)0*([0-9]+)$', 2) AS n FROM proposals) WHERE k <> ''""")
def bills_as_proposals(spark, d):
    """Bills of any notation: their key, chamber, kind of page and cut title."""
    flat, pattern = F.regexp_replace(F.upper("bill_number"), "[. ]", ""), "^([A-Z]+)0*([0-9]+)$"
    b = table(spark, d, "proposals").select(F.lower(F.trim("id")).alias("id"), "title", F.regexp_extract(flat, pattern, 1).alias("k"), F.regexp_extract(flat, pattern, 2).alias("n")).where("k <> ''")
    return b.select("id", F.concat_ws("-", F.lit("118"), F.lower("k"), "n").alias("key"), F.when(F.col("k").isin(*UPPER), "senate").otherwise("house").alias("chamber"), C.mapped(F.col("k"), BILL_PATHS, "other").alias("path"), F.substring("title", 1, 500).alias("title")).distinct()


@query(sql("pro") + """SELECT id, CASE WHEN comment_period_end IS NULL THEN 'introduced' WHEN comment_period_end > TIMESTAMPTZ '2024-01-31 00:00:00+00' THEN 'open_comment' ELSE 'comment_closed' END AS status FROM pro WHERE type = 'regulation'""")
def regulation_status(spark, d):
    """Documents of regulations: open while their comment period lasts."""
    end = F.col("comment_period_end")
    p = rows(spark, d, "pro", "type comment_period_end").where("type = 'regulation'")
    return p.select("id", F.when(end.isNull(), "introduced").when(end > F.lit("2024-01-31 00:00:00").cast("timestamp"), "open_comment").otherwise("comment_closed").alias("status"))


@query(_TYPED + f""", r AS (SELECT DISTINCT congress, chamber, rollnumber, question, result, date FROM vote_list_items)
  SELECT congress || '|' || chamber || '|' || rollnumber AS roll, {_case("lower(trim(result))", RESULTS, repr('other'))} AS outcome, max(epoch_ms) AS at FROM r LEFT JOIN done ON done.value = date GROUP BY ALL""")
def rolls_with_times(spark, d):
    """Roll calls with their outcome and their instant."""
    r = table(spark, d, "vote_list_items").select("congress", "chamber", "rollnumber", "question", "result", "date").distinct()
    roll = F.concat_ws("|", F.col("congress").cast("string"), "chamber", F.col("rollnumber").cast("string"))
    got = T.normalise(r, "date").select(roll.alias("roll"), C.mapped(F.lower(F.trim("result")), RESULTS, "other").alias("outcome"), "epoch_ms")
    return got.groupBy("roll", "outcome").agg(F.max("epoch_ms").alias("at"))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS day, 'FY' || year(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH) AS fy, left(c_name, 500) AS recipient, n_name AS place FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def awards_as_spending(spark, d):
    """Awards as spending records: whole cents, day, fiscal year, recipient and place."""
    o = table(spark, d, "orders").select("o_orderkey", C.half_up(F.col("o_totalprice") * 100).alias("cents"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.substring("c_name", 1, 500).alias("recipient"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    got = skew_join(skew_join(o, c, ["c_custkey"], "inner", sketch=o), n, ["n_nationkey"], "inner", sketch=c)
    return got.select("o_orderkey", "cents", "day", C.us_fiscal_year(F.col("day")).alias("fy"), "recipient", "place")


@query("""SELECT 'state' AS type, state AS code, count(*) AS bodies FROM (SELECT DISTINCT * FROM governing_bodies) g WHERE state IS NOT NULL GROUP BY 2 UNION ALL SELECT 'country', 'US', count(*) FROM (SELECT DISTINCT * FROM governing_bodies) g WHERE state IS NULL""")
def jurisdictions(spark, d):
    """Places seeded from the bodies: the country, and each state once."""
    g = table(spark, d, "governing_bodies").distinct()
    state = F.col("state")
    return g.groupBy(F.when(state.isNull(), "country").otherwise("state").alias("type"), F.coalesce(state, F.lit("US")).alias("code")).agg(F.count("*").alias("bodies"))


@query("""SELECT coalesce(event_type, 'Unknown') AS charge, count(*) AS n, round(sum(value), 4)::DOUBLE AS cost, round(sum(sum(value)) OVER (), 4)::DOUBLE AS total FROM events GROUP BY 1""")
def charges(spark, d):
    """Charge lines landed as JSON, read leniently, rolled up with the total of all."""
    path = f"{shared_dir(spark)}/polispark/{spark.sparkContext.applicationId}/charges-{uuid.uuid4().hex}"
    table(spark, d, "events").select(F.col("event_type").alias("ChargeDescription"), F.col("value").alias("BilledCost")).write.json(path)
    lines = files.lines(spark, path, "ChargeDescription string, ResourceName string, BilledCost double")
    g = durable(lines.groupBy(F.coalesce("ChargeDescription", "ResourceName", F.lit("Unknown")).alias("charge")).agg(F.count("*").alias("n"), F.sum("BilledCost").alias("cost")), "charges")
    total = g.agg(F.sum("cost").alias("t")).first().t
    return g.select("charge", "n", F.round("cost", 4).alias("cost"), F.round(F.lit(total), 4).alias("total"))


@query("""WITH r AS (SELECT event_type AS pipeline, event_id, ts FROM events) SELECT k AS pipeline, CASE WHEN last IS NULL THEN 'pending' WHEN last % 2 = 0 THEN 'complete' ELSE 'failed' END AS status, last FROM (SELECT unnest(['click', 'error', 'purchase', 'nightly']) AS k) n LEFT JOIN (SELECT pipeline, max_by(event_id, {'a': ts, 'b': event_id}) AS last FROM r GROUP BY 1) m ON m.pipeline = k""")
def pipeline_status(spark, d):
    """The latest run of each known pipeline; those that never ran are pending."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("pipeline")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))
    known = spark.createDataFrame([("click",), ("error",), ("purchase",), ("nightly",)], "pipeline string")
    return known.join(e, "pipeline", "left").select("pipeline", F.coalesce(F.when(F.col("last") % 2 == 0, "complete").when(F.col("last").isNotNull(), "failed"), F.lit("pending")).alias("status"), "last")


@query(sql("con") + "SELECT 'connections' AS pipeline, 'complete' AS status, count(*) AS n FROM con UNION ALL SELECT 'tags', 'pending', NULL")
def run_log(spark, d):
    """A run written to the log as it starts and ends, and the log's latest line of each pipeline."""
    path = f"{shared_dir(spark)}/polispark/{spark.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    sinks.log_run(spark, path, "r1", "connections", "running")
    sinks.log_run(spark, path, "r1", "connections", "complete", rows(spark, d, "con", "id").count())
    return sinks.last_runs(spark, path, ["connections", "tags"]).select("pipeline", "status", "n")


@query(sql("off") + "SELECT id, full_name, coalesce(party, 'z') AS party FROM off WHERE is_active ORDER BY coalesce(party, 'z'), lower(full_name), id LIMIT 50")
def browse_by_party(spark, d):
    """Browsing: those without a party come last."""
    party = F.coalesce("party", F.lit("z"))
    return rows(spark, d, "off", "full_name party is_active").where("is_active").select("id", "full_name", party.alias("party")).orderBy("party", F.lower("full_name"), "id").limit(50)


@query(sql("off", "ent", "con", "fin") + """SELECT round(100.0 * (SELECT count(*) FROM off WHERE json_extract_string(source_ids, '$.roster') IS NOT NULL) / (SELECT count(*) FROM off), 1)::DOUBLE AS roster_pct, round(100.0 * (SELECT count(*) FROM fin WHERE industry IS NOT NULL) / (SELECT count(*) FROM fin), 1)::DOUBLE AS industry_pct,
  round(100.0 * (SELECT count(*) FROM off WHERE state IS NULL) / (SELECT count(*) FROM off), 1)::DOUBLE AS no_state_pct, (SELECT count(*) FROM con WHERE connection_type LIKE 'vote%') AS votes, (SELECT count(DISTINCT connection_type) FROM con) AS kinds""")
def coverage_ratios(spark, d):
    """Shares of complete rows, each table read once."""
    pct = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count("*"), 1)
    off = rows(spark, d, "off", "state source_ids").agg(pct(F.get_json_object("source_ids", "$.roster").isNotNull()).alias("roster_pct"), pct(F.col("state").isNull()).alias("no_state_pct"))
    fin = rows(spark, d, "fin", "industry").agg(pct(F.col("industry").isNotNull()).alias("industry_pct")).first()
    con = rows(spark, d, "con", "connection_type").agg(F.count_if(F.col("connection_type").startswith("vote")).alias("votes"), F.count_distinct("connection_type").alias("kinds")).first()
    return off.select("roster_pct", F.lit(fin.industry_pct).alias("industry_pct"), "no_state_pct", F.lit(con.votes).cast("bigint").alias("votes"), F.lit(con.kinds).cast("bigint").alias("kinds"))


@query(sql("con", "nod") + """, g AS (SELECT connection_type, to_id, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS cents, count(*) AS n FROM con GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY connection_type ORDER BY n DESC, to_id) AS rn FROM g), l AS (SELECT id, min(label) AS label FROM nod GROUP BY 1)
  SELECT connection_type, to_id, label, n, CAST(sum(n) OVER (PARTITION BY connection_type) AS BIGINT) AS ring FROM k LEFT JOIN l ON l.id = to_id WHERE rn <= 8""")
def sunburst_rings(spark, d):
    """Two rings: kinds of edges with the number of the kept children, and the eight most frequent targets of each, with labels."""
    from pyspark.sql import Window

    from polispark.plans.civics import nodes

    g = rows(spark, d, "con", "to_id connection_type").groupBy("connection_type", "to_id").agg(F.count("*").alias("n"))
    top = G.top_per_group(g, ["connection_type"], [F.desc("n"), F.col("to_id")], 8)
    label = nodes(spark, d).groupBy(F.col("id").alias("to_id")).agg(F.min("label").alias("label"))
    got = top.withColumn("ring", F.sum("n").over(Window.partitionBy("connection_type")))  # eight rows a group
    return got.join(label, "to_id", "left").select("connection_type", "to_id", "label", "n", "ring")


@query("""SELECT DISTINCT committee_id, sub_id, kind FROM (SELECT committee_id, sub_id, CASE upper(entity_type) WHEN 'IND' THEN 'individual' WHEN 'ORG' THEN 'corporation' WHEN 'PAC' THEN 'pac' WHEN 'COM' THEN 'pac' WHEN 'CCM' THEN 'candidate' WHEN 'PTY' THEN 'party' ELSE 'other' END AS kind FROM fec_contributions)""")
def contributor_kinds(spark, d):
    """Codes of contributors spelt out."""
    codes = {"IND": "individual", "ORG": "corporation", "PAC": "pac", "COM": "pac", "CCM": "candidate", "PTY": "party"}
    return table(spark, d, "fec_contributions").select("committee_id", "sub_id", C.mapped(F.upper("entity_type"), codes, "other").alias("kind")).distinct()
