"""Derivations, tags and their uses: rule tables, vote categories, edges, buckets, the chord by tags; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polispark.functions import civic as C
from polispark.operators import graph as G
from polispark.operators import timestamps as T
from polispark.operators import upsert as U
from polispark.operators.skew import skew_join
from polispark.plans.civics import keys, rows, sql
from polispark.plans.problems import _TYPED
from polispark.session import durable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-31"


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return register


# -- rule tables -----------------------------------------------------------------------------------------------------

#: SQL of the rule table that the queries use: the words of the canonical industries. Any table of this form can take its place.
_KW = """kw AS (SELECT entry_id AS place, label, unnest(regexp_split_to_array(lower(label), '[^a-z]+')) AS keyword FROM canonical_entries WHERE kind = 'industry'),
  rule AS (SELECT DISTINCT * FROM kw WHERE length(keyword) >= 3 AND keyword <> 'and')"""
_HIT = "CASE WHEN length(keyword) <= 4 THEN regexp_matches({0}, '\\b' || keyword || '\\b') ELSE contains({0}, keyword) END"


def industry_rules(spark, d) -> list[tuple[str, str]]:
    words = table(spark, d, "canonical_entries").where("kind = 'industry'").select(F.col("entry_id").alias("place"), "label", F.explode(F.split(F.lower("label"), "[^a-z]+")).alias("keyword"))
    return C.rules(words.where("length(keyword) >= 3 AND keyword <> 'and'").distinct())


@query(sql("fin") + f""", {_KW}, t AS (SELECT lower(donor_name || ' ' || coalesce(industry, '')) AS x, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n FROM fin WHERE donor_type = 'pac' AND donor_name IS NOT NULL GROUP BY 1),
  m AS (SELECT x, min_by(label, place) AS label FROM t JOIN rule ON {_HIT.format('x')} GROUP BY x)
  SELECT coalesce(label, 'Other') AS sector, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(n) AS BIGINT) AS n FROM t LEFT JOIN m USING (x) GROUP BY 1""")
def sectors_by_rules(spark, d):
    """Committee money by sector: the first rule in the declared order that is found in name and industry; short keywords as words only."""
    fin = rows(spark, d, "fin", "donor_name donor_type industry amount_cents").where("donor_type = 'pac' AND donor_name IS NOT NULL")
    text = F.concat_ws(" ", "donor_name", F.coalesce("industry", F.lit("")))
    t = fin.groupBy(text.alias("x")).agg(F.sum("amount_cents").alias("cents"), F.count("*").alias("n"))  # each text is looked at once
    return t.groupBy(C.first_match(F.col("x"), industry_rules(spark, d), "Other").alias("sector")).agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))


_TAGS = f"""{_KW}, tg AS (SELECT DISTINCT id, label AS tag FROM ent JOIN rule ON {_HIT.format('lower(name)')}),
  tags AS (SELECT id, tag, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM tg)"""


def entity_tags(spark, d) -> DataFrame:
    """id, tag, confidence of donors: all industries whose rules match the name; several are less certain than one."""
    found = C.all_matches(F.col("name"), industry_rules(spark, d))
    return rows(spark, d, "ent", "name").select("id", found.alias("tags")).select("id", F.explode("tags").alias("tag"), F.when(F.size("tags") > 1, 0.7).otherwise(0.8).alias("confidence")).distinct()


@query(sql("ent") + f", {_TAGS} SELECT id, tag, confidence, CASE WHEN confidence >= 0.8 THEN 'primary' ELSE 'secondary' END AS visibility FROM tags")
def donor_tags(spark, d):
    return entity_tags(spark, d).withColumn("visibility", F.when(F.col("confidence") >= 0.8, "primary").otherwise("secondary"))


_FLOW = sql("off", "fin", "ent") + f""", {_TAGS}, flow AS (SELECT coalesce(tag, 'untagged') AS industry, upper(coalesce(o.party, 'other')[1]) || lower(coalesce(o.party, 'other')[2:]) || ' ' || CASE WHEN o.role_title ILIKE '%representative%' THEN 'House' ELSE 'Senate' END AS recipient,
  CAST(sum(f.amount_cents) AS BIGINT) AS cents, count(DISTINCT f.official_id) AS officials, count(DISTINCT f.donor_name) AS donors
  FROM fin f JOIN off o ON o.id = f.official_id LEFT JOIN ent e ON e.name = f.donor_name LEFT JOIN tags ON tags.id = e.id AND confidence > 0 WHERE f.amount_cents > 0 AND json_extract_string(o.source_ids, '$.roster') IS NOT NULL GROUP BY 1, 2)
"""


def _flows(spark, d) -> DataFrame:
    """Money of rostered officials by tag and recipient. An amount counts once per entity of the donor's name and per tag of it, as the
    joins do; donors without an entity, and entities without a tag, stay as untagged."""
    off = rows(spark, d, "off", "party role_title source_ids").where(F.get_json_object("source_ids", "$.roster").isNotNull()).select(F.col("id").alias("official_id"), "party", "role_title")
    money = rows(spark, d, "fin", "official_id donor_name amount_cents").where("amount_cents > 0")
    ent = rows(spark, d, "ent", "name").select(F.col("name").alias("donor_name"), F.col("id").alias("entity"))
    names = ent.join(entity_tags(spark, d).select(F.col("id").alias("entity"), "tag"), "entity", "left").select("donor_name", "tag")
    paid = skew_join(money, off, ["official_id"], "inner", sketch=keys(spark, d, "fin", "official_id"))
    tagged = skew_join(paid, names, ["donor_name"], "left", sketch=keys(spark, d, "fin", "donor_name"))
    recipient = F.concat_ws(" ", F.initcap(F.coalesce("party", F.lit("other"))), F.when(F.col("role_title").ilike("%representative%"), "House").otherwise("Senate"))
    return tagged.groupBy(F.coalesce("tag", F.lit("untagged")).alias("industry"), recipient.alias("recipient")).agg(F.sum("amount_cents").alias("cents"), F.count_distinct("official_id").alias("officials"), F.count_distinct("donor_name").alias("donors"))


@query(_FLOW + "SELECT * FROM flow")
def chord_by_tags(spark, d):
    return _flows(spark, d)


@query(_FLOW + """SELECT * FROM (SELECT 'flow' AS kind, industry, recipient, cents FROM flow ORDER BY cents DESC, industry, recipient LIMIT 10)
  UNION ALL SELECT 'total', NULL, NULL, CAST(sum(cents) AS BIGINT) FROM flow UNION ALL SELECT 'untagged', NULL, NULL, CAST(sum(cents) FILTER (WHERE industry = 'untagged') AS BIGINT) FROM flow UNION ALL SELECT 'minor', NULL, NULL, count(*) FILTER (WHERE cents < 1000000) FROM flow""")
def chord_summary(spark, d):
    """The ten largest flows, the total, what is untagged, and how many flows a least amount hides."""
    flow = durable(_flows(spark, d), "flows")
    none = F.lit(None).cast("string")
    side = flow.agg(F.sum("cents").alias("total"), F.sum(F.when(F.col("industry") == "untagged", F.col("cents"))).alias("untagged"), F.count_if(F.col("cents") < 1_000_000).alias("minor"))
    long = side.unpivot([], ["total", "untagged", "minor"], "kind", "cents").select("kind", none.alias("industry"), none.alias("recipient"), "cents")
    return flow.orderBy(F.desc("cents"), "industry", "recipient").limit(10).select(F.lit("flow").alias("kind"), "industry", "recipient", "cents").unionByName(long)


#: States of the chain.
CHAIN_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
_IN = ", ".join(f"'{s}'" for s in CHAIN_STATES)
_ID = "json_extract_string(source_ids, '$.{}')".format
_FROM = "CASE WHEN regexp_matches({0}, '^[SH][0-9][A-Z]{{2}}') AND substr({0}, 3, 2) IN ({1}) THEN substr({0}, 3, 2) END".format


@query(sql("off", "fin") + f""", s AS (SELECT id, full_name AS name, coalesce(party, 'nonpartisan') AS party, coalesce(nullif(state, ''), {_FROM(_ID('fec_candidate_id'), _IN)}, {_FROM(_ID('fec_id'), _IN)}, 'Unknown') AS state,
  CASE WHEN {_ID('fec_candidate_id')} LIKE 'S%' THEN 'senate' WHEN {_ID('fec_candidate_id')} LIKE 'H%' THEN 'house' WHEN {_ID('fec_id')} LIKE 'S%' THEN 'senate' WHEN {_ID('fec_id')} LIKE 'H%' THEN 'house'
  WHEN role_title ILIKE '%senator%' THEN 'senate' WHEN role_title ILIKE '%representative%' THEN 'house' ELSE 'unknown' END AS chamber FROM off WHERE is_active)
  SELECT s.id, name, party, state, chamber, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM s JOIN fin ON official_id = s.id GROUP BY ALL HAVING sum(amount_cents) > 0 ORDER BY total_cents DESC, s.id LIMIT 200""")
def treemap_chain(spark, d):
    """The treemap with state and chamber from the first place that tells them: column, either candidate id, title."""
    off = rows(spark, d, "off", "full_name role_title party state is_active source_ids").where("is_active")
    ids = [F.get_json_object("source_ids", f"$.{k}") for k in ("fec_candidate_id", "fec_id")]
    state = [F.when(i.rlike("^[SH][0-9][A-Z]{2}") & F.substring(i, 3, 2).isin(CHAIN_STATES), F.substring(i, 3, 2)) for i in ids]
    chamber = F.coalesce(*[F.when(i.startswith("S"), "senate").when(i.startswith("H"), "house") for i in ids], F.when(F.col("role_title").ilike("%senator%"), "senate").when(F.col("role_title").ilike("%representative%"), "house"), F.lit("unknown"))
    total = rows(spark, d, "fin", "official_id amount_cents").groupBy(F.col("official_id").alias("id")).agg(F.sum("amount_cents").alias("total_cents")).where("total_cents > 0")
    got = off.select("id", F.col("full_name").alias("name"), F.coalesce("party", F.lit("nonpartisan")).alias("party"), F.coalesce(F.nullif("state", F.lit("")), *state, F.lit("Unknown")).alias("state"), chamber.alias("chamber")).join(total, "id")
    return got.orderBy(F.desc("total_cents"), "id").limit(200)


# -- votes and edges -------------------------------------------------------------------------------------------------

#: Titles of procedural votes, questions that are procedural, and titles of leaders.
PROCEDURAL = (
    "On the Cloture Motion", "On Passage", "On the Amendment", "On the Conference Report", "On the Joint Resolution", "On the Resolution", "On the Motion", "On the Motion to Proceed",
    "On the Motion to Table", "On Cloture on the Motion", "On the Motion to Concur", "On Agreeing to the Amendment", "On Agreeing to the Resolution",
)
QUESTIONS = (
    "on the cloture motion", "on passage", "on the amendment", "on the conference report", "on the joint resolution", "on the resolution", "on the motion", "on the motion to proceed",
    "on the motion to table", "on the motion to recommit", "on agreeing to the amendment",
)
LEADERS = ("secretary", "administrator", "director", "commissioner", "chair", "chairman", "attorney general", "surgeon general", "comptroller", "treasurer", "postmaster")


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def vote_category(title, kind):
    """procedural by exact title, then nomination by its forms, then regulation by type, else substantive."""
    nominated = title.ilike("On the Nomination%") | title.ilike("%Nomination of%") | title.ilike("Confirmation of%")
    return F.when(title.isin(*PROCEDURAL), "procedural").when(nominated, "nomination").when(kind == "regulation", "regulation").otherwise("substantive")


_CATEGORY = f"CASE WHEN {{0}} IN ({_quoted(PROCEDURAL)}) THEN 'procedural' WHEN {{0}} ILIKE 'On the Nomination%' OR {{0}} ILIKE '%Nomination of%' OR {{0}} ILIKE 'Confirmation of%' THEN 'nomination' WHEN {{1}} = 'regulation' THEN 'regulation' ELSE 'substantive' END".format


@query(sql("pro") + f""", v AS (SELECT DISTINCT congress, chamber, rollnumber, question FROM vote_list_items)
  SELECT 'proposal' AS src, id AS key, {_CATEGORY('title', 'type')} AS category FROM pro UNION ALL SELECT 'roll', congress || '|' || chamber || '|' || rollnumber, {_CATEGORY('question', "''")} FROM v""")
def vote_categories(spark, d):
    """The category of proposals, and of roll calls by their question."""
    pro = rows(spark, d, "pro", "title type").select(F.lit("proposal").alias("src"), F.col("id").alias("key"), vote_category(F.col("title"), F.col("type")).alias("category"))
    roll = table(spark, d, "vote_list_items").select("congress", "chamber", "rollnumber", "question").distinct()
    key = F.concat_ws("|", F.col("congress").cast("string"), "chamber", F.col("rollnumber").cast("string"))
    return pro.unionByName(roll.select(F.lit("roll").alias("src"), key.alias("key"), vote_category(F.col("question"), F.lit("")).alias("category")))


def vote_kind(vote, category, question, title):
    """The edge of a vote, null where it makes none: procedural ones, and votes of no known value."""
    q, t = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    procedural = F.coalesce(category == "procedural", F.lit(False)) | q.isin(*QUESTIONS)
    nominated = F.coalesce(category == "nomination", F.lit(False)) | q.contains("nomination") | t.contains("nomination") | t.contains("confirming")
    yes_no = F.when(vote.isin("yes", "no"), F.concat(F.when(nominated, "nomination_vote_").otherwise("vote_"), vote))
    return F.when(~procedural, F.when(vote.isin("present", "not voting", "abstain"), "vote_abstain").otherwise(yes_no))


@query(sql("con", "pro") + """, v AS (SELECT from_id, to_id, occurred_at, con.id, substr(connection_type, 6) AS vote, vote_category, lower(coalesce(title, '')) AS t FROM con LEFT JOIN pro ON pro.id = to_id WHERE connection_type LIKE 'vote%' AND to_type = 'proposal'),
  k AS (SELECT *, CASE WHEN vote_category = 'procedural' THEN NULL WHEN vote = 'abstain' THEN 'vote_abstain' WHEN vote IN ('yes', 'no') THEN CASE WHEN coalesce(vote_category = 'nomination', false) OR contains(t, 'nomination') OR contains(t, 'confirming') THEN 'nomination_vote_' ELSE 'vote_' END || vote END AS kind FROM v)
  SELECT from_id, to_id, kind, max(occurred_at) AS occurred_at, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
def vote_edges_by_category(spark, d):
    """Votes with category and title of their proposal, mapped to edges or skipped; one edge per official, proposal and kind."""
    con = rows(spark, d, "con", "from_id to_type to_id connection_type occurred_at").where(F.col("connection_type").startswith("vote") & (F.col("to_type") == "proposal"))
    pro = rows(spark, d, "pro", "title vote_category").select(F.col("id").alias("to_id"), "title", "vote_category")
    v = skew_join(con, pro, ["to_id"], "left", sketch=con)
    kind = vote_kind(F.substring("connection_type", 6, 20), F.col("vote_category"), F.lit(None).cast("string"), F.col("title"))
    return v.select("from_id", "to_id", kind.alias("kind"), "occurred_at").where("kind IS NOT NULL").groupBy("from_id", "to_id", "kind").agg(F.max("occurred_at").alias("occurred_at"), F.count("*").alias("n"))


@query(sql("off") + f""", b AS (SELECT DISTINCT lower(trim(id)) AS agency_id, lower(trim(governing_body_id)) AS body FROM agencies)
  SELECT DISTINCT off.id AS from_id, agency_id AS to_id FROM off JOIN b ON body = lower(trim(off.governing_body_id)) WHERE {' OR '.join(f"contains(lower(role_title), '{w}')" for w in LEADERS)}""")
def leaders_of_agencies(spark, d):
    """Officials whose title holds one of the leaders' words, and the agencies of their governing body."""
    b = table(spark, d, "agencies").select(F.lower(F.trim("id")).alias("to_id"), F.lower(F.trim("governing_body_id")).alias("body")).distinct()
    lead = rows(spark, d, "off", "role_title governing_body_id").where(F.lower("role_title").rlike("|".join(LEADERS))).select(F.col("id").alias("from_id"), F.lower(F.trim("governing_body_id")).alias("body"))
    return skew_join(b, lead, ["body"], "inner").select("from_id", "to_id").distinct()


@query(_TYPED + """, p AS (SELECT DISTINCT cmteid, candid, totalcents, txcount, latestdate FROM pac_aggregations), m AS (SELECT cmteid, max(name) AS name FROM committee_master GROUP BY 1),
  g AS (SELECT cmteid, candid, CAST(sum(totalcents) AS BIGINT) AS cents, CAST(sum(txcount) AS BIGINT) AS n, max(epoch_ms) AS last_ms FROM p LEFT JOIN done ON done.value = latestdate GROUP BY 1, 2 HAVING sum(totalcents) >= 500000)
  SELECT cmteid, name, candid, cents, n, CAST(make_timestamp(last_ms * 1000) AS DATE) AS latest, round(least(1.0, log10(cents / 100000.0) / 4), 6)::DOUBLE AS strength FROM g JOIN m USING (cmteid)""")
def pac_edges(spark, d):
    """Committees of the master file and the candidates to whom they gave $5,000 or more: amounts, the latest date and the edge's strength. Dates are parsed, not compared as text."""
    p = table(spark, d, "pac_aggregations").select("cmteid", "candid", "totalcents", "txcount", "latestdate").distinct()
    g = T.normalise(p, "latestdate").groupBy("cmteid", "candid").agg(F.sum("totalcents").alias("cents"), F.sum("txcount").alias("n"), F.max("epoch_ms").alias("at")).where("cents >= 500000")
    m = table(spark, d, "committee_master").groupBy("cmteid").agg(F.max("name").alias("name"))
    return skew_join(g, m, ["cmteid"], "inner").select("cmteid", "name", "candid", "cents", "n", F.timestamp_millis("at").cast("date").alias("latest"), F.round(F.least(F.lit(1.0), F.log10(F.col("cents") / 100_000.0) / 4), 6).alias("strength"))


# -- tags in buckets -------------------------------------------------------------------------------------------------


@query(sql("pro") + f"""SELECT id, CASE WHEN days <= 7 THEN 'urgent' ELSE 'closing_soon' END AS tag FROM (SELECT id, floor(epoch(comment_period_end - TIMESTAMPTZ '{AS_OF} 00:00:00+00') / 86400) AS days FROM pro) WHERE days BETWEEN 0 AND 14""")
def urgency_tags(spark, d):
    days = F.floor((F.unix_timestamp("comment_period_end") - F.unix_timestamp(F.lit(AS_OF).cast("timestamp"))) / 86_400)
    return rows(spark, d, "pro", "comment_period_end").select("id", days.alias("days")).where("days BETWEEN 0 AND 14").select("id", F.when(F.col("days") <= 7, "urgent").otherwise("closing_soon").alias("tag"))


@query(sql("off", "fin", "con") + f""", ten AS (SELECT id, CASE WHEN y < 2 THEN 'freshman' WHEN y < 6 THEN 'sophomore' WHEN y < 12 THEN 'veteran' ELSE 'senior' END AS tag FROM (SELECT id, datediff('day', term_start, DATE '{AS_OF}') / 365.25 AS y FROM off WHERE term_start IS NOT NULL)),
  don AS (SELECT official_id AS id, count(*) AS n, avg(amount_cents) AS m, sum(CASE WHEN donor_type = 'pac' THEN amount_cents ELSE 0 END) / nullif(sum(amount_cents), 0) AS s FROM fin WHERE official_id IS NOT NULL GROUP BY 1),
  v AS (SELECT DISTINCT from_id, to_id FROM con WHERE connection_type = 'vote_yes'), p AS (SELECT DISTINCT to_id, party FROM v JOIN off ON off.id = from_id WHERE party IS NOT NULL), c AS (SELECT to_id, count(*) AS parties, min(party) AS sole FROM p GROUP BY 1),
  x AS (SELECT off.id, count(*) AS yes, count(*) FILTER (WHERE parties > 1 OR sole <> off.party) AS crossed FROM v JOIN off ON off.id = v.from_id JOIN c ON c.to_id = v.to_id WHERE party IS NOT NULL GROUP BY 1)
  SELECT id, 'tenure' AS kind, tag FROM ten UNION ALL SELECT id, 'donors', 'pac_heavy' FROM don WHERE s > 0.5 UNION ALL SELECT id, 'donors', 'grassroots' FROM don WHERE m < 50000 AND n > 100 UNION ALL SELECT id, 'donors', 'large_donor_funded' FROM don WHERE m > 500000
  UNION ALL SELECT id, 'votes', 'bipartisan' FROM x WHERE crossed > 0.2 * yes UNION ALL SELECT id, 'votes', 'partisan' FROM x WHERE crossed < 0.05 * yes AND yes > 50""")
def official_tags(spark, d):
    """Tenure, pattern of donors, and whether others of another party voted alike, as tags."""
    from polispark.plans.reference import bipartisan

    years = F.datediff(F.lit(AS_OF).cast("date"), "term_start") / 365.25
    ten = rows(spark, d, "off", "term_start").where("term_start IS NOT NULL").select("id", F.lit("tenure").alias("kind"), F.when(years < 2, "freshman").when(years < 6, "sophomore").when(years < 12, "veteran").otherwise("senior").alias("tag"))
    g = rows(spark, d, "fin", "official_id donor_type amount_cents").where("official_id IS NOT NULL").groupBy(F.col("official_id").alias("id"))
    g = g.agg(F.count("*").alias("n"), F.avg("amount_cents").alias("m"), F.try_divide(F.sum(F.when(F.col("donor_type") == "pac", F.col("amount_cents")).otherwise(0)), F.sum("amount_cents")).alias("s"))
    pattern = F.array_compact(F.array(F.when(F.col("s") > 0.5, "pac_heavy"), F.when((F.col("m") < 50_000) & (F.col("n") > 100), "grassroots"), F.when(F.col("m") > 500_000, "large_donor_funded")))
    votes = bipartisan(spark, d).select("id", F.lit("votes").alias("kind"), F.when(F.col("crossed") > 0.2 * F.col("yes"), "bipartisan").when((F.col("crossed") < 0.05 * F.col("yes")) & (F.col("yes") > 50), "partisan").alias("tag"))
    return ten.unionByName(g.select("id", F.lit("donors").alias("kind"), F.explode(pattern).alias("tag"))).unionByName(votes.where("tag IS NOT NULL"))


@query(sql("fin") + "SELECT CASE WHEN amount_cents < 500000 THEN 'small' WHEN amount_cents < 5000000 THEN 'medium' WHEN amount_cents < 50000000 THEN 'large' ELSE 'mega' END AS size, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fin GROUP BY 1")
def donation_sizes(spark, d):
    a = F.col("amount_cents")
    return rows(spark, d, "fin", "amount_cents").groupBy(F.when(a < 500_000, "small").when(a < 5_000_000, "medium").when(a < 50_000_000, "large").otherwise("mega").alias("size")).agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


#: Keywords of issues, found anywhere in a title.
ISSUES = {
    "healthcare": ("health", "medicare", "medicaid", "hospital", "prescription", "drug", "pharma", "insurance", "care act", "patient", "medical", "mental health", "opioid", "vaccine", "public health"),
    "climate": ("climate", "clean energy", "renewable", "carbon", "emission", "environment", "pollution", "solar", "wind energy", "fossil", "oil", "gas pipeline", "green", "conservation", "wildlife", "ocean", "water quality"),
    "economy": ("tax", "budget", "spending", "economic", "inflation", "trade", "tariff", "jobs", "employment", "wage", "financial", "bank", "housing", "debt", "appropriation", "fund", "relief"),
    "education": ("education", "school", "student", "teacher", "college", "university", "loan", "learning", "child", "youth", "early childhood"),
    "defense": ("defense", "military", "national security", "armed forces", "veteran", "army", "navy", "air force", "pentagon", "nato", "authorization act", "homeland"),
    "immigration": ("immigration", "border", "asylum", "refugee", "citizenship", "visa", "daca", "migrant", "deportation", "undocumented"),
    "justice": ("justice", "civil rights", "voting rights", "police", "criminal", "prison", "court", "constitutional", "amendment", "equal", "discrimination", "freedom", "privacy"),
}
_ISSUE = " UNION ALL ".join(f"SELECT id, title, '{k}' AS issue FROM pro WHERE regexp_matches(lower(title), '{'|'.join(w)}')" for k, w in ISSUES.items())


@query(sql("con", "pro") + f""", i AS ({_ISSUE}), v AS (SELECT DISTINCT from_id, to_id, connection_type FROM con WHERE connection_type IN ('vote_yes', 'vote_no')),
  g AS (SELECT from_id, issue, count(*) FILTER (WHERE connection_type = 'vote_yes') AS yes, count(*) FILTER (WHERE connection_type = 'vote_no') AS no, count(*) AS total, array_to_string(list_sort(list(DISTINCT title))[1:3], '; ') AS titles FROM v JOIN i ON i.id = v.to_id GROUP BY 1, 2)
  SELECT from_id, issue, yes, no, total, round(yes / total, 6)::DOUBLE AS yes_rate, titles FROM g""")
def issues_of_voters(spark, d):
    """Votes of an official by issue of the title, with up to three titles (the first by name)."""
    found = C.all_matches(F.col("title"), [(k, "|".join(w)) for k, w in ISSUES.items()])
    issue = rows(spark, d, "pro", "title").select(F.col("id").alias("to_id"), "title", F.explode(found).alias("issue"))
    v = rows(spark, d, "con", "from_id to_id connection_type").where(F.col("connection_type").isin("vote_yes", "vote_no")).select("from_id", "to_id", "connection_type").distinct()
    met = durable(skew_join(v, issue, ["to_id"], "inner"), "issues")
    counts = met.groupBy("from_id", "issue").agg(F.count_if(F.col("connection_type") == "vote_yes").alias("yes"), F.count_if(F.col("connection_type") == "vote_no").alias("no"), F.count("*").alias("total"))
    first = G.top_per_group(met.select("from_id", "issue", "title").distinct(), ["from_id", "issue"], [F.col("title")], 3)  # three rows a group are gathered
    titles = first.groupBy("from_id", "issue").agg(F.array_join(F.sort_array(F.collect_list("title")), "; ").alias("titles"))
    return counts.join(titles, ["from_id", "issue"]).withColumn("yes_rate", F.round(F.col("yes") / F.col("total"), 6))


@query(sql("pro", "con") + """, v AS (SELECT to_id, count(*) AS votes FROM con WHERE connection_type LIKE 'vote%' GROUP BY 1)
  SELECT id, coalesce(votes, 0) AS votes FROM pro LEFT JOIN v ON to_id = id WHERE status = 'open_comment' AND id NOT IN (SELECT proposal_id FROM documents WHERE doc_kind = 'summary' AND proposal_id IS NOT NULL) ORDER BY votes DESC, id LIMIT 100""")
def summary_candidates(spark, d):
    """Open proposals that have no summary among the documents, the most voted first: an anti-join before the counts."""
    done = table(spark, d, "documents").where("doc_kind = 'summary' AND proposal_id IS NOT NULL").select(F.col("proposal_id").alias("id"))
    open_ = skew_join(rows(spark, d, "pro", "status").where("status = 'open_comment'").select("id"), done, ["id"], "left_anti")
    v = rows(spark, d, "con", "to_id connection_type").where(F.col("connection_type").startswith("vote")).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("votes"))
    return open_.join(v, "id", "left").select("id", F.coalesce("votes", F.lit(0)).alias("votes")).orderBy(F.desc("votes"), "id").limit(100)


# -- writes, pages, counts -------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(CASE WHEN event_type = 'purchase' THEN 'true' END AS VARCHAR) AS paid FROM events")
def merged_props(spark, d):
    """A JSON column merged with a patch for some rows; the others stay."""
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    patch = e.where("event_type = 'purchase'").select("event_id", F.lit('{"paid": true}').alias("patch"))
    got = U.merge_json(e, "props", patch, ["event_id"], "patch")
    return got.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.paid").alias("paid"))


@query(sql("con") + "SELECT id, from_id, connection_type FROM con WHERE id > (SELECT id FROM con ORDER BY id LIMIT 1 OFFSET 499) ORDER BY id LIMIT 500")
def keyset_scan(spark, d):
    """The second page of the edges in the order of their ids, continued behind the last id of the first."""
    con = rows(spark, d, "con", "from_id connection_type")
    last = U.keyset_page(con.select("id"), "id", None, 500).agg(F.max("id").alias("id")).first().id
    return U.keyset_page(con, "id", last, 500)


@query(sql("pro") + "SELECT id, created_at::TIMESTAMP AS created_at FROM pro WHERE created_at > TIMESTAMPTZ '2023-06-01 00:00:00+00' ORDER BY created_at, id LIMIT 100 OFFSET 100")
def changed_proposals(spark, d):
    return U.changed_page(rows(spark, d, "pro", "created_at"), "created_at", "2023-06-01 00:00:00", 1, 100)


@query(sql("con") + "SELECT connection_type, count(*) AS n FROM con WHERE connection_type NOT IN ('oversight', 'endorsement', 'appointment') GROUP BY 1")
def other_kinds(spark, d):
    return rows(spark, d, "con", "connection_type").where(~F.col("connection_type").isin("oversight", "endorsement", "appointment")).groupBy("connection_type").agg(F.count("*").alias("n"))


@query(sql("pro") + "SELECT type, status, count(*) AS n FROM pro GROUP BY 1, 2")
def status_summary(spark, d):
    return rows(spark, d, "pro", "type status").groupBy("type", "status").agg(F.count("*").alias("n"))


_AGE = """age AS (SELECT id, name, acronym, agency_type, body FROM (SELECT lower(trim(id)) AS id, trim(name) AS name, acronym, agency_type, lower(trim(governing_body_id)) AS body,
  row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC, coalesce(acronym, '') DESC, coalesce(name, '') DESC, coalesce(agency_type, '') DESC, coalesce(governing_body_id, '') DESC) AS rn FROM agencies) WHERE rn = 1)"""


def agencies_now(spark, d) -> DataFrame:
    """id, name, acronym, agency_type, body of the current row of each agency."""
    a = table(spark, d, "agencies")
    fill = lambda c: F.coalesce(c, F.lit(""))
    row = F.struct(F.trim("name").alias("name"), "acronym", "agency_type", F.lower(F.trim("governing_body_id")).alias("body"))
    return a.groupBy(F.lower(F.trim("id")).alias("id")).agg(F.max_by(row, F.struct("updated_at", *[fill(c) for c in ("acronym", "name", "agency_type", "governing_body_id")])).alias("x")).select("id", "x.*")


@query(sql("pro") + f""", {_AGE}, c AS (SELECT governing_body_id AS body, count(*) AS total, count(*) FILTER (WHERE status = 'open_comment') AS open FROM pro GROUP BY 1)
  SELECT id, coalesce(total, 0) AS total, coalesce(open, 0) AS open FROM age LEFT JOIN c ON lower(trim(c.body)) = age.body""")
def agency_counts(spark, d):
    """Proposals of each agency's governing body, all and open, from one grouped count."""
    c = rows(spark, d, "pro", "governing_body_id status").groupBy(F.lower(F.trim("governing_body_id")).alias("body")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open_comment").alias("open"))
    return skew_join(agencies_now(spark, d), c, ["body"], "left").select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("open", F.lit(0)).alias("open"))


@query(sql("pro") + f", {_AGE} SELECT id, name FROM age WHERE (contains(lower(name), 'data') OR contains(lower(acronym), 'bd')) AND agency_type IN ('federal', 'state') AND body IN (SELECT lower(trim(governing_body_id)) FROM pro WHERE status = 'open_comment')")
def agency_list(spark, d):
    """Agencies by a part of the name or acronym, by type, and with open proposals."""
    hit = agencies_now(spark, d).where((F.lower("name").contains("data") | F.lower("acronym").contains("bd")) & F.col("agency_type").isin("federal", "state"))
    open_ = rows(spark, d, "pro", "governing_body_id status").where("status = 'open_comment'").select(F.lower(F.trim("governing_body_id")).alias("body"))
    return skew_join(hit, open_, ["body"], "left_semi").select("id", "name")


@query(sql("off", "fin") + """, t AS (SELECT DISTINCT official_id FROM fin WHERE donor_type = 'pac' AND amount_cents >= 100000) SELECT id, full_name FROM off WHERE contains(lower(full_name), 'a') AND role_title ILIKE '%senator%' AND party = 'republican' AND id IN (SELECT official_id FROM t)""")
def officials_list(spark, d):
    """Officials by text, chamber, party and the presence of a tag: a conjunction, the tag as a semi-join."""
    off = rows(spark, d, "off", "full_name role_title party").where(F.lower("full_name").contains("a") & F.col("role_title").ilike("%senator%") & (F.col("party") == "republican"))
    tagged = rows(spark, d, "fin", "official_id donor_type amount_cents").where("donor_type = 'pac' AND amount_cents >= 100000").select(F.col("official_id").alias("id"))
    return skew_join(off, tagged, ["id"], "left_semi").select("id", "full_name")


#: Kinds of edges that are shown as they are, and what others are shown as.
SHOWN = ("donation", "vote_yes", "vote_no", "vote_abstain", "nomination_vote_yes", "nomination_vote_no", "appointment", "revolving_door", "oversight", "lobbying", "co_sponsorship")
SHOWN_AS = {"contract_award": "donation", "business_partner": "oversight", "endorsement": "oversight", "family": "appointment", "legal_representation": "oversight"}
NODE_AS = {"official": "official", "agency": "agency", "governing_body": "agency", "proposal": "proposal", "organization": "organization"}
ENTITY_AS = {"pac": "pac", "super_pac": "pac", "party_committee": "pac", "individual": "individual"}
_SHOWN = f"CASE WHEN connection_type IN ({_quoted(SHOWN)}) THEN connection_type {' '.join(f'''WHEN connection_type = '{k}' THEN '{v}' ''' for k, v in SHOWN_AS.items())} ELSE 'oversight' END"
_NODE = f"CASE {' '.join(f'''WHEN {{0}} = '{k}' THEN '{v}' ''' for k, v in NODE_AS.items())} WHEN {{0}} = 'financial_entity' THEN CASE WHEN {{1}} IN ('pac', 'super_pac', 'party_committee') THEN 'pac' WHEN {{1}} = 'individual' THEN 'individual' ELSE 'corporation' END ELSE 'corporation' END".format


@query(sql("con", "ent") + f", e AS (SELECT id, min(entity_type) AS k FROM ent GROUP BY 1) SELECT {_NODE('from_type', 'k')} AS node, {_SHOWN} AS edge, count(*) AS n FROM con LEFT JOIN e ON e.id = from_id AND from_type = 'financial_entity' GROUP BY 1, 2")
def shown_kinds(spark, d):
    """Edges by the kinds that are shown for their start and for themselves; donors by their own type."""
    e = rows(spark, d, "ent", "entity_type").groupBy(F.col("id").alias("from_id")).agg(F.min("entity_type").alias("k")).withColumn("from_type", F.lit("financial_entity"))
    con = rows(spark, d, "con", "from_type from_id connection_type")
    met = skew_join(con, e, ["from_id", "from_type"], "left", sketch=con)
    node = F.when(F.col("from_type") == "financial_entity", C.mapped(F.col("k"), ENTITY_AS, "corporation")).otherwise(C.mapped(F.col("from_type"), NODE_AS, "corporation"))
    return met.groupBy(node.alias("node"), C.mapped(F.col("connection_type"), {k: k for k in SHOWN} | SHOWN_AS, "oversight").alias("edge")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(avg(value), 6)::DOUBLE AS mean, round(avg(abs(value - lag_value) / nullif(lag_value, 0)), 6)::DOUBLE AS variance, count(*) AS n FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lag_value FROM
  (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5) GROUP BY 1""")
def last_five_variance(spark, d):
    """Mean of the last five runs of a kind, and how much each differs from the one before it."""
    last = G.top_per_group(table(spark, d, "events").select("event_type", "event_id", "ts", "value"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 5)
    before = F.lag("value").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    step = last.withColumn("before", before)
    return step.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.abs(F.col("value") - F.col("before")) / F.nullif("before", F.lit(0.0))), 6).alias("variance"), F.count("*").alias("n"))


_ROUND = "floor(x / {0} + 0.5)".format
_DOLLARS = f"CASE WHEN x >= 1e9 THEN '$' || printf('%.1f', {_ROUND('1e8')} / 10) || 'B' WHEN x >= 1e6 THEN '$' || printf('%.1f', {_ROUND('1e5')} / 10) || 'M' WHEN x >= 1e3 THEN '$' || CAST(CAST({_ROUND('1e3')} AS BIGINT) AS VARCHAR) || 'K' WHEN x < 0 THEN '-$' || format('{{:,}}', CAST(floor(-x + 0.5) AS BIGINT)) ELSE '$' || format('{{:,}}', CAST(floor(x + 0.5) AS BIGINT)) END"


@query(sql("ent") + f"SELECT DISTINCT id, {_DOLLARS} AS usd FROM (SELECT id, total_donated_cents / 100.0::DOUBLE AS x FROM ent)")
def formatted_totals(spark, d):
    return rows(spark, d, "ent", "total_donated_cents").select("id", C.compact_usd(F.col("total_donated_cents")).alias("usd")).distinct()
