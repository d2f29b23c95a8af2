"""The same tables and functions for users of SQL: temporary views, scalar functions and table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.plans.civics import nodes, rows, sql
from polispark.plans.reference import _views

VIEWS = {"off": "civic_officials", "fin": "civic_contributions", "ent": "civic_donors", "pro": "civic_proposals", "bod": "civic_bodies", "con": "civic_connections"}

_SCALARS = (
    "trigrams(s STRING) RETURNS ARRAY<STRING> RETURN array_distinct(flatten(transform(filter(split(lower(s), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    "trigram_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce(try_divide(size(array_intersect(trigrams(a), trigrams(b))), size(array_union(trigrams(a), trigrams(b)))), 0D)",
    "us_fiscal_year(d DATE) RETURNS STRING RETURN coalesce(concat('FY', year(add_months(d, 3))), 'Unknown')",
    "donation_strength(cents BIGINT) RETURNS DOUBLE RETURN CASE WHEN cents > 0 THEN greatest(0D, least(1D, log10(cents / 100000D) / 4)) ELSE 0D END",
    "clean_key(k STRING) RETURNS STRING RETURN lower(trim(BOTH ' \\t\\r\\n' FROM k))",
)
_TABLES = (
    "officials_of(of_state STRING, of_party STRING) RETURNS TABLE (id STRING, full_name STRING) RETURN SELECT id, full_name FROM civic_officials WHERE (of_state IS NULL OR state = of_state) AND (of_party IS NULL OR party = of_party)",
    "edges_at(node STRING) RETURNS TABLE (id STRING, other STRING, connection_type STRING) RETURN SELECT id, to_id, connection_type FROM civic_connections WHERE from_id = node UNION ALL SELECT id, from_id, connection_type FROM civic_connections WHERE to_id = node",
    "donors_of(official STRING) RETURNS TABLE (donor_name STRING, cents BIGINT, n BIGINT) RETURN SELECT donor_name, sum(amount_cents), count(*) FROM civic_contributions WHERE official_id = official GROUP BY donor_name",
)


#: Table functions with arguments, by the questions they answer. An argument that is null does not filter; counts are exact; ties have an order.
_MORE = (
    "view_summary() RETURNS TABLE (total BIGINT, human BIGINT, bot BIGINT) RETURN SELECT count(*), count_if(NOT is_bot), count_if(is_bot) FROM civic_views",
    "top_pages(lim INT) RETURNS TABLE (page STRING, views BIGINT, sessions BIGINT) RETURN SELECT page, views, sessions FROM (SELECT *, row_number() OVER (ORDER BY views DESC, page) AS rn FROM (SELECT page, count(*) AS views, count(DISTINCT session_id) AS sessions FROM civic_views WHERE NOT is_bot GROUP BY page)) WHERE rn <= lim",
    "view_devices() RETURNS TABLE (device STRING, n BIGINT) RETURN SELECT coalesce(device, 'desktop'), n FROM (SELECT device, count(*) AS n FROM civic_views GROUP BY device)",
    "officials_by(chamber STRING, of_party STRING, of_state STRING) RETURNS TABLE (id STRING) RETURN SELECT id FROM civic_officials WHERE (chamber IS NULL OR CASE chamber WHEN 'senate' THEN role_title ILIKE '%senator%' WHEN 'house' THEN role_title ILIKE '%representative%' ELSE false END) AND (of_party IS NULL OR party = of_party) AND (of_state IS NULL OR state = of_state)",
    "officials_breakdown() RETURNS TABLE (level STRING, n BIGINT) RETURN SELECT CASE WHEN get_json_object(source_ids, '$.roster') IS NOT NULL THEN 'rostered' WHEN role_title LIKE 'State%' THEN 'state' ELSE 'other' END, count(*) FROM civic_officials GROUP BY 1",
    "official_donors(official STRING, lim INT) RETURNS TABLE (donor_name STRING, donor_type STRING, industry STRING, usd DOUBLE, n BIGINT) RETURN SELECT donor_name, donor_type, industry, usd, n FROM (SELECT *, row_number() OVER (ORDER BY usd DESC, donor_name, donor_type) AS rn FROM (SELECT donor_name, donor_type, coalesce(min(industry), 'Other') AS industry, CAST(sum(amount_cents) / 100 AS DOUBLE) AS usd, count(*) AS n FROM civic_contributions WHERE official_id = official GROUP BY 1, 2)) WHERE rn <= lim",
    "committees_by_party() RETURNS TABLE (party STRING, donor_name STRING, cents BIGINT) RETURN SELECT coalesce(party, 'other'), donor_name, cents FROM (SELECT party, donor_name, sum(amount_cents) AS cents FROM civic_contributions JOIN civic_officials ON civic_officials.id = official_id WHERE donor_type = 'pac' AND donor_name NOT ILIKE '%aggregate%' AND donor_name NOT ILIKE '%unitemized%' GROUP BY party, donor_name)",
    "sector_totals(members ARRAY<STRING>, least_cents BIGINT) RETURNS TABLE (sector STRING, cents BIGINT) RETURN SELECT sector, cents FROM (SELECT *, row_number() OVER (ORDER BY cents DESC, sector) AS rn FROM (SELECT industry AS sector, sum(amount_cents) AS cents FROM civic_contributions WHERE array_contains(members, official_id) AND industry IS NOT NULL AND lower(industry) <> 'other' GROUP BY 1)) WHERE rn <= 12 AND cents >= least_cents",
    "cross_totals(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS TABLE (sector STRING, a_cents BIGINT, b_cents BIGINT) RETURN SELECT sector, a_cents, b_cents FROM (SELECT *, row_number() OVER (ORDER BY a_cents + b_cents DESC, sector) AS rn FROM (SELECT sector, sum(CASE WHEN in_a THEN cents ELSE 0 END) AS a_cents, sum(CASE WHEN in_b THEN cents ELSE 0 END) AS b_cents FROM (SELECT industry AS sector, amount_cents AS cents, array_contains(a, official_id) AS in_a, array_contains(b, official_id) AS in_b FROM civic_contributions WHERE industry IS NOT NULL AND lower(industry) <> 'other') WHERE in_a OR in_b GROUP BY 1)) WHERE rn <= 12",
    "connections_of(members ARRAY<STRING>, lim INT) RETURNS TABLE (id STRING, from_id STRING, to_id STRING, amount_cents BIGINT) RETURN SELECT id, from_id, to_id, amount_cents FROM (SELECT *, row_number() OVER (ORDER BY amount_cents DESC NULLS LAST, strength DESC NULLS LAST, id) AS rn FROM civic_connections WHERE array_contains(members, from_id)) WHERE rn <= lim",
    "treemap(lim INT) RETURNS TABLE (id STRING, name STRING, cents BIGINT) RETURN SELECT id, name, cents FROM (SELECT *, row_number() OVER (ORDER BY cents DESC, id) AS rn FROM (SELECT o.id, o.full_name AS name, sum(amount_cents) AS cents FROM civic_officials o JOIN civic_contributions f ON f.official_id = o.id WHERE o.is_active GROUP BY 1, 2 HAVING sum(amount_cents) > 0)) WHERE rn <= lim",
    "named_like(q STRING, lim INT) RETURNS TABLE (type STRING, id STRING, label STRING, score DOUBLE) RETURN SELECT type, id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, label, id) AS rn FROM (SELECT type, id, label, round(trigram_similarity(label, q), 6) AS score FROM civic_nodes WHERE label IS NOT NULL) WHERE score > 0.3 OR contains(lower(label), lower(q))) WHERE rn <= lim",
    "latest_of(kind STRING, lim INT) RETURNS TABLE (event_id BIGINT, at TIMESTAMP) RETURN SELECT event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM civic_views WHERE page = kind) WHERE rn <= lim",
    "table_sizes() RETURNS TABLE (name STRING, n BIGINT) RETURN SELECT 'officials', count(*) FROM civic_officials UNION ALL SELECT 'connections', count(*) FROM civic_connections UNION ALL SELECT 'contributions', count(*) FROM civic_contributions",
)


def database_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of all tables below a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def register(spark: SparkSession, sf_dir: str) -> None:
    """Creates the views over sf_dir and the functions in this session; calling it again replaces them."""
    for short, name in VIEWS.items():
        rows(spark, sf_dir, short).createOrReplaceTempView(name)
    nodes(spark, sf_dir).createOrReplaceTempView("civic_nodes")
    _views(spark, sf_dir).createOrReplaceTempView("civic_views")
    for text in (*_SCALARS, *_TABLES, *_MORE):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_PV = "WITH pv AS (SELECT event_id, ts, event_type AS page, user_id AS session_id, event_type = 'error' AS is_bot, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'desktop' ELSE 'mobile' END AS device FROM events)\n"
_TOP = "(SELECT official_id FROM {} WHERE official_id IS NOT NULL GROUP BY 1 ORDER BY sum(amount_cents) DESC, official_id LIMIT 1)"
_SOME = "(SELECT id FROM off WHERE {} ORDER BY id LIMIT 40)"


def _api(name: str, call: str, oracle: str) -> None:
    """A query that calls a table function as a user of SQL would."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        members = {}
        for slot, where in (("ohio", "state = 'OH'"), ("dem", "party = 'democrat'")):
            if f":{slot}" in call:
                members[slot] = [r.id for r in spark.sql(f"SELECT id FROM civic_officials WHERE {where} ORDER BY id LIMIT 40").collect()]
        if ":top" in call:
            members["top"] = (spark.sql(f"SELECT official_id FROM {_TOP.format('civic_contributions')}").first() or [""])[0]
        return spark.sql(call, args={k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else v for k, v in members.items()})

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, oracle


_api("api_view_summary", "SELECT * FROM view_summary()", _PV + "SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_bot) AS human, count(*) FILTER (WHERE is_bot) AS bot FROM pv")
_api("api_top_pages", "SELECT * FROM top_pages(3)", _PV + "SELECT page, count(*) AS views, count(DISTINCT session_id) AS sessions FROM pv WHERE NOT is_bot GROUP BY page ORDER BY views DESC, page LIMIT 3")
_api("api_view_devices", "SELECT * FROM view_devices()", _PV + "SELECT coalesce(device, 'desktop') AS device, count(*) AS n FROM pv GROUP BY pv.device")
_api("api_officials_by", "SELECT 'all' AS args, id FROM officials_by(NULL, NULL, NULL) UNION ALL SELECT 'some', id FROM officials_by('senate', 'republican', NULL) UNION ALL SELECT 'state', id FROM officials_by('house', NULL, 'OH')", sql("off") + "SELECT 'all' AS args, id FROM off UNION ALL SELECT 'some', id FROM off WHERE role_title ILIKE '%senator%' AND party = 'republican' UNION ALL SELECT 'state', id FROM off WHERE role_title ILIKE '%representative%' AND state = 'OH'")
_api("api_officials_breakdown", "SELECT * FROM officials_breakdown()", sql("off") + "SELECT CASE WHEN json_extract_string(source_ids, '$.roster') IS NOT NULL THEN 'rostered' WHEN role_title LIKE 'State%' THEN 'state' ELSE 'other' END AS level, count(*) AS n FROM off GROUP BY 1")
_api("api_official_donors", "SELECT * FROM official_donors(:top, 50)", sql("fin") + f"SELECT donor_name, donor_type, coalesce(min(industry), 'Other') AS industry, CAST(sum(amount_cents) AS BIGINT) / 100.0::DOUBLE AS usd, count(*) AS n FROM fin WHERE official_id = {_TOP.format('fin')} GROUP BY 1, 2 ORDER BY usd DESC, donor_name, donor_type LIMIT 50")
_api("api_committees_by_party", "SELECT * FROM committees_by_party()", sql("off", "fin") + "SELECT coalesce(o.party, 'other') AS party, f.donor_name, CAST(sum(f.amount_cents) AS BIGINT) AS cents FROM fin f JOIN off o ON o.id = f.official_id WHERE f.donor_type = 'pac' AND f.donor_name NOT ILIKE '%aggregate%' AND f.donor_name NOT ILIKE '%unitemized%' GROUP BY o.party, f.donor_name")
_api("api_sector_totals", "SELECT * FROM sector_totals(:ohio, 100000)", sql("off", "fin") + f"SELECT industry AS sector, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fin WHERE official_id IN {_SOME.format("state = 'OH'")} AND industry IS NOT NULL AND lower(industry) <> 'other' GROUP BY 1 HAVING sum(amount_cents) >= 100000 ORDER BY cents DESC, sector LIMIT 12")
_api("api_cross_totals", "SELECT * FROM cross_totals(:ohio, :dem)", sql("off", "fin") + f""", a AS {_SOME.format("state = 'OH'")}, b AS {_SOME.format("party = 'democrat'")} SELECT industry AS sector, CAST(sum(CASE WHEN official_id IN (SELECT id FROM a) THEN amount_cents ELSE 0 END) AS BIGINT) AS a_cents, CAST(sum(CASE WHEN official_id IN (SELECT id FROM b) THEN amount_cents ELSE 0 END) AS BIGINT) AS b_cents
  FROM fin WHERE (official_id IN (SELECT id FROM a) OR official_id IN (SELECT id FROM b)) AND industry IS NOT NULL AND lower(industry) <> 'other' GROUP BY 1 ORDER BY a_cents + b_cents DESC, sector LIMIT 12""")
_api("api_connections_of", "SELECT * FROM connections_of(:dem, 200)", sql("off", "con") + f"SELECT id, from_id, to_id, amount_cents FROM con WHERE from_id IN {_SOME.format("party = 'democrat'")} ORDER BY amount_cents DESC NULLS LAST, strength DESC NULLS LAST, id LIMIT 200")
_api("api_treemap", "SELECT * FROM treemap(150)", sql("off", "fin") + "SELECT o.id, o.full_name AS name, CAST(sum(amount_cents) AS BIGINT) AS cents FROM off o JOIN fin f ON f.official_id = o.id WHERE o.is_active GROUP BY 1, 2 HAVING sum(amount_cents) > 0 ORDER BY cents DESC, o.id LIMIT 150")
_api("api_latest_of", "SELECT * FROM latest_of('click', 20)", _PV + "SELECT event_id, ts::TIMESTAMP AS at FROM pv WHERE page = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20")
_api("api_table_sizes", "SELECT * FROM table_sizes()", sql("off", "con", "fin") + "SELECT 'officials' AS name, count(*) AS n FROM off UNION ALL SELECT 'connections', count(*) FROM con UNION ALL SELECT 'contributions', count(*) FROM fin")
