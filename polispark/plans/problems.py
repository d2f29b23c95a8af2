"""The general problems p1, p3, p4 and p6 as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.functions.keys import clean_key
from polispark.operators import hierarchy, references, skew, timestamps
from polispark.session import durable, table

#: Share of rows from which p4_found reports a key.
FOUND_SHARE = 0.03


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = hierarchy.current_agencies(table(spark, sf_dir, "agencies"))
    return hierarchy.resolve_roots(edges).select(F.col("id").alias("agency_id"), "root_id")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = hierarchy.current_agencies(table(spark, sf_dir, "agencies"))
    got = hierarchy.resolve_hierarchy(edges)
    return got.select(F.col("id").alias("agency_id"), "root_id", "depth", F.array_join("path", "/").alias("path"), "in_loop", "on_loop")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = hierarchy.current_agencies(table(spark, sf_dir, "agencies"))
    got = hierarchy.descendants(durable(hierarchy.resolve_hierarchy(edges), "hierarchy"))
    return got.select(F.col("ancestor_id").alias("agency_id"), F.col("id").alias("descendant_id"), "distance")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.broken_references(spark, sf_dir).select("ref_table", "ref_field", "row_id").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with repeated references counted once."""
    found = references.broken_references(spark, sf_dir).select("ref_table", "ref_field", "row_id", "month", "status").distinct()
    return found.groupBy("ref_table", "ref_field", "month", "status").agg(F.count("*").alias("n"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = table(spark, sf_dir, "entity_connections").select(clean_key("from_id").alias("f"), clean_key("to_id").alias("t"), F.col("amount_cents").alias("amount"))
    ends = F.array(F.struct(F.lit("from").alias("side"), F.col("f").alias("key_id"), F.col("t").alias("other")), F.struct(F.lit("to").alias("side"), F.col("t").alias("key_id"), F.col("f").alias("other")))
    return con.select(F.inline(ends), "amount")


def _key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = skew.per_key_stats(_ends(spark, sf_dir), "key_id", "other", "amount", by=["side"])
    return got.select("side", "key_id", "n_rows", F.col("amount").alias("amount_cents"), "n_other", "is_heavy")


def p4_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_stats(spark, sf_dir).drop("is_heavy")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "entity_connections").count()
    return _key_stats(spark, sf_dir).where(F.col("n_rows") >= FOUND_SHARE * n).select("side", "key_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timestamps.typed_dates(spark, sf_dir)
    return got.where(F.col("epoch_ms").isNotNull() & (F.col("row_key") != "")).select("src", "row_key", "epoch_ms").distinct()


def p6_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per source whose value is null or no real date."""
    got = timestamps.typed_dates(spark, sf_dir)
    return got.groupBy("src").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.col("value").isNotNull() & F.col("epoch_ms").isNull()).alias("n_unreadable"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p3_found, p3_report, p4_found, p4_key_stats, p6_found, p6_unreadable)}

_CLEAN = "lower(trim({}, chr(9) || chr(10) || chr(13) || ' '))".format
_AGENCY = f"""cur AS (SELECT id, parent, created_at FROM (
  SELECT {_CLEAN('id')} AS id, {_CLEAN('parent_agency_id')} AS parent, created_at,
    row_number() OVER (PARTITION BY {_CLEAN('id')} ORDER BY updated_at DESC, coalesce({_CLEAN('parent_agency_id')}, '') DESC, created_at DESC) AS rn
  FROM agencies WHERE id IS NOT NULL) WHERE rn = 1)"""
_TREE = f"""WITH RECURSIVE {_AGENCY},
edge AS (SELECT c.id, p.id AS parent FROM cur c LEFT JOIN cur p ON p.id = c.parent),
walk AS (SELECT id, id AS top, 0 AS d, [id] AS path FROM edge
  UNION ALL SELECT w.id, e.parent, w.d + 1, list_prepend(e.parent, w.path) FROM walk w JOIN edge e ON e.id = w.top
  WHERE e.parent IS NOT NULL AND NOT list_contains(w.path, e.parent)),
fin AS (SELECT id, max_by(top, d) AS top, max(d) AS d, max_by(path, d) AS path FROM walk GROUP BY id),
lop AS (SELECT f.id, e.parent AS first, list_position(f.path, e.parent) AS p, f.path FROM fin f JOIN edge e ON e.id = f.top WHERE e.parent IS NOT NULL),
res AS (SELECT f.id, coalesce(list_min(l.path[1:l.p]), f.top) AS root_id, CASE WHEN l.id IS NULL THEN f.path ELSE l.path[l.p:] END AS path,
  l.id IS NOT NULL AS in_loop FROM fin f LEFT JOIN lop l ON l.id = f.id)
"""
_REFS = f"""WITH {_AGENCY},
tgt AS (SELECT 'official' AS ref_type, {_CLEAN('id')} AS key, min(created_at) AS born FROM officials GROUP BY 1, 2
  UNION ALL SELECT 'proposal', {_CLEAN('id')}, min(created_at) FROM proposals GROUP BY 1, 2
  UNION ALL SELECT 'financial_entity', {_CLEAN('id')}, min(created_at) FROM financial_entities GROUP BY 1, 2
  UNION ALL SELECT 'governing_body', {_CLEAN('id')}, min(created_at) FROM governing_bodies GROUP BY 1, 2
  UNION ALL SELECT 'agency', id, created_at FROM cur),
ref AS (SELECT 'entity_connections' AS ref_table, 'from_id' AS ref_field, {_CLEAN('id')} AS row_id, from_type AS ref_type, {_CLEAN('from_id')} AS key, created_at FROM entity_connections
  UNION ALL SELECT 'entity_connections', 'to_id', {_CLEAN('id')}, to_type, {_CLEAN('to_id')}, created_at FROM entity_connections
  UNION ALL SELECT 'financial_relationships', 'official_id', {_CLEAN('id')}, 'official', {_CLEAN('official_id')}, created_at FROM financial_relationships
  UNION ALL SELECT 'agencies', 'parent_agency_id', id, 'agency', parent, created_at FROM cur),
bad AS (SELECT DISTINCT ref_table, ref_field, row_id, strftime(ref.created_at, '%Y-%m') AS month, CASE WHEN tgt.key IS NULL THEN 'missing' ELSE 'late' END AS status
  FROM ref LEFT JOIN tgt ON tgt.ref_type = ref.ref_type AND tgt.key = ref.key WHERE ref.key IS NOT NULL AND (tgt.key IS NULL OR tgt.born > ref.created_at))
"""
_ENDS = f"""WITH con AS (SELECT {_CLEAN('from_id')} AS f, {_CLEAN('to_id')} AS t, amount_cents FROM entity_connections),
ends AS (SELECT 'from' AS side, f AS key_id, t AS other, amount_cents FROM con UNION ALL SELECT 'to', t, f, amount_cents FROM con),
st AS (SELECT side, key_id, count(*) AS n_rows, CAST(sum(amount_cents) AS BIGINT) AS amount_cents, count(DISTINCT other) AS n_other FROM ends WHERE key_id IS NOT NULL GROUP BY 1, 2)
"""
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_OFFSETS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in timestamps.FIXED_ZONES.items()) + "}"
_REGIONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**timestamps.REGION_ZONES, "": timestamps.DEFAULT_ZONE}.items()) + "}"
_TYPED = f"""WITH raw AS (SELECT 'pac_aggregations' AS src, cmteid || '|' || candid AS row_key, latestdate AS value FROM pac_aggregations
  UNION ALL SELECT 'fec_contributions', CAST(sub_id AS VARCHAR), receipt_date FROM fec_contributions
  UNION ALL SELECT 'vote_list_items', CAST(congress AS VARCHAR) || '|' || chamber || '|' || CAST(rollnumber AS VARCHAR), date FROM vote_list_items),
vals AS (SELECT DISTINCT value, trim(value, chr(9) || chr(10) || chr(13) || ' ') AS s FROM raw WHERE value IS NOT NULL),
packed AS (SELECT value, s, CASE WHEN regexp_full_match(s, '[0-9]{{7,8}}') THEN CASE WHEN CAST(lpad(s, 8, '0')[1:2] AS INT) BETWEEN 1 AND 12
  THEN lpad(s, 8, '0')[5:8] || '-' || lpad(s, 8, '0')[1:2] || '-' || lpad(s, 8, '0')[3:4] ELSE lpad(s, 8, '0')[1:4] || '-' || lpad(s, 8, '0')[5:6] || '-' || lpad(s, 8, '0')[7:8] END ELSE s END AS x FROM vals),
forms(k, pat) AS (VALUES (1, '^(?P<y>[0-9]{{4}})-(?P<m>[0-9]{{1,2}})-(?P<d>[0-9]{{1,2}})(?P<r>.*)$'), (2, '^(?P<m>[0-9]{{1,2}})/(?P<d>[0-9]{{1,2}})/(?P<y>[0-9]{{4}}|[0-9]{{2}})(?P<r>[^0-9].*|)$'),
  (3, '^(?P<d>[0-9]{{1,2}})[.](?P<m>[0-9]{{1,2}})[.](?P<y>[0-9]{{4}}|[0-9]{{2}})(?P<r>[^0-9].*|)$'), (4, '^(?:[A-Za-z]{{3,9}},?[ ]+)?(?P<d>[0-9]{{1,2}})[- ](?P<m>[A-Za-z]{{3,9}})[.]?[- ,]+(?P<y>[0-9]{{4}}|[0-9]{{2}})(?P<r>[^0-9].*|)$'),
  (5, '^(?:[A-Za-z]{{3,9}},[ ]+)?(?P<m>[A-Za-z]{{3,9}})[.]?[ ]+(?P<d>[0-9]{{1,2}}),?[ ]+(?P<y>[0-9]{{4}})(?P<r>[^0-9].*|)$')),
cut AS (SELECT value, s, CASE {' '.join(f"WHEN regexp_matches(x, (SELECT pat FROM forms WHERE k = {k})) THEN {k}" for k in range(1, 6))} END AS k, x FROM packed),
part AS (SELECT value, s, CASE k {' '.join(f"WHEN {k} THEN [{', '.join(f'regexp_extract(x, (SELECT pat FROM forms WHERE k = {k}), {g})' for g in order)}]" for k, order in ((1, (1, 2, 3, 4)), (2, (3, 1, 2, 4)), (3, (3, 2, 1, 4)), (4, (3, 2, 1, 4)), (5, (3, 1, 2, 4))))} END AS g FROM cut),
num AS (SELECT value, s, CASE WHEN length(g[1]) = 2 THEN 2000 ELSE 0 END + TRY_CAST(g[1] AS INT) AS y, coalesce(TRY_CAST(g[2] AS INT), nullif(list_position({_MONTHS}, lower(g[2])[1:3]), 0)) AS mo, TRY_CAST(g[3] AS INT) AS d, rtrim(g[4]) AS rest FROM part),
tim AS (SELECT *, CASE WHEN y BETWEEN 1900 AND 2099 THEN TRY_CAST(printf('%04d-%02d-%02d', y, mo, d) AS DATE) END AS day, regexp_extract(rest, '^(?:[ ]*[Tt,][ ]*|[ ]+)([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.,]([0-9]{{1,9}}))?)?[ ]*(?:([AaPp])[.]?[Mm][.]?)?[ ]*([A-Za-z]{{1,5}}|[+-][0-9]{{2}}(?::?[0-9]{{2}})?)?$', ['h', 'mi', 'sec', 'frac', 'half', 'zone']) AS t FROM num),
wall AS (SELECT value, s, day, rest, upper(t.zone) AS zone, TRY_CAST(t.mi AS INT) AS mi, coalesce(TRY_CAST(nullif(t.sec, '') AS INT), 0) AS sec, coalesce(TRY_CAST(rpad(t.frac, 3, '0')[1:3] AS INT), 0) AS ms,
  CASE WHEN t.half = '' THEN TRY_CAST(t.h AS INT) WHEN TRY_CAST(t.h AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(t.h AS INT) % 12 + CASE WHEN lower(t.half) = 'p' THEN 12 ELSE 0 END END AS h FROM tim),
loc AS (SELECT value, s, day, rest, zone, CASE WHEN h <= 23 AND mi <= 59 AND sec <= 59 THEN day + to_hours(h) + to_minutes(mi) + to_seconds(sec) + to_milliseconds(ms) END AS local FROM wall),
shift AS (SELECT *, CASE WHEN zone LIKE '+%' OR zone LIKE '-%' THEN CASE WHEN CAST(zone[2:3] AS INT) <= 18 AND coalesce(TRY_CAST(replace(zone, ':', '')[4:5] AS INT), 0) <= 59
  THEN CASE WHEN zone LIKE '-%' THEN -1 ELSE 1 END * (CAST(zone[2:3] AS INT) * 60 + coalesce(TRY_CAST(replace(zone, ':', '')[4:5] AS INT), 0)) END ELSE {_OFFSETS}[zone] END AS offs, {_REGIONS}[zone] AS region FROM loc),
inst AS (SELECT *, CASE WHEN region IS NULL OR local IS NULL THEN NULL WHEN timezone(region, timezone(region, local) - INTERVAL 1 HOUR) = local THEN epoch_ms(timezone(region, local)) - 3600000 ELSE epoch_ms(timezone(region, local)) END AS zoned FROM shift),
done AS (SELECT value, CASE WHEN regexp_full_match(s, '[0-9]{{10}}|[0-9]{{13}}') THEN CASE WHEN CAST(rpad(s, 13, '0') AS BIGINT) BETWEEN epoch_ms(TIMESTAMP '1900-01-01') AND epoch_ms(TIMESTAMP '2100-01-01') - 1 THEN CAST(rpad(s, 13, '0') AS BIGINT) END
  WHEN rest = '' THEN epoch_ms(CAST(day AS TIMESTAMP)) WHEN offs IS NOT NULL THEN epoch_ms(local) - offs * 60000 ELSE zoned END AS epoch_ms FROM inst)
"""
ORACLE = {
    "p6_found": _TYPED + "SELECT DISTINCT src, row_key, CAST(epoch_ms AS BIGINT) AS epoch_ms FROM raw JOIN done USING (value) WHERE epoch_ms IS NOT NULL AND row_key <> ''",
    "p6_unreadable": _TYPED + "SELECT src, count(*) AS n_rows, count(*) FILTER (WHERE raw.value IS NULL) AS n_null, count(*) FILTER (WHERE raw.value IS NOT NULL AND epoch_ms IS NULL) AS n_unreadable FROM raw LEFT JOIN done USING (value) GROUP BY src",
    "p1_found": _TREE + "SELECT id AS agency_id, root_id FROM res",
    "p1_hierarchy": _TREE + "SELECT id AS agency_id, root_id, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, '/') AS path, in_loop, in_loop AND len(path) = 1 AS on_loop FROM res",
    "p1_descendants": _TREE + """SELECT a AS agency_id, id AS descendant_id, CAST(len(path) - list_position(path, a) AS INTEGER) AS distance
      FROM (SELECT id, path, root_id, in_loop, unnest(path) AS a FROM res) WHERE a <> id AND NOT (in_loop AND a = root_id)
      UNION ALL SELECT root_id, id, CAST(len(path) - 1 AS INTEGER) FROM res WHERE in_loop AND id <> root_id""",
    "p3_found": _REFS + "SELECT DISTINCT ref_table, ref_field, row_id FROM bad",
    "p3_report": _REFS + "SELECT ref_table, ref_field, month, status, count(*) AS n FROM bad GROUP BY ALL",
    "p4_found": _ENDS + f"SELECT side, key_id FROM st WHERE n_rows >= {FOUND_SHARE} * (SELECT count(*) FROM entity_connections)",
    "p4_key_stats": _ENDS + "SELECT * FROM st",
}
