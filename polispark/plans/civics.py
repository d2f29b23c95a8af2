"""The domain tables without repeated rows and with clean keys, as DataFrames and as SQL of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.functions.keys import clean_key
from polispark.session import exists, table, written

_KEYS = {
    "officials": ("id",), "financial_relationships": ("id", "official_id"), "financial_entities": ("id",), "proposals": ("id",),
    "governing_bodies": ("id",), "entity_connections": ("id", "from_id", "to_id"),
}
_COLUMNS = {
    "officials": ("id", "full_name", "role_title", "party", "state", "governing_body_id", "term_start", "is_active", "source_ids", "created_at"),
    "financial_relationships": ("id", "official_id", "donor_name", "donor_type", "industry", "amount_cents", "contribution_date", "cycle_year", "fec_committee_id", "created_at"),
    "financial_entities": ("id", "name", "entity_type", "total_donated_cents"),
    "proposals": ("id", "governing_body_id", "type", "status", "title", "vote_category", "introduced_at", "comment_period_end", "created_at"),
    "governing_bodies": ("id", "name", "type", "state"),
    "entity_connections": ("id", "from_type", "from_id", "to_type", "to_id", "connection_type", "strength", "amount_cents", "occurred_at", "created_at"),
}
_SHORT = {"off": "officials", "fin": "financial_relationships", "ent": "financial_entities", "pro": "proposals", "bod": "governing_bodies", "con": "entity_connections"}


#: Cleaned tables of a session: (application, folder, table, fingerprint of its files) -> path and schema.
_MADE: dict[tuple, tuple] = {}
#: Columns by which the rows of a cleaned file are sorted, so that row groups hold ranges of keys and a lookup skips the others.
_SORTED = {"entity_connections": ("from_id", "to_id"), "financial_relationships": ("official_id",)}


def _fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Number, bytes and latest time of the files below a path: a table that is written anew is cleaned anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(at) if fs.exists(at) else []
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def _once(spark: SparkSession, sf_dir: str, name: str, sources: list[str], make) -> DataFrame:
    """What make() gives, written once per session and state of its sources."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *[_fingerprint(spark, f"{sf_dir}/{s}.parquet") for s in sources])
    if key not in _MADE or not exists(spark, _MADE[key][0]):
        df = make()
        _MADE[key] = written(df, f"clean-{name}"), df.schema
    path, schema = _MADE[key]
    return spark.read.schema(schema).parquet(path)


def clean(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table with clean keys, strength as double and repeated rows once.

    The shuffle that removes repeated rows runs once per session and table; all queries then read columns and push filters
    into the cleaned files.
    """

    def make() -> DataFrame:
        cols = [clean_key(c).alias(c) if c in _KEYS[name] else F.col(c).cast("double").alias(c) if c == "strength" else F.col(c) for c in _COLUMNS[name]]
        df = table(spark, sf_dir, name).select(*cols).distinct()
        return df.sortWithinPartitions(*_SORTED[name]) if name in _SORTED else df

    return _once(spark, sf_dir, name, [name], make)


def rows(spark: SparkSession, sf_dir: str, short: str, columns: str = "") -> DataFrame:
    """A cleaned table by its short name; `columns` names what is wanted besides the id; without it all are taken."""
    name = _SHORT[short]
    take = ["id", *(c for c in columns.split() if c != "id")] if columns else _COLUMNS[name]
    return clean(spark, sf_dir, name).select(*take)


def keys(spark: SparkSession, sf_dir: str, short: str, column: str, name: str | None = None) -> DataFrame:
    """One key column alone: what the search for heavy keys needs."""
    return clean(spark, sf_dir, _SHORT[short]).select(F.col(column).alias(name or column))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, id, label of all entities, written once per session; of an agency the acronym, else the name, of its current row."""

    def make() -> DataFrame:
        agencies = table(spark, sf_dir, "agencies").groupBy(clean_key("id").alias("id")).agg(F.max_by(F.struct(F.col("acronym").alias("a"), F.col("name").alias("n")), F.struct("updated_at", F.coalesce("acronym", F.lit("")), F.coalesce("name", F.lit("")))).alias("x"))
        one = lambda short, kind, col: rows(spark, sf_dir, short, col).groupBy("id").agg(F.min(col).alias("label")).select(F.lit(kind).alias("type"), "id", "label")
        out = agencies.select(F.lit("agency").alias("type"), "id", F.coalesce("x.a", F.trim("x.n")).alias("label"))
        for short, kind, col in (("off", "official", "full_name"), ("pro", "proposal", "title"), ("ent", "financial_entity", "name"), ("bod", "governing_body", "name")):
            out = out.unionByName(one(short, kind, col))
        return out

    return _once(spark, sf_dir, "nodes", ["agencies", "officials", "proposals", "financial_entities", "governing_bodies"], make)


_CLEAN = "lower(trim({}, chr(9) || chr(10) || chr(13) || ' '))".format


def sql(*shorts: str) -> str:
    """WITH clause that defines the short names."""
    parts = []
    for s in shorts:
        if s == "nod":
            parts.append(
                f"nod AS (SELECT 'agency' AS type, id, coalesce(acronym, trim(name)) AS label FROM (SELECT {_CLEAN('id')} AS id, acronym, name, row_number() OVER (PARTITION BY {_CLEAN('id')} "
                "ORDER BY updated_at DESC, coalesce(acronym, '') DESC, coalesce(name, '') DESC) AS rn FROM agencies) WHERE rn = 1 "
                f"UNION ALL SELECT 'official', {_CLEAN('id')}, min(full_name) FROM officials GROUP BY 2 UNION ALL SELECT 'proposal', {_CLEAN('id')}, min(title) FROM proposals GROUP BY 2 "
                f"UNION ALL SELECT 'financial_entity', {_CLEAN('id')}, min(name) FROM financial_entities GROUP BY 2 UNION ALL SELECT 'governing_body', {_CLEAN('id')}, min(name) FROM governing_bodies GROUP BY 2)"
            )
            continue
        name = _SHORT[s]
        cols = [f"{_CLEAN(c)} AS {c}" if c in _KEYS[name] else f"CAST({c} AS DOUBLE) AS {c}" if c == "strength" else c for c in _COLUMNS[name]]
        parts.append(f"{s} AS (SELECT DISTINCT {', '.join(cols)} FROM {name})")
    return "WITH " + ",\n".join(parts) + "\n"
