"""The queries of the llm problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polispark.functions.keys import clean_key
from polispark.llm import aliases, canonical, encoding, language, leakage, linkage, variants
from polispark.session import durable, table


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four sources in one form: src, key, name, state, district, level, party, year."""
    text = F.create_map(*[F.lit(x) for code, name in linkage.STATES.items() for x in (name.replace("_", " "), code)])
    codes = list(linkage.STATES)
    party = lambda c: F.nullif(F.upper(F.substring(F.trim(c), 1, 1)), F.lit(""))
    number = lambda c: F.regexp_extract(F.col(c).cast("string"), r"0*(\d+)\s*$", 1)
    blank = lambda c: F.nullif(c, F.lit(""))
    code = lambda c: F.when(F.upper(F.trim(c)).isin(codes), F.upper(F.trim(c)))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "officials")
    role = F.lower("role_title")
    level = F.when(role.startswith("state rep"), "sl").when(role.startswith("state sen"), "su").when(role.startswith("rep"), "fl").when(role.startswith("sen"), "fu").when(role.isNotNull(), "o?")
    off = rows.select(F.lit("officials").alias("src"), clean_key("id").alias("key"), F.col("full_name").alias("name"), code(F.col("state")).alias("state"), blank(number("district_name")).alias("district"), level.alias("level"), party(F.col("party")).alias("party"), F.year("term_start").alias("year"))
    rows = table(spark, sf_dir, "weball_rows")
    state = F.coalesce(code(F.substring("candid", 3, 2)), code(F.col("candofficest")))
    web = rows.select(F.lit("weball").alias("src"), F.col("candid").alias("key"), F.col("candname").alias("name"), state.alias("state"), none.alias("district"), F.when(F.col("candid").startswith("S"), "fu").otherwise("fl").alias("level"), none.alias("party"), F.lit(None).cast("int").alias("year"))
    rows = table(spark, sf_dir, "os_people")
    house = F.when(F.col("division_id").contains("/sldu:") | (F.col("org_classification") == "upper"), "su").when(F.col("division_id").contains("/sldl:") | (F.col("org_classification") == "lower"), "sl").otherwise("s?")
    ppl = rows.select(F.lit("openstates").alias("src"), F.col("id").alias("key"), "name", code(F.regexp_extract("division_id", "state:([a-z]{2})", 1)).alias("state"), blank(number("district")).alias("district"), house.alias("level"), party(F.col("party")).alias("party"), F.substring("start_date", 1, 4).try_cast("int").alias("year"))
    rows = table(spark, sf_dir, "congress_members")
    state = F.coalesce(code(F.col("state")), F.try_element_at(text, F.lower(F.trim("state"))))
    con = rows.select(F.lit("congress").alias("src"), F.col("bioguideid").alias("key"), "name", state.alias("state"), blank(number("district")).alias("district"), F.when(F.lower("chamber").startswith("sen"), "fu").otherwise("fl").alias("level"), party(F.col("partyname")).alias("party"), F.col("startyear").cast("int").alias("year"))
    return off.unionByName(web).unionByName(ppl).unionByName(con)


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matching pairs with their sources and confidence."""
    return linkage.link(durable(linkage.records(_people(spark, sf_dir)), "records"), many=("weball",))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_links(spark, sf_dir).select("key_a", "key_b")


def _name_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, n, is_org (null: unknown) of all distinct strings of the three fields; whoever a field holds is told by its type."""
    fin, fec = table(spark, sf_dir, "financial_relationships"), table(spark, sf_dir, "fec_contributions")
    rows = fin.select(F.col("donor_name").alias("name"), (F.col("donor_type") != "individual").cast("int").alias("org"))
    rows = rows.unionByName(fec.select(F.col("contributor_name").alias("name"), (F.upper("entity_type") != "IND").cast("int").alias("org")))
    rows = rows.unionByName(fec.select(F.col("contributor_employer").alias("name"), F.lit(1).alias("org")))
    return rows.where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"), (F.max("org") == 1).alias("is_org"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.pairs(durable(variants.cluster(durable(_name_strings(spark, sf_dir), "strings")), "clusters"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spelling: its entity and the entity's number of spellings."""
    got = durable(variants.cluster(durable(_name_strings(spark, sf_dir), "strings")), "clusters")
    return got.join(got.groupBy("entity").agg(F.count("*").alias("n_spellings")), "entity").select("name", "entity", "n_spellings")


def _free_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("industry", "financial_relationships", "industry"), ("occupation", "fec_contributions", "contributor_occupation"), ("organization", "committee_master", "connectedorg"))
    parts = [table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(col).alias("raw_value")) for kind, name, col in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = canonical.map_values(_free_entries(spark, sf_dir), table(spark, sf_dir, "canonical_entries"), aliases.table(spark))
    return got.select("kind", "raw_value", "entry_id")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and way: distinct values and rows."""
    rows = _free_entries(spark, sf_dir).where(F.col("raw_value").isNotNull()).groupBy("kind", "raw_value").agg(F.count("*").alias("n"))
    got = canonical.map_values(rows, table(spark, sf_dir, "canonical_entries"), aliases.table(spark)).join(rows, ["kind", "raw_value"])
    return got.groupBy("kind", "way").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per outcome of decoding what was encoded, and the ids of all."""
    docs = table(spark, sf_dir, "documents")
    ids = durable(encoding.encode(docs), "ids")
    back = encoding.decode(ids).withColumnRenamed("text", "decoded")
    got = docs.select("doc_id", "text").join(back, "doc_id").join(ids, "doc_id")
    return got.groupBy((F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same")).agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_ids"))


def _hits(spark: SparkSession, sf_dir: str, masks: tuple[str, ...] = leakage.MASKS) -> DataFrame:
    return leakage.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), masks=masks)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).where(F.col("slips") == 0).select("doc_id", "item_id").distinct()


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with substitutions included: all windows with at most leakage.SLIPS differing words."""
    return leakage.leaked(_hits(spark, sf_dir, leakage.COVER))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.unnamed(language.segments(table(spark, sf_dir, "documents")))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = language.segments(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "seg", "lang", "words", F.round("confidence", 6).alias("confidence"), "whole")


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.documents(language.segments(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p5_found, p5_clusters, p7_found, p7_unmatched, p8_ids, p8_roundtrip, p9_found, p9_overlaps, p10_found, p10_segments, p10_documents)}

_GRAMS = """SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM (
  SELECT {key}, regexp_extract_all(lower(strip_accents(regexp_replace(replace(replace(t, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\\p{{Cf}}', '', 'g'))), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM (SELECT {key}, unnest([text, regexp_replace(text, '</?[a-zA-Z][^<>]{{0,200}}>|&#?[0-9a-zA-Z]{{1,12}};', ' ', 'g')]) AS t FROM {table} WHERE text IS NOT NULL)) WHERE len(w) >= 10"""
ORACLE: dict[str, str] = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(key='doc_id', table='documents')}) JOIN ({_GRAMS.format(key='item_id', table='eval_items')}) USING (gram)",
}
