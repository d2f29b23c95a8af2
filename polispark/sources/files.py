"""Readers of landed files with declared schemas: delimited text, XML roll calls, JSON pages and lines."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polispark.operators.skew import skew_join


def lenient_number(c: Column) -> Column:
    """A number, 0 for anything that is none."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("double"), F.lit(0.0))


def delimited(spark: SparkSession, path: str, columns: dict[str, int], key: str, numbers: tuple[str, ...] = (), sep: str = "|", encoding: str = "ISO-8859-1") -> DataFrame:
    """Columns by their position in lines without a header or quotes.

    Blank lines and lines without the key are skipped; short lines have nulls, long ones lose what follows; numbers are read
    leniently. The reader splits large files and reads only the named positions.
    """
    width = max(columns.values()) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, quote="", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cols = [(lenient_number(F.col(f"c{i}")) if name in numbers else F.nullif(F.col(f"c{i}"), F.lit(""))).alias(name) for name, i in columns.items()]
    return raw.select(*cols).where(F.col(key).isNotNull())


def lookup(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest `order`."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("v")).select(key, "v.*")


def house_votes(spark: SparkSession, path: str) -> DataFrame:
    """member, vote of each recorded vote of lower-house roll calls; one recorded vote or many."""
    schema = "legislator struct<`_name-id`: string, _VALUE: string>, vote string"
    got = spark.read.format("xml").option("rowTag", "recorded-vote").schema(schema).load(path)
    return got.select(F.col("legislator.`_name-id`").alias("member"), F.lower(F.trim("vote")).alias("vote"), F.input_file_name().alias("file"))


def senate_votes(spark: SparkSession, path: str) -> DataFrame:
    """name_key (last name and state), vote of each member in upper-house roll calls."""
    schema = "last_name string, state string, vote_cast string"
    got = spark.read.format("xml").option("rowTag", "member").schema(schema).load(path)
    key = F.concat_ws(":", F.lower(F.trim("last_name")), F.upper(F.trim("state")))
    return got.select(key.alias("name_key"), F.lower(F.trim("vote_cast")).alias("vote"), F.input_file_name().alias("file"))


def pages(spark: SparkSession, path: str, item: str, items: str) -> DataFrame:
    """Rows of the array `items` (element type `item`) of JSON pages; pages without it have no rows."""
    got = spark.read.schema(f"{items} array<{item}>").option("multiLine", True).json(path)
    return got.select(F.inline(items))


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that can't be read are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def contributions(spark: SparkSession, path: str, columns: dict[str, int], key: str, amount: str, least: float = 0.0, kinds: tuple[str, tuple[str, ...]] | None = None, among: tuple[str, DataFrame] | None = None) -> DataFrame:
    """A delimited contribution file with its filters in the scan: the least amount, allowed kinds (in upper case), and keys of a table (a semi-join)."""
    got = delimited(spark, path, columns, key, (amount,)).where(F.col(amount) >= least)
    if kinds is not None:
        got = got.where(F.upper(kinds[0]).isin(*kinds[1]))
    return got if among is None else skew_join(got, among[1], [among[0]], "left_semi")


def zipped_lines(spark: SparkSession, path: str, entry: str | None = None) -> DataFrame:
    """value: the lines of one entry (the first, if none is named) of each landed archive. An archive cannot be split: one task holds its packed bytes (2 GB at most, the bound of a binary value) and unpacks them line by line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(entry or z.namelist()[0]) as f:
                    while part := list(itertools.islice(f, 10_000)):
                        yield pd.DataFrame({"value": [x.decode("latin-1").rstrip("\r\n") for x in part]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def house_roll(spark: SparkSession, path: str) -> DataFrame:
    """file, congress, chamber, roll, bill, at, question, result of lower-house roll calls."""
    schema = "congress int, chamber string, `rollcall-num` int, `legis-num` string, `action-date` string, `vote-question` string, `vote-result` string"
    got = spark.read.format("xml").option("rowTag", "vote-metadata").schema(schema).load(path)
    return got.select(F.input_file_name().alias("file"), "congress", F.lit("House").alias("chamber"), F.col("`rollcall-num`").alias("roll"), F.col("`legis-num`").alias("bill"), F.col("`action-date`").alias("at"), F.col("`vote-question`").alias("question"), F.col("`vote-result`").alias("result"))


def senate_roll(spark: SparkSession, path: str) -> DataFrame:
    """file, congress, chamber, roll, bill, at, question, result of upper-house roll calls."""
    schema = "congress int, vote_number int, vote_date string, question string, vote_result string, document struct<document_type: string, document_number: string>"
    got = spark.read.format("xml").option("rowTag", "roll_call_vote").schema(schema).load(path)
    bill = F.concat_ws(" ", "document.document_type", "document.document_number")
    return got.select(F.input_file_name().alias("file"), "congress", F.lit("Senate").alias("chamber"), F.col("vote_number").alias("roll"), bill.alias("bill"), F.col("vote_date").alias("at"), "question", F.col("vote_result").alias("result"))
