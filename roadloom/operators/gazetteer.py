"""Settlements by name: an index of the names' letters in threes finds them with accents and misspellings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.operators.city import Boundary
from roadloom.operators.tiles import AREAS
from roadloom.plans.staging import staged

#: What a table of settlements holds.
SETTLEMENTS = f"{AREAS}, country string, size long"
#: Letters with accents, by their decomposition, and the letter below.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii()}


def plain_name(name: Column) -> Column:
    """A name in lower case, without accents, its words apart by one space."""
    bare = F.translate(F.replace(name, F.lit("ß"), F.lit("ss")), "".join(_MARKED), "".join(_MARKED.values()))
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def grams(name: Column) -> Column:
    """The different runs of three characters of a name with a space on either side."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def find_settlements(queries: DataFrame, settlements: DataFrame, limit: int = 1, least: float = 0.5) -> DataFrame:
    """(query, rank, name, country, size, score): for each of ``queries`` (query; country, or null for any), the best
    ``limit`` of ``settlements`` (name, country, size, ...).

    The score is twice the shared runs over all runs of both names, at least ``least``; the best come first, then the
    largest, then by country and name. Names meet by an equi-join on runs; what is common to many names is a hot key,
    which adaptive execution splits, and pairs are summed within tasks first. Null and empty names find nothing and
    aren't found; settlements alike in name and country are one, the largest. Empty tables: no rows.
    """
    towns = settlements.where("name is not null").groupBy("name", "country").agg(F.max(F.coalesce("size", F.lit(0).cast("long"))).alias("size"))
    towns = staged(towns.withColumn("own", plain_name(F.col("name"))).where("own <> ''").withColumn("g", grams(F.col("own"))), "settlements")
    asked = queries.where("query is not null").select("query", F.col("country").alias("wanted")).distinct()
    asked = staged(asked.withColumn("g", grams(plain_name(F.col("query")))).where(plain_name(F.col("query")) != ""), "queries")
    index = towns.select("name", "country", "size", F.size("g").alias("n"), F.explode("g").alias("gram"))
    probes = asked.select("query", "wanted", F.size("g").alias("m"), F.explode("g").alias("gram"))
    met = probes.join(index, "gram").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("country")))
    shared = met.groupBy("query", "wanted", "m", "name", "country", "size", "n").agg(F.count("*").alias("both"))
    scored = shared.withColumn("score", 2 * F.col("both") / (F.col("m") + F.col("n"))).where(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy("query", "wanted").orderBy(F.desc("score"), F.desc("size"), "country", "name"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", F.col("wanted").alias("asked_country"), "rank", "name", "country", "size", "score")


def boundary_by_name(spark: SparkSession, path: str, name: str, country: str | None = None) -> Boundary:
    """The boundary of the settlement that fits ``name`` best, from a Parquet table of :data:`SETTLEMENTS`; none is an
    error."""
    table = spark.read.schema(SETTLEMENTS).parquet(path)
    found = find_settlements(spark.createDataFrame([(name, country)], "query string, country string"), table).first()
    if found is None:
        raise ValueError(f"city not found: {name}")
    own = (F.col("name") == found["name"]) & F.col("country").eqNullSafe(F.lit(found["country"]))
    row = table.where(own).orderBy(F.desc_nulls_last("size")).first()
    box = None if row["min_lat"] is None else (row["min_lat"], row["max_lat"], row["min_lon"], row["max_lon"])
    return Boundary.of_rings([[(p["lon"], p["lat"]) for p in ring] for ring in row["rings"]], box)
