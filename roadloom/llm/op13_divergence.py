"""An audit of how sources diverge in their words, by plain relational steps.

Terms are exploded from the texts and counted by group (language and source). Each language keeps the terms of enough
documents; its groups are crossed with that vocabulary, so that absent terms count too, and get smoothed shares in
whole numbers. Groups of a language meet term by term; differences are summed by pair of sources and ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.llm.text import lower_ascii
from roadloom.plans.staging import staged

#: All but ASCII that is no letter; a class of ranges is searched ten times as fast as its complement.
TERMS = "[A-Za-z\\x80-\\x{10FFFF}]+"
_EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class AuditPolicy:
    """min_docs: a language keeps the terms of so many of its documents. smoothing: added to each count. scale: what
    a share of one is written as. top_terms: ranks of terms to return. broadcast_groups: up to so many groups, which
    the driver counts, they are broadcast to the vocabulary; beyond it they meet it in ``slices`` of each language.
    broadcast_terms: up to so many terms, counted too, the vocabulary is broadcast to the counts."""

    min_docs: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    broadcast_groups: int = 10_000
    broadcast_terms: int = 500_000
    slices: int = 256


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs`` (text, lang, source): occurrences, and documents that have the term.

    Each text's terms are sorted within their row, so that the first of equals counts the document; both counts are
    summed within tasks before the one shuffle.
    """
    terms = F.sort_array(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERMS), F.lit(0)))
    # The list beside itself, shifted by one: no term is empty, as what stands before the first is.
    beside = F.arrays_zip(F.col("t").alias("term"), F.concat(F.array(F.lit("")), F.col("t")).alias("before"))
    rows = docs.select("lang", "source", terms.alias("t")).select("lang", "source", F.inline(beside).alias("term", "before")).where("term is not null")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def _share(n: Column, total: Column, vocabulary: Column, p: AuditPolicy) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * vocabulary)), exactly."""
    top = (n + p.smoothing).cast("decimal(20,0)") * F.lit(p.scale).cast("decimal(18,0)")
    below = (total + p.smoothing * vocabulary).cast("decimal(20,0)")
    rest = top % below
    return F.lit(1).cast("long") + ((top - rest) / below).cast("decimal(20,0)").cast("long")


def _crossed(groups: DataFrame, vocabulary: DataFrame, p: AuditPolicy) -> DataFrame:
    """Each group with each term of its language."""
    if groups.count() <= p.broadcast_groups:
        return vocabulary.join(F.broadcast(groups), "lang")
    slice_ = F.pmod(F.xxhash64("term"), F.lit(p.slices)).cast("int").alias("slice")
    spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(p.slices - 1))).alias("slice"))
    return vocabulary.select("*", slice_).join(spread, ["lang", "slice"]).drop("slice")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", policy: AuditPolicy = AuditPolicy()) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs``.

    Part ``pair``: item is each other source of the language, value the differences of both sources' shares, summed
    over the language's vocabulary. Part ``term``: item is a term that the group has and uses more than its language
    does, value by how much, the ``policy.top_terms`` first. Ranks follow values, the larger first, then items.

    Null text, language or source: empty, and so a group like others. Each row is a document, repeated ones too. A
    language without vocabulary: its pairs have value 0, and there are no terms. Texts of any length are read whole.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    p = policy
    bare = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = staged(term_counts(bare), "terms")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= p.min_docs)
    vocabulary = staged(vocabulary.select("lang", "term", "all_n"), "vocabulary")
    side = vocabulary.select("lang", "term")
    side = F.broadcast(side) if side.count() <= p.broadcast_terms else side
    kept = staged(counts.join(side, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = staged(bare.select("lang", "source").distinct(), "names")
    groups = staged(names.join(sums, ["lang", "source"], "left").join(langs, "lang").fillna(0, ["total"]), "groups")
    dense = _crossed(groups, vocabulary, p).join(kept, ["lang", "source", "term"], "left").fillna(0, ["n"])
    own, whole = _share(F.col("n"), F.col("total"), F.col("v"), p), _share(F.col("all_n"), F.col("all_total"), F.col("v"), p)
    dense = staged(dense.select("lang", "source", "term", "n", own.alias("p"), whole.alias("q")), "dense")

    one, two = dense.alias("a"), dense.alias("b")
    met = one.join(two, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    apart = met.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(F.abs(F.col("a.p") - F.col("b.p"))).alias("value"))
    pairs = names.join(names.select("lang", F.col("source").alias("item")), "lang").where("source < item").join(apart, ["lang", "source", "item"], "left").fillna(0, ["value"])
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", "value", F.inline(both)).select("lang", "source", "item", "value")
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    # The limit also holds within tasks before the shuffle, so a group's window gets few rows of each.
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= p.top_terms)
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(p: AuditPolicy = AuditPolicy()) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, total: f"(1 + ({p.scale}::HUGEINT * ({n} + {p.smoothing})) // ({total} + {p.smoothing} * v))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
e AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS all_n FROM e GROUP BY ALL HAVING count(DISTINCT r) >= {p.min_docs}),
k AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN v USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM v GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
x AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "coalesce(total, 0)")} AS p, {share("all_n", "all_total")} AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN k USING (lang, source, term)),
y AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z) WHERE part = 'pair' OR rank <= {p.top_terms}
"""


QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {"op13_divergence": oracle()}
