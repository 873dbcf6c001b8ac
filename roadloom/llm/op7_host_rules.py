"""Host-level quality rules, with DataFrame functions only.

Each document is measured and held against the rules in one pass over the texts. Failures are summed by host, the
hosts' rates are shrunk towards a beta prior fitted to all hosts, and each host's verdict goes back to its documents.
A document is kept if it passes the base rule and its host isn't rejected; the other rules speak through the hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.text import WHITESPACE, fresh, without, words_of
from roadloom.plans.staging import staged

SYMBOLS = "#*$%&|<>"
DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = ("host_rate", "host_low", "host_rejected", "prior_a", "prior_b")


@dataclass(frozen=True)
class HostPolicy:
    """min_words, max_repeat_percent: the base rule. max_symbols_per_word, max_dup_lines_per_word, word length:
    what else counts as a failure of a document. max_host_rate, max_ratio: a host is rejected, with all its documents,
    when the lower end of its posterior rate lies above ``max_host_rate`` or above ``max_ratio`` times the prior's
    mean, whichever is lower. z: standard deviations of the posterior from its mean to that end; it spares small hosts
    that failed by chance. min_weight, max_weight: bounds of the prior's weight in documents; the upper one also
    counts where hosts differ no more than chance lets them. broadcast_hosts: up to so many rejected hosts, which
    the driver counts, they are broadcast; beyond it the join shuffles."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.3
    max_dup_lines_per_word: float = 0.1
    min_word_chars: float = 1.5
    max_word_chars: float = 40.0
    max_host_rate: float = 0.5
    max_ratio: float = 2.0
    z: float = 1.645
    min_weight: float = 1.0
    max_weight: float = 1000.0
    broadcast_hosts: int = 100_000


def domain_of(url: Column) -> Column:
    """The host of a URL in lower case, without ``www.``; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five measures of :data:`DIGEST` (long); a null text counts as empty.

    Repeats: three-word windows are hashed to 64 bits and sorted within their row with their positions, windows
    with an equal neighbour are repeats, and the words they cover are counted from the gaps between their starts.
    Columns of ``df`` named like a measure are replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in DIGEST])
    t, w, g, s, n = fresh(df, "_t", "_w", "_g", "_s", "_n")
    keep = [F.col(f"`{c}`") for c in df.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = df.select(*keep, body.alias(t)).select(*keep, t, words_of(F.col(t)).alias(w))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "")
    grams = F.transform(
        F.slice(F.col(w), 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)).alias("h"), i.alias("p")),
    )
    rows = words.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(without(F.col(t), WHITESPACE)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(without(F.col(t), SYMBOLS))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.sort_array(grams).alias(g),
    )
    twice = F.filter(F.col(g), lambda x, i: (x["h"] == F.get(F.col(g), i - 1)["h"]) | (x["h"] == F.get(F.col(g), i + 1)["h"]))
    rest = [*keep, *DIGEST[:4]]
    starts = rows.select(*rest, twice.alias(s)).select(*rest, F.sort_array(F.transform(F.col(s), lambda x: x["p"])).alias(s))
    covered = F.transform(F.col(s), lambda p, i: F.coalesce(F.least(F.get(F.col(s), i + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
    repeats = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words")
    # Made by a generator, the measures aren't computed anew in each condition that is pushed below.
    return starts.select(*keep, F.inline(F.array(F.struct(*DIGEST[:4], repeats))))


def base_failure(p: HostPolicy) -> Column:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < p.min_words) | (100 * r > p.max_repeat_percent * n)


def rule_failure(p: HostPolicy) -> Column:
    """Whether a document fails the base rule or any other rule."""
    n = F.col("n_words")
    return (
        base_failure(p)
        | (F.col("n_symbols") > p.max_symbols_per_word * n)
        | (F.col("n_dup_lines") > p.max_dup_lines_per_word * n)
        | (F.col("word_chars") < p.min_word_chars * n)
        | (F.col("word_chars") > p.max_word_chars * n)
    )


def host_verdicts(measured: DataFrame, host: str, policy: HostPolicy = HostPolicy()) -> DataFrame:
    """One row per host (null is a host): host, n_docs, n_failed, host_rate, host_low, host_rejected, prior_a, prior_b.

    host_rate = (n_failed + a) / (n_docs + a + b), where the beta prior (a, b) has the documents' mean rate and,
    by the method of moments, the spread of the hosts' rates beyond chance; host_low is its posterior's lower end.
    Partial sums leave each task before the shuffle, so a host with a third of all rows costs no more than another.
    The prior is one row of sums. Empty table: no rows.
    """
    failed = F.col("failed") if "failed" in measured.columns else rule_failure(policy)
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    hosts = staged(hosts, "hosts")
    n, f = F.col("n_docs"), F.col("n_failed")
    s = hosts.agg(
        F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(F.pow(n.cast("double"), F.lit(2.0))).alias("nn"),
        F.sum(F.pow(f.cast("double"), F.lit(2.0)) / n).alias("ffn"),
    ).first()
    a, b = beta_prior(s["h"], s["n"] or 0, s["f"] or 0, s["nn"] or 0.0, s["ffn"] or 0.0, policy)
    rate = (f + F.lit(a)) / (n + F.lit(a + b))
    low = rate - policy.z * F.sqrt(rate * (1 - rate) / (n + F.lit(a + b + 1)))
    rejected = low > min(policy.max_host_rate, policy.max_ratio * a / (a + b))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("host_rate"), low.alias("host_low"), rejected.alias("host_rejected"), F.lit(a).alias("prior_a"), F.lit(b).alias("prior_b"))


def beta_prior(hosts: int, n: int, f: int, nn: float, ffn: float, policy: HostPolicy = HostPolicy()) -> tuple[float, float]:
    """The prior's parameters from sums over hosts of 1, n, f, n*n and f*f/n (f failures of n documents).

    With fewer than two hosts, no spread beyond chance or a mean of 0 or 1, the prior has the policy's greatest weight.
    """
    if n == 0:
        return 1.0, 1.0
    mean = min(max(f / n, 1e-6), 1 - 1e-6)
    weight = policy.max_weight
    spread = n - nn / n
    if hosts > 1 and spread > 0 and 0 < f < n:
        # Weighted variance of the hosts' rates less what binomial chance adds to it.
        between = (ffn - f * f / n - (hosts - 1) * mean * (1 - mean)) / spread
        if between > 0:
            weight = min(max(mean * (1 - mean) / between - 1, policy.min_weight), policy.max_weight)
    return mean * weight, (1 - mean) * weight


def with_verdicts(measured: DataFrame, host: str, policy: HostPolicy = HostPolicy()) -> DataFrame:
    """``measured`` with base_failed, host_rate, host_low, host_rejected, prior_a, prior_b and kept.

    kept: the base rule passed and the host isn't rejected. The verdicts of hosts are broadcast when their count is
    within ``policy.broadcast_hosts``; otherwise the join shuffles, and adaptive execution splits a hot host.
    """
    verdicts = staged(host_verdicts(measured, host, policy), "verdicts")
    [h] = fresh(measured, "_host")
    side = verdicts.select(F.col("host").alias(h), *VERDICT)
    if verdicts.count() <= policy.broadcast_hosts:
        side = F.broadcast(side)
    out = measured.select("*", base_failure(policy).alias("base_failed"))
    out = out.join(side, F.col(f"`{host}`").eqNullSafe(F.col(h)), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop(h)


def host_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """Per document: its key, the measures, base_failed, host_rate, host_low, host_rejected, prior_a, prior_b and
    kept, without the text.

    Null text: empty, so it fails. Null host: the documents without a host form one. Repeated rows and keys: each
    row is judged. Empty table: no rows. Other columns are dropped, whatever their names.
    """
    k, h = F.col(f"`{key}`").alias("doc_id"), F.col(f"`{host}`").alias("host")
    rows = with_measures(docs.select(k, h, F.col(f"`{text}`").alias("text")))
    return with_verdicts(staged(rows.drop("text"), "measures"), "host", policy)


def keep_quality(docs: DataFrame, text: str = "text", host: str = "source", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    Texts are measured once: the rows are written with their failures, those that fail the base rule without their
    columns, hosts are judged from that table's narrow columns, and the rows of hosts that aren't rejected are read
    back. Null text: empty, so the row goes. Null host: the rows without a host form one. Repeated rows are judged
    alike. Empty table: no rows.
    """
    d, t, h, base, failed = "row", "text", "host", "base_failed", "failed"
    bare = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias(d), F.col(f"`{host}`").alias(h), F.col(f"`{text}`").alias(t))
    rows = with_measures(bare).select(h, F.when(~base_failure(policy), F.col(d)).alias(d), base_failure(policy).alias(base), rule_failure(policy).alias(failed))
    rows = staged(rows, "judged")
    bad = staged(host_verdicts(rows, h, policy).where("host_rejected").select(F.col("host").alias("bad")), "bad-hosts")
    side = F.broadcast(bad) if bad.count() <= policy.broadcast_hosts else bad
    out = rows.where(~F.col(base)).join(side, F.col(h).eqNullSafe(F.col("bad")), "left_anti")
    return out.select(*[F.col(f"{d}.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return host_quality(docs).select("doc_id", *DIGEST, "base_failed", "kept")


def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' texts, judged by the domains of their URLs, every seventh of which serves menus alone."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    domain = domain_of(F.col("url"))
    menu = F.pmod(F.conv(F.substring(F.md5(domain), 1, 6), 16, 10).cast("long"), F.lit(7)) == 0
    rows = pages.select("page_id", F.when(menu, F.repeat(F.lit("home | news | "), 5)).otherwise(text).alias("text"), domain.alias("domain"))
    return host_quality(rows, "page_id", "text", "domain").select("doc_id", *DIGEST, "base_failed", F.round("host_rate", 9).alias("host_rate"), "host_rejected", "kept")


_P = HostPolicy()


def oracle(rows: str, columns: str = "NOT base_failed AND NOT bad AS kept") -> str:
    """The rules in SQL over ``rows``, a query of doc_id, source and text."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM ({rows})),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) o(k) GROUP BY r),
m AS (
  SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < {_P.min_words} OR 100 * n_repeat_words > {_P.max_repeat_percent} * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR n_symbols > {_P.max_symbols_per_word}::DOUBLE * n_words OR n_dup_lines > {_P.max_dup_lines_per_word}::DOUBLE * n_words
  OR word_chars < {_P.min_word_chars}::DOUBLE * n_words OR word_chars > {_P.max_word_chars}::DOUBLE * n_words AS failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM f GROUP BY source),
s AS (SELECT count(*) AS h, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ffn FROM h),
v AS (SELECT *, least(greatest(f / n, 1e-6), 1 - 1e-6) AS mean, n - nn / n AS spread FROM s),
x AS (SELECT *, CASE WHEN h > 1 AND spread > 0 AND f > 0 AND f < n THEN (ffn - f * f / n - (h - 1) * mean * (1 - mean)) / spread ELSE 0 END AS between_hosts FROM v),
z AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, {_P.min_weight}::DOUBLE), {_P.max_weight}::DOUBLE) ELSE {_P.max_weight}::DOUBLE END AS weight FROM x),
o AS (SELECT source, n, weight, mean, (f + mean * weight) / (n + weight) AS rate FROM h, z),
q AS (SELECT source, rate, rate - {_P.z}::DOUBLE * sqrt(rate * (1 - rate) / (n + weight + 1)) > least({_P.max_host_rate}::DOUBLE, {_P.max_ratio}::DOUBLE * mean) AS bad FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {columns}
FROM f JOIN q ON f.source IS NOT DISTINCT FROM q.source
"""


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[.]', '')"
_PAGES = f"""SELECT page_id AS doc_id, host AS source, CASE WHEN ('0x' || substr(md5(host), 1, 6))::BIGINT % 7 = 0 THEN repeat('home | news | ', 5) ELSE regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') END AS text FROM (SELECT *, {_HOST} AS host FROM pages)"""
QUERIES = {"op7_host_rules": op7_host_rules, "page_domains": page_domains}
ORACLE = oracle("SELECT doc_id, source, text FROM documents")
ORACLES = {"op7_host_rules": ORACLE, "page_domains": oracle(_PAGES, "round(rate, 9) AS host_rate, bad AS host_rejected, NOT base_failed AND NOT bad AS kept")}
