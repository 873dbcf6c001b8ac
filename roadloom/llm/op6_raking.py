"""Mixing by iterative proportional fitting, with DataFrame functions only.

Token weights of the cells (source, language, topic) are raked until their sums meet the target share of each source,
language and topic. Probabilities are capped at 1 within the fit: capped cells are held and the others raked again,
and where targets need more tokens than there are, the rate gives way. Each document is then sampled with its cell's
probability.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.text import fresh, words_of
from roadloom.plans.staging import drop_staged, staged

DIMS = ("source", "lang", "topic")
#: Rounds in which values' goals are bounded, one aggregate of a dimension's values each.
FILLINGS = 20
#: By topic, what marks a text of it.
MARKS = {"license": ("icense", "opyright", "arrant"), "contact": ("@", "hone:", "Tel."), "table": (" | ", "\t")}
_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class MixPolicy:
    """rate: the share of all tokens to sample, on average, at most. temperature: without a table of targets, a
    value's target is proportional to its tokens to this power, but no more than the share ``bound`` of its tokens,
    so that it can be met at ``rate``; what that takes from rare values goes to the others. targets: by dimension, a table (value, share) whose
    shares are scaled to sum to 1; values without a target get none, and targets of absent values can't be met.
    rounds: of raking. give_way: where the targets can't be met at ``rate``, sample less, so that they are met;
    otherwise values with too few tokens are taken whole as far as the others allow, and fall short. headroom: the
    share of the greatest rate at which each value alone has tokens enough that is tried first. tolerance: the
    greatest relative gap between what is sampled and a target; beyond it a warning is logged, or with ``strict`` an
    error raised. marks: by topic, the strings that mark it. seed: of the draws. broadcast_cells: up to so many cells,
    which the driver counts, they are broadcast to the documents; beyond it the join shuffles."""

    rate: float = 0.8
    temperature: float = 0.7
    bound: float = 0.95
    targets: dict = field(default_factory=dict)
    rounds: int = 8
    seed: int = 42
    broadcast_cells: int = 100_000
    give_way: bool = True
    headroom: float = 0.999
    tolerance: float = 0.01
    strict: bool = False
    marks: dict = field(default_factory=lambda: MARKS)


def topic_of(text: Column, marks: dict = MARKS) -> Column:
    """The topic with the most marks in a text, the first of equals; prose without any."""
    t = F.coalesce(text, F.lit(""))
    count = lambda m: F.floor((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(m), F.lit("")))) / len(m.encode()))
    scores = [F.struct(sum((count(m) for m in ms[1:]), count(ms[0])).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("topic")) for i, (name, ms) in enumerate(marks.items())]
    best = F.greatest(*scores, F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("i"), F.lit("prose").alias("topic")))
    return best["topic"]


def _value(c: Column) -> Column:
    """A non-null key for a value; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def measure(docs: DataFrame, key: str, text: str, source: str, lang: str, topic: str | None = None, tokens: str | None = None, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """Per document: doc_id, source, lang and topic as keys, n_tokens: column ``tokens`` (null: none) or, without
    one, the words of the text (null: none)."""
    t = F.col(f"`{text}`")
    size = F.coalesce(F.col(f"`{tokens}`"), F.lit(0)) if tokens else F.size(words_of(F.coalesce(t, F.lit(""))))
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        _value(F.col(f"`{source}`")).alias("source"),
        _value(F.col(f"`{lang}`")).alias("lang"),
        _value(F.col(f"`{topic}`") if topic else topic_of(t, policy.marks)).alias("topic"),
        size.cast("long").alias("n_tokens"),
    )


def _goal(cells: DataFrame, dim: str, policy: MixPolicy) -> DataFrame:
    """(value, has, goal): of each value, its tokens and its share of the target.

    Targets that aren't named are filled up like water: a value's goal is what it can give, or else its part of what
    those at that bound leave. The bounded ones are the smallest, so every round finds more of them or none.
    """
    has = cells.groupBy(dim).agg(F.sum("w").alias("has"))
    if dim in policy.targets:
        own = policy.targets[dim].select(_value(F.col("value")).alias(dim), F.col("share").cast("double").alias("share"))
        own = has.join(own, dim, "full").select(dim, F.coalesce("has", F.lit(0.0)).alias("has"), F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        own = has.withColumn("share", F.pow("has", F.lit(policy.temperature)))
    own = staged(own, "shares")
    total = own.agg(F.sum("share"), F.sum("has")).first()
    share, all_has = float(total[0] or 1.0), float(total[1] or 0.0)
    if dim in policy.targets or not all_has:
        return own.select(dim, "has", (F.col("share") / F.lit(share)).alias("goal"))
    most, level = F.col("has") * F.lit(max(policy.bound, policy.rate) / (policy.rate * all_has)), 1.0 / share
    for _ in range(FILLINGS):
        full = F.col("share") * F.lit(level) >= most
        held, open_ = own.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).first()
        new = (1.0 - held) / open_ if open_ else level
        if abs(new - level) <= 1e-12 * level:
            break
        level = new
    return own.select(dim, "has", F.least(F.col("share") * F.lit(level), most).alias("goal"))


def rake(cells: DataFrame, goals: dict, rate: float, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """``cells`` (source, lang, topic, w) with ``probability``: min(1, rate * the dimensions' factors), such that the
    tokens sampled of each value come to ``rate`` times its goal, of all tokens.

    Cells at 1 are held while the others are raked. What a value's cells sum to is concave in its factor, so of the
    two lower bounds of the factor sought (no cell capped, or those that are so now) the larger one never passes it,
    and rounds come closer to it from below. Only the dimensions' factors are carried from step to step, as written
    tables: a step joins the cells with them and sums per value, so it shuffles partial sums, and plans stay as long
    in the last round as in the first.
    """
    total = float(cells.agg(F.sum("w")).first()[0] or 0.0)
    factors = {d: staged(goals[d].select(d, F.lit(1.0).alias(f"g_{d}")), "factor") for d in DIMS}
    for _ in range(policy.rounds):
        for d in DIMS:
            rows = cells
            for o in DIMS:
                rows = rows.join(factors[o], o)
            one, two = (F.col(f"g_{o}") for o in DIMS if o != d)
            x = F.lit(rate) * one * two
            full = x * F.col(f"g_{d}") >= 1
            sums = rows.groupBy(d).agg(
                F.max(f"g_{d}").alias("old"), F.sum(F.col("w") * x).alias("all"), F.sum(F.when(full, F.col("w")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("w") * x)).alias("open")
            ).join(goals[d], d)
            goal = F.col("goal") * F.lit(rate * total)
            held = F.when(F.col("open") > 0, (goal - F.col("full")) / F.col("open")).when(goal >= F.col("full") * (1 - 1e-9), F.col("old"))
            new = staged(sums.select(d, F.when(F.col("all") > 0, F.greatest(goal / F.col("all"), held)).otherwise(F.col("old")).alias(f"g_{d}")), "factor")
            drop_staged(factors[d])
            factors[d] = new
    for d in DIMS:
        cells = cells.join(factors[d], d)
    g = [F.col(f"g_{d}") for d in DIMS]
    return cells.select(*DIMS, "w", F.least(F.lit(rate) * g[0] * g[1] * g[2], F.lit(1.0)).alias("probability"))


def calibrate(cells: DataFrame, policy: MixPolicy = MixPolicy()) -> tuple[DataFrame, float]:
    """:func:`rake` at the greatest rate up to the policy's at which the targets are met, and the largest relative gap
    that is left in a marginal.

    With ``give_way`` the rate falls to what every value of every dimension can give; if the gap is still above the
    tolerance there, towards the rate at which no cell is capped, which one more fit tells, and at last to that rate.
    Otherwise the rate stays, and values with too few tokens fall short.
    """
    goals = {d: _goal(cells, d, policy) for d in DIMS}
    total = float(cells.agg(F.sum("w")).first()[0] or 0.0)
    rate = policy.rate
    if policy.give_way and total:
        most = [goals[d].where("goal > 0 and has > 0").agg(F.min(F.col("has") / F.col("goal"))).first()[0] for d in DIMS]
        rate = min([rate, *[policy.headroom * m / total for m in most if m is not None]])

    def tried(rate: float) -> tuple[DataFrame, float, float]:
        out = staged(rake(cells, goals, rate, policy), "probabilities")
        return out, largest_gap(marginals(out, goals)), out.agg(F.max("probability")).first()[0] or 0.0

    out, gap, top = tried(rate)
    if gap <= policy.tolerance or not policy.give_way or top < 1:
        return out, gap
    low = 1e-6 * rate
    open_, open_gap, top = tried(low)
    uncapped = min(rate, low / top) if top else low
    out, gap, _ = tried((rate * uncapped) ** 0.5)
    if gap <= policy.tolerance:
        return out, gap
    return staged(open_.withColumn("probability", F.least(F.col("probability") * (uncapped / low), F.lit(1.0))), "probabilities"), open_gap


def marginals(rows: DataFrame, goals: dict) -> DataFrame:
    """(dimension, value, natural, goal, sampled): of each value, its share of all tokens, its goal, and its share of
    the tokens that the cells' probabilities sample on average."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMS])).alias("x")
    sums = rows.select(each, "w", (F.col("w") * F.col("probability")).alias("kept")).groupBy("x.dimension", "x.value").agg(F.sum("w").alias("w"), F.sum("kept").alias("kept"))
    sums = staged(sums, "marginals")
    total = sums.where(F.col("dimension") == DIMS[0]).agg(F.sum("w").alias("w"), F.sum("kept").alias("kept")).first()
    goal = None
    for d in DIMS:
        part = goals[d].select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "goal")
        goal = part if goal is None else goal.unionByName(part)
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.lit(float(total[c] or 1.0))
    return sums.join(goal, ["dimension", "value"], "full").select("dimension", "value", share("w").alias("natural"), F.coalesce("goal", F.lit(0.0)).alias("goal"), share("kept").alias("sampled"))


def largest_gap(reached: DataFrame) -> float:
    """The largest relative gap between what is sampled and its goal."""
    return reached.where("goal > 0").agg(F.max(F.abs(F.col("sampled") / F.col("goal") - 1))).first()[0] or 0.0


def draw(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from a document's key: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cell_probabilities(measured: DataFrame, policy: MixPolicy = MixPolicy()) -> tuple[DataFrame, float]:
    """(source, lang, topic, probability) of each cell, and the largest relative gap in a marginal of what they
    sample, caps included. A hot source is summed within tasks before the shuffle."""
    cells = staged(measured.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("w")), "cells")
    out, gap = calibrate(cells, policy)
    if gap > policy.tolerance:
        told = f"at the rate of {policy.rate}, a marginal is off its goal by up to {gap:.3f} of it"
        if policy.strict:
            raise ValueError(told)
        _LOG.warning("raking: %s", told)
    return out.drop("w"), gap


def sample_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, tokens: str | None = None, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """Per document: doc_id, n_tokens, topic, probability and sampled, without the text.

    ``topic``: a column of topics; without one, :func:`topic_of`. ``tokens``: a column of token counts; without one,
    words. Null source, language or topic: a value of its own. Null or empty text: no words, the probability of its
    cell. Null key: one draw for all such rows; repeated keys are drawn alike. Texts of any length are counted whole.
    Empty table: no rows. Other columns are dropped, whatever their names.
    """
    rows = staged(measure(docs, key, text, source, lang, topic, tokens, policy), "measures")
    cells, _ = cell_probabilities(rows, policy)
    if cells.count() <= policy.broadcast_cells:
        cells = F.broadcast(cells)
    out = rows.join(cells, [*DIMS])
    return out.select(
        "doc_id", "n_tokens", F.regexp_replace("topic", "^=", "").alias("topic"), "probability", (draw(F.col("doc_id"), policy.seed) < F.col("probability")).alias("sampled")
    )


def sample_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, tokens: str | None = None, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """The rows of ``docs`` that :func:`sample_plan` samples, with all their columns, whatever their names; the texts
    stay where they are while cells are raked. Nulls, empty texts, repeated rows and empty tables are as there."""
    cells, _ = cell_probabilities(measure(docs, key, text, source, lang, topic, tokens, policy), policy)
    *names, p = fresh(docs, *DIMS, "probability")
    side = cells.select(*[F.col(d).alias(n) for d, n in zip(DIMS, names, strict=True)], F.col("probability").alias(p))
    if cells.count() <= policy.broadcast_cells:
        side = F.broadcast(side)
    t = F.col(f"`{text}`")
    own = (_value(F.col(f"`{source}`")), _value(F.col(f"`{lang}`")), _value(F.col(f"`{topic}`") if topic else topic_of(t, policy.marks)))
    on = (own[0] == side[names[0]]) & (own[1] == side[names[1]]) & (own[2] == side[names[2]])
    return docs.join(side, on).where(draw(F.col(f"`{key}`"), policy.seed) < F.col(p)).drop(*names, p)


def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sample_plan(docs).withColumn("probability", F.round("probability", 9))


def oracle(p: MixPolicy = MixPolicy()) -> str:
    """The same fit in SQL, at the first rate that is tried."""
    count = lambda m: f"(strlen(t) - strlen(replace(t, '{m}', ''))) // {len(m.encode())}".replace("\t", "' || chr(9) || '")
    scores = [" + ".join(count(m) for m in ms) for ms in p.marks.values()]
    names = list(p.marks)
    topic = "CASE " + " ".join(f"WHEN s{i} > 0 AND s{i} = greatest({', '.join(f's{j}' for j in range(len(names)))}) THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'prose' END"
    steps = [
        f"""t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
k AS (SELECT *, {", ".join(f"{s} AS s{i}" for i, s in enumerate(scores))} FROM t),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang, '=' || {topic} AS topic,
  len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM k)""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL)",
    ]
    by = lambda of: " ".join(f"JOIN f_{d}_{of[d]} {n} USING ({d})" for d, n in zip(DIMS, "xyz", strict=True))
    for x in DIMS:
        steps.append(f"h_{x} AS MATERIALIZED (SELECT *, pow(has, {p.temperature}) AS share, has * {max(p.bound, p.rate)}::DOUBLE / ({p.rate}::DOUBLE * sum(has) OVER ()) AS most FROM (SELECT {x}, sum(w) AS has FROM c GROUP BY {x}))")
        steps.append(f"l_{x}_0 AS MATERIALIZED (SELECT 1 / sum(share) AS v FROM h_{x})")
        for i in range(FILLINGS):
            full = f"share * (SELECT v FROM l_{x}_{i}) >= most"
            steps.append(f"l_{x}_{i + 1} AS MATERIALIZED (SELECT coalesce((1 - coalesce(sum(most) FILTER ({full}), 0)) / sum(share) FILTER (NOT ({full})), (SELECT v FROM l_{x}_{i})) AS v FROM h_{x})")
        steps.append(f"g_{x} AS MATERIALIZED (SELECT {x}, has, least(share * (SELECT v FROM l_{x}_{FILLINGS}), most) AS goal FROM h_{x})")
        steps.append(f"f_{x}_0 AS MATERIALIZED (SELECT {x}, 1.0::DOUBLE AS f FROM g_{x})")
    least = ", ".join(f"(SELECT {p.headroom}::DOUBLE * min(has / goal) FROM g_{x} WHERE goal > 0) / sum(w)" for x in DIMS)
    steps.append(f"s AS MATERIALIZED (SELECT least({p.rate}::DOUBLE, {least}) AS rate, sum(w) AS total FROM c)")
    at = dict.fromkeys(DIMS, 0)
    for _ in range(p.rounds):
        for n, x in zip("xyz", DIMS, strict=True):
            one, two = (f"{m}.f" for m in "xyz" if m != n)
            steps.append(
                f"f_{x}_{at[x] + 1} AS MATERIALIZED (SELECT {x}, CASE WHEN al > 0 THEN greatest(goal * scale / al, CASE WHEN op > 0 THEN (goal * scale - fu) / op WHEN goal * scale >= fu * (1 - 1e-9) THEN old END) ELSE old END AS f FROM "
                f"(SELECT {x}, any_value(scale) AS scale, max(old) AS old, sum(w * v) AS al, sum(CASE WHEN v * old >= 1 THEN w ELSE 0 END) AS fu, sum(CASE WHEN v * old >= 1 THEN 0 ELSE w * v END) AS op FROM "
                f"(SELECT c.{x}, w, rate * total AS scale, {n}.f AS old, rate * {one} * {two} AS v FROM c {by(at)}, s) GROUP BY {x}) JOIN g_{x} USING ({x}))"
            )
            at[x] += 1
    steps.append(f"q AS (SELECT source, lang, topic, least(rate * x.f * y.f * z.f, 1.0) AS p FROM c {by(at)}, s)")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, n_tokens, substr(topic, 2) AS topic, round(p, 9) AS probability, "
        f"('0x' || substr(md5(doc_id::VARCHAR || ':{p.seed}'), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r} < p AS sampled FROM d JOIN q USING (source, lang, topic)"
    )


QUERIES = {"op6_raking": op6_raking}
ORACLES = {"op6_raking": oracle()}
