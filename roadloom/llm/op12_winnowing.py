"""Benchmark decontamination by winnowing.

Of each window of words, the fingerprint is the smallest hash of its shorter runs of words (k-grams), the last of
equals. It depends on the window's words alone, so a window that a document shares with an item has the same
fingerprint in both: joining the few fingerprints misses no shared span of a window's length. What meets is extended
to whole windows, whose words are compared, and neighbouring windows make up longer spans.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns, bound_batches
from roadloom.llm.text import fresh, lower_ascii
from roadloom.plans.staging import staged

#: Bytes of text whose words are found and hashed at once.
BLOCK = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
WORDS = "[0-9a-z\\x80-\\x{10FFFF}]+"


@dataclass(frozen=True)
class WinnowPolicy:
    """words: of a window; an item of fewer is one window. gram: words of a fingerprint's run. broadcast_windows: up
    to so many (window, item) pairs, which the driver counts, the tasks hold the index; beyond it fingerprints are
    joined by shuffle."""

    words: int = 10
    gram: int = 7
    broadcast_windows: int = 300_000


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word in bytes: polynomials of the lower-cased bytes, from running sums by blocks
    that are cut between words."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and _LETTER[raw[end]]:
            more = ~_LETTER[raw[end : end + BLOCK]]
            end += int(more.argmax()) if more.any() else len(more)
        part = raw[at:end]
        edge = np.flatnonzero(np.diff(_LETTER[part].view(np.int8), prepend=0, append=0))
        a, b = edge[::2], edge[1::2]
        room = 1 << max(len(part), BLOCK).bit_length()
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), room)[: len(part)], out=sums[1:])
        h = (sums[b] - sums[a]) * _powers(pow(int(_BASE), -1, 1 << 64), room)[a]
        starts.append(a + at)
        ends.append(b + at)
        hashes.append(_mixed(h + (b - a).astype(np.uint64)))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + words[j : j + n]
    return _mixed(out)


def fingerprints(words: np.ndarray, policy: WinnowPolicy) -> tuple[np.ndarray, np.ndarray]:
    """For each full window: the place of its fingerprint, and for each place the run's hash."""
    grams = gram_hashes(words, policy.gram)
    n, reach = max(0, len(words) - policy.words + 1), policy.words - policy.gram + 1
    place, least = np.arange(n), grams[:n].copy()
    for j in range(1, reach):
        later = grams[j : j + n]
        new = later <= least
        place[new] = np.flatnonzero(new) + j
        least[new] = later[new]
    return place, grams


def item_windows(text: str | None, policy: WinnowPolicy) -> list[tuple[bytes, int, int, int]]:
    """(words joined by spaces, their number, fingerprint, hash) of each different window of an item."""
    data = (text or "").encode()
    a, b, words = word_hashes(np.frombuffer(data, np.uint8))
    low = data.lower()
    size = min(policy.words, len(a))
    if not size:
        return []
    if size < policy.words:
        prints = whole = gram_hashes(words, size)
    else:
        place, grams = fingerprints(words, policy)
        prints, whole = grams[place], gram_hashes(words, size)
    said = [low[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    found = {b" ".join(said[i : i + size]): (size, int(f), int(h)) for i, (f, h) in enumerate(zip(prints, whole, strict=True))}
    return [(w, *x) for w, x in found.items()]


def index(items: DataFrame, key: str = "item_id", text: str = "text", policy: WinnowPolicy = WinnowPolicy()) -> DataFrame:
    """(item, window, size, print, hash): the different windows of each item (its key as a string) and their
    fingerprints and hashes.

    Null text or one without words: no windows. Null key: its windows are there, under a null item. Rows that repeat
    a key are one item of all their windows. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    bound_batches(items.sparkSession)
    slim = items.select(F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    names = ["item", "window", "size", "print", "hash"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = item_windows(t, policy)
                for at in range(0, len(got), 10_000):
                    part = got[at : at + 10_000]
                    signed = [np.array([x[j] for x in part], np.uint64).view(np.int64) for j in (2, 3)]
                    cols = [[item] * len(part), [x[0].decode() for x in part], [x[1] for x in part], *signed]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return slim.mapInArrow(run, "item string, window string, size int, print long, hash long").distinct()


class _Index:
    """What tasks hold of the windows: fingerprints by size, and words and items by window."""

    def __init__(self, rows: pa.Table) -> None:
        self.windows: dict[int, list[tuple[bytes, int, set]]] = {}
        prints: dict[int, set[int]] = {}
        items: dict[str, set] = {}
        for item, window, size, p, h in zip(*(rows.column(c).to_pylist() for c in ("item", "window", "size", "print", "hash")), strict=True):
            prints.setdefault(size, set()).add(p % (1 << 64))
            if window not in items:
                self.windows.setdefault(h % (1 << 64), []).append((window.encode(), size, items.setdefault(window, set())))
            items[window] |= {item} - {None}
        self.prints = {s: np.array(sorted(x), np.uint64) for s, x in prints.items()}


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == values)


def _met(words: np.ndarray, text_of: np.ndarray, size: int, prints: np.ndarray, policy: WinnowPolicy) -> np.ndarray:
    """Where windows of ``size`` words, within one text, begin whose fingerprint is among ``prints``."""
    n = max(0, len(words) - size + 1)
    if size < policy.words:
        hit = _among(gram_hashes(words, size), prints)
    else:
        place, grams = fingerprints(words, policy)
        chosen = np.zeros(len(grams), bool)
        chosen[place] = True
        chosen[chosen] = _among(grams[chosen], prints)
        hit = chosen[place]
    return np.flatnonzero(hit & (text_of[:n] == text_of[len(words) - n :]))


def _texts(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in groups of about :data:`BLOCK` bytes, a longer one alone, with the place of the first."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode()
        if group and size + len(data) > BLOCK:
            yield first, group
            first, group, size = i, [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield first, group


def _words_of(group: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts in lower case, start, end and hash of each word, and its text."""
    joined = b"\n".join(group)
    a, b, words = word_hashes(np.frombuffer(joined, np.uint8))
    text_of = np.searchsorted(np.cumsum([len(g) + 1 for g in group]), a, "right")
    return joined.lower(), a, b, words, text_of


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())]


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _hits(texts: list, known: _Index, policy: WinnowPolicy) -> list[pa.Array]:
    """The columns :data:`_FIELDS` of the texts."""
    n_words, n_hit, items = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [set() for _ in texts]
    for first, group in _texts(texts):
        low, a, b, words, text_of = _words_of(group)
        n_words[first : first + len(group)] = np.bincount(text_of, minlength=len(group))
        edge = np.zeros(len(words) + 1, np.int64)
        for size, prints in known.prints.items():
            starts = _met(words, text_of, size, prints, policy)
            if not len(starts):
                continue
            hashes = gram_hashes(words, size)[starts]
            for i, h in zip(starts.tolist(), hashes.tolist(), strict=True):
                for window, wide, held in known.windows.get(h, ()):
                    if wide == size and b" ".join([low[x:y] for x, y in zip(a[i : i + size].tolist(), b[i : i + size].tolist(), strict=True)]) == window:
                        edge[i] += 1
                        edge[i + size] -= 1
                        items[first + text_of[i]] |= held
        n_hit[first : first + len(group)] += np.bincount(text_of[np.cumsum(edge[:-1]) > 0], minlength=len(group))
    empty = _digest(set())
    return [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) if x else empty for x in items], pa.string())]


def _by_join(docs: DataFrame, text: str, known: DataFrame, policy: WinnowPolicy) -> DataFrame:
    """(digest, n_words, n_hit, n_items, items_sha256) of each different text, by joins alone: fingerprints with the
    index, then the windows that have those that met, by their words."""
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # at most the words of a window
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = staged(docs.select(F.sha2(body, 256).alias("digest"), body.alias("body")).dropDuplicates(["digest"]), "texts")

    def emit(df: DataFrame, column: str, schema: str, make) -> DataFrame:
        bound_batches(df.sparkSession)
        at = df.columns.index(column)

        def run(batches):
            for batch in batches:
                for keys, rows in make(batch.column(0).to_pylist(), batch.column(at).to_pylist()):
                    for k in range(0, len(keys), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 10_000], pa.string())] + [c[k : k + 10_000] for c in rows], names=[f.split()[0] for f in schema.split(", ")])

        return df.mapInArrow(run, schema)

    def prints(digests: list, bodies: list):
        for first, group in _texts(bodies):
            *_, words, text_of = _words_of(group)
            for size in sizes:
                n = max(0, len(words) - size + 1)
                whole = text_of[:n] == text_of[len(words) - n :]
                if size < policy.words:
                    at, grams = np.flatnonzero(whole), gram_hashes(words, size)
                else:
                    place, grams = fingerprints(words, policy)
                    at = np.unique(place[whole])
                if len(at):
                    yield [digests[first + d] for d in text_of[at].tolist()], [pa.array(np.full(len(at), size, np.int32)), pa.array(grams[at].view(np.int64))]

    found = emit(texts, "body", "digest string, size int, print long", prints).distinct()
    found = staged(found.join(known.select("size", "print").distinct(), ["size", "print"], "left_semi"), "met")
    # A text's own fingerprints that met are no more than its words.
    lists = found.groupBy("digest").agg(F.collect_list(F.struct("size", "print")).alias("met"))
    packed = texts.join(lists, "digest").select("digest", F.struct("body", "met").alias("x"))

    def windows(digests: list, rows: list):
        for digest, row in zip(digests, rows, strict=True):
            low, a, b, words, text_of = _words_of([row["body"].encode()])
            for size in sizes:
                own = np.array(sorted(x["print"] % (1 << 64) for x in row["met"] if x["size"] == size), np.uint64)
                starts = _met(words, text_of, size, own, policy) if len(own) else []
                for part in range(0, len(starts), 10_000):
                    at = starts[part : part + 10_000].tolist()
                    said = [b" ".join([low[x:y] for x, y in zip(a[i : i + size].tolist(), b[i : i + size].tolist(), strict=True)]).decode() for i in at]
                    yield [digest] * len(at), [pa.array(at, pa.int64()), pa.array(np.full(len(at), size, np.int32)), pa.array(said, pa.string())]

    seen = emit(packed, "x", "digest string, start long, size int, window string", windows)
    ids = known.select("size", "window").distinct().withColumn("of", F.sha2(F.concat_ws(":", "size", "window"), 256))
    seen = staged(seen.join(ids, ["size", "window"]).select("digest", "start", "size", "of"), "seen")
    spans = seen.groupBy("digest", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    spans = spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))
    spans = spans.select("digest", F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda acc: acc["n"]).alias("n_hit"))
    members = known.where("item is not null").select(F.sha2(F.concat_ws(":", "size", "window"), 256).alias("of"), "item")
    named = seen.select("digest", "of").distinct().join(members, "of").select("digest", "item").distinct()
    named = named.groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    n_words = F.size(F.regexp_extract_all(lower_ascii(F.col("body")), F.lit(WORDS), F.lit(0))).cast("long")
    out = texts.select("digest", n_words.alias("n_words")).join(spans, "digest", "left").join(named, "digest", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("digest", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", policy: WinnowPolicy = WinnowPolicy()) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items_sha256 and contaminated; columns so named are replaced, all
    others stay, whatever their names.

    A word is hit within any occurrence of a window of an item. n_items counts the items with such windows, and
    items_sha256 digests their keys as strings, sorted, joined by commas. Null or empty text: no words, so no hits.
    Repeated rows are judged alike. Items with a null key hit words but aren't counted or named; null items have no
    windows. Texts of any length are read whole, a block at a time, and cost follows their length, whatever repeats
    in them. Empty tables: no rows, or no hits.
    """
    if not 1 <= policy.gram <= policy.words:
        raise ValueError("a fingerprint's run must fit in a window")
    known = staged(index(items, item_key, item_text, policy), "windows")
    new = {f.name for f in _FIELDS} | {"contaminated"}
    if text.lower() in new:
        raise ValueError(f"the column {text} would be replaced")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    if known.count() <= policy.broadcast_windows:
        shared = docs.sparkSession.sparkContext.broadcast(_Index(known.toArrow()))
        out = add_columns(docs, text, _FIELDS, lambda texts: _hits(texts, shared.value, policy))
    else:
        [d] = fresh(docs, "_digest")
        side = staged(_by_join(docs, text, known, policy).withColumnRenamed("digest", d), "judged")
        out = docs.join(side, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256) == F.col(d)).drop(d)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs.select("doc_id", "text"), items).drop("text")


def oracle(p: WinnowPolicy = WinnowPolicy()) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, w, least(len(w), {p.words}) AS m FROM (SELECT item_id, {words("text")} AS w FROM benchmark) WHERE len(w) > 0),
j AS MATERIALIZED (SELECT DISTINCT item, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
q AS (SELECT r, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM j))),
h AS MATERIALIZED (SELECT r, s, m, item FROM q JOIN j USING (m, g)),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


QUERIES = {"op12_winnowing": op12_winnowing}
ORACLES = {"op12_winnowing": oracle()}
