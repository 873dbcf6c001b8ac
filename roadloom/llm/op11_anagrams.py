"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' values, powers of their code points. Two words that differ by one added,
removed or exchanged letter have keys that differ by that letter's value, or by the difference of two. So each word is
entered under its own key and under its key less each of its different letters: an addition meets the longer word's
lessened key at the shorter one's own, an exchange meets at a key that both have lessened to. What meets has the right
letters, and their order is verified then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.text import lower_ascii
from roadloom.plans.staging import drop_staged, staged, staged_with

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
_KEY = "decimal(38,0)"


@dataclass(frozen=True)
class SpellingPolicy:
    """min_letters, min_count: which words are compared. ratio: a word's form occurs at least so many times as often.
    drop_every: of the runs in texts, those whose digest this divides lose a letter, as misspellings for the query;
    0: none do. max_steps: of doubling the paths along forms; paths are no longer than the logarithm of the counts."""

    min_letters: int = 5
    min_count: int = 3
    ratio: int = 2
    drop_every: int = 97
    max_steps: int = 8


def letter_value(letter: Column) -> Column:
    """The fourth power of a letter's code point: a sum of up to 2^31 of them fits the key."""
    square = (F.ascii(letter).cast("long") * F.ascii(letter)).cast("decimal(13,0)")
    return (square * square).cast(_KEY)


def letters_of(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: x != "")


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast(_KEY), lambda a, x: (a + letter_value(x)).cast(_KEY))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", policy: SpellingPolicy = SpellingPolicy()) -> DataFrame:
    """(word, n) of the runs of Latin letters, A-Z lower-cased, that are long and frequent enough.

    Of a run whose CRC-32 with its document's key is a multiple of ``policy.drop_every``, one letter goes, the one at
    that digest modulo the length. Null text: no runs. Null key: digested as if it were empty. Repeated rows count
    each. Runs are counted within tasks before the shuffle, so a frequent one costs no more than another. Texts and
    runs of any length are read whole. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(lower_ascii(F.col(f"`{text}`")), F.lit(RUNS), F.lit(0))).alias("run"))
    rows = rows.where(F.length("run") >= policy.min_letters)
    word = F.col("run")
    if policy.drop_every:
        rows = rows.select("run", F.crc32(F.concat_ws(":", "k", "run").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % policy.drop_every == 0, short).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.length("word") >= policy.min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= policy.min_count)


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) of each pair of ``words`` (word, n; distinct) that differ by exactly one inserted, deleted or
    replaced code point, once.

    A word has an entry for itself and one for each of its different letters, at most the alphabet however long it
    is. Entries meet by key and length in one sort-merge join; a key that many words share is a hot key, which adaptive
    execution splits. Null words have no entries. Empty table: no rows.
    """
    rows = words.where("word is not null").select("word", "n", letters_of(F.col("word")).alias("l")).select("word", "n", "l", anagram_key(F.col("l")).alias("key"))
    whole = F.array(F.struct(F.col("key").alias("key"), F.size("l").alias("len"), F.lit("").alias("gone")))
    less = F.transform(F.array_distinct("l"), lambda x: F.struct((F.col("key") - letter_value(x)).cast(_KEY).alias("key"), (F.size("l") - 1).alias("len"), x.alias("gone")))
    entries = staged(rows.select("word", "n", F.explode(F.concat(whole, less)).alias("e")).select("e.*", "word", "n"), "entries")
    a, b = entries.alias("a"), entries.alias("b")
    added = (F.col("a.gone") == "") & (F.col("b.gone") != "")
    exchanged = (F.col("a.gone") != "") & (F.col("b.gone") != "") & (F.col("a.gone") != F.col("b.gone")) & (F.col("a.word") < F.col("b.word"))
    ordered = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.len") == F.col("b.len")) & (added | exchanged) & ordered)
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def spelling_forms(words: DataFrame, policy: SpellingPolicy = SpellingPolicy()) -> DataFrame:
    """Per word of ``words`` (word, n; distinct): word, form, root, n, n_near, form_n.

    form: the near word of the largest n, the first in code-point order of equals, if it occurs ``policy.ratio`` times
    as often or more; else null. root: where forms lead at last; the word itself without any. With a ratio of 2 or
    more a path at least doubles its count with every step, so it ends and is short; steps double it in each round.
    Null words: no near words. Empty table: no rows.
    """
    if policy.ratio < 2:
        raise ValueError("a ratio below 2 would let forms lead in circles")
    words = staged(words.select("word", "n"), "words")
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("nb").alias("no")), F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("na").alias("no")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("no")).alias("less"), F.col("o").alias("o"))).alias("best"))
    good = -F.col("best.less") >= policy.ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.o")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")
    )
    rows = staged(rows, "forms")
    paths = rows.where("form is not null").select("word", F.col("form").alias("root"))
    paths, seen = staged_with(paths, "paths", moved=F.count("*"))
    for _ in range(policy.max_steps):
        if not seen["moved"]:
            break
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new, seen = staged_with(paths.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "paths", moved=F.count("further"))
        drop_staged(paths)
        paths = new
    else:
        if seen["moved"]:
            raise RuntimeError(f"paths along forms did not end in {policy.max_steps} doublings")
    out = rows.join(paths.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", policy: SpellingPolicy = SpellingPolicy()) -> DataFrame:
    """:func:`spelling_forms` of the words of ``docs`` as :func:`count_words` counts them, where nulls, empty and long
    texts, repeated rows and empty tables are told."""
    return spelling_forms(count_words(docs, key, text, policy), policy)


def op11_anagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(p: SpellingPolicy = SpellingPolicy()) -> str:
    """The same in SQL: CRC-32 by a table of bytes, near words by strings with one letter deleted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE k AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN {0xEDB88320} ELSE 0 END)) AS c FROM range(256) r(i))),
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= {p.min_letters} GROUP BY ALL),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM c),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, (k.k)[(xor(a, x) & 255) + 1]))) AS h FROM b, k),
g AS (SELECT CASE WHEN h % {p.drop_every} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM g WHERE length(word) >= {p.min_letters} GROUP BY word HAVING sum(n) >= {p.min_count}),
x AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
l AS (SELECT DISTINCT a.word AS a, a.n AS na, x.word AS b, x.n AS nb FROM x JOIN w a ON a.word = x.less),
e AS (SELECT a, na, b, nb FROM l UNION ALL SELECT b, nb, a, na FROM l UNION ALL SELECT DISTINCT p.word, p.n, q.word, q.n FROM x p JOIN x q ON p.less = q.less AND p.i = q.i AND p.word <> q.word),
f AS MATERIALIZED (SELECT a AS word, n_near, CASE WHEN nb >= {p.ratio} * na THEN b END AS form, CASE WHEN nb >= {p.ratio} * na THEN nb END AS form_n
  FROM (SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY nb DESC, b) AS r FROM e) WHERE r = 1),
s AS (SELECT word, word AS root, 0 AS d FROM w UNION ALL SELECT s.word, f.form, d + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT w.word, f.form, s.root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n
FROM w LEFT JOIN f USING (word) JOIN (SELECT word, arg_max(root, d) AS root FROM s GROUP BY word) s USING (word)
"""


QUERIES = {"op11_anagrams": op11_anagrams}
ORACLES = {"op11_anagrams": oracle()}
