from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadloom.llm import op4_secret_links as sec
from roadloom.llm import op6_raking as mix
from roadloom.llm import op7_host_rules as host
from roadloom.llm import op8_simhash as sim
from roadloom.llm import op9_hilbert as hil
from roadloom.operators import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd, none):
    texts = ["a b c a b c", "a a a a", "x\ny\nx\n \n \nx ", "one two", "p\x0bq\x0cr s\ttab", "a b c d a b c d a b", "#|x *y"]
    df = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("N_WORDS", F.lit("clash"))
    for r in host.with_measures(df).collect():
        assert tuple(r[c] for c in host.DIGEST) == measures(r["text"]), r["text"][:50]
    assert host.host_quality(none).count() == 0 and host.keep_quality(none).count() == 0


def test_prior():
    a, b = host.beta_prior(10, 1000, 100, 100_000.0, 10.0)
    assert a / (a + b) == pytest.approx(0.1) and a + b == pytest.approx(1000)  # equal rates: the prior is firm
    a, b = host.beta_prior(2, 200, 100, 20_000.0, 100.0)
    assert a / (a + b) == pytest.approx(0.5) and a + b == 1.0  # rates 0 and 1: hosts speak for themselves
    assert host.beta_prior(0, 0, 0, 0.0, 0.0) == (1.0, 1.0)


def prose(i, n=80):
    return " ".join(f"w{i}x{j}" for j in range(n))


def symbols(i):
    return prose(i, 60) + " #" * 40


def host_rows():
    """Good hosts, one with a single failure and one bad host, half of whose texts pass the base rule and all of which
    fail another; null is a host of its own."""
    rows = [(h * 100 + i, prose(h * 100 + i) if i else "too short", f"good{h}") for h in range(12) for i in range(40)]
    rows += [(5000 + i, symbols(i) if i % 2 else "too short", "bad") for i in range(40)]
    return rows + [(6000, prose(1), None), (6000, prose(1), None), (6001, "short", "tiny"), (6002, prose(3), "tiny"), (6003, None, None)]


def judged(rows, p):
    """The documents kept, by plain Python."""
    m = [measures(t) for _, t, _ in rows]
    base = [n < p.min_words or 100 * rep > p.max_repeat_percent * n for n, _, _, _, rep in m]
    failed = [b or sym > p.max_symbols_per_word * n or dup > p.max_dup_lines_per_word * n or not p.min_word_chars * n <= chars <= p.max_word_chars * n for b, (n, chars, sym, dup, _) in zip(base, m, strict=True)]
    n, f = Counter(h for *_, h in rows), Counter(h for (*_, h), x in zip(rows, failed, strict=True) if x)
    a, b = host.beta_prior(len(n), len(rows), sum(f.values()), sum(x * x for x in n.values()), sum(f[s] ** 2 / n[s] for s in n), p)
    bad = set()
    for h in n:
        rate = (f[h] + a) / (n[h] + a + b)
        if rate - p.z * (rate * (1 - rate) / (n[h] + a + b + 1)) ** 0.5 > min(p.max_host_rate, p.max_ratio * a / (a + b)):
            bad.add(h)
    return [not x and h not in bad for x, (*_, h) in zip(base, rows, strict=True)], bad


def test_host_verdicts(spark, odd, none):
    rows = host_rows()
    keep, bad = judged(rows, host.HostPolicy())
    assert bad == {"bad"}
    want = sorted(k for (k, _, _), x in zip(rows, keep, strict=True) if x)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(-1) for c in ("n_words", "kept", "failed", "host", "row", "c0", "host_rate")})
    for policy in (host.HostPolicy(), host.HostPolicy(broadcast_hosts=-1)):
        got = host.host_quality(df, policy=policy)
        assert sorted(r["doc_id"] for r in got.where("kept").collect()) == want
        assert {r["host"] for r in got.where("host_rejected").collect()} == bad and got.select("prior_a", "prior_b").distinct().count() == 1
        out = host.keep_quality(df, policy=policy)
        assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == want
        assert {r["n_words"] for r in out.collect()} == {-1}
    assert host.keep_quality(odd).count() == host.host_quality(odd).where("kept").count() == 0
    assert host.keep_quality(none).columns == none.columns


def test_host_verdicts_equal_sql(spark, tmp_path):
    from compare import rows_of, rows_of_sql
    import duckdb

    spark.createDataFrame(host_rows(), "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = host.op7_host_rules(spark, f"file://{tmp_path}")
    got = rows_of(df)
    assert got == rows_of_sql(con, host.ORACLE, df.columns)
    assert any(not r[df.columns.index("kept")] for r in df.where("not base_failed").collect())


def test_pages_of_bad_domains_go(spark):
    rows = host.page_domains(spark, "/root/testdata/sf0.01").collect()
    assert {r["host_rejected"] for r in rows} == {True, False}
    assert all(r["kept"] == (not r["base_failed"] and not r["host_rejected"]) for r in rows) and any(r["kept"] for r in rows)


def test_domain(spark):
    urls = spark.createDataFrame([("https://WWW.Example.com/a?b",), ("http://x.example.com:80/",), ("no url",), (None,)], "u string")
    assert [r[0] for r in urls.select(host.domain_of(F.col("u"))).collect()] == ["example.com", "x.example.com", None, None]


def simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, limit=4):
    values = sorted(set(prints))
    near = {v: {u for u in values if bin(u ^ v).count("1") <= limit} for v in values}
    label = {}
    for v in values:
        if v not in label:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = v
                    todo += near[x]
    return label


def test_fingerprints():
    for t in [None, "", " \n", "One", "a B c", "a b c d", "a b c d e", "É x É x É", "w " * 70_000, "x\x0by\x0cz q r"]:
        assert sim.fingerprint(t) == simhash(t)


def test_links_of_all_kinds(spark):
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(60):
        v = int(rng.integers(0, 1 << 63)) * 2
        values.add(v)
        for n in rng.integers(1, 7, 4):
            values.add(v ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    # A dense group: all that differ from one value in up to two of twelve bits.
    values |= {12345 ^ (1 << a) ^ (1 << b) for a, b in itertools.product(range(40, 52), repeat=2)} | {12345}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    got = {r["b"] % (1 << 64): r["group"] for r in sim.link_groups(spark.createDataFrame([(v,) for v in signed], "b long")).collect()}
    want = groups(values)
    assert len(set(zip(got.values(), (want[v] for v in got), strict=True))) == len(set(want.values())) == len(set(got.values()))
    for n in (2, 3, 4, 5):
        assert sum(r + 1 for _, _, r in sim.segment_plan(4, n)) > 4
    assert [sim.segments_for(n, 4) for n in (0, 10**6, 10**8, 10**10)] == [3, 3, 3, 2]
    with pytest.raises(ValueError):
        sim.segment_plan(4, 1)


def test_two_segments_miss_nothing(spark):
    rng = np.random.default_rng(8)
    values = set()
    for _ in range(150):
        v = int(rng.integers(0, 1 << 63))
        values |= {v, v ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(3, 6)), replace=False))}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    got = {r["b"] % (1 << 64): r["group"] for r in sim.link_groups(spark.createDataFrame([(v,) for v in signed], "b long"), segments=2).collect()}
    want = groups(values)
    assert len(set(zip(got.values(), (want[v] for v in got), strict=True))) == len(set(want.values())) == len(set(got.values()))


def plans_of(monkeypatch, *modules):
    """The physical plans of all tables that the modules stage from now on."""
    plans = []
    for m in modules:
        for name in ("staged", "staged_with"):
            if hasattr(m, name):
                def stage(df, *a, f=getattr(m, name), **b):
                    plans.append(df._jdf.queryExecution().executedPlan().toString())
                    return f(df, *a, **b)

                monkeypatch.setattr(m, name, stage)
    return plans


def test_exploded_fingerprints_are_not_broadcast(spark, odd, monkeypatch):
    """Spark takes the keys of a fingerprint's balls for as few as fingerprints, far below what it broadcasts."""
    monkeypatch.setattr(components, "MOST_BROADCAST", 0)
    plans = plans_of(monkeypatch, sim, components)
    bits = spark.range(2000).select((F.col("id") * 7919).alias("b"))
    last = sim.link_groups(bits)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    rows = sim.simhash_groups(odd)
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 8
    assert not any("BroadcastExchange" in p for p in plans)


def test_keys_beyond_the_limit_are_not_broadcast(spark, odd, monkeypatch):
    plans = plans_of(monkeypatch, sim)
    for limit, n in ((-1, 0), (1_000_000, 2)):
        plans[:] = []
        rows = sim.keep_one(odd, broadcast_keys=limit)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        assert sum(p.count("BroadcastExchange") for p in plans) == n


def test_simhash_rows(spark, odd, none):
    rows = sim.simhash_groups(odd.withColumn("component_id", F.lit("x"))).collect()
    prints = [simhash(r["text"]) for r in odd.collect()]
    label = groups(prints)
    low = {}
    for r, p in zip(odd.collect(), prints, strict=True):
        if r["doc_id"] is not None:
            low[label[p]] = min(low.get(label[p], 1 << 60), r["doc_id"])
    want = sorted(((r["doc_id"], f"{p:016x}", low.get(label[p])) for r, p in zip(odd.collect(), prints, strict=True)), key=repr)
    assert sorted((tuple(r) for r in rows), key=repr) == want
    clash = odd.withColumns({c: F.lit(1) for c in ("_key", "b", "row", "c0", "component_id")})
    for n in (1_000_000, -1):
        kept = sim.keep_one(clash, broadcast_keys=n)
        assert kept.columns == clash.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 4, 5, 6, 7, None]
    assert sim.keep_one(none).columns == none.columns and sim.keep_one(none).count() == 0


def test_repeated_keys_keep_their_own_text(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    # Key 5 stands for its own group with text one; with text two it belongs to the group of key 3.
    rows = [(5, one, "b"), (5, one, "a"), (5, two, "c"), (3, two, "d"), (9, one, "e"), (7, three, "f")]
    for order in (rows, rows[::-1]):
        kept = sim.keep_one(spark.createDataFrame(order, "doc_id long, text string, tag string").repartition(3))
        got = sorted((r["doc_id"], r["text"], r["tag"]) for r in kept.collect())
        assert [g[:2] for g in got] == [(3, two), (5, one), (7, three)]
        assert order is rows or got == first  # noqa: F821
        first = got


CELLS = "source string, lang string, topic string, n_tokens double"


def sampled_shares(rows, prob):
    p = {tuple(r[d] for d in mix.DIMS): r["probability"] for r in prob.collect()}
    assert all(0 <= x <= 1 for x in p.values())
    kept, total = Counter(), sum(w * p[tuple(c)] for *c, w in rows)
    for *c, w in rows:
        kept.update({(d, v): w * p[tuple(c)] / total for d, v in zip(mix.DIMS, c, strict=True)})
    return kept, total / sum(r[3] for r in rows), max(p.values())


def test_raking_meets_given_targets(spark):
    rng = np.random.default_rng(1)
    rows = [("=" + s, "=" + la, "=" + t, float(rng.integers(1, 100))) for s in "abc" for la in "xy" for t in "pq"]
    rows[0] = (*rows[0][:3], 5000.0)  # one cell holds most tokens
    share = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "value string, share double")
    prob, gap = mix.cell_probabilities(spark.createDataFrame(rows, CELLS), mix.MixPolicy(targets={"source": share}, rounds=12))
    kept, rate, _ = sampled_shares(rows, prob)
    assert [kept["source", "=" + s] for s in "abc"] == pytest.approx([0.25, 0.5, 0.25], rel=0.01) and gap <= 0.01 and rate < 0.8


def plain_goals(has, p=mix.MixPolicy()):
    """Shares by the policy's temperature, none above what the value can give; the others share the rest."""
    total, full = sum(has.values()), set()
    most = {v: x * p.bound / (p.rate * total) for v, x in has.items()}
    while True:
        level = (1 - sum(most[v] for v in full)) / sum(x**p.temperature for v, x in has.items() if v not in full)
        new = {v for v, x in has.items() if x**p.temperature * level >= most[v]}
        if new <= full:
            return {v: most[v] if v in full else x**p.temperature * level for v, x in has.items()}
        full |= new


def test_sampling_keeps_the_targets(spark):
    rng = np.random.default_rng(34)
    rows = [("=" + s, "=" + la, "=" + t, float(rng.integers(1, 100)) ** 2) for s in "abc" for la in "xy" for t in "pq"]
    cells = spark.createDataFrame(rows, CELLS)
    found = {}
    for name, policy in {
        "low": mix.MixPolicy(rate=0.3), "bounded": mix.MixPolicy(), "gives way": mix.MixPolicy(bound=1e9), "keeps the rate": mix.MixPolicy(bound=1e9, give_way=False)
    }.items():
        prob, gap = mix.cell_probabilities(cells, policy)
        kept, rate, top = sampled_shares(rows, prob)
        has = Counter()
        for *c, w in rows:
            has.update({(d, v): w for d, v in zip(mix.DIMS, c, strict=True)})
        goal = {(d, v): x for d in mix.DIMS for v, x in plain_goals({v: x for (o, v), x in has.items() if o == d}, policy).items()}
        assert max(abs(kept[k] / goal[k] - 1) for k in has) == pytest.approx(gap, abs=1e-6)
        found[name] = gap, rate, top
    assert found["low"][0] < 0.01 and found["low"][1] == pytest.approx(0.3, abs=1e-3)
    assert found["bounded"][0] < 0.01 and found["bounded"][1] == pytest.approx(0.8, rel=0.02)
    assert found["gives way"][0] < 0.01 and found["gives way"][1] < 0.8 and found["gives way"][2] == 1
    assert found["keeps the rate"][0] > 0.01 and found["keeps the rate"][1] > found["gives way"][1]
    with pytest.raises(ValueError):
        mix.cell_probabilities(cells, mix.MixPolicy(bound=1e9, give_way=False, strict=True))


def test_documents_are_sampled_to_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "source", "lang").join(mix.op6_raking(spark, sf), "doc_id").collect()
    for dim in mix.DIMS:
        has, kept = Counter(), Counter()
        for r in rows:
            has[r[dim]] += r["n_tokens"]
            kept[r[dim]] += r["n_tokens"] * r["probability"]
        assert {v: x / sum(kept.values()) for v, x in kept.items()} == pytest.approx(plain_goals(has), rel=0.01)
        assert sum(kept.values()) == pytest.approx(0.8 * sum(has.values()), rel=0.02)
    n, expected = sum(r["sampled"] for r in rows), sum(r["probability"] for r in rows)
    assert abs(n - expected) < 4 * sum(r["probability"] * (1 - r["probability"]) for r in rows) ** 0.5


def test_topics(spark):
    texts = ["plain words", "mail a@b.c or d@e.f, see the License", "The license and Copyright @", "a | b | c", None, "@ License"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mix.topic_of(F.col("t"))).collect()] == ["prose", "contact", "license", "table", "prose", "license"]


def test_sampling_rows(odd, none):
    plan = mix.sample_plan(odd).collect()
    assert len(plan) == 9 and all(0 <= r["probability"] <= 1 for r in plan)
    assert next(r["n_tokens"] for r in plan if r["doc_id"] == 5) == 30_000
    assert next(r["n_tokens"] for r in mix.sample_plan(odd, tokens="n_chars").collect() if r["doc_id"] == 6) == 100_000
    clash = odd.withColumns({"topic": F.lit("t"), "probability": F.lit(2), "_topic": F.lit(3), "w": F.lit(4)})
    for policy in (mix.MixPolicy(), mix.MixPolicy(broadcast_cells=-1)):
        out = mix.sample_mix(clash, policy=policy)
        assert out.columns == clash.columns
        assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((r["doc_id"] for r in plan if r["sampled"]), key=repr)
    assert mix.sample_plan(none).count() == 0 and mix.sample_mix(none).count() == 0


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_curve_steps_to_neighbours(spark, dims, bits):
    points = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(points, ", ".join(f"d{i} int" for i in range(dims)))
    at = df.withColumn("at", hil.curve_index([F.col(f"d{i}") for i in range(dims)], bits)).orderBy("at").collect()
    assert [r["at"] for r in at] == list(range(len(points)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in itertools.pairwise(at))


def check_law(plan, docs, shards=16):
    assert len(plan) == len(docs)
    sizes = Counter(r["shard"] for r in plan)
    assert set(sizes) <= set(range(shards)) and max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in plan if r["shard"] == s) == list(range(sizes[s]))
    key = lambda k, t: (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((tuple(r[c] for c in ("doc_id", "size", "text_crc32")) for r in plan), key=repr) == sorted((key(r["doc_id"], r["text"]) for r in docs), key=repr)
    order = [r["curve"] for r in sorted(plan, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_shards(spark, odd, none, sf, tmp_path):
    check_law(hil.shard_plan(odd.withColumn("shard", F.lit("x"))).collect(), odd.collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_law(hil.shard_plan(docs).collect(), docs.collect())
    assert hil.shard_plan(none).count() == 0
    rows = hil.op9_hilbert(spark, sf)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and rows.count() == docs.count()
    hil.write_shards(docs, hil.shard_plan(docs), f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").groupBy("shard").count().count() == 16
    clash = docs.withColumns({"_doc": F.lit(1), "_slot": F.lit(2), "shard": F.lit(3)})
    with pytest.raises(ValueError):
        hil.write_shards(clash, hil.shard_plan(clash), f"file://{tmp_path}/none")
    hil.write_shards(clash, hil.shard_plan(clash), f"file://{tmp_path}/other", shard="part")
    assert spark.read.parquet(f"file://{tmp_path}/other").columns == [*clash.columns, "part"]
    with pytest.raises(ValueError):
        hil.write_shards(odd, hil.shard_plan(odd), f"file://{tmp_path}/none")
    big = spark.createDataFrame([(1, "x" * 3_000_000, "a", "en"), (2, "y", "a" * 100_000, None)], "doc_id long, text string, source string, lang string")
    check_law(hil.shard_plan(big).collect(), big.collect())


def test_stages_take_any_table(spark, odd, none):
    extra = {c: F.lit("mine") for c in ("row", "_key", "probability", "secrets", "n_words", "kept", "b")}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs.withColumns(extra), "")
            assert out.columns[:1] == ["doc_id"] and (name == corpus_pipeline.STAGES[-1][0] or out.columns == [*docs.columns, *extra])
            assert out.count() <= docs.count()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    keep, _ = judged([(r["doc_id"], r["text"], r["source"]) for r in docs], host.HostPolicy())
    kept = [r for r, x in zip(docs, keep, strict=True) if x]
    stage = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r["doc_id"] for r in stage.collect()) == sorted(r["doc_id"] for r in kept)
    label = groups([simhash(r["text"]) for r in kept])
    low = {}
    for r in kept:
        g = label[simhash(r["text"])]
        low[g] = min(low.get(g, 1 << 60), r["doc_id"])
    kept = [{**r.asDict(), "text": sec.redact(r["text"])} for r in kept if r["doc_id"] in set(low.values())]
    for r in kept:
        r["n_chars"] = len(r["text"])
    plan = mix.sample_plan(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")).where("sampled")
    ids = sorted(r["doc_id"] for r in plan.collect())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == ids and len(rows) > 20
    texts = {r["doc_id"]: r["text"] for r in kept}
    import public_tokenizers as P

    from roadloom.llm.op5_byte_bpe import _encoding

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as fh:
        enc = _encoding(fh.read(), P.PATTERN)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(texts[r["doc_id"]]) for r in rows)
