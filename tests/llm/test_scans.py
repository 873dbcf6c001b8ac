from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from roadloom.llm import op2_licenses as lic
from roadloom.llm import op4_secret_links as sec
from roadloom.llm import op10_surrogates as sur

KEY = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"


def base_plain(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(f"({KEY})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, b, sec.KINDS[k]) for a, k, b in sorted(found)]


def test_base_spans():
    rng = random.Random(4)
    bits = ["password", "Token", "SECRET", "api_key", "apikey", "paſſword", "toKen", " ", "  ", "=", ":", "'", '"', "abc", "abcdef1", "a" * 30, "0f" * 13, "AKIA", "AKIA" + "Q" * 16, "Z9", "\n", "é", "=="]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sec.base_spans(t) == base_plain(t), t


def test_links_need_a_complement():
    lone = "the value Zk39dkfLwo20slKdk30w stands alone"
    assert sec.secret_spans(lone) == []
    both = "user=alice01 and Zk39dkfLwo20slKdk30w at https://db.example.com/x"
    assert [k for _, _, k in sec.secret_spans(both)] == ["weak_id", "weak_secret", "endpoint"]
    apart = "user=alice01\n\nZk39dkfLwo20slKdk30w"
    assert sec.secret_spans(apart) == []
    far = "user=alice01 " + "x " * 300 + "Zk39dkfLwo20slKdk30w"
    assert sec.secret_spans(far, sec.LinkPolicy(gap=200)) == [] and len(sec.secret_spans(far)) == 2
    held = "https://host.example.com/x?token=abcdef1 with Zk39dkfLwo20slKdk30w"
    assert [k for _, _, k in sec.secret_spans(held)] == ["assign", "weak_secret"]
    beside = "id AKIA" + "B7" * 8 + " key Zk39dkfLwo20slKdk30w"
    assert [k for _, _, k in sec.secret_spans(beside)] == ["access", "weak_secret"]
    assert sec.redact(both) == "user=[SECRET] and [SECRET] at https://db.example.com/x"


def weak_plain(t, gap):
    """Each weak candidate against every other part of its scope."""
    base = base_plain(t)
    weak = [(m.start(m.lastindex), m.end(m.lastindex), "weak_id") for m in sec._WEAK_ID.finditer(t)] + [(*m.span(), "weak_secret") for m in sec._WEAK_SECRET.finditer(t)]
    ends = [(*m.span(), "endpoint") for m in sec._ENDPOINT.finditer(t)]
    if not (weak or ends or base):
        return []
    crosses = lambda x: any(x[0] < b and a < x[1] for a, b, _ in base)
    scope = lambda a: len([m for m in re.finditer(r"\n[\x20\t\r]*\n", t) if m.start() < a])
    role = {"access": "id", "weak_id": "id", "endpoint": "endpoint"}
    parts = base + [x for x in weak if not crosses(x)] + ends
    out = []
    for a, b, k in [x for x in weak + ends if not crosses(x)]:
        need = {"weak_id": ("secret",), "weak_secret": ("id", "endpoint"), "endpoint": ("id", "secret")}[k]
        for c, d, o in parts:
            if role.get(o, "secret") in need and scope(a) == scope(c) and (gap is None or (c - b <= gap and a - d <= gap)):
                out.append((a, b, k))
                break
    return sorted(set(out))


@pytest.mark.parametrize("gap", [None, 0, 12])
def test_weak_spans_against_all_pairs(gap):
    rng = random.Random(14)
    bits = ["user=alice01", "client_id: abc9", "login='bob.x'", "Zk39dkfLwo20slKdk30w", "https://db.example.com/x", "s3://b/k?token=abcdef1", "AKIA" + "B7" * 8, "AKIAB7B7B7B7", "password=abcdef9", "0f" * 13, "\n\n", "\n \t\n", "\n", " ", "word", "x " * 9, "host.internal.net"]
    for _ in range(3000):
        t = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert sorted(set(sec.weak_spans(t, sec.base_spans(t), sec.LinkPolicy(gap)))) == weak_plain(t, gap), t


def test_secret_rows(spark, odd, none):
    got = sec.find_secrets(odd.withColumnRenamed("lang", "secrets"))
    assert got.count() == 9 and all(r["secrets"] == [] for r in got.collect())
    assert sec.find_secrets(none).count() == 0
    df = spark.createDataFrame([(1, "password=abcdef9 x", 18), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = sec.redact_secrets(df)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "[SECRET] x", 10), (2, None, 0), (3, "clean", 5)]


def test_secret_query(spark, sf):
    rows = {r["doc_id"]: r for r in sec.op4_secret_links(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want, got = base_plain(r["text"] or ""), rows[r["doc_id"]]
        assert [got[f"n_{k}"] for k in sec.KINDS] == [sum(x[2] == k for x in want) for k in sec.KINDS]
        assert got["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
    assert len(rows) == 200


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        n, start, end = lic.align(a, b, 0, 20)
        assert n == lcs(a, b)
        assert n == lcs(a, b[start:end])


@pytest.mark.parametrize("at", range(len(lic.TEMPLATES)))
def test_templates_are_found(at):
    index, (name, text) = lic.TemplateIndex(lic.TEMPLATES, lic.LicensePolicy()), lic.TEMPLATES[at]
    whole = f"Some words before. {text} And some after."
    [(found, coverage, a, b)] = index.scan(whole)
    assert (found, coverage) == (name, 1.0) and whole[a:b] == text.rstrip("./")
    words = text.split()
    if len(words) > 20:
        changed = " ".join([*words[:9], "really", *words[10:]])
        assert index.scan("x " + changed)[0][0] == name
        assert all(c >= 0.8 for _, c, _, _ in index.scan(" ".join(words[: len(words) // 2])))


def best_plain(words, template, policy):
    """The most words of the template that any place of the text holds within the band, without an index."""
    return max((lic.align(template, words, s, policy.band)[0] for s in range(-policy.band, len(words))), default=0)


def test_whole_scans_against_every_place():
    """With any edits, a template is reported wherever a place of the text holds enough of it, with as many words."""
    rng, policy = random.Random(6), lic.LicensePolicy()
    chosen = [t for t in lic.TEMPLATES if t[0] in ("MIT", "MPL-2.0", "ISC", "Zlib", "GPL-3.0-only", "CC-BY-4.0", "BSL-1.0")]
    for name, text in chosen:
        index = lic.TemplateIndex([(name, text)], policy)
        template = lic.words_with_spans(text)[0]
        for _ in range(4 if len(template) > 40 else 25):
            words = list(template)
            for _ in range(rng.randint(0, max(1, len(words) // 4))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(template + ["foo", "bar"])] * rng.randint(0, 2)
            around = [rng.choice(["some", "other", "words", *template[:3]]) for _ in range(20)]
            doc = around[:10] + words + around[10:]
            found, most = index.scan(" ".join(doc)), best_plain(doc, template, policy)
            if found:
                assert max(round(c * len(template)) for _, c, _, _ in found) >= min(most, len(template))
            elif index.names:
                assert most < policy.min_coverage * len(template) or not any(index.names[0] <= set(doc[i : i + len(template) + 6]) for i in range(len(doc)))
            else:
                assert most < policy.min_coverage * len(template)


def test_full_of_one_gram():
    index, began = lic.TemplateIndex(lic.TEMPLATES, lic.LicensePolicy()), time.process_time()
    assert index.scan("including without limitation the rights to " * 15_000) == []
    assert time.process_time() - began < 20


def test_short_notices():
    index = lic.TemplateIndex(lic.TEMPLATES, lic.LicensePolicy())
    names = lambda t: [(n, round(c, 2)) for n, c, _, _ in index.scan(t)]
    assert names("It is released under the terms of the MIT License, as is.") == [("MIT", 1.0)]
    assert names("Released under an MIT License") == [("MIT", 0.8)]
    assert names("Released, a, under b the c MIT d License") == [("MIT", 1.0)]
    assert names("Released under the Foo License") == [] and names("MIT: released under the Foo License") == []
    one = "Released under the MIT License."
    for text, n in ((f"{one} {one}", 2), (f"{one} " * 50, 50), (f"{one} Released under an MIT License. {one}", 3)):
        got = index.scan(text)
        assert [x for x, *_ in got] == ["MIT"] * n and all(len(text[a:b].split()) == 5 for _, _, a, b in got)
    [(_, _, a, b)] = index.scan(f"{one} See the other License")
    assert (a, b) == (0, len(one) - 1)
    assert names("Licensed under the Apache License, Version 2.0. " * 3) == [("Apache-2.0", 1.0)] * 3


def test_license_rows(spark, odd, none, sf):
    assert lic.scan_licenses(none).count() == 0
    assert all(r["licenses"] == [] for r in lic.scan_licenses(odd.withColumnRenamed("lang", "licenses")).collect())
    rows = {r["doc_id"]: r["n_licenses"] for r in lic.op2_licenses(spark, sf).collect()}
    want = {r["doc_id"]: bool(re.search(r"(?i)licensed?\b", r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {k: v > 0 for k, v in rows.items()} == want
    with pytest.raises(ValueError):
        lic.TemplateIndex([("empty", "...")], lic.LicensePolicy())


KINDS_OF = lambda t: [k for _, _, k, _ in sur.detect(t)]


def test_detection():
    t = "Mail jo.doe@mail.example.com or (555) 123-4567; +44 20 7946 0958; 4111 1111 1111 1111; 10.0.0.255; 123-45-6789; Mrs Anna Smith. v1.2.3 and 20240101"
    assert KINDS_OF(t) == ["email", "phone", "phone", "card", "ip", "ssn", "name", "name"]
    assert sur.detect("plain words, 42 and 3.14, a@b and token 9f8e7d6c5b4a39281706; 12:30:45 20240101, std::vector, 2024-01-01") == []
    long = "a" * 300 + "@x.example.com"
    assert [(a, b) for a, b, _, _ in sur.detect(f"to {long}!")] == [(3, 3 + len(long))]
    for p in ("+14155550123", "+33 6 12 34 56 78", "06 12 34 56 78", "+34 612 34 56 78", "030/1234567", "+4915112345678", "0049 30 1234567", "+420 601 123 456"):
        assert [(k, t[a:b]) for t in [f"call {p}, now"] for a, b, k, _ in sur.detect(t)] == [("phone", p)]
        new, _ = sur.replace(p, b"k", {})
        code = {"+420": 4, "+34 ": 4, "+33 ": 4, "+491": 3, "+141": 2, "0049": 4}.get(p[:4], 1)
        assert new != p and new[:code] == p[:code] and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", p)
    forms = {f for p in ("+44 20 7946 0958", "020 7946 0958", "+442079460958", "0044 20 7946 0958") for *_, f in sur.detect(p)}
    assert len(forms) == 1
    for ip in ("2001:db8:85a3::8a2e:370:7334", "2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "2001:db8:85a3:0:0:8a2e:370:7334"):
        new, n = sur.replace(f"at {ip}.", b"k", {})
        assert n == 1 and KINDS_OF(new) == ["ip6"] and new.count(":") == ip.count(":") and new != f"at {ip}."


def test_names_are_coreferent():
    t = "Mrs Anna Smith met Dr. John Doe. Then Anna left, Smith's car stayed; ANNA! Emily Watson and Mr Doe. г-жа Анна Иванова"
    new, n = sur.replace(t, b"k", {})
    assert n == 12 and not re.search("Anna|Smith|John|Doe|ANNA|Emily|Watson|Анна|Иванова", new)
    one = lambda pattern: re.search(pattern, new)[1]
    anna, smith = one(r"Mrs (\w+)"), one(r"Mrs \w+ (\w+)")
    assert f"Then {anna} left, {smith}'s car" in new and f"; {anna.upper()}!" in new and one(r"Mr (\w+)") == one(r"Dr\. \w+ (\w+)")
    assert anna.endswith("a") or anna.endswith("e")  # a woman's name
    assert re.fullmatch("[А-Яа-я]+ [А-Яа-я]+", one("г-жа (.*)"))
    for t, name in (("我见到李明先生，李明很好", "李明"), ("田中さん", "田中"), ("김민수 씨", "김민수")):
        new, n = sur.replace(t, b"k", {})
        assert n == t.count(name) and name not in new and len(new) == len(t)


def test_surrogates_keep_form():
    for kind, text, form in (("email", "Jo.D0e@Mail.Example.com", "jo.d0e@mail.example.com"), ("phone", "+1 (217) 555-7713", "2175557713"), ("card", "4111 1111 1111 1111", "4111111111111111"), ("ip", "10.7.0.255", "10.7.0.255"), ("iban", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000")):
        out = sur.render(text, kind, sur.surrogate(b"k", kind, form, 0))
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
        assert shape(out)[: len(text) - 4] == shape(text)[: len(text) - 4] and out != text
        assert [k for _, _, k, _ in sur.detect(f"x {out} y")] == [kind]
    assert sur._luhn(sur.surrogate(b"k", "card", "4111111111111111", 3)) == 0
    assert sur.surrogate(b"k", "name", "f:cyrillic:анна", 0)[-1] == "а" and sur.surrogate(b"k", "name", "f:latin:anna", 0).isascii()


def test_surrogates_are_distinct(spark):
    # Octets of one digit leave few values, so many proposals collide with one another or are somebody's own.
    values = [f"{a}.{b}.{c}.{d}" for a in range(3) for b in range(10) for c in range(10) for d in range(10)]
    known = spark.createDataFrame([("ip", v) for v in values], "kind string, form string")
    rows = sur.settle(known, sur.SurrogatePolicy(b"k", rounds=40)).collect()
    cores = [r["core"] for r in rows]
    assert sorted(r["form"] for r in rows) == sorted(values)
    assert len(set(cores)) == len(values) and not set(cores) & set(values)
    assert max(r["attempt"] for r in rows) > 0


def test_replacement(spark, odd, none):
    texts = [f"write to a{i % 7}@x{i % 3}.example.com, 10.0.0.{i % 5} or Mrs Anna Smith" for i in range(40)] + [None, "", "clean"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_entities int").withColumns({c: F.lit(c) for c in ("_key", "_both", "_digest", "_attempts", "found")})
    few = sur.replace_entities(df)
    many = sur.replace_entities(df, policy=sur.SurrogatePolicy(broadcast_entities=-1))
    assert few.columns == many.columns == [c for c in df.columns if c != "n_entities"] + ["n_entities"] and {r["_both"] for r in many.collect()} == {"_both"}
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in few.collect()}
    assert got == {r["doc_id"]: (r["text"], r["n_entities"]) for r in many.collect()}
    assert (got[40], got[41], got[42]) == ((None, 0), ("", 0), ("clean", 0))
    old, new = [[sur.detect(t)[0][3] for t in x] for x in (texts[:40], [got[i][0] for i in range(40)])]
    assert len(set(zip(old, new, strict=True))) == len(set(old)) == len(set(new)) and not set(old) & set(new)
    assert all(got[i][1] == 4 for i in range(40))
    assert sur.replace_entities(none).count() == 0
    assert sorted(r["n_entities"] for r in sur.replace_entities(odd).collect()) == [0] * 9


def settled_plain(known, key):
    """Surrogates of all entities, attempt by attempt, in one dictionary."""
    owner = lambda k, f: f.rsplit(":", 1)[-1] if k == "name" else f
    used, out, todo, attempt = {(k, owner(k, f)) for k, f in known}, {}, sorted(known), 0
    while todo:
        tried = {}
        for k, f in todo:
            tried.setdefault((k, sur.surrogate(key, k, f, attempt)), []).append((k, f))
        won = {core: min(fs) for core, fs in tried.items() if core not in used}
        out.update({x: attempt for x in won.values()})
        used |= set(won)
        todo, attempt = [x for x in todo if x not in out], attempt + 1
    return out


def test_surrogate_query_against_plain_python(spark, sf):
    """The whole query: every text as one dictionary of all entities makes it, no entity in clear, none shared."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {(k, f) for t in docs.values() for _, _, k, f in sur.detect(t or "")}
    policy = sur.SurrogatePolicy()
    attempts = settled_plain(known, policy.key)
    rows = sur.op10_surrogates(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and len(known) > 5
    cores = {x: sur.surrogate(policy.key, *x, a) for x, a in attempts.items()}
    assert len({(k, c) for (k, _), c in cores.items()}) == len(known)
    for r in rows:
        assert (r["text"], r["n_entities"]) == sur.replace(docs[r["doc_id"]], policy.key, attempts)
        for a, b, k, f in sur.detect(docs[r["doc_id"]] or ""):
            if k in ("email", "card", "ip", "ssn"):
                assert docs[r["doc_id"]][a:b] not in r["text"]


def test_surrogates_cost_follows_length():
    """Long runs of digits before a letter, and directories of names, take no more than their length asks for."""
    import time

    from roadloom.llm import op10_surrogates as pii

    began = time.perf_counter()
    for text in (("+" + "1" * 80 + "x ") * 2000, "+" + "12 " * 40_000 + "x", "+1" * 100_000, "+49 " + "1" * 100_000 + "a", "00" * 50_000 + "b", "a@" * 100_000, "a." * 100_000 + "@" + "b." * 100_000):
        assert not [x for x in pii.detect(text) if x[2] == "phone"]
    word = lambda i: chr(65 + i % 26) + "".join(chr(97 + i // 26**k % 26) for k in range(5))
    names = {word(i) for i in range(0, 100_000, 2)}
    found = pii.detect(" ".join(f"Mr. {w} said so, {w.upper()}." for w in sorted(names)))
    assert len(found) == 2 * len(names)
    han = "".join(f"王{chr(0x4E00 + i % 20_000)}{chr(0x4E00 + i // 7 % 20_000)}先生、" for i in range(50_000))
    assert len(pii.detect(han)) == 50_000
    assert time.perf_counter() - began < 10


def test_names_within_words():
    """In scripts without spaces the longest name counts, and none reaches beyond its word."""
    from roadloom.llm import op10_surrogates as pii

    text = "田中様 6789田中、田中様さん 김철수 씨, 김철수는 Dr. Ames, AMES, Amesbury"
    assert [text[a:b] for a, b, _, _ in pii.detect(text)] == ["田中", "田中", "田中様", "김철수", "김철수", "Ames", "AMES"]
