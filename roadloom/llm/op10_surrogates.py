"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same wherever one recurs.

An entity's surrogate follows from the key, its kind, its canonical form and an attempt number. All distinct entities
of the corpus are checked together: a surrogate that another entity has, or that is itself somebody's real value,
takes the next attempt. Attempts above 0 are few; texts are rewritten where they are, beside that table.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns, bound_batches
from roadloom.llm.text import fresh
from roadloom.plans.staging import staged

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_GAP = r"[ ./-]"
_DIGIT_KINDS = [
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)),
    ("card", re.compile(r"(?<![0-9A-Za-z+])(?!00)\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])", re.ASCII)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)", re.ASCII)),
    ("ip6", re.compile(rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])", re.ASCII)),
    # With a country's code; with an area's code apart; with a national 0, in pairs or after a slash or space. A run of
    # digits is taken in one way only, so a number is tried no more often than it can have groups.
    ("phone", re.compile(
        rf"(?<![\w+])(?<!\d[:./-])(?:(?:\+|00)[1-9]\d{{0,2}}(?:{_GAP}?\(\d{{1,4}}\))?(?>{_GAP}?\d{{1,14}}){{1,7}}|(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]?\d{{3,4}}"
        rf"|0\d(?:[ .-]\d{{2}}){{4}}|0\d{{2,4}}[ /-]\d{{5,9}})(?!\w)", re.ASCII)),
]
#: Countries' codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_DIGIT = re.compile(r"[0-9]")
#: Titles by the gender that they give (x: none), and given names of one gender that are no common words.
_TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Signor г-н господин Господин",
    "f": "Mrs Ms Miss Madam Lady Frau Mme Mlle Madame Mademoiselle Señora Sra Srta Señorita Doña Signora г-жа госпожа Госпожа",
    "x": "Dr Prof Professor Doctor Doktor Docteur",
}
_GIVEN = {
    "m": "James John Robert Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kevin Brian Edward Peter Paul Hans Klaus Jürgen Wolfgang Stefan Andreas Matthias Sebastian Jean Pierre Michel Jacques François Luc José Juan Carlos Luis Miguel Javier Pedro Pablo Иван Сергей Андрей Дмитрий Алексей Николай Владимир Γιώργος Νίκος Γιάννης",
    "f": "Mary Anna Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Laura Julia Maria Ursula Sabine Heike Claudia Katharina Ingrid Marie Sophie Isabelle Nathalie Camille Carmen Lucía Sofía Elena Isabel Ana Teresa Анна Мария Елена Ольга Наталья Екатерина Татьяна Μαρία Ελένη Κατερίνα",
}
_TITLE_GENDER = {t: g for g, ts in _TITLES.items() for t in ts.split()}
_GIVEN_GENDER = {n: g for g, ns in _GIVEN.items() for n in ns.split()}
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽА-ЯЁІЇЄΑ-Ω"
_START = re.compile(rf"[{_UPPER}][^\W\d_]+")
_SMALL_TITLE = re.compile(r"(?<!\w)(г-н|г-жа|господин|госпожа)(?!\w)")
_WORD = re.compile(r"\w+")
_UNSPACED = ("han", "hangul", "katakana", "hiragana")
_REST = re.compile(r"[ -]([^\W\d_]+)")
#: Names before an honorific, with the gender that it gives. A Chinese or Korean name begins with a frequent surname.
_BEFORE = [
    ("m", re.compile("([王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯董程曹袁邓许沈曾彭吕苏卢蒋蔡贾丁魏薛叶余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺][一-龥]{1,2})(?=先生)")),
    ("f", re.compile("([王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯董程曹袁邓许沈曾彭吕苏卢蒋蔡贾丁魏薛叶余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺][一-龥]{1,2})(?=女士|小姐)")),
    ("x", re.compile("((?<![一-龥])[一-龥]{2,3}|(?<![ァ-ー])[ァ-ー]{2,8})(?=さん|様)")),
    ("x", re.compile("(?<![가-힣])([김이박최정강조윤장임한오서신권황안송류전홍][가-힣]{1,2})(?= ?씨(?![가-힣]))")),
]
_HONORIFIC = re.compile("先生|女士|小姐|さん|様|씨")
#: Scripts by their letters; the first three have syllables of their own, in the others each letter becomes another.
_SCRIPTS = {
    "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽ", "hebrew": "א-ת", "arabic": "ا-ي", "devanagari": "क-ह", "hangul": "가-힣", "hiragana": "ぁ-ゖ", "katakana": "ァ-ヺ", "han": "一-龥", "thai": "ก-ฮ", "georgian": "ა-ჰ", "armenian": "ա-ֆ",
}
_SYLLABLES = {
    "latin": ("ba da fe ga ke la li ma mi no pa ra re ri ro sa so ta ti va".split(), {"m": ["n", "r", "s", "ld"], "f": ["a", "ia", "ina", "elle"], "x": ["son", "er", "ini", "ard"]}),
    "cyrillic": ("ба да ве га же ка ла ли ма ми но па ра ри са со та ти ва зо".split(), {"m": ["н", "р", "м", "слав"], "f": ["а", "ия", "ина", "ена"], "x": ["ко", "ник", "юк", "ман"]}),
    "greek": ("βα γα δε κα λα λι μα μι νο πα ρα ρι σα σο τα τι".split(), {"m": ["ς", "ος", "ης", "ας"], "f": ["α", "η", "ια", "ινα"], "x": ["ιδη", "ακη", "ου", "οπουλο"]}),
}


@dataclass(frozen=True)
class SurrogatePolicy:
    """key: the secret from which surrogates follow. rounds: attempts before an entity gets a tag of its digest
    instead. broadcast_entities: up to so many entities with an attempt above 0 are broadcast; beyond it, each
    document is joined with those that it holds."""

    key: bytes = b"a key that its owner should choose"
    rounds: int = 12
    broadcast_entities: int = 200_000


def _script(word: str) -> str:
    return next((s for s, span in _SCRIPTS.items() if span[0] <= word[0] <= span[2]), "latin")


def _national(digits: str, foreign: bool) -> str:
    """The number itself: without the country's code, if it has one, and without the 0 that is dialled before it.

    What is left out is part of the format and stays.
    """
    if foreign:
        digits = digits[1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3 :]
    return digits[1:] if digits.startswith("0") else digits


def _phone_form(text: str) -> str | None:
    digits, foreign = re.sub("[^0-9]", "", text), text[0] == "+"
    if text.startswith("00"):
        digits, foreign = digits[2:], True
    if not (8 if foreign else 9) <= len(digits) <= 15:
        return None
    form = _national(digits, foreign)
    return form if len(form) >= 5 else None


def _ip6_form(text: str) -> str | None:
    try:
        form = ipaddress.IPv6Address(text).exploded
    except ValueError:
        return None
    # A few groups are more likely code than an address.
    return form if _DIGIT.search(text) and sum(g != "0000" for g in form.split(":")) >= 3 else None


def _mentions(text: str, forms: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """Where words of names stand in a text: whole words, or, in scripts that leave no space between words, the longest
    from where it begins. Each word of the text is looked up, so many names cost no more than few."""
    inner = {f for f in forms if _script(f) in _UNSPACED}
    lengths = sorted({len(f) for f in inner}, reverse=True)
    for m in _WORD.finditer(text):
        word, a = m.group(), m.start()
        if word in forms:
            yield a, m.end(), word
        elif inner and not word.isascii():
            i = 0
            while i < len(word):
                n = next((n for n in lengths if n <= len(word) - i and word[i : i + n] in inner), 0)
                if n:
                    yield a + i, a + i + n, word[i : i + n]
                i += n or 1


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """The words of names: after a title, from a known given name on, or before an honorific; and, once one is found,
    every other mention of its words in the text, which have the gender of the first."""
    found: dict[int, tuple[int, str, str]] = {}
    role: dict[str, str] = {}

    def take(spans: list[tuple[int, int]], gender: str) -> None:
        for i, (a, b) in enumerate(spans):
            word = text[a:b].casefold()
            given = i < len(spans) - 1 or len(spans) == 1 and text[a:b] in _GIVEN_GENDER
            found[a] = (b, role.setdefault(word, gender if given else "x"), word)

    def words_from(at: int, most: int) -> list[tuple[int, int]]:
        spans = []
        while len(spans) < most and (m := _REST.match(text, at)) and _START.fullmatch(m.group(1)) and m.group(1) not in _TITLE_GENDER:
            spans.append(m.span(1))
            at = m.end()
        return spans

    starts = [(m.start(), m.end(), m.group()) for m in _START.finditer(text)]
    if "госп" in text or "г-" in text:
        starts += [(m.start(), m.end(), m.group()) for m in _SMALL_TITLE.finditer(text)]
    for a, b, word in starts:
        if a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        gender = _TITLE_GENDER.get(word)
        if gender:
            spans = words_from(b + (text[b : b + 1] == "."), 3)
            if spans and gender == "x":
                gender = _GIVEN_GENDER.get(text[slice(*spans[0])], "x")
            take(spans, gender)
        elif word in _GIVEN_GENDER and a not in found:
            spans = words_from(b, 2)
            if spans:
                take([(a, b), *spans], _GIVEN_GENDER[word])
    if _HONORIFIC.search(text):
        for gender, pattern in _BEFORE:
            for m in pattern.finditer(text):
                found.setdefault(m.start(1), (m.end(1), role.setdefault(m.group(1), gender), m.group(1)))
    if role:
        mentions = {form: w for w in role for form in (w.upper(), w.capitalize())} | {text[a:b]: w for a, (b, _, w) in found.items()}
        for a, b, form in _mentions(text, mentions):
            found.setdefault(a, (b, role[mentions[form]], mentions[form]))
    return [(a, b, "name", f"{own}:{_script(w)}:{w}") for a, (b, own, w) in found.items()]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, by start, without overlaps: the earlier kind has priority.

    Kinds: email, iban, card, ssn, ip, ip6, phone, and the words of names. Forms are equal where writings of one value
    are: case and separators don't count, nor do a phone number's country code and leading 0.
    """
    found = []
    at = text.find("@")
    while at >= 0:
        after, a = _DOMAIN.match(text, at + 1), at
        while after and a and text[a - 1] in _LOCAL:
            a -= 1
        if after and a < at:
            found.append((a, after.end(), "email", text[a : after.end()].lower()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for kind, pattern in _DIGIT_KINDS:
            if kind == "ip6" and "::" not in text and text.count(":") < 7:
                continue
            for m in pattern.finditer(text):
                t = m.group()
                form = t if kind == "ip" else _phone_form(t) if kind == "phone" else _ip6_form(t) if kind == "ip6" else re.sub("[^0-9A-Z]", "", t)
                if form:
                    found.append((m.start(), m.end(), kind, form))
    found += _names(text)
    order = {k: i for i, k in enumerate(("email", *[k for k, _ in _DIGIT_KINDS], "name"))}
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], order[x[2]])):
        while out and x[0] < out[-1][1] and order[x[2]] < order[out[-1][2]]:
            out.pop()
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class _Stream:
    """Keyed numbers below a bound."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.key, self.seed, self.n, self.pool = key, "\0".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + b"\0%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def like(self, s: str) -> str:
        """A letter for each lower-case letter, a digit for each digit; the rest stays."""
        return "".join(chr(97 + self.below(26)) if "a" <= c <= "z" else str(self.below(10)) if c.isdigit() else c for c in s)


def _luhn(digits: str) -> int:
    return sum((d if i % 2 == 0 else sum(divmod(2 * d, 10))) for i, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The canonical form of an entity's replacement; below 0, a tag of its digest."""
    if attempt < 0:
        return f"[{kind.upper()}-{hmac.new(key, f'{kind}\0{form}'.encode(), hashlib.sha256).hexdigest()[:24]}]"
    s = _Stream(key, kind, form, attempt)
    if kind == "email":
        local, _, domain = form.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{s.like(local)}@{_Stream(key, 'domain', domain).like(name)}.{top}"
    if kind == "ip6":
        # Groups of zeros stay, as writings leave them out.
        digit = lambda n: "123456789abcdef"[s.below(15)] + "".join("0123456789abcdef"[s.below(16)] for _ in range(n - 1))
        return ":".join("0000" if g == "0000" else digit(len(g.lstrip("0"))).zfill(4) for g in form.split(":"))
    if kind == "ip":
        span = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        return ".".join(str(span[len(x)][0] + s.below(span[len(x)][1])) for x in form.split("."))
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in form[4:])
        number = int("".join(str(int(c, 36)) for c in body + form[:2] + "00"))
        return f"{form[:2]}{98 - number % 97:02d}{body}"
    if kind == "card":
        body = form[0] + "".join(str(s.below(10)) for _ in form[1:-1])
        # The check digit keeps the remainder, so a valid number stays valid.
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)) == _luhn(form))
    if kind == "name":
        role, script, word = form.split(":", 2)
        if script not in _SYLLABLES:
            low, high = (ord(_SCRIPTS[script][i]) for i in (0, 2))
            return "".join(chr(low + s.below(high - low + 1)) if low <= ord(c) <= high else c for c in word)
        syllables, ends = _SYLLABLES[script]
        return "".join(syllables[s.below(len(syllables))] for _ in range(2 + attempt // 4 + s.below(2))) + ends[role][s.below(4)]
    # A number doesn't begin with 0, which would be taken for the digit that is dialled before it.
    return "".join(str(1 + s.below(9) if i == 0 and kind == "phone" else s.below(10)) for i, _ in enumerate(form))


def render(original: str, kind: str, core: str) -> str:
    """``core`` written as ``original`` is: its separators and its case."""
    if core.startswith("["):
        return core
    if kind == "email":
        return "".join(c.upper() if o.isupper() else c for c, o in zip(core, original, strict=True))
    if kind == "name":
        return core.upper() if original.isupper() else core.capitalize()
    if kind == "ip":
        return core
    if kind == "ip6":
        groups = original.split(":")
        out = ipaddress.IPv6Address(core).compressed if "::" in original else core if all(len(g) == 4 for g in groups) else ":".join(g.lstrip("0") or "0" for g in core.split(":"))
        return out.upper() if original != original.lower() else out
    code = sum(map(str.isdigit, original)) - len(core) if kind == "phone" else 0
    rest = iter("".join(filter(str.isdigit, original))[:code] + core)
    return "".join(next(rest) if c.isdigit() or (kind == "iban" and c.isalpha()) else c for c in original)


def replace(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """The text with every entity replaced, and their number."""
    if text is None:
        return None, 0
    out, at, found = [], 0, detect(text)
    for a, b, kind, form in found:
        out += [text[at:a], render(text[a:b], kind, surrogate(key, kind, form, attempts.get((kind, form), 0)))]
        at = b
    return "".join(out) + text[at:] if found else text, len(found)


_ENTITY = pa.struct([("kind", pa.string()), ("form", pa.string())])
_ENTITIES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("form", T.StringType())]))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, form) of all texts; a frequent entity leaves each task once. Null and empty texts have none,
    repeated rows add none, an empty table has no rows."""

    def make(texts: list) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "form": f} for k, f in dict.fromkeys((k, f) for _, _, k, f in detect(t or ""))] for t in texts], pa.list_(_ENTITY))]

    found = add_columns(docs.select(F.col(f"`{text}`").alias("text")), "text", [T.StructField("found", _ENTITIES)], make)
    return found.select(F.explode("found").alias("x")).select("x.kind", "x.form").distinct()


def _proposed(rows: DataFrame, key: bytes) -> DataFrame:
    bound_batches(rows.sparkSession)

    def run(batches):
        for b in batches:
            k, f, a = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "form", "attempt"))
            core = [surrogate(key, *x) for x in zip(k, f, a, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(f, pa.string()), pa.array(a, pa.int32()), pa.array(core, pa.string())], names=["kind", "form", "attempt", "core"])

    return rows.select("kind", "form", F.col("attempt").cast("int").alias("attempt")).mapInArrow(run, "kind string, form string, attempt int, core string")


def settle(known: DataFrame, policy: SurrogatePolicy = SurrogatePolicy()) -> DataFrame:
    """``known`` (kind, form; distinct) with attempt and core, such that no two entities of a kind share a core and
    no core is the form of an entity. Each round proposes for what is open and joins the proposals with all forms and
    with the cores that are settled; of equal proposals, the smallest form keeps its own. Null kinds and forms aren't
    expected, as :func:`entities` makes none. Empty table: no rows."""
    owner = lambda c: F.when(F.col("kind") == "name", F.substring_index(c, ":", -1)).otherwise(F.col(c))
    real = known.select("kind", owner("form").alias("core")).distinct()
    parts, todo = [], known
    for turn in range(policy.rounds + 1):
        last = turn == policy.rounds
        tried = staged(_proposed(todo.withColumn("attempt", F.lit(-1 if last else turn)), policy.key), "tried")
        used = real
        for p in parts:
            used = used.unionByName(p.select("kind", "core"))
        first = tried.groupBy("kind", "core").agg(F.min("form").alias("form")).join(used, ["kind", "core"], "left_anti")
        parts.append(tried if last else staged(tried.join(first, ["kind", "core", "form"], "left_semi"), "settled"))
        todo = staged(tried.join(parts[-1].select("kind", "form"), ["kind", "form"], "left_anti").select("kind", "form"), "open")
        if todo.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, parts)


def replace_entities(docs: DataFrame, text: str = "text", policy: SurrogatePolicy = SurrogatePolicy()) -> DataFrame:
    """``docs`` with the text rewritten and n_entities (long), the number of its replacements.

    Null text: stays null. Texts without entities, empty ones too, stay as they are. Empty table: no rows. Repeated
    rows are rewritten alike, and so is an entity in any document. A column named n_entities is replaced; all others
    stay, whatever their names. A name is seen by a title, an honorific or a given name of the list; from then on all
    mentions of its words in that text are replaced, also where such a word has another meaning. Texts of any length
    are read whole, and cost follows their length, however many numbers and names they hold.
    """
    known = staged(entities(docs, text), "entities")
    redone = staged(settle(known, policy).where("attempt <> 0").select("kind", "form", "attempt"), "redone")
    fields = [T.StructField(text, T.StringType()), T.StructField("n_entities", T.LongType())]
    cols = [c for c in docs.columns if c.lower() != "n_entities"]
    if redone.count() <= policy.broadcast_entities:
        table = {(r["kind"], r["form"]): r["attempt"] for r in redone.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def make(texts: list) -> list[pa.Array]:
            done = [replace(t, policy.key, shared.value) for t in texts]
            return [pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())]

        return add_columns(docs, text, fields, make).select(*[f"`{c}`" for c in cols], "n_entities")
    # Each text is joined with those of its own entities that have an attempt, by a digest of the text.
    def own(texts: list) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "form": f} for k, f in dict.fromkeys((k, f) for _, _, k, f in detect(t or ""))] for t in texts], pa.list_(_ENTITY))]

    digest, key, tries, both = fresh(docs, "_digest", "_key", "_attempts", "_both")
    named = add_columns(docs.select(F.col(f"`{text}`").alias("t")).distinct(), "t", [T.StructField("found", _ENTITIES)], own)
    each = named.select(F.sha2("t", 256).alias(digest), F.explode("found").alias("x")).select(digest, "x.kind", "x.form").join(redone, ["kind", "form"])
    lists = each.groupBy(digest).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(tries))
    rows = docs.withColumn(key, F.sha2(F.col(f"`{text}`"), 256)).join(lists, F.col(key) == F.col(digest), "left")
    rows = rows.withColumn(both, F.struct(F.col(f"`{text}`").alias("t"), F.col(tries).alias("a")))

    def apply(rows: list) -> list[pa.Array]:
        done = [replace(r["t"], policy.key, {(x["kind"], x["form"]): x["attempt"] for x in r["a"] or []}) for r in rows]
        return [pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())]

    return add_columns(rows, both, fields, apply).select(*[f"`{c}`" for c in cols], "n_entities")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace_entities(docs).select("doc_id", "text", "n_entities")


QUERIES = {"op10_surrogates": op10_surrogates}
ORACLES: dict = {}
