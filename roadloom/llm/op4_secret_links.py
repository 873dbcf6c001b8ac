"""Secret scans by linking the parts of multipart credentials.

A text's scopes are its paragraphs, cut at blank lines. Within a scope, an interval join links access identifiers,
secrets and endpoints. Strong parts are reported as they are; a weak candidate is reported only when a part that
complements it lies in its scope, or near it there if the policy sets a gap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns

# The base patterns and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
# End of fixed values.

#: Kinds of weak candidates, after the base kinds in order: an identifier that is short or plainly named, a value
#: that could be a key, and an endpoint with which a credential is used.
WEAK = ("weak_id", "weak_secret", "endpoint")
_WEAK_ID = re.compile(r"""(?<![A-Za-z0-9])(?:(?:access_?key_?id|client_?id|account|login|user(?:name)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})|((?:AKIA|ASIA)[A-Z0-9]{8,}))""", re.ASCII | re.IGNORECASE)
_WEAK_SECRET = re.compile(r"""(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}""", re.ASCII)
_ENDPOINT = re.compile(r"""(?:https?|ftps?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|gs)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+(?:amazonaws|azure|googleapis|internal|cloudapp)\.[a-z.]{2,}""", re.ASCII)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


@dataclass(frozen=True)
class LinkPolicy:
    """gap: most characters between linked parts (None: any). Both parts of a link lie in one scope."""

    gap: int | None = None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, in characters, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _near(spans: list[tuple[int, int]], reach: list[int], a: int, b: int, gap: int) -> bool:
    """Whether one of ``spans`` (by start; ``reach``: the greatest end so far) comes within ``gap`` of [a, b)."""
    i = bisect_left(spans, (b + gap + 1,))
    return i > 0 and reach[i - 1] >= a - gap


def weak_spans(text: str, base: list[tuple[int, int, str]], policy: LinkPolicy = LinkPolicy()) -> list[tuple[int, int, str]]:
    """The weak candidates that a complementary part supports, outside the base spans.

    An identifier is complemented by a secret, a secret by an identifier, and an endpoint by either. What supports
    a candidate is a base part (access identifiers; assigned values and hex secrets) or, for an identifier and a
    secret that are both weak, one another; an endpoint supports a secret too, also one that overlaps a base span. The join is a sweep: parts of each
    role are sorted by start with running greatest ends, so a search finds each candidate's nearest partner.
    """
    weak = [(m.start(m.lastindex), m.end(m.lastindex), "weak_id") for m in _WEAK_ID.finditer(text)]
    ends = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if not (weak or ends or base):
        return []
    taken, found = [], []
    top = -1
    spans = [(a, b) for a, b, _ in base]
    for a, b in spans:
        top = max(top, b)
        taken.append(top)
    weak += [(m.start(), m.end(), "weak_secret") for m in _WEAK_SECRET.finditer(text)]
    free = [x for x in weak + ends if not _near(spans, taken, x[0], x[1], -1)]
    if not free:
        return []
    # An endpoint that holds a base span isn't reported, but what is beside it belongs to it.
    held = [(a, b, "") for a, b, _ in ends if _near(spans, taken, a, b, -1)]
    cuts = [m.start() for m in _BLANK.finditer(text)]
    scoped: dict[int, dict[str, list]] = {}
    for a, b, kind in [*base, *free, *held]:
        role = {"access": "id", "weak_id": "id", "endpoint": "endpoint", "": "endpoint"}.get(kind, "secret")
        scoped.setdefault(bisect_left(cuts, a), {}).setdefault(role, []).append((a, b, kind))
    gap = len(text) if policy.gap is None else policy.gap
    for roles in scoped.values():
        sides = {}
        for role, parts in roles.items():
            parts.sort()
            top, reach = -1, []
            for _, b, _ in parts:
                top = max(top, b)
                reach.append(top)
            sides[role] = ([(a, b) for a, b, _ in parts], reach)
        for role, partners in (("id", ("secret",)), ("secret", ("id", "endpoint")), ("endpoint", ("id", "secret"))):
            for a, b, kind in roles.get(role, []):
                if kind in WEAK and any(p in sides and _near(*sides[p], a, b, gap) for p in partners):
                    found.append((a, b, kind))
    return found


def secret_spans(text: str | None, policy: LinkPolicy = LinkPolicy()) -> list[tuple[int, int, str]]:
    """All reported spans by start, then kind."""
    base = base_spans(text or "")
    order = (*KINDS, *WEAK)
    return sorted({*base, *weak_spans(text or "", base, policy)}, key=lambda x: (x[0], order.index(x[2]), x[1]))


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_secrets(docs: DataFrame, text: str = "text", policy: LinkPolicy = LinkPolicy()) -> DataFrame:
    """``docs`` with secrets: an array of (start, end, kind), code points, end exclusive, by start and then kind.

    Null text: empty. Empty table: no rows. Repeated rows are scanned alike. A column named secrets is replaced, all
    others stay. A scope never leaves its document, so the interval join needs no shuffle.
    """

    def make(texts: list) -> list[pa.Array]:
        return [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in secret_spans(t, policy)] for t in texts], _ARROW)]

    return add_columns(docs, text, [T.StructField("secrets", T.ArrayType(_SPAN))], make)


def redact(text: str | None, policy: LinkPolicy = LinkPolicy()) -> str | None:
    """``text`` with every reported span replaced by [SECRET]; overlapping spans become one. Endpoints stay."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in secret_spans(text, policy):
        if kind == "endpoint" or b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", policy: LinkPolicy = LinkPolicy()) -> DataFrame:
    """``docs``, with the same columns in the same order, the text redacted and its length in ``n_chars`` renewed.

    Null text: stays null, as does its length. Empty and clean texts stay as they are. Repeated rows are redacted
    alike. Empty table: no rows. Columns may have any name.
    """
    cols = docs.columns

    def make(texts: list) -> list[pa.Array]:
        return [pa.array([redact(t, policy) for t in texts], pa.string())]

    out = add_columns(docs, text, [T.StructField(text, T.StringType())], make)
    if n_chars in cols:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col(f"`{text}`").isNull(), F.col(f"`{n_chars}`")).otherwise(F.length(f"`{text}`").cast(kind)))
    return out.select(*[f"`{c}`" for c in cols])


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_secrets(docs).drop("text")
    count = {k: F.size(F.filter(F.col("secrets.kind"), lambda x: x == F.lit(k))).cast("long") for k in KINDS}  # noqa: B023
    digest = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*KINDS))
    return rows.select(
        "doc_id", *[count[k].alias(f"n_{k}") for k in KINDS], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans")
    )


QUERIES = {"op4_secret_links": op4_secret_links}
ORACLES: dict = {}
