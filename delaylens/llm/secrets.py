"""Secret scans with corpus-wide ownership frequency.

``scan`` finds candidate credentials in each text; values leave the task only
as SHA-256 digests. ``ownership`` counts, per digest, the distinct owners and
repositories that hold it, in three aggregations that each combine on the map
side, so a value copied everywhere costs no more than a rare one.
``classify`` calls a value an example if ``example_owners`` owners or more hold
it, and otherwise live. Base kinds are always reported; values of the other
kinds are reported where they are live.

Defined results: a null text is empty and has no candidates; a null owner or
repository counts as one owner or repository of its own. Rows that share id and
text are copies with equal results; they count once for each owner. Rows that
share an id but not a text stay apart. Extra columns are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_on_rows, map_arrow, stage, text_key, text_or_empty

# The base kinds in the order in which equal starts are listed.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Further kinds: (name, pattern). Their spans are added where they are live.
MORE_KINDS = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    ("google", r"AIza[A-Za-z0-9_-]{35}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),  # searched by _tokens
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
)
KINDS = BASE_KINDS + tuple(name for name, _ in MORE_KINDS)
MIN_ASSIGNED = 8
EXAMPLE_OWNERS = 3

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_REST = tuple((KINDS.index(k), re.compile(p)) for k, p in (("access", ACCESS), ("hex", HEX), *MORE_KINDS) if k != "jwt")
_JWT = KINDS.index("jwt")
_RUN = re.compile(r"[A-Za-z0-9_-]{8,}+")


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """What the jwt pattern finds, in one pass over the runs between dots: the
    pattern itself would read a run again from every eyJ in it."""
    if ".eyJ" not in text:
        return []
    found, at = [], 0
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    for (a, b), (c, d), (e, f) in zip(runs, runs[1:], runs[2:]):
        if a < at or c != b + 1 or e != d + 1 or text[b] != "." or text[d] != "." or d - c < 11 or not text.startswith("eyJ", c):
            continue
        start = text.find("eyJ", a, b)
        if 0 <= start <= b - 11:
            found.append((start, f, text[start:f]))
            at = f
    return found


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) in order, in code points."""
    found = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGNED]
    for kind, pattern in _REST:
        found += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text)]
    found += [(a, _JWT, b, value) for a, b, value in _tokens(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


CANDIDATE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: __id, __key, owner, repository, base counts,
    base_sha256 and the candidates with the digests of their values."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        text_key(text).alias("__key"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        text.alias("__text"),
    )
    kept = ["__id", "__key", "owner", "repository"]
    ddl = ", ".join(f"{c} {t}" for c, t in rows.select(*kept).dtypes) + (
        ", n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,"
        " found array<struct<start: int, kind: int, end: int, digest: binary>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, found = [], []
            for value in batch.column(4):
                spans = candidates(value.as_py())
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append(
                    [{"start": a, "kind": k, "end": b, "digest": hashlib.sha256(v.encode()).digest()} for a, k, b, v in spans]
                )
            out = [*batch.columns[:4], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string())]
            out.append(pa.array(found, pa.list_(CANDIDATE)))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return map_arrow(rows, run, ddl)


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate digest."""
    held = scanned.select("owner", "repository", F.explode("found.digest").alias("digest"))
    return (
        held.groupBy("digest", "owner", "repository")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_found"))
    )


def classify(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(__id, __key, spans): the spans of each text that has any, in order,
    as structs of start, kind, end, base and live."""
    once = scanned.filter(F.size("found") > 0).dropDuplicates(["__id", "__key"])
    spans = once.select("__id", "__key", F.explode("found").alias("f")).select("__id", "__key", "f.*")
    live = (F.col("n_owners") < example_owners).alias("live")
    return (
        spans.join(ownership(scanned), "digest")
        .select("__id", "__key", F.struct("start", "kind", "end", (F.col("kind") < len(BASE_KINDS)).alias("base"), live).alias("s"))
        .groupBy("__id", "__key")
        .agg(F.sort_array(F.collect_list("s")).alias("spans"))
    )


def span_list(spans: Column) -> Column:
    """Spans that are reported, as kind:start:end joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.filter(spans, lambda s: s["base"] | s["live"])
    return F.array_join(F.transform(told, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    example_owners: int = EXAMPLE_OWNERS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, base counts, base_sha256, spans, n_live and
    n_example (spans of live and of widely copied values)."""
    scanned = stage(scan(docs, owner, repository, id_col, text_col), "secrets")
    told = classify(scanned, example_owners)
    spans = F.coalesce(F.col("spans"), F.array().cast(told.schema["spans"].dataType))
    return join_on_rows(scanned, told, "left").select(
        F.col("__id").alias(id_col),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        span_list(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def mask_live(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    example_owners: int = EXAMPLE_OWNERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    mask: str = "[SECRET]",
) -> DataFrame:
    """All rows of ``docs``; live values are replaced by ``mask`` in the text.

    Overlapping live spans are replaced together. Texts without live spans,
    null texts too, stay as they are.
    """
    scanned = stage(scan(docs, owner, repository, id_col, text_col), "secrets")
    told = classify(scanned, example_owners).select("__id", "__key", F.filter("spans", lambda s: s["live"]).alias("__live"))
    told = stage(told.filter(F.size("__live") > 0), "secrets-live")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(id_col).alias("__id"),
        text_key(text_or_empty(text_col)).alias("__key"),
    )
    text = F.col(f"__row.`{text_col}`")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        plain = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh = s["start"] >= a["at"]
        return F.struct(
            F.concat(a["out"], plain, F.when(fresh, mask).otherwise("")).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        )

    rebuilt = F.aggregate("__live", state, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.col("__live").isNull(), text).otherwise(rebuilt)
    return join_on_rows(packed, told, "left").select(F.col("__row").withField(f"`{text_col}`", masked).alias("__row")).select("__row.*")
