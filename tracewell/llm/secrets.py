"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its whole text. A blob
is scanned once for each version of the rules, whatever the number of paths
that hold it, and the findings are joined back to all paths. The ledger of what
has been scanned lies in a table of its own (:func:`scan_into`): a later run reads
it, scans what it lacks, and adds that.

Defined cases: a null text is an empty blob; an empty blob has no findings;
repeated rows are repeated in the result; a null path is kept as a path;
other columns pass through untouched in :func:`redact` and are left out of
the findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import exists, shielded, stored, text_or_empty

#: Raise when a rule changes: blobs are then scanned again.
RULES_VERSION = 4

#: Fixed patterns: kind, pattern, group whose length counts, least length.
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A private key: to the END of the same label where no other key begins before it, or else over headers and base64 lines.
_PEM = (
    r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY((?: BLOCK)?)-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY\2-----"
    r"|(?:(?:\\[rn]|[\s\"',>])*[A-Z][A-Za-z-]{1,30}: [^\n\\]*(?=\n|\\))*"
    r"(?:(?:\\[rn]|[\s\"',>])*[A-Za-z0-9+/]{16,}={0,2})*"
    r"(?:(?:\\n|\r?\n)[ \t]*[A-Za-z0-9+/]{1,15}={0,2}(?=[ \t]*(?:[\r\n\\\"']|\Z)))?)"
)
#: Rules of this operator beside the base ones.
MORE_RULES = (
    ("pem", _PEM, 0, 1),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]*:[^\s:/@]{6,}@", 0, 1),
)
KINDS = tuple(r[0] for r in BASE_RULES + MORE_RULES)
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

# A match below the least length still uses up its characters, so the length is
# tested after the match. Maximal runs of one class are the exception: there a
# counted pattern finds the same runs and skips the short ones faster.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@lru_cache(maxsize=1)
def _compiled() -> dict[str, re.Pattern]:
    got = {k: re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)) for k, p, _, _ in BASE_RULES + MORE_RULES}
    got["hex"] = re.compile(r"[0-9a-f]{16,}")
    return got


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text: (kind, start, end) in code points, by start, then kind as listed."""
    rx, found = _compiled(), []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in rx["assign"].finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in rx["access"].finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in rx["hex"].finditer(text)]
    for kind, hint in (("pem", "PRIVATE KEY"), ("jwt", "eyJ"), ("forge", "gh"), ("url_login", "://")):
        if hint in text:
            found += [(kind, *m.span()) for m in rx[kind].finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(x.as_py())] for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["blob", "spans"])


def blobs_of(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, content address and text of every version."""
    body = text_or_empty(text)
    return versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("body"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, *, path: str = "doc_id", text: str = "text", rules_version: int = RULES_VERSION) -> DataFrame:
    """Ledger rows (blob, rules_version, spans) of the blobs that ``ledger`` lacks for this version of the rules.

    One version of each unseen blob is chosen on narrow rows; only the chosen
    texts are scanned, in place where the join leaves them.
    """
    every = blobs_of(versions, path, text)
    # Paths may be null or repeat.
    first = every.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        first = first.join(ledger.filter(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")
    chosen = every.alias("e").join(first.alias("f").hint("shuffle_hash"), (F.col("e.path").eqNullSafe(F.col("f.path"))) & (F.col("e.blob") == F.col("f.blob")), "left_semi")
    found = chosen.select("blob", "body").mapInArrow(_scan, f"blob string, spans {SPANS}")
    # Rows that repeat path and text together were scanned alike; one of them stays.
    return found.groupBy("blob").agg(F.first("spans").alias("spans")).withColumn("rules_version", F.lit(rules_version))


def findings(versions: DataFrame, ledger: DataFrame, *, path: str = "doc_id", text: str = "text", rules_version: int = RULES_VERSION) -> DataFrame:
    """path, blob and spans of every version, from the ledger."""
    known = ledger.filter(F.col("rules_version") == rules_version).select("blob", "spans")
    paths = blobs_of(versions, path, text).select("path", "blob")
    return paths.join(known, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan_all(versions: DataFrame, ledger: DataFrame | None = None, *, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every version, ledger with what was new)."""
    new = stored(scan_unseen(versions, ledger, path=path, text=text), "blob-ledger", keep=True)
    whole = new if ledger is None else ledger.select(new.columns).unionByName(new)
    return findings(versions, whole, path=path, text=text), whole


def scan_into(versions: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every version, ledger), with the ledger kept as a table at ``path``.

    Blobs that an earlier run scanned with these rules are not scanned again. What
    two runs at one time both add counts once.
    """
    spark = versions.sparkSession
    read = lambda: spark.read.schema(f"blob string, spans {SPANS}, rules_version int").parquet(path).dropDuplicates(["blob", "rules_version"])
    before = read() if exists(spark, path) else None
    scan_unseen(versions, before, path=key, text=text).write.mode("append").parquet(path)
    ledger = read()
    return findings(versions, ledger, path=key, text=text), ledger


def cut_out(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` with each span replaced by ``<secret>``, in one pass; spans are in order of their starts and may overlap, then one mark stands for them."""
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        if s >= at:
            out += [text[at:s], "<secret>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(versions: DataFrame, ledger: DataFrame, *, text: str = "text") -> DataFrame:
    """``versions`` with every secret span of ``text`` replaced by ``<secret>``; texts without one stay as they are."""

    @F.pandas_udf("string")
    def cut(body: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_out(t, list(s), list(e)) for t, s, e in zip(body, starts, ends, strict=True)], dtype=object)

    known = ledger.filter((F.col("rules_version") == RULES_VERSION) & (F.size("spans") > 0)).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))

    def work(docs: DataFrame) -> DataFrame:
        joined = docs.withColumn("_blob", F.sha2(text_or_empty(text), 256)).join(known, "_blob", "left")
        found = F.col("_spans").isNotNull()
        # Only texts with a secret go to the function.
        redacted = cut(F.when(found, F.col(text).cast("string")), F.col("_spans")["start"], F.col("_spans")["end"])
        return joined.withColumn("_text", redacted).withColumn(text, F.when(found, F.col("_text")).otherwise(F.col(text))).select(docs.columns)

    return shielded(versions, work)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""
    base = [r[0] for r in BASE_RULES]
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    spelled = lambda c: F.array_join(F.transform(c, mark), ",")
    only = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(only(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(spelled(only(*base)), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
