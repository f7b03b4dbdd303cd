"""Secret scanning with an incremental ledger of content-addressed blobs.

A *version* is a text at a path (here: a document id). Versions are addressed by
the SHA-256 of their text, so a text that many paths share, or that comes back
later, is one blob. A blob is scanned with a rule only if the ledger does not hold
that (blob, rule, rule version) yet; raising a rule's version rescans with that
rule alone. Findings belong to blobs and are joined back to all paths.

Edge cases: a null text counts as the empty text; repeated rows and equal paths
keep their own result rows; overlapping spans of different rules are all
reported; an empty table gives no rows. Texts are deduplicated inside each task
before they are shuffled, so a text that a third of all paths share moves once
per task.
"""

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import documents, only, slices, texts_of

SPANS = "array<struct<kind:string,start:int,end:int>>"
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """A pattern; matches shorter than ``least`` characters (of ``group``) are no findings.

    A text without any of the ``hints`` (in lower case, looked up in the lower-cased
    text) cannot match. Without hints the pattern is tried on every text.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


# The patterns to find.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", group=2, least=12, hints=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("platform", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")),
)
BASE_KINDS = ("assign", "access", "hex")


def scanner(rules: tuple[Rule, ...]):
    """A function from a text and the kinds to look for to (kind, start, end), by start, then by order of the rules."""
    compiled = [(k, r, re.compile(r.pattern)) for k, r in enumerate(rules)]

    def scan(text: str, kinds: set[str] | None = None) -> list[tuple[str, int, int]]:
        low, found = text.lower(), []
        for k, rule, pattern in compiled:
            if kinds is not None and rule.kind not in kinds or rule.hints and not any(h in low for h in rule.hints):
                continue
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((m.start(), k, m.end()))
        return [(rules[k].kind, start, end) for start, k, end in sorted(found)]

    return scan


def blob_id(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the blobs of ``versions`` (column ``text``) that ``ledger`` lacks.

    Returns one row per blob that had something to scan: ``blob``, ``scanned``
    (array of rule and version now covered) and ``spans``. ``ledger`` has ``blob``
    and ``scanned`` of earlier runs, a blob possibly in several rows. Append the
    result to the ledger's store and later runs skip what it covers.
    """
    names = [f"{r.kind}:{r.version}" for r in rules]
    blobs = versions.select(blob_id().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    every = F.array(*[F.lit(n) for n in names])
    if ledger is None:
        todo = blobs.withColumn("scanned", every)
    else:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("done"))
        pending = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        todo = blobs.join(done, "blob", "left").withColumn("scanned", pending).drop("done").filter(F.size("scanned") > 0)

    def run(batches):
        scan, kind = scanner(rules), dict(zip(names, [r.kind for r in rules], strict=True))
        typed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan(text, {kind[n] for n in scanned})]
                for text, scanned in zip(texts_of(batch.column("text")).to_pylist(), batch.column("scanned").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("scanned"), pa.array(spans, typed)], ["blob", "scanned", "spans"])

    return todo.select("blob", "text", "scanned").mapInArrow(run, f"blob binary, scanned array<string>, spans {SPANS}")


def path_findings(versions: DataFrame, findings: DataFrame, path: str = "doc_id") -> DataFrame:
    """All versions with the spans of their blob: ``path`` and ``spans`` (empty if clean)."""
    paths = versions.select(path, blob_id().alias("blob"))
    spans = findings.filter(F.size("spans") > 0).select("blob", "spans")
    return paths.join(spans, "blob", "left").select(path, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact(docs: DataFrame, mask: str = MASK, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``, overlapping spans by one; other columns stay.

    ``n_chars``, if there, is set anew for changed texts. Texts without findings stay as they are.
    """
    columns = docs.columns
    findings = scan_versions(only(docs, "text"), None, rules).filter(F.size("spans") > 0)
    marked = docs.withColumn("__blob", blob_id()).join(findings.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), "__blob", "left")

    @F.pandas_udf("string")
    def masked(text, spans):
        import pandas as pd

        out = []
        for t, marks in zip(text, spans, strict=True):
            if t is not None and marks is not None:
                parts, at = [], 0
                for span in marks:
                    if span["end"] > at:
                        if span["start"] >= at:
                            parts += [t[at : span["start"]], mask]
                        at = span["end"]
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    # Only texts with findings are sent to Python.
    found = F.col("__spans").isNotNull()
    rows = marked.withColumn("__new", masked(F.when(found, F.col("text")), "__spans"))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(found, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.coalesce("__new", "text")).select(*[F.col(f"`{c}`") for c in columns])


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(documents(spark, sf_dir), "doc_id", "text")
    found = path_findings(docs, scan_versions(docs))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
