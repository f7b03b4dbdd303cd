"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed left to right into dictionary phrases: the shortest run that is
not in the dictionary yet becomes a phrase and starts the next one. The set of
phrases is hashed and reduced to a signature of ``BINS`` minimum hashes (one
permutation, cut into bins; an empty bin borrows from the next full one). The share
of equal bins estimates how much of their phrases two texts have in common, much
like how well one would compress given the other.

``edit_probe`` measures the fingerprint: each document is held against its next one
by id, and against an edited copy whose last half is replaced by the beginning of
the next. The first half is parsed once for both.

Edge cases: a null text is empty; an empty text has an empty fingerprint, alike (1)
to another empty one and unlike (0) to any other; equal ids are ordered by text;
a single document is its own next one; an empty table gives no rows.

Order is made by a range shuffle, so a task sees neighbours. Only the last document
of a task lacks its next one; these few edges are joined and finished in a second step.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.common import documents, only, slices, texts_of
from marquee.session import cut

BINS = 64
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
#: An empty bin of a signature without any phrase.
NONE = np.uint64(MASK)


def parse(text: str, known: set[str], phrase: str = "") -> tuple[list[int], str]:
    """Lengths of the new phrases in the order of the text, and the phrase left open; ``known`` grows."""
    lengths, add, done = [], known.add, len
    for c in text:
        phrase += c
        if phrase not in known:
            add(phrase)
            lengths.append(done(phrase))
            phrase = ""
    return lengths, phrase


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of runs of code points that follow each other."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, 1), powers(INVERSE, 1)

    def __call__(self, text: str, lengths: list[int]) -> np.ndarray:
        """One hash for each run; the runs lie one after the other from the start of the text."""
        n, ends = len(text), np.cumsum(np.array(lengths, np.int64))
        if n >= len(self.up):
            self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(code + np.uint64(1)) * self.up[:n], out=running[1:])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return mix((running[ends] - running[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum hashes by bin, 16 bits each; empty if there are no phrases."""
    if not len(hashes):
        return np.zeros(0, np.uint16)
    least = np.full(BINS, NONE)
    np.minimum.at(least, (hashes >> np.uint64(58)).astype(np.int64), hashes & np.uint64((1 << 58) - 1))
    full = np.flatnonzero(least != NONE)
    source = full[np.searchsorted(full, np.arange(BINS)) % len(full)]
    away = ((source - np.arange(BINS)) % BINS).astype(np.uint64)
    return (mix(least[source] + away * np.uint64(BASE)) & np.uint64(0xFFFF)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def fingerprint(text: str) -> str:
    """The signature of one text in hexadecimal."""
    return signature(Hasher()(text, parse(text, set())[0])).tobytes().hex()


class Probe:
    """Fingerprints of a document and of its edited copy."""

    def __init__(self) -> None:
        self.hash = Hasher()

    def of(self, text: str) -> np.ndarray:
        return signature(self.hash(text, parse(text, set())[0]))

    def both(self, text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
        half = len(text) // 2
        kept, known = text[: len(text) - half], set()
        first, phrase = parse(kept, known)
        edited = kept + following[:half]
        mine, _ = parse(text[len(kept) :], set(known), phrase)
        other, _ = parse(edited[len(kept) :], known, phrase)
        return signature(self.hash(text, first + mine)), edited, signature(self.hash(edited, first + other))


FIELDS = "doc_id long, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
COLUMNS = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def finished(probe: Probe, doc_id: int | None, text: str, following: str, next_signature=None) -> tuple[tuple, np.ndarray]:
    """A result row without the likeness to the next document, and the document's signature."""
    own, edited, other = probe.both(text, following)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    near = None if next_signature is None else likeness(own, next_signature)
    return (doc_id, len(text), sha, own.tobytes(), other.tobytes(), likeness(own, other), near), own


def in_order(batches):
    """Rows of one task, sorted: results for all documents but the last; the first and the last go on with their text."""
    probe, held, first = Probe(), None, True
    rows: list[tuple] = []
    ready, before = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*COLUMNS, "edge", "part", "text"])

    for batch in slices(batches):
        for doc_id, text, part in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")).to_pylist(), batch.column("part").to_pylist(), strict=True):
            if first:
                rows.append((doc_id, None, None, probe.of(text).tobytes(), None, None, None, 1, part, text))
                first = False
            if held is not None:
                row, own = finished(probe, held[0], held[1], text)
                if ready is not None:
                    rows.append((*ready[:-1], likeness(before, own), 0, part, None))
                ready, before = row, own
            held = (doc_id, text, part)
        if rows:
            yield batch_of(rows)
            rows = []
    if held is not None:
        if ready is not None:
            rows.append((*ready[:-1], likeness(before, probe.of(held[1])), 0, held[2], None))
        rows.append((held[0], None, None, None, None, None, None, 2, held[2], held[1]))
        yield batch_of(rows)


def across(batches):
    """The last document of a task with the first of the next."""
    probe = Probe()
    for batch in slices(batches):
        rows = [
            finished(probe, r["doc_id"], r["text"], r["next_text"], np.frombuffer(r["next_fingerprint"], "<u2"))[0] for r in batch.to_pylist()
        ]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)


def edit_probe(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, both fingerprints, and the likeness to the edited copy and the next document."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    done = cut(ordered.mapInArrow(in_order, FIELDS + ", edge int, part int, text string"))
    firsts = done.filter("edge = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = done.filter("edge = 2").select("doc_id", "text", "part")
    # One row for each task, without texts.
    parts = done.filter("edge = 1").select("part")
    order = W.orderBy("part")
    start = F.min("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    links = parts.select("part", F.coalesce(F.lead("part").over(order), start).alias("next_part"))
    edges = lasts.join(links, "part").join(firsts, "next_part").select("doc_id", "text", "next_text", "next_fingerprint")
    rows = done.filter("edge = 0").select(*COLUMNS).unionByName(edges.mapInArrow(across, FIELDS))
    text = [F.lower(F.hex(c)).alias(name) for c, name in (("edited", "edited_sha256"), ("fingerprint", "fingerprint"), ("edited_fingerprint", "edited_fingerprint"))]
    return rows.select("doc_id", "n_chars", *text, "near_edited", "near_next")


def op9_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(only(documents(spark, sf_dir), "doc_id", "text"))
