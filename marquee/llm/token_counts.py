"""Token counts of whole texts by a map-side lookup in two tiers.

The tokenizer writes a space as a mark before the word it precedes, and no piece of its
vocabulary has a mark behind another character. So a text falls apart wherever a run of
spaces begins, and the counts of these pre-tokens add up to that of the text.
``check_pieces`` refuses a vocabulary for which this does not hold.

A first pass over all documents finds frequent pre-tokens: each task keeps a bounded
summary (Misra and Gries), which holds every pre-token that makes up more than 1 in
``HELD`` of the task's; only summaries are added up. The ``TABLE`` most frequent and
their token counts are broadcast (at most ``TABLE * LONGEST`` bytes of text). In the
second pass the different pre-tokens of a slice of text are looked up in that table,
those missing in a cache of the Python worker, and what is missing there is encoded.
Pre-tokens are never shuffled, and no result depends on what the table or a cache holds.

Edge cases: a null text is empty; an empty text has no bytes and no tokens; each row is
counted for itself, so repeated rows and null ids give a row each; an empty table gives no
rows. A text of any length is handled whole, longer pre-tokens than ``LONGEST`` bytes are
encoded without being remembered.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import documents, only, shipped, slices, sums, texts_of
from marquee.llm.packing import tokenizer_path

TOKENIZER = "piece_bpe_32k.model"
#: Tokens beyond which a document is over the limit.
LIMIT = 4096
#: Entries of the broadcast table, of a task's summary, and of a worker's cache.
TABLE, HELD, REMEMBERED = 16_384, 4_096, 400_000
#: The longest pre-token, in bytes, that the table and the caches hold.
LONGEST = 64
#: Text handled at once, in bytes.
SLICE = 8 << 20
#: The tokenizer's mark for a space.
MARK = "▁"


def check_pieces(processor) -> None:
    """Refuse a vocabulary with a mark behind another character."""
    for k in range(processor.get_piece_size()):
        if MARK in processor.id_to_piece(k).lstrip(MARK):
            raise ValueError(f"piece {k} joins two words, so pre-tokens cannot be counted apart")


def loaded(tokenizer: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_path(tokenizer))


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the texts, and their pre-tokens in a row, each with the spaces before it.

    The mark itself counts as a space, and every text that is not empty gets a space in front.
    """
    texts = pc.replace_substring(texts, MARK, " ")
    full = pc.greater(pc.binary_length(texts), 0)
    texts = pc.binary_join_element_wise(pc.if_else(full, " ", ""), texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = np.concatenate([[0], ends])
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int32)[texts.offset] if len(texts) else 0
    data = np.frombuffer(data or b"", np.uint8)[begin : begin + int(first[-1])]
    space = data == 32
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[first[:-1][first[:-1] < first[1:]]] = True  # a text also begins one if the text before ends with a space
    at = np.flatnonzero(starts)
    bounds = np.append(at, len(data)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data))
    return np.searchsorted(at, first), units


def joined(keys: list[pa.Array], counts: list[np.ndarray], most: int) -> tuple[pa.Array, np.ndarray]:
    """The sum of summaries, cut to ``most`` entries by taking the next largest count off each."""
    coded = pa.concat_arrays(keys).dictionary_encode()
    total = np.bincount(coded.indices.to_numpy(), np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
    if len(total) > most:
        total = total - np.partition(total, -most - 1)[-most - 1]
    kept = total > 0
    return coded.dictionary.filter(pa.array(kept)), total[kept]


def summaries(docs: DataFrame) -> DataFrame:
    """``unit, n``: of each task at most ``HELD`` pre-tokens, with counts that are never too high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = pa.array([], pa.string()), np.zeros(0, np.int64)
        for batch in slices(batches, size=SLICE):
            coded = pre_tokens(texts_of(batch.column("text")))[1].dictionary_encode()
            short = pc.less_equal(pc.binary_length(coded.dictionary), LONGEST)
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            keys, counts = joined([keys, coded.dictionary.filter(short)], [counts, n[short.to_numpy(zero_copy_only=False)]], HELD)
        yield pa.RecordBatch.from_arrays([keys, pa.array(counts)], ["unit", "n"])

    return only(docs, "text").mapInArrow(run, "unit string, n long")


def lengths_of(units: list[str], processor) -> list[int]:
    """Tokens of pre-tokens, the first space of which is the one that the tokenizer adds itself."""
    return [len(ids) for ids in processor.encode([u[1:] if len(u) > 1 else u for u in units], num_threads=1)] if units else []


def frequent(docs: DataFrame, tokenizer: str = TOKENIZER, most: int = TABLE) -> tuple[list[str], list[int]]:
    """The most frequent pre-tokens of all documents and their numbers of tokens."""
    processor = loaded(tokenizer)
    check_pieces(processor)
    found = summaries(docs).groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most).collect()
    units = [r["unit"] for r in found if r["unit"] != " "]
    return units, lengths_of(units, processor)


class Counter:
    """Numbers of tokens of pre-tokens: from the table, else from this worker's cache, else by encoding."""

    def __init__(self, units: list[str], lengths: list[int], tokenizer: str) -> None:
        self.table, self.lengths = pa.array(units, pa.string()), np.array([*lengths, 0], np.int64)
        self.processor, self.cache = loaded(tokenizer), {" ": 1}

    def of(self, units: pa.Array) -> np.ndarray:
        place = pc.fill_null(pc.index_in(units, self.table), len(self.table)).to_numpy()
        out, missed = self.lengths[place], np.flatnonzero(place == len(self.table))
        names = units.take(pa.array(missed)).to_pylist()
        unknown = [u for u in names if u not in self.cache]
        new = dict(zip(unknown, lengths_of(unknown, self.processor), strict=True))
        out[missed] = [new[u] if u in new else self.cache[u] for u in names]
        if len(self.cache) + len(new) > REMEMBERED:
            self.cache = {" ": 1}
        self.cache.update({u: n for u, n in new.items() if len(u) <= LONGEST})
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        offsets, units = pre_tokens(texts)
        coded = units.dictionary_encode()
        return sums(self.of(coded.dictionary)[coded.indices.to_numpy()], offsets).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id``, ``text``)."""
    spark = shipped(docs.sparkSession)
    table = spark.sparkContext.broadcast(frequent(docs, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*table.value, tokenizer)
        for batch in slices(batches, size=SLICE):
            texts = texts_of(batch.column("text"))
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
