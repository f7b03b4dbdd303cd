"""Best-two-fit packing of tokenized documents into sequences of bounded length.

A bin is filled greedily with the longest piece that still fits. Then its
smallest piece is given back if two unpacked pieces fit the gap that this leaves
more tightly. The packer works on the *histogram* of piece lengths, which has at
most ``limit`` entries however many documents there are: equal lengths are
interchangeable, so one step packs as many bins alike as the histogram allows.
What comes out are runs "pieces number r to r + k of length L go to the bins from
number b on, at offset o", at most a few for each length. Pieces are numbered
within their length by a distributed ranking and find their run by binary search.

Edge cases: a null or empty text is one piece holding the end id alone; equal ids
or repeated rows are packed as separate pieces; an empty table gives no rows.
"""

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import documents, in_slices, only, ranges, texts_of, word_lists
from marquee.operators.ranking import ranked
from marquee.session import cut

LIMIT = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Text handled at once, in bytes.
SLICE = 8 << 20
#: Words, and units of words, whose ids a task remembers; when there are more it starts over.
REMEMBERED = 300_000


def tokenizer_path(name: str) -> str:
    """Where the named vocabulary lies on the machine that asks; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def printable_bytes() -> dict[int, str]:
    """The characters that stand for bytes inside the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Token ids of words. This tokenizer drops white space and never joins across it,
    so the ids of a text are those of its words one after the other.

    A word of Latin letters with trailing punctuation is two units to the tokenizer.
    Their ids come straight from its merge model and are remembered, up to a bound;
    every other word goes through the whole tokenizer.
    """

    simple = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@[-`{-~]*)")

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.model, self.table = self.tokenizer.model, printable_bytes()
        self.known: dict[str, list[int]] = {"": []}
        self.words: dict[str, list[int]] = {}

    def unit(self, text: str) -> list[int]:
        if (ids := self.known.get(text)) is None:
            if len(self.known) > REMEMBERED:
                self.known = {"": []}
            spelt = text if text.isascii() else "".join([self.table[b] for b in text.encode()])
            ids = self.known[text] = [t.id for t in self.model.tokenize(spelt)]
        return ids

    def __call__(self, words: list[str]) -> list[list[int]]:
        if len(self.words) > REMEMBERED:
            self.words = {}
        simple, memory = self.simple.fullmatch, self.words
        for word in words:
            if word in memory:
                continue
            if m := simple(word):
                letters, marks = m.groups()
                ids = self.unit(letters.lower())
                memory[word] = ids + self.unit(marks) if marks else ids
            else:
                memory[word] = self.tokenizer.encode(word, add_special_tokens=False).ids
        return [memory[word] for word in words]


def encode(texts: pa.Array, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each followed by the end id, and the offsets of the texts."""
    offsets, words = word_lists(texts)
    coded = words.dictionary_encode()
    ids = encoder(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
    token = coded.indices.to_numpy()
    running = np.concatenate([[0], np.cumsum(lengths[token])])
    ends = running[offsets[1:]] + np.arange(1, len(offsets))
    out = np.full(int(running[-1]) + len(offsets) - 1, END_ID, "<u4")
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = flat[ranges(starts[token], lengths[token])]
    return out, np.concatenate([[0], ends])


def cut_pieces(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token pieces of each document: whole if it fits, else runs of ``limit`` ids and a rest."""

    def work():
        encoder = WordEncoder(tokenizer)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, offsets = encode(texts_of(batch.column("text")), encoder)
            sizes = np.diff(offsets)
            counts = -(-sizes // limit)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = ranges(np.zeros(len(sizes), np.int64), counts)
            start = piece * limit
            length = np.minimum(limit, sizes[row] - start)
            at, raw = offsets[row] + start, memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

        return one

    def run(batches):
        yield from in_slices(work(), size=SLICE)(batches)

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES)


def best_two_fit(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many alike) for ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    sizes = np.arange(limit + 1)
    bins = []

    def below(extra: dict[int, int]) -> np.ndarray:
        """For each room, the longest piece that is left and fits; 0 if none."""
        free = left.copy()
        for size, n in extra.items():
            free[size] -= n
        return np.maximum.accumulate(np.where(free > 0, sizes, 0))

    top = limit
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return bins
        content, gap, used = [], limit, {}
        fit = below({})
        while fit[gap]:
            size = int(fit[gap])
            n = min(gap // size, int(left[size]) - used.get(size, 0))
            content += [size] * n
            used[size] = used.get(size, 0) + n
            gap -= n * size
            fit = below(used) if used[size] == left[size] else fit
        if gap and len(content) > 1:
            smallest = content[-1]
            room = gap + smallest
            held = dict(used)
            fit = below(held)
            first = sizes[1:room]
            first = first[(left[1:room] - np.array([held.get(int(s), 0) for s in first])) > 0]
            second = fit[room - first]
            # The same length twice needs two pieces of it; otherwise take the next shorter one.
            for k in np.flatnonzero(second == first):
                if left[first[k]] - held.get(int(first[k]), 0) < 2:
                    second[k] = fit[first[k] - 1]
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > smallest:
                k = int(total.argmax())
                content[-1:] = [int(first[k]), int(second[k])]
        kinds, times = np.unique(content, return_counts=True)
        n = int((left[kinds] // times).min())
        left[kinds] -= n * times
        bins.append((content, n))


def runs_of(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), by length and rank; a run ends where the next begins."""
    taken: dict[int, int] = {}
    rows, number = [], 0
    for content, n in bins:
        offset = 0
        for size in content:
            rank = taken.get(size, 0)
            rows.append((size, rank, number, offset))
            taken[size] = rank + n
            offset += size
        number += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Give every piece (``length`` from 1 to ``limit``) its ``sequence_id`` and ``offset``."""
    spark, pieces = pieces.sparkSession, cut(pieces)
    counts = np.zeros(limit + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``limit`` rows
        counts[length] = n
    runs = spark.sparkContext.broadcast(runs_of(best_two_fit(counts, limit)))

    def place(batches):
        size, rank, first, offset = runs.value.T
        key = size << 44 | rank
        for batch in batches:
            at = batch.column("position").to_numpy() - 1
            k = np.searchsorted(key, batch.column("length").to_numpy() << 44 | at, side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(first[k] + at - rank[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked(pieces, ["length"], ["doc_id", "piece"])
    return placed.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(cut_pieces(docs, limit, tokenizer), limit)


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
