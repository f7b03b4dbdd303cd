"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model over words and the end of the text. Its root
state has an arc for every word; every word of the training texts has a state of its
own, with an arc for each follower seen and a failure arc to the root that carries the
weight left over (absolute discounting, interpolated with the root). Reading a text left to
right, the state after a word is that word's, or the root; the log10 weights of the
arcs taken add up to the score. The arcs of a state and its failure arc share out
one, so a text's score is the log10 of its probability.

The vocabulary and the arcs grow with the corpus, so the model is never in one
place. Documents are dealt into chunks of bounded size, by the part of the input
file they lie in, and keys into buckets. Each chunk counts what it holds, once per different
word and bigram, as one row of sorted arrays per bucket; the counts are summed by key over all
chunks, and each chunk gets back the sums alone, in the order of the keys that it sent,
for a word with the number of its different followers. With them a chunk has the part of the
automaton that its documents can reach. Bigrams go to the bucket of their first word, those of
frequent words to that of the bigram, so no bucket is hot. Nothing but two totals and the
frequent words is sent to all tasks.

Words and bigrams are told apart by 64-bit hashes.

Edge cases: a null text is empty; an empty text is the end token alone; documents
with a null id are not learned from; repeated rows are learned from and scored each;
without training documents every token has the same chance; an empty table gives no
rows.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import SLICE_BYTES, documents, id_bucket, only, slices, texts_of, word_lists
from marquee.llm.phrases import BASE, INVERSE, mix, powers
from marquee.session import cut

#: Share of the training tokens beyond which a word has a state: all words that occur have one.
CONTEXT = 0
#: Occurrences that a bigram needs to be an arc, and what is taken off its count.
LEAST, DISCOUNT = 1, 0.75
#: Input file bytes whose documents are scored together.
CHUNK_BYTES = 8 << 20
#: Different keys that a task counts before it passes them on.
HELD = 2_000_000
#: Text for which there is a bucket of keys, in bytes.
BUCKET_BYTES = 4 << 20
#: Occurrences beyond which the bigrams of a word are dealt over all buckets.
HOT = 100_000
END = np.int64(0)


def word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, never that of the end token."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    up, down = powers(BASE, len(data) + 1), powers(INVERSE, len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=running[1:])
    starts, ends = offsets[:-1], offsets[1:]
    keys = mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64)
    return np.where(keys == END, np.int64(1), keys)


@dataclass
class Tokens:
    """The tokens of some texts: position in ``keys`` per token (end tokens included), and the texts' offsets."""

    token: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Tokens":
        offsets, words = word_lists(pc.ascii_lower(texts))
        coded = words.dictionary_encode()
        keys = np.append(word_keys(coded.dictionary), END)
        ends = offsets[1:] + np.arange(1, len(offsets))
        token = np.full(len(words) + len(offsets) - 1, len(keys) - 1, np.int64)
        inside = np.ones(len(token), bool)
        inside[ends - 1] = False
        token[inside] = coded.indices.to_numpy()
        return cls(token, np.concatenate([[0], ends]), keys)

    def per_token(self, per_text: np.ndarray) -> np.ndarray:
        return np.repeat(per_text, np.diff(self.offsets))

    def followers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of tokens that follow a word of their text, the word's position in ``keys``, and the bigrams' keys."""
        before = self.token[:-1]
        at = np.flatnonzero(before != len(self.keys) - 1) + 1
        word, keys = self.token[at - 1], self.keys.view(np.uint64)
        return at, word, mix(keys[word] * np.uint64(0x9E3779B97F4A7C15) + keys[self.token[at]]).view(np.int64)


def bucket_of(keys: np.ndarray, states: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: that of its state, or its own if the state is hot."""
    return np.where(np.isin(states, hot), keys, states) % buckets


def list_of(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """All numbers in a column of lists, in a row."""
    return np.concatenate([np.zeros(0, np.int64), *[part.flatten().to_numpy(zero_copy_only=False) for part in column.chunks]])


class Tally:
    """Counts by chunk and key, merged from time to time; ``states`` are the words that bigrams start with, ``seen``
    counts all documents and ``n`` those learned from."""

    def __init__(self, hot: np.ndarray, buckets: int) -> None:
        self.hot, self.buckets = hot, buckets
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.size = 0

    def add(self, chunk: int, keys: np.ndarray, states: np.ndarray, n: np.ndarray, seen: np.ndarray) -> None:
        self.parts.setdefault(chunk, []).append((keys, states, n.astype(np.int32), seen.astype(np.int32)))
        self.size += len(keys)

    def merge(self) -> None:
        self.size = 0
        for chunk, parts in self.parts.items():
            if len(parts) > 1:
                key, state, *counts = [np.concatenate(values) for values in zip(*parts, strict=True)]
                parts.clear()
                order = np.argsort(key)
                key = key[order]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                parts.append((key[starts], state[order[starts]], *(np.add.reduceat(n[order], starts, dtype=np.int32) for n in counts)))
            self.size += len(parts[0][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        while self.parts:
            chunk, [(keys, states, n, seen)] = self.parts.popitem()
            bucket = bucket_of(keys, states, self.hot, self.buckets)
            order = np.lexsort((keys, states, bucket))
            bucket = bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            offsets = np.append(starts, len(bucket))
            lists = [list_of(values[order], offsets) for values in (keys, states, n, seen)]
            batch = pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), chunk)), *lists], ["bucket", "chunk", "key", "state", "n", "seen"])
            step = max(1, 100_000 * len(starts) // max(1, len(keys)))
            for k in range(0, len(starts), step):
                yield batch.slice(k, step)
        self.size = 0


def tallied(chunked: DataFrame, buckets: int, hot: np.ndarray | None = None) -> DataFrame:
    """``bucket, chunk, key, n`` and more: for the tokens that any document of a chunk has, how often its training documents
    have them (``n``) and all (``seen``); or, if the ``hot`` words are given, for the bigrams, with their first words (``state``).

    A row holds all keys of its bucket, in the order of state and key.
    """
    bigrams = hot is not None
    fields = ["bucket", "chunk", "key", "state" if bigrams else "seen", "n"]

    def run(batches):
        tally = Tally(hot if bigrams else np.zeros(0, np.int64), buckets)

        def rows():
            for batch in tally.rows():
                yield batch.select(fields)

        for batch in slices(batches, size=SLICE_BYTES // 4):
            tokens = Tokens.of(texts_of(batch.column("text")))
            train = tokens.per_token(batch.column("train").to_numpy(zero_copy_only=False))
            chunk = batch.column("chunk").to_numpy()
            at, word, keys = tokens.followers() if bigrams else (np.arange(len(tokens.token)), None, None)
            for c in np.unique(chunk):
                here = tokens.per_token(chunk == c)[at]
                if keys is None:
                    seen = np.bincount(tokens.token[here], minlength=len(tokens.keys))
                    n, used = np.bincount(tokens.token[here & train], minlength=len(tokens.keys)), seen > 0
                    tally.add(int(c), tokens.keys[used], tokens.keys[used], n[used], seen[used])
                else:
                    found, one, place = np.unique(keys[here], return_index=True, return_inverse=True)
                    n = np.bincount(place, train[at][here], len(found))
                    tally.add(int(c), found, tokens.keys[word[here][one]], n, n)
            if tally.size > HELD:
                tally.merge()
                if tally.size > HELD // 2:
                    yield from rows()
        yield from rows()

    return chunked.select("text", "train", "chunk").mapInArrow(run, f"bucket long, chunk long, key array<long>, {fields[3]} array<{'long' if bigrams else 'int'}>, n array<int>")


@dataclass
class Bucket:
    """The rows of one bucket: its different ``keys`` with their ``states``, in the order of the rows, and their counts ``c`` over
    all chunks; the place in ``keys`` of each number in the rows; and the chunks with the keys that each sent."""

    keys: np.ndarray
    states: np.ndarray
    place: np.ndarray
    c: np.ndarray
    chunks: np.ndarray
    sent: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> "Bucket":
        key = numbers(rows.column("key"))
        state = numbers(rows.column("state")) if "state" in rows.column_names else key
        order = np.lexsort((key, state))
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        c = np.bincount(place, numbers(rows.column("n")), len(first)).astype(np.int64)
        chunks, number = np.unique(rows.column("chunk").to_numpy(), return_inverse=True)
        lengths = np.concatenate([pc.list_value_length(part).to_numpy() for part in rows.column("key").chunks])
        # A chunk that was passed on in parts may have sent a key more than once.
        sent = np.unique(np.repeat(number, lengths) * len(first) + place)
        offsets = np.searchsorted(sent, np.arange(len(chunks) + 1) * len(first))
        return cls(key[first], state[first], place, c, chunks, sent % max(1, len(first)), offsets)

    def told(self, of_key: np.ndarray) -> pa.ListArray:
        """A number of each key, for each chunk those of the keys that it sent."""
        return list_of(of_key[self.sent], self.offsets)


@dataclass
class Automaton:
    """The part of the model that a chunk of documents can reach."""

    tokens: int
    words: int
    #: Keys of the words that have a state, sorted; how often each occurs; the share left for the root.
    states: np.ndarray
    counts: np.ndarray
    failure: np.ndarray

    def root(self, c: np.ndarray) -> np.ndarray:
        """Weight of the root's arc for a token seen ``c`` times."""
        return (c + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def traverse(self, tokens: Tokens, token_counts: np.ndarray, at: np.ndarray, word: np.ndarray, arc_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 weights of the root's arcs, and of the arcs taken from the states that the texts run through.

        ``token_counts`` belong to ``tokens.keys``; ``arc_counts`` are those of the bigrams at ``at``, which start with ``word``.
        """
        root = self.root(token_counts)[tokens.token]
        taken = root.copy()
        if len(self.states):
            place = np.minimum(np.searchsorted(self.states, tokens.keys), len(self.states) - 1)
            place = np.where(self.states[place] == tokens.keys, place, -1)[word]
            at, state, c = at[place >= 0], place[place >= 0], arc_counts[place >= 0]
            taken[at] = np.where(c >= LEAST, (c - DISCOUNT) / self.counts[state], 0.0) + self.failure[state] * root[at]
        return np.log10(root), np.log10(taken)


def split_bytes(spark: SparkSession) -> int:
    """The most that Spark reads of a file in one task, from a setting like 134217728b, 16m or 128MB."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def chunks(docs: DataFrame, train) -> DataFrame:
    """``doc_id, text, train, held_out, chunk``; ``docs`` is read from files."""
    parts = max(1, -(-split_bytes(docs.sparkSession) // CHUNK_BYTES))
    place = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), place.alias("chunk"))


def bucket_count(chunked: DataFrame) -> int:
    size = chunked.agg(F.sum(F.octet_length("text"))).first()[0]
    return 1 + (size or 0) // BUCKET_BYTES


def word_totals(words: DataFrame) -> DataFrame:
    """Of each bucket: training tokens, different ones among them, and its hot words."""
    least = HOT

    def run(rows: pa.Table) -> pa.Table:
        bucket = Bucket.of(rows)
        seen = np.bincount(bucket.place, numbers(rows.column("seen")), len(bucket.keys))
        hot = bucket.keys[seen > least].tolist()
        return pa.table({"total": [int(bucket.c.sum())], "different": [int((bucket.c > 0).sum())], "hot": pa.array([hot], pa.list_(pa.int64()))})

    return words.groupBy("bucket").applyInArrow(run, "total long, different long, hot array<long>")


def arcs_of(key: tuple, rows: pa.Table) -> pa.Table:
    """What each chunk is told of its bigrams in a bucket; and, in a row without a chunk, the words that they start with and
    the different followers of each among them."""
    bucket = Bucket.of(rows)
    states, at = np.unique(bucket.states, return_inverse=True)
    followers = np.bincount(at, bucket.c >= LEAST, len(states)).astype(np.int64)
    told, none = bucket.told(bucket.c), pa.nulls(1, pa.list_(pa.int64()))
    chunks = len(bucket.chunks)
    columns = {
        "bucket": pa.array([key[0].as_py()] * (chunks + 1), pa.int64()),
        "chunk": pa.concat_arrays([pa.array(bucket.chunks), pa.nulls(1, pa.int64())]),
        "c": pa.concat_arrays([told, none]),
        "state": pa.concat_arrays([pa.nulls(chunks, pa.list_(pa.int64())), list_of(states, [0, len(states)])]),
        "followers": pa.concat_arrays([pa.nulls(chunks, pa.list_(pa.int64())), list_of(followers, [0, len(states)])]),
    }
    return pa.table(columns)


TOLD = "chunk long, arc boolean, bucket long, c array<long>, followers array<long>"


def words_of(key: tuple, rows: pa.Table, followers: pa.Table) -> pa.Table:
    """What each chunk is told of its words in a bucket."""
    if not rows.num_rows:
        lists = pa.list_(pa.int64())
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), lists, lists)], [f.split()[0] for f in TOLD.split(", ")])
    bucket = Bucket.of(rows)
    # The followers of a hot word were counted in several buckets.
    place = np.searchsorted(bucket.keys, followers.column("state").to_numpy())
    number = np.bincount(place, followers.column("followers").to_numpy(), len(bucket.keys)).astype(np.int64)
    chunks = len(bucket.chunks)
    columns = [pa.array(bucket.chunks), pa.array(np.zeros(chunks, bool)), pa.array(np.full(chunks, key[0].as_py())), bucket.told(bucket.c), bucket.told(number)]
    return pa.table(columns, [f.split()[0] for f in TOLD.split(", ")])


@dataclass
class Learned:
    """Training tokens, different ones among them, the hot words, the number of buckets, and what each chunk is told: per
    bucket the counts (and, of words, followers) of its keys in their order."""

    total: int
    different: int
    hot: np.ndarray
    buckets: int
    told: DataFrame


def learn(chunked: DataFrame) -> Learned:
    buckets = bucket_count(chunked)
    words = cut(tallied(chunked, buckets))
    totals = word_totals(words).collect()
    hot = np.array(sorted(k for r in totals for k in r["hot"]), np.int64)
    bigrams = tallied(chunked, buckets, hot).groupBy("bucket")
    bigrams = cut(bigrams.applyInArrow(arcs_of, "bucket long, chunk long, c array<long>, state array<long>, followers array<long>"))
    followers = bigrams.filter("chunk IS NULL").select(F.explode(F.arrays_zip("state", "followers")).alias("word")).select("word.*")
    followers = followers.withColumn("bucket", F.pmod("state", F.lit(buckets)))
    told = words.groupBy("bucket").cogroup(followers.groupBy("bucket")).applyInArrow(words_of, TOLD)
    arcs = bigrams.filter("chunk IS NOT NULL").select("chunk", F.lit(True).alias("arc"), "bucket", "c", F.lit(None).cast("array<long>").alias("followers"))
    return Learned(sum(r["total"] for r in totals), sum(r["different"] for r in totals), hot, buckets, told.unionByName(arcs))


def looked_up(keys: np.ndarray, states: np.ndarray, hot: np.ndarray, buckets: int, told: pa.Table, column: str = "c") -> np.ndarray:
    """The numbers told of the keys of a chunk."""
    order = np.lexsort((keys, states, bucket_of(keys, states, hot, buckets)))
    out = np.zeros(len(keys))
    out[order] = numbers(told.sort_by("bucket").column(column))
    return out


def distinct(keys: list[np.ndarray], states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with their states; the lists are emptied."""
    key, state = np.concatenate(keys), np.concatenate(states)
    keys.clear()
    states.clear()
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    return key[new], state[order[new]]


FIELDS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(total: int, different: int, hot: np.ndarray, buckets: int, docs: pa.Table, told: pa.Table) -> pa.Table:
    """Scores of a chunk, whose texts are read in slices: for their keys, and with what was told of these."""

    def read() -> Iterator[tuple[pa.RecordBatch, Tokens]]:
        for part in slices(docs.to_batches(), size=SLICE_BYTES // 4):
            yield part, Tokens.of(texts_of(part.column("text")))

    words, ahead, behind = np.zeros(0, np.int64), [], []
    for _, tokens in read():
        words = np.union1d(words, tokens.keys)
        _, word, keys = tokens.followers()
        keys, one = np.unique(keys, return_index=True)
        ahead.append(keys)
        behind.append(tokens.keys[word[one]])
    bigrams, first = distinct(ahead, behind)
    arc = told.column("arc")
    arcs = looked_up(bigrams, first, hot, buckets, told.filter(arc))
    del first
    told = told.filter(pc.invert(arc))
    counts, followers = (looked_up(words, words, np.zeros(0, np.int64), buckets, told, c) for c in ("c", "followers"))
    states = np.flatnonzero((counts > CONTEXT * total) & (words != END))
    model = Automaton(total, different, words[states], counts[states], DISCOUNT * followers[states] / counts[states])
    scored = []
    for part, tokens in read():
        at, word, keys = tokens.followers()
        token_counts = counts[np.searchsorted(words, tokens.keys)]
        root, taken = model.traverse(tokens, token_counts, at, word, arcs[np.searchsorted(bigrams, keys)])
        starts = tokens.offsets[:-1]
        known = (token_counts > 0)[tokens.token]
        columns = [
            part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(np.diff(tokens.offsets)), pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
            pa.array(np.full(part.num_rows, total)), pa.array(np.add.reduceat(root, starts)), pa.array(np.add.reduceat(taken, starts)),
        ]
        scored.append(pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FIELDS.split(", ")]))
    return pa.Table.from_batches(scored)


def score_corpus(docs: DataFrame, train) -> DataFrame:
    """Score every document with a model learned from those for which ``train`` holds.

    ``docs`` (``doc_id``, ``text``) has to be read from files; ``cut`` anything else first.
    """
    chunked = chunks(only(docs, "doc_id", "text"), train)
    model = learn(chunked)
    total, different, hot, buckets = model.total, model.different, model.hot, model.buckets

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)], [f.split()[0] for f in FIELDS.split(", ")])
        return score_chunk(total, different, hot, buckets, left, right)

    held = chunked.drop("train").withColumn("held_out", F.coalesce(id_bucket(5) == 1, F.lit(False)))
    return held.groupBy("chunk").cogroup(model.told.groupBy("chunk")).applyInArrow(run, FIELDS)


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir), id_bucket(5) != 1)
