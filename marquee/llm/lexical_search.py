"""Ranked lexical search with document FP-trees.

Every document is restricted to the terms that a block of items asks for, as a vector of
(term, tf). ``vectors`` writes them once, from the whole texts; document counts, lengths
and document frequencies are sums over them. A task reads its vectors in runs of at most
``TREE_DOCUMENTS`` and builds a tree of each run: terms are put in order of falling document
frequency, so that vectors that begin with the same frequent terms share a path. Each node
keeps, over the documents below it, the largest tf of every term and the smallest m.
A score grows with tf and falls with m, so the score of those values bounds the scores of
all documents below. An item is searched depth first, most promising child first, and leaves
out what cannot reach its ten best so far, which a task carries from tree to tree.
Every task passes on its best ten of each item, and a window ranks those.

A chain of nodes with one child is one node, and siblings with few documents share a leaf.
Items go in blocks of about ``BLOCK`` terms, each with a pass of its own over the documents;
an item with more terms is a block by itself. A block is all that is broadcast.

Edge cases: null texts have no terms, and documents without terms count for nothing; an item
without id is left out, rows with the same item id are one item that holds the terms of all;
repeated documents are ranked each, a null doc_id after all others of its score; without
documents, terms or items there are no rows. Further columns are ignored.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.common import documents, only, ranges, shipped, slices, texts_of, word_lists
from marquee.llm.decontamination import words_of
from marquee.session import cut

BEST = 10
#: Weight of the length in m, in hundredths; tf and m enter a score in thousandths.
LENGTH_SHARE = 75
#: (item, term) pairs that are searched at once.
BLOCK = 32_768
#: Documents of a tree, and of a leaf that is scored as a whole.
TREE_DOCUMENTS, LEAF = 8_192, 32
#: Entries of a tree's table of tf maxima, at most.
MAXIMA = 8_000_000
VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"

#: Byte values as terms see them: separators are spaces, A-Z lower case.
FOLDED = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
FOLDED[65:91] += 32


def term_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the texts, and their terms in a row."""
    texts = pc.binary_join_element_wise(texts, "")  # a copy whose buffers begin with its first text
    _, offsets, data = texts.buffers()
    folded = FOLDED[np.frombuffer(data or b"", np.uint8)]
    return word_lists(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(folded)))


def vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs``: of each document with terms their number, and how often it has those of the vocabulary (by position)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(known.value, pa.string())
        for batch in slices(batches):
            offsets, terms = term_lists(texts_of(batch.column("text")))
            coded = terms.dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, names), -1).to_numpy()[coded.indices.to_numpy()]
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)[place >= 0]
            pair, tf = np.unique(row * len(names) + place[place >= 0], return_counts=True)
            row, term = np.divmod(pair, max(1, len(names)))
            full = np.flatnonzero(n)
            bounds = pa.array(np.searchsorted(row, np.append(full, len(n))), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(full)), pa.array(n[full].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return only(docs, "doc_id", "text").mapInArrow(run, VECTOR)


@dataclass
class Query:
    """What the documents are searched for; terms are numbered by falling document frequency."""

    items: list[int]
    #: Of each item its terms and their weights, times how often it has them.
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    #: Number of each position of the vocabulary, -1 for terms without weight.
    number: np.ndarray
    size: int
    documents: int
    length: int

    @classmethod
    def of(cls, items: dict[int, Counter], vocabulary: list[str], df: dict[int, int], documents: int, length: int) -> "Query":
        weight = {k: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for k, n in df.items()}
        order = sorted((k for k in df if weight[k] > 0), key=lambda k: (-df[k], k))
        number = np.full(len(vocabulary), -1, np.int64)
        number[order] = np.arange(len(order))
        place, names, terms, weights = {t: k for k, t in enumerate(vocabulary)}, [], [], []
        for item, counts in sorted(items.items()):
            own = [(number[place[t]], n * weight[place[t]]) for t, n in sorted(counts.items()) if number[place[t]] >= 0]
            if own:
                names.append(item)
                terms.append(np.array([k for k, _ in own]))
                weights.append(np.array([w for _, w in own], np.int64))
        return cls(names, terms, weights, number, len(order), documents, length)

    def m(self, n: np.ndarray) -> np.ndarray:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.documents // self.length


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score, for a weight of 1."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of some vectors. ``terms`` are numbers by falling document frequency, ascending in each document."""

    def __init__(self, m: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int, leaf: int = LEAF) -> None:
        self.order = np.arange(len(m))
        #: First and last position (exclusive) in ``order``, and parent of each node; the root is 0.
        self.first, self.last, self.parent = [0], [len(m)], [-1]
        self.grow(bounds, terms, leaf)
        lengths = np.diff(bounds)[self.order]
        at = ranges(bounds[:-1][self.order], lengths)
        self.m, self.terms, self.tfs = m[self.order], terms[at], tfs[at]
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.children: list[list[int]] = [[] for _ in self.first]
        for k in range(1, len(self.first)):
            self.children[self.parent[k]].append(k)
        self.maxima = np.zeros((len(self.first), size), np.int32)
        self.least = np.full(len(self.first), np.iinfo(np.int64).max)
        for k in range(len(self.first) - 1, -1, -1):  # a node comes after its parent
            if not self.children[k]:
                a, b = self.first[k], self.last[k]
                entries = slice(self.bounds[a], self.bounds[b])
                np.maximum.at(self.maxima[k], self.terms[entries], self.tfs[entries])
                self.least[k] = self.m[a:b].min() if b > a else self.least[k]
            if k:
                up = self.parent[k]
                np.maximum(self.maxima[up], self.maxima[k], out=self.maxima[up])
                self.least[up] = min(self.least[up], self.least[k])

    def grow(self, bounds: np.ndarray, terms: np.ndarray, leaf: int) -> None:
        """Divide nodes by their documents' next term, one depth of the paths after the other."""
        lengths, depth = np.diff(bounds), 0
        open_nodes = [0] if len(self.order) > leaf else []
        while open_nodes:
            sizes = np.array([self.last[k] - self.first[k] for k in open_nodes])
            at = ranges(np.array([self.first[k] for k in open_nodes]), sizes)
            node, docs = np.repeat(np.arange(len(open_nodes)), sizes), self.order[at]
            ended = lengths[docs] <= depth
            term = np.where(ended, -1, terms[np.where(ended, 0, bounds[:-1][docs] + depth)])
            sort = np.lexsort((term, node))
            self.order[at], term = docs[sort], term[sort]
            begins = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (term[1:] != term[:-1])]))
            runs = defaultdict(list)
            for k, a, n, t in zip(node[begins].tolist(), at[begins].tolist(), np.diff(np.append(begins, len(at))).tolist(), term[begins].tolist(), strict=True):
                runs[k].append((a, n, t))
            depth, following = depth + 1, []
            for k, own in runs.items():
                if len(own) == 1:
                    following += [open_nodes[k]] if own[0][2] >= 0 else []
                    continue
                small = 0  # documents of the few-document siblings just before
                for a, n, t in own:
                    if n <= leaf and small + n <= leaf and small:
                        self.last[-1], small = a + n, small + n
                        continue
                    small = n if n <= leaf else 0
                    self.first.append(a)
                    self.last.append(a + n)
                    self.parent.append(open_nodes[k])
                    if n > leaf and t >= 0:
                        following.append(len(self.first) - 1)
            open_nodes = following

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], ids: list) -> list[tuple]:
        """The ``BEST`` of ``best`` and the documents here, as (-score, id is null, id)."""
        bound = parts(self.maxima[:, terms], self.least[:, None]) @ weights
        weight = np.zeros(self.maxima.shape[1], np.int64)
        weight[terms] = weights
        stack, bound = [0], bound.tolist()
        while stack:
            k = stack.pop()
            # A document with the score of the last one kept may have a smaller id.
            if bound[k] == 0 or len(best) == BEST and bound[k] < -best[-1][0]:
                continue
            if self.children[k]:
                stack += sorted(self.children[k], key=bound.__getitem__)
                continue
            a, b = self.first[k], self.last[k]
            edges = self.bounds[a : b + 1]
            entries = slice(edges[0], edges[-1])
            added = weight[self.terms[entries]]
            hit = np.flatnonzero(added)
            doc = np.searchsorted(edges - edges[0], hit, side="right") - 1
            score = np.zeros(b - a, np.int64)
            np.add.at(score, doc, added[hit] * parts(self.tfs[entries][hit], self.m[a:b][doc]))
            wanted = np.flatnonzero(score >= max(1, -best[-1][0] if len(best) == BEST else 1)).tolist()
            if wanted:
                best = sorted([*best, *((-int(score[d]), ids[self.order[a + d]] is None, ids[self.order[a + d]] or 0) for d in wanted)])[:BEST]
        return best


def best_of(stored: DataFrame, query: Query) -> DataFrame:
    """``item_id, doc_id, score``: each task's best of each item."""
    shared = stored.sparkSession.sparkContext.broadcast(query)

    def runs_of_documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and sum(b.num_rows for b in held) + part.num_rows > most:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(part)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: list[list[tuple]] = [[] for _ in q.items]
        for table in runs_of_documents(batches, max(LEAF, min(TREE_DOCUMENTS, LEAF * MAXIMA // max(1, 2 * q.size)))):
            lists = table.column("terms").combine_chunks()
            edges = lists.offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(edges))
            terms = q.number[lists.flatten().to_numpy()]
            tfs = table.column("tfs").combine_chunks().flatten().to_numpy()
            kept = np.flatnonzero(terms >= 0)
            kept = kept[np.lexsort((terms[kept], row[kept]))]
            bounds = np.searchsorted(row[kept], np.arange(len(lists) + 1))
            tree = Tree(q.m(table.column("n").to_numpy()), bounds, terms[kept], tfs[kept], q.size)
            ids = table.column("doc_id").to_pylist()
            best = [tree.search(t, w, b, ids) for t, w, b in zip(q.terms, q.weights, best, strict=True)]
        rows = [(item, None if null else doc, -score) for item, found in zip(q.items, best, strict=True) for score, null, doc in found]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], ["item_id", "doc_id", "score"])

    return stored.mapInArrow(run, "item_id long, doc_id long, score long")


def search_block(docs: DataFrame, items: dict[int, Counter]) -> DataFrame:
    """``item_id, doc_id, score`` of all that a task found to be among an item's best."""
    vocabulary = sorted(set().union(*items.values()))
    stored = cut(vectors(docs, vocabulary))
    n, length = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the block at most
    return best_of(stored, Query.of(items, vocabulary, {r["term"]: r["count"] for r in df}, n, max(1, length)))


def lexical_search(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents (``doc_id``, ``text``) of each item (``item_id``, ``text``)."""
    spark = shipped(docs.sparkSession)
    asked = only(items, "item_id", "text").filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.explode(words_of()).alias("term"))
    counts = cut(asked.filter("term <> ''").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n")))
    blocks = -(-counts.count() // block)
    found = None
    for k in range(blocks):
        own: dict[int, Counter] = defaultdict(Counter)
        for r in counts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():
            own[r["item_id"]][r["term"]] = r["n"]
        if own:
            rows = search_block(docs, own)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST).select("item_id", "rank", "doc_id", "score")


def op12_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), docs AS (
  SELECT place, doc_id, terms, len(terms) AS n FROM texts WHERE len(terms) > 0
), size AS (
  SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM docs
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
  ) GROUP BY ALL
), held AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, size GROUP BY term
), scored AS (
  SELECT a.item_id, d.doc_id, h.place, CAST(sum(a.times * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (25 + (75 * d.n * s.total) // s.length)))) AS BIGINT) AS score
  FROM held h JOIN docs d USING (place) JOIN weights w USING (term) JOIN asked a USING (term), size s GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
