"""The prefix trie of conversations, rolled up by centroid decomposition.

``rebuilt`` gives every conversation the first turns of another, then its own. ``trie`` turns
them into nodes: a node is a different sequence of first turns, known by the running sums
of two 64-bit hashes of (place, role, text). Subtree sums of leaves and saved tokens come from
a centroid decomposition of the forest of parent edges:

* A node's weight is the number of its members, so the weight of a whole subtree is the number
  of turns that its members have from there on, and is counted without a walk.
* In each component those nodes that hold more than half of its weight below them
  are a path from its top down to its centroid. The total of what hangs below the centroid
  (itself included) goes to every node of that path. Then the component falls apart: into the
  subtrees of the centroid's children, and into the rest, whose path nodes lose the centroid's weight.
* No part weighs more than half of the component, so the rounds are at most the
  logarithm of all turns, however deep or broad the trie. Rounds over components of more than
  ``COMPONENT`` nodes are distributed; smaller ones are finished, many at once, inside a task.

Nodes are numbered such that each subtree is one run of numbers (``place`` to ``last``), hence
"below the centroid" is a comparison. Which child a node lies under is the last child before it;
it is looked up inside slices of the numbers, with what slices before hand on. So neither a
conversation, a node nor a component with a third of all rows is ever in one task. The ids
whose hash a node carries are joined to texts in slices as well; a task then reads those texts one
after the other, as SHA-256 asks for.

Edge cases: rows without conv_id are left out; a null role or text is empty; turns of equal
number are ordered by role, then text (repeated rows count each); a conversation left without
turns is a member of the root alone; an empty table gives no rows, not even a root. Further
columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.common import id_bucket, only, shipped
from marquee.operators.ranking import ranked
from marquee.session import cut

#: Conversations take their first turns from the one whose number is the next multiple of this towards 0; how many, at most.
FAMILY, SHARED = 20, 3
#: Nodes of a component that a task may finish by itself.
COMPONENT = 4_096
#: Ids that are joined to one text.
BLOCK = 100_000
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]
SPACE = r"[\x20\x09-\x0D]+"


def running(rows: DataFrame, group: list[str], order: list[str], names: list[str]) -> DataFrame:
    """The rows with ``before_<name>``: sums over the rows before, in the same group, at any size of a group."""
    # The order is unique inside a group; rows of a group lie in slices that are summed each for itself.
    sliced = cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("slice", F.spark_partition_id()))
    slices = sliced.groupBy(*group, "slice").agg(*[F.sum(n).alias(f"sum_{n}") for n in names])
    earlier = W.partitionBy(*group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select(*group, "slice", *[F.coalesce(F.sum(f"sum_{n}").over(earlier), F.lit(0)).alias(f"sum_{n}") for n in names])
    inside = W.partitionBy(*group, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = sliced.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"own_{n}") for n in names]).join(offsets, [*group, "slice"])
    return summed.select(*rows.columns, *[(F.col(f"own_{n}") + F.col(f"sum_{n}")).alias(f"before_{n}") for n in names])


def count_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, turns, a, b, words`` of each rebuilt turn (``depth`` from 1, ``a`` and ``b`` hashes of role and
    text), and ``conv_id, turns`` of each conversation."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    rows = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role, text)
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    hashed = rows.select("*", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), count_words(F.col("text")).alias("words"))
    turns = cut(ranked(hashed, ["conv_id"], ["turn", "role", "text", "line"]).select("conv_id", F.col("position").alias("p"), "a", "b", "words"))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    sized = own.select("*", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), id_bucket(SHARED + 1, "conv_id").alias("h")).join(base, "base", "left")
    alone = F.col("conv_id") == F.col("base")
    sized = sized.select("conv_id", "base", F.when(alone, 0).otherwise(F.col("h")).alias("h"), F.when(alone, 0).otherwise(taken).alias("taken"), "own")
    sized = cut(sized.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    kept = turns.join(sized, "conv_id").filter("p > h").select("conv_id", (F.col("taken") + F.col("p") - F.col("h")).alias("depth"), "turns", "a", "b", "words")
    first = turns.filter(F.col("p") <= SHARED).withColumnRenamed("conv_id", "base")
    lent = first.join(sized.filter("taken > 0"), "base").filter("p <= taken").select("conv_id", F.col("p").alias("depth"), "turns", "a", "b", "words")
    return kept.unionByName(lent), sized.select("conv_id", "turns")


def halves(column: str) -> list[Column]:
    """A 64-bit number as two of 32 bits, whose sums do not run over."""
    return [F.shiftrightunsigned(column, 32).alias(f"{column}_high"), F.col(column).bitwiseAND(0xFFFFFFFF).alias(f"{column}_low")]


def joined_halves(column: str, place: Column) -> Column:
    high, low = (place.getField(f"{column}_{h}") % (1 << 32) for h in ("high", "low"))
    return F.shiftleft(high, 32).bitwiseOR(low)


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, turns, words`` with the keys of the node after the turn (``k1, k2``) and of its parent."""
    placed = turns.select("conv_id", "depth", "turns", "words", F.xxhash64("depth", "a").alias("a"), F.xxhash64("depth", "b").alias("b"))
    parts = [f"{c}_{h}" for c in "ab" for h in ("high", "low")]
    summed = running(placed.select("conv_id", "depth", "turns", "words", *halves("a"), *halves("b")), ["conv_id"], ["depth"], parts)
    before = F.struct(*[F.col(f"before_{n}").alias(n) for n in parts])
    after = F.struct(*[(F.col(f"before_{n}") + F.col(n)).alias(n) for n in parts])
    keys = [joined_halves(c, at).alias(name) for at, names in ((after, KEY), (before, PARENT)) for c, name in zip("ab", names, strict=True)]
    return cut(summed.select("conv_id", "depth", "turns", "words", *keys))


def trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``place, above, last, conv, depth, parent_conv, n_convs, n_children, save, k1, k2``; ``place`` and ``above``
    are the numbers of a node and its parent), and ``k1, k2, conv_id`` of the conversations that end at a node."""
    rows = paths(turns)
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"), *[F.max(p).alias(p) for p in PARENT],
    )
    # Children follow their parent in order of their smallest member, each with its whole subtree.
    nodes = cut(running(nodes, PARENT, ["conv"], ["weight"]))
    children = nodes.groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)]).agg(F.count(F.lit(1)).alias("n_children"))
    parents = cut(nodes.select(*KEY, "conv").join(children, KEY))
    above = parents.select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT, strict=True)], F.col("conv").alias("parent_conv"))
    full = nodes.join(parents.select(*KEY, "n_children"), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = cut(full.select(*KEY, *PARENT, "conv", "n_convs", "n_children", "words", "weight", F.col("before_weight").alias("shift")))
    # A node lies as many places behind the root as it is deep, plus all subtrees that come before it on its way.
    ways = running(rows.select(*KEY, "conv_id", "depth").join(full, KEY), ["conv_id"], ["depth"], ["shift"]).filter("conv_id = conv")
    numbered = ways.select(
        (F.col("depth") + F.col("before_shift") + F.col("shift")).alias("place"), (F.col("depth") - 1 + F.col("before_shift")).alias("above"), *KEY, *PARENT, "conv", "depth", "n_convs", "n_children",
        ((F.col("n_convs") - 1) * F.col("words")).alias("save"), "weight",
    )
    numbered = cut(numbered)
    # The root is no row of ``nodes``; its children take its smallest member.
    least, n_convs, total = conversations.agg(F.min("conv_id"), F.count(F.lit(1)), F.coalesce(F.sum("turns"), F.lit(0))).first()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = rows.sparkSession.range(1 if n_convs else 0).select(
        zero.alias("place"), F.lit(-1).cast("long").alias("above"), *[zero.alias(k) for k in KEY], F.lit(least).cast("long").alias("conv"), zero.alias("depth"), none.alias("parent_conv"),
        F.lit(n_convs).cast("long").alias("n_convs"), F.lit(numbered.filter("depth = 1").count()).cast("long").alias("n_children"), zero.alias("save"), F.lit(total + n_convs).cast("long").alias("weight"),
    )
    below = numbered.join(above, PARENT, "left").withColumn("parent_conv", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv")))
    names = root.columns
    ends = rows.filter("depth = turns").select(*KEY, "conv_id").unionByName(conversations.filter("turns = 0").select(*[zero.alias(k) for k in KEY], "conv_id"))
    return cut(below.select(*names).unionByName(root)).withColumn("last", F.col("place") + F.col("weight")), ends


STATE = ["place", "above", "last", "component", "weight", "total", "leaf", "save", "leaves", "saved"]
LOCAL = "place long, leaves long, saved long"


def split_components(state: DataFrame, sized: DataFrame) -> DataFrame:
    """One round over components: the new state, in which ``done`` marks the centroids. ``sized`` has the component's
    number of nodes, and its centroid as ``c`` (``place, last, weight``)."""
    at = state.join(sized, "component")
    below = (F.col("place") >= F.col("c.place")) & (F.col("place") < F.col("c.last"))
    on_path = (2 * F.col("weight") > F.col("total")) & (F.col("place") <= F.col("c.place"))
    top = F.when(F.col("above") == F.col("c.place"), F.struct(F.col("place").alias("component"), F.col("weight").alias("total")))
    at = at.select("*", below.alias("below"), on_path.alias("on_path"), top.alias("top"))
    # Of the nodes below the centroid: the last of its children up to here, else what slices before hand on.
    inside = W.partitionBy("component", "slice").orderBy("place")
    pieces = at.groupBy("component", "slice").agg(F.max("top").alias("top"), *[F.sum(F.when(F.col("below"), F.col(v))).alias(f"sum_{v}") for v in ("leaf", "save")])
    whole = W.partitionBy("component")
    handed = pieces.select(
        "component", "slice", F.max("top").over(whole.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("handed"),
        *[F.coalesce(F.sum(f"sum_{v}").over(whole), F.lit(0)).alias(f"sum_{v}") for v in ("leaf", "save")],
    )
    told = at.withColumn("top", F.last("top", ignorenulls=True).over(inside)).join(handed, ["component", "slice"])
    done, child = F.col("place") == F.col("c.place"), F.coalesce("top", "handed")
    return told.select(
        "slice", "place", "above", "last", "leaf", "save",
        F.when(F.col("below") & ~done, child.getField("component")).otherwise(F.col("component")).alias("component"),
        F.when(F.col("below") & ~done, child.getField("total")).otherwise(F.col("total") - F.col("c.weight")).alias("total"),
        (F.col("weight") - F.when(F.col("on_path") & ~done, F.col("c.weight")).otherwise(0)).alias("weight"),
        *[(F.col(name) + F.when(F.col("on_path"), F.col(f"sum_{v}")).otherwise(0)).alias(name) for name, v in (("leaves", "leaf"), ("saved", "save"))],
        done.alias("done"),
    )


def decompose(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The same rounds over whole components that lie in one place, until every node has been a centroid."""
    place, above, last, leaf, save = (s[c] for c in ("place", "above", "last", "leaf", "save"))
    component, weight, total = s["component"].copy(), s["weight"].copy(), s["total"].copy()
    leaves, saved = s["leaves"].copy(), s["saved"].copy()
    rows = np.arange(len(place))
    while len(rows):
        rows = rows[np.lexsort((place[rows], component[rows]))]
        first = np.flatnonzero(np.concatenate([[True], np.diff(component[rows]) != 0]))
        size = np.diff(np.append(first, len(rows)))
        at, heavy = np.arange(len(rows)), 2 * weight[rows] > total[rows]
        centre = np.maximum.reduceat(np.where(heavy, at, -1), first)
        lost = np.repeat(weight[rows[centre]], size)
        middle = np.repeat(centre, size)
        x = rows[middle]
        below = (place[rows] >= place[x]) & (place[rows] < last[x])
        path = heavy & (at <= middle)
        for own, out in ((leaf, leaves), (save, saved)):
            out[rows[path]] += np.repeat(np.add.reduceat(np.where(below, own[rows], 0), first), size)[path]
        done = at == middle
        child = rows[np.maximum.accumulate(np.where(below & (above[rows] == place[x]), at, 0))]
        moved = below & ~done
        new_component, new_total = np.where(moved, place[child], component[rows]), np.where(moved, weight[child], total[rows] - lost)
        weight[rows[path & ~done]] -= lost[path & ~done]
        component[rows], total[rows] = new_component, new_total
        rows = rows[~done]
    return {"place": place, "leaves": leaves, "saved": saved}


def finished(pool: DataFrame, most: int) -> DataFrame:
    """``place, leaves, saved`` of components of at most ``most`` nodes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(batch: pa.Table) -> pa.RecordBatch:
            out = decompose({c: batch.column(c).to_numpy() for c in STATE})
            return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in ("place", "leaves", "saved")], ["place", "leaves", "saved"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([*([] if held is None else held.to_batches()), batch])
            if held.num_rows > 4 * most:
                # The last component may go on in the next batch.
                component = held.column("component").to_numpy()
                whole = int(np.searchsorted(component, component[-1]))
                if whole:
                    yield solved(held.slice(0, whole))
                    held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield solved(held)

    return pool.select(*STATE).repartition("component").sortWithinPartitions("component", "place").mapInArrow(run, LOCAL)


def rollup(nodes: DataFrame, most: int = COMPONENT) -> DataFrame:
    """``place, leaves, saved``: the number of leaves and the sum of ``save`` in the subtree of each node."""
    zero = F.lit(0).cast("long")
    leaf = (F.col("n_children") == 0).cast("long")
    size = nodes.agg(F.max("last")).first()[0] or 0
    state = nodes.select("place", "above", "last", zero.alias("component"), "weight", F.lit(size).cast("long").alias("total"), leaf.alias("leaf"), "save", zero.alias("leaves"), zero.alias("saved"))
    state = cut(state.repartitionByRange("place").withColumn("slice", F.spark_partition_id()))
    out, pool = [], []
    while True:
        centre = F.max(F.when(2 * F.col("weight") > F.col("total"), F.struct("place", "last", "weight")))
        sized = cut(state.groupBy("component").agg(centre.alias("c"), F.count(F.lit(1)).alias("nodes")))
        large = sized.filter(F.col("nodes") > most).select("component", "c")
        if large.isEmpty():
            pool.append(state)
            break
        pool.append(state.join(large, "component", "left_anti"))
        state = cut(split_components(state, large))
        out.append(state.filter("done").select("place", "leaves", "saved"))
        state = state.filter("NOT done").drop("done")
    rest = pool[0].select(*STATE)
    for more in pool[1:]:
        rest = rest.unionByName(more.select(*STATE))
    result = finished(rest, most)
    for more in out:
        result = result.unionByName(more)
    return result


def hashes_of_ends(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: the hash of each node's ids, in order and joined by commas."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of one node as texts; what one batch holds of a node is at most ``BLOCK`` ids in a text."""
        for batch in batches:
            k1, k2, ids = (batch.column(c).to_numpy() for c in (*KEY, "conv_id"))
            change = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            first = np.union1d(np.concatenate([[0], change]), np.arange(0, len(ids), BLOCK)) if len(ids) else np.zeros(0, int)
            names = pc.cast(batch.column("conv_id"), pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), names)
            yield pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), pa.array(ids[first]), pc.binary_join(lists, ",")], [*KEY, "conv_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if (a, b) != held:
                    out += [(*held, digest.hexdigest())] if held else []
                    held, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield rows_of(out)
        if held:
            yield rows_of([(*held, digest.hexdigest())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        a, b, digest = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], [*KEY, "ends_sha256"])

    sliced = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(texts, "k1 long, k2 long, conv_id long, ids string")
    return sliced.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most: int = COMPONENT) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node."""
    shipped(conversations.sparkSession)
    turns, whole = rebuilt(conversations)
    nodes, ends = trie(turns, whole)
    sums = cut(rollup(nodes, most))
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.join(sums, "place").join(hashes_of_ends(ends), KEY, "left")
    return full.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op13_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (
  SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS digits FROM turns
), heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    CASE WHEN conv_id % 20 = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], digits),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 END AS h
  FROM bytes
), sizes AS (
  SELECT conv_id, base, h, least(h, n) AS taken FROM (SELECT c.conv_id, c.base, c.h, count(t.p) AS n FROM heads c LEFT JOIN turns t ON t.conv_id = c.base GROUP BY ALL)
), rebuilt AS (
  SELECT s.conv_id, t.p AS d, t.role, t.text FROM sizes s JOIN turns t ON t.conv_id = s.base AND t.p <= s.taken
  UNION ALL SELECT s.conv_id, s.taken + t.p - s.h, t.role, t.text FROM sizes s JOIN turns t ON t.conv_id = s.conv_id AND t.p > s.h
), ways AS (
  SELECT conv_id, d, text, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY d) AS way, count(*) OVER (PARTITION BY conv_id) AS turns FROM rebuilt
  UNION ALL SELECT s.conv_id, 0, '', [], (SELECT count(*) FROM rebuilt r WHERE r.conv_id = s.conv_id) FROM sizes s
), nodes AS (
  SELECT way, min(conv_id) AS conv, any_value(d) AS depth, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '') AS ends,
    CASE WHEN any_value(d) = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) END AS save
  FROM ways GROUP BY way
), lines AS (
  SELECT w.way, n.conv, n.depth, n.save, w.conv_id FROM ways w JOIN nodes n USING (way)
), children AS (
  SELECT p.way, count(*) AS n_children FROM nodes c JOIN lines p ON p.conv_id = c.conv AND p.depth = c.depth - 1 GROUP BY p.way
), below AS (
  SELECT a.way, sum(c.save) AS saved, count(*) FILTER (k.n_children IS NULL) AS leaves
  FROM nodes c JOIN lines a ON a.conv_id = c.conv AND a.depth <= c.depth LEFT JOIN children k ON k.way = c.way GROUP BY a.way
)
SELECT n.conv AS conv_id, n.depth::BIGINT AS depth, p.conv AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
  sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b USING (way) LEFT JOIN children k USING (way) LEFT JOIN lines p ON p.conv_id = n.conv AND p.depth = n.depth - 1
"""
