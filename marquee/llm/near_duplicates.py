"""N-gram Jaccard join by parity sketches.

A document's set are its different shingles of some words. Sets that are equal are one
class. For a pair of classes of sizes a and b, a Jaccard of 0.9 or more means that at
most (a + b) / 19 shingles are in only one of the two; for 0.8 it is (a + b) / 9.

*What can link.* A linked set shares all but 10 % (20 % for 0.8) of its shingles with one other
class, so a class of which more shingles occur in no other class at all links with nothing. Some
shingles, those with the lowest hashes, show that of most classes; the other shingles of the classes that
remain are then looked at in the same way. Only the texts of the classes left are read from here on.

*Sketch.* Every shingle flips one bit of a wide bit sketch, so the Hamming distance
of two sketches is at most the number of shingles in only one set. The sketch is cut
into more blocks than that bound allows differences, so two linked classes agree on
all blocks but so many (pigeonhole). The number of blocks follows from the size; it is
taken from a coarse scale, and a class near a step of the scale is sketched for both
sides, so all sizes that can link meet in one size band. A block is compared by the
XOR of a 64-bit code of each set bit. Of its blocks a class only needs one more than it may
differ in, and takes the fullest ones and those as full: blocks of few shingles or none agree by chance.

*Join without pairing a group with itself.* The classes that agree on a block form a
group. Its most popular member leads, and only (leader, member) is verified, exactly,
on the shingle sets. Members linked to their leader are in one component already. For
two members of which one is not linked to the leader, the triangle inequality says
that they link only if their differences to the leader overlap, and then one of the
first differences of one (in the order of how many members of the leader have them; one more
than the pair may not share) is among those of the other. These prefixes are joined,
with bounds from the positions, and what remains is verified exactly. So no link is lost, and groups of
near copies cost in proportion to their size and their differences.

*Components* come from rounds of minimum labels with pointer jumping.

Edge cases: a text with fewer words than a shingle has its whole sequence as the one
shingle; null, empty and blank texts have the empty set and stay alone; rows with
equal ids are one document each and count as linked only by their texts; rows without
an id get their class's component; an empty table gives no rows.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import LOWER, UPPER, documents, only, ranges, slices, texts_of, unused, word_lists
from marquee.llm.phrases import mix
from marquee.llm.scoring import word_keys
from marquee.session import cut, release


@dataclass(frozen=True)
class Likeness:
    """When two documents link: words of a shingle, and the Jaccard of their sets in percent."""

    words: int = 3
    percent: int = 90

    def apart(self, sizes):
        """The most shingles that two linked sets of these sizes together may not share."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def partner(self, size):
        """The largest size that a set of this size can link with."""
        return 100 * size // self.percent

    def links(self, n: Column, m: Column, both: Column) -> Column:
        return 100 * both >= self.percent * (n + m - both)

    def most_apart(self, sizes: Column) -> Column:
        """``apart`` as a column expression."""
        return F.floor(sizes * (100 - self.percent) / (100 + self.percent))

    def most_alone(self, n: Column) -> Column:
        """The most shingles of a linked set of this size that no other set has."""
        return F.floor(n * (100 - self.percent) / 100)

    @property
    def lowest(self) -> np.uint64:
        """The end of the hashes that are looked at first: two thirds more of all than a linked set may have alone."""
        return np.uint64((1 << 64) // 300 * 5 * (100 - self.percent))

    def prefix(self, n: Column) -> Column:
        """Differences of which a linked partner must share one: one more than they may not share."""
        return (self.most_apart(n + F.floor(100 * n / self.percent)) + 1).cast("int")


EXACT, NEAR = Likeness(), Likeness(words=5, percent=80)
#: Lowest bits of a key, for the step of the scale of block counts.
STEP_BITS = 6
#: Size of the bitmap of ids, as a power of two of bits; it bounds what is sent to the driver and to each task.
MAP_BITS = 26
#: Ids that may be broadcast, some 20 MB in memory; more are joined by a shuffle.
BROADCAST_IDS = 250_000
#: Parts in which pairs of classes are compared at most, and how many pairs make one more; the sets of one part are on disk at a time.
PARTS, PART_PAIRS = 4, 50_000


def blocks_for(size: np.ndarray | int, like: Likeness):
    """Blocks that sets of this size need at least: two and a sixteenth more than they may differ in."""
    most = like.apart(2 * size)
    return np.where(most > 0, most + 2 + most // 16, 1)


def scale(most: int) -> np.ndarray:
    """The block counts in use, up to the first that is at least ``most``."""
    steps = [1]
    while steps[-1] < most:
        steps.append(max(steps[-1] + 2, steps[-1] * 3 // 2))
    return np.array(steps, np.int64)


def largest_sizes(steps: np.ndarray, like: Likeness) -> list[int]:
    """For each block count the largest size that uses it."""
    out, size = [], 0
    for blocks in steps.tolist():
        low, high = size, 20 * (blocks + 1)
        while low < high:  # blocks_for never falls
            middle = (low + high + 1) // 2
            low, high = (middle, high) if blocks_for(middle, like) <= blocks else (low, middle - 1)
        out.append(size := low)
    return out


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, sorted, all texts in a row; and the texts' offsets."""
    offsets, words = word_lists(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    key = mix(word_keys(coded.dictionary).view(np.uint64))[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    sizes = np.diff(offsets)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    starts = ranges(offsets[:-1], counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    have = np.minimum(sizes, width)[owner]
    h = np.zeros(len(starts), np.uint64)
    for k in range(width):
        at = np.minimum(starts + k, max(len(key) - 1, 0))
        h = np.where(have > k, mix(h * np.uint64(0x9E3779B97F4A7C15) + key[at] + np.uint64(k + 1)) if len(key) else h, h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


def block_keys(h: np.ndarray, offsets: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sketch blocks of each set, in the order of the sets; the sets' offsets into them; and the shingles in each block.

    The lowest bits of a key tell the step of the scale.
    """
    n = np.diff(offsets)
    lowest, highest = blocks_for(n, like), blocks_for(like.partner(n), like)
    steps = scale(int(highest.max()) if len(n) else 1)
    first, last = np.searchsorted(steps, lowest), np.searchsorted(steps, highest)
    code, spread = mix(h ^ np.uint64(0xA5A5A5A5)), h >> np.uint64(32)
    owners, keys, filled = [], [], []
    for s in range(1, len(steps)):  # one block is the whole set, and equal sets are one class
        blocks = int(steps[s])
        rows = np.flatnonzero((first <= s) & (s <= last) & (n > 0))
        if not len(rows):
            continue
        at = ranges(offsets[rows], n[rows])
        place = np.repeat(np.arange(len(rows)) * blocks, n[rows]) + ((spread[at] * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, value = place[order], code[at][order]
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        pattern = np.zeros(len(rows) * blocks, np.uint64)
        pattern[place[begin]] = np.bitwise_xor.reduceat(value, begin)
        number = np.tile(np.arange(blocks, dtype=np.uint64), len(rows))
        keys.append(mix(pattern + mix(number + np.uint64(blocks << 32))) >> np.uint64(STEP_BITS) << np.uint64(STEP_BITS) | np.uint64(s))
        owners.append(np.repeat(rows, blocks))
        filled.append(np.bincount(place, minlength=len(rows) * blocks))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64), np.zeros(0, np.int64)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return key[order].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64), np.concatenate(filled)[order]


def fullest(keys: np.ndarray, ends: np.ndarray, filled: np.ndarray, n: np.ndarray, like: Likeness) -> np.ndarray:
    """Which of the blocks of ``block_keys`` are compared: in each step of the scale one more than a set of that size may differ in, and all that are as full as the last of them.

    A pair agrees on one of the blocks taken by the set that asks for fuller ones, and the other set takes that block, too.
    """
    step = keys & ((1 << STEP_BITS) - 1)
    owner = np.repeat(np.arange(len(n)), np.diff(ends))
    begin = np.flatnonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
    order = np.lexsort((-filled, run))
    largest = np.array(largest_sizes(scale(int(blocks_for(like.partner(n.max()), like)) if len(n) else 1), like))
    size = n[owner[begin]]
    least = filled[order[begin + like.apart(size + np.minimum(like.partner(size), largest[step[begin]]))]]
    return filled >= least[run]


def classes_of(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that depends on nothing but its shingles."""
    full, out = np.flatnonzero(np.diff(offsets)), np.zeros(len(offsets) - 1, np.uint64)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(h + np.uint64(0x51)), offsets[full]) + np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x7F4A7C15)), offsets[full]) * np.uint64(0xBF58476D1CE4E5B9))
    return out.view(np.int64)


def sketched(docs: DataFrame, like: Likeness) -> DataFrame:
    """``doc_id, key, n, class`` of every document, with a hash of its text as ``key``; the empty set has no class."""

    def run(batches):
        for batch in slices(batches):
            h, offsets = shingle_sets(texts_of(batch.column("text")), like.words)
            n = np.diff(offsets)
            name = pa.array(classes_of(h, offsets), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array(n), name], ["doc_id", "key", "n", "class"])

    return only(docs, "doc_id", "text").withColumn("key", text_key()).mapInArrow(run, "doc_id long, key long, n long, class long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingle_keys(docs: DataFrame, like: Likeness, lowest: bool) -> DataFrame:
    """``key, class`` of the shingles with the lowest hashes, or of all others, once in each task that meets the class."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            h, offsets = shingle_sets(texts_of(batch.column("text")), like.words)
            name = classes_of(h, offsets)
            new = np.zeros(len(name), bool)
            for i in np.flatnonzero(np.diff(offsets)).tolist():
                if (c := int(name[i])) not in seen:
                    seen.add(c)
                    new[i] = True
            owner = np.repeat(np.arange(len(name)), np.diff(offsets))
            kept = new[owner] & ((h < like.lowest) == lowest)
            keys, owner = h[kept].view(np.int64), owner[kept]
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(name[owner[k : k + 100_000]])], ["key", "class"])

    return only(docs, "text").mapInArrow(run, "key long, class long")


def linkable(classes: DataFrame, keys: DataFrame, like: Likeness) -> DataFrame:
    """The ``classes`` (``class, n, alone``) without those of which more shingles occur in no other class than a link allows.

    ``alone`` counts such shingles; those among ``keys`` are added.
    """
    alone = keys.groupBy("key").agg(F.min("class").alias("class"), F.max("class").alias("high")).filter("class = high").groupBy("class").agg(F.count(F.lit(1)).alias("more"))
    found = classes.join(alone, "class", "left").withColumn("alone", F.col("alone") + F.coalesce("more", F.lit(0))).drop("more")
    return cut(found.filter(F.col("alone") <= like.most_alone(F.col("n"))))


def linkable_texts(docs: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """``class, text`` of the classes that can link with another one at all, one row each."""
    place = F.min(F.struct(named_id().alias("id"), "key")).alias("place")
    classes = sketches.filter("class IS NOT NULL").groupBy("class").agg(F.max("n").alias("n"), place).select("class", "n", "place.*", F.lit(0).cast("long").alias("alone"))
    classes = linkable(classes, shingle_keys(docs, like, True), like)
    release(docs.sparkSession)
    texts = cut(standing(docs, classes))
    if texts.count() > classes.count():
        texts = cut(texts.dropDuplicates(["class"]))
    classes = linkable(classes, shingle_keys(texts, like, False), like)
    release(docs.sparkSession)
    return texts.join(few(classes.select("class")), "class", "left_semi")


def standing(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, text`` of the rows at the places (``id, key``) of the classes.

    A bitmap of the ids, with 64 bits for each while they fit, leaves out almost all other documents before the join.
    """
    ids = classes.select(F.xxhash64("id").alias("key"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, min(MAP_BITS, 6 + max(4, ids.count().bit_length()))))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked_in(bitmap.value, batch.column("hash").to_numpy())))

    rows = only(docs, "doc_id", "text").select(named_id().cast("long").alias("id"), "text").withColumn("key", text_key()).withColumn("hash", F.xxhash64("id"))
    found = rows.mapInArrow(run, "id long, text string, key long, hash long")
    return found.join(few(classes.select("id", "key", "class")), ["id", "key"]).select("class", "text")


def sketch_blocks(texts: DataFrame, like: Likeness) -> DataFrame:
    """``key, class, n`` of the fullest blocks of each class's sketch."""

    def run(batches):
        for batch in slices(batches):
            h, offsets = shingle_sets(texts_of(batch.column("text")), like.words)
            n, name = np.diff(offsets), batch.column("class").to_numpy()
            keys, ends, filled = block_keys(h, offsets, like)
            kept = fullest(keys, ends, filled, n, like)
            keys, owner = keys[kept], np.repeat(np.arange(len(n)), np.diff(ends))[kept]
            for k in range(0, len(keys), 100_000):
                part = owner[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(name[part]), pa.array(n[part])], ["key", "class", "n"])

    return texts.select("class", "text").mapInArrow(run, "key long, class long, n long")


def bitmap_of(keys: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """One mark for each value of the keys' upper ``bits`` that occurs; the size does not depend on their number."""
    bit = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = bit.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def marked_in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap marks each key's upper bits."""
    bit = keys.view(np.uint64) >> np.uint64(65 - 6 - len(bitmap).bit_length())
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def few(ids: DataFrame) -> DataFrame:
    """The ids, with the hint to broadcast them if their number allows it."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def groups(texts: DataFrame, like: Likeness) -> DataFrame:
    """``key, class, n`` for the blocks on which at least two classes agree."""
    blocks = cut(sketch_blocks(texts, like))
    shared = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("key")
    return blocks.join(shared, "key", "left_semi")


def led(members: DataFrame, like: Likeness) -> DataFrame:
    """``leader, class``: each member of a group with the group's leader, once."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    popular = members.join(sizes, "key").groupBy("class").agg(F.sum("size").alias("popular"))
    ranked = members.join(popular, "class").withColumn("rank", F.struct("popular", "class", "n"))
    leaders = ranked.groupBy("key").agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("size"))
    pairs = members.join(leaders, "key").filter(F.col("class") != F.col("top.class"))
    # In a group of two only sizes that can link matter.
    low, high = F.least("n", "top.n"), F.greatest("n", "top.n")
    pairs = pairs.filter((F.col("size") > 2) | (100 * low >= like.percent * high))
    return pairs.select(F.col("top.class").alias("leader"), "class").distinct()


def named_id() -> Column:
    """The id of a document, or the last one that there can be."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1))


def shingles_of(texts: DataFrame, wanted: DataFrame, like: Likeness) -> DataFrame:
    """``class, n, shingles`` of the classes in ``wanted`` (column ``class``), derived from the texts."""

    def run(batches):
        for batch in slices(batches):
            h, offsets = shingle_sets(texts_of(batch.column("text")), like.words)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(np.diff(offsets)), lists], ["class", "n", "shingles"])

    return texts.join(few(cut(wanted.distinct())), "class", "left_semi").select("class", "text").mapInArrow(run, "class long, n long, shingles array<long>")


def parts_of(pairs: DataFrame, most: int) -> int:
    return min(most, 1 + pairs.count() // PART_PAIRS)


def parted(rows: DataFrame, parts: int, *by: str) -> list[DataFrame]:
    """The rows cut into so many parts by a hash of some columns."""
    return [rows.filter(F.pmod(F.xxhash64(*by), F.lit(parts)) == part) for part in range(parts)]


def compared(pairs: DataFrame, texts: DataFrame, like: Likeness, left: str, right: str, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``result`` makes of the pairs with ``n, a`` (size and set of the left class) and ``m, b`` (of the right).

    Sets take more room than their texts, so the pairs are compared in parts, one after the other, and no set is stored.
    """
    done = []
    for rows in parted(pairs, parts_of(pairs, PARTS), left, right):
        sides = []
        for name, size, shingles in ((left, "n", "a"), (right, "m", "b")):
            sets = shingles_of(texts, rows.select(F.col(name).alias("class")), like)
            sides.append(sets.select(F.col("class").alias(name), F.col("n").alias(size), F.col("shingles").alias(shingles)))
        done.append(cut(result(rows.join(sides[0], left).join(sides[1], right))))
        release(texts.sparkSession)
    return reduce(DataFrame.unionByName, done)


def differences(rows: DataFrame, like: Likeness) -> DataFrame:
    """(leader, class) with ``n`` (size), ``linked``, the differences (``first``; none for the only member of a leader) and how many there are (``apart``)."""
    rows = rows.withColumn("extra", F.array_except("b", "a")).withColumn("missing", F.array_except("a", "b"))
    linked = like.links(F.col("n"), F.col("m"), F.col("m") - F.size("extra"))
    first = F.when(F.col("members") > 1, F.concat("extra", "missing")).otherwise(F.array().cast("array<long>"))
    return rows.select("leader", "class", F.col("m").alias("n"), linked.alias("linked"), first.alias("first"), (F.size("extra") + F.size("missing")).alias("apart"))


def members_apart(diffs: DataFrame, like: Likeness) -> DataFrame:
    """Candidate pairs of members that share a leader, one of them not linked to it.

    The differences are joined in parts, one after the other, by leader.
    """
    # Leaders with a member that is not linked and at least one more.
    open_ = diffs.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.min("linked").alias("all")).filter("members > 1 AND NOT all")
    rows = diffs.join(few(cut(open_.select("leader"))), "leader", "left_semi")
    return reduce(DataFrame.unionByName, [cut(sharing(prefixes(part, like), like)) for part in parted(rows, parts_of(diffs, 2 * PARTS), "leader")]).distinct()


def prefixes(rows: DataFrame, like: Likeness) -> DataFrame:
    """``leader, class, n, linked, apart, at, element`` of the first differences of each member, without those that no candidate pair has in common.

    Their order is that of how many members have them; those that only one has, or only linked ones, come before all others.
    """
    each = rows.select("leader", "class", "n", "linked", "apart", F.explode("first").alias("element"))
    met = each.groupBy("leader", "element").agg(F.count(F.lit(1)).alias("met"), F.min("linked").alias("all")).filter("met > 1 AND NOT all").drop("all")
    common = each.join(met, ["leader", "element"]).groupBy("leader", "class", "n", "linked", "apart").agg(F.sort_array(F.collect_list(F.struct("met", "element"))).alias("common"))
    before = F.col("apart") - F.size("common")
    first = F.slice("common", 1, F.greatest(like.prefix(F.col("n")) - before, F.lit(0)))
    return common.select("leader", "class", "n", "linked", "apart", before.alias("before"), F.posexplode(first).alias("at", "one")).withColumn("at", F.col("before") + F.col("at")).select("*", "one.element").drop("before", "one")


def sharing(rows: DataFrame, like: Likeness) -> DataFrame:
    """The pairs of ``members_apart`` whose first differences have an element in common."""
    a, b = rows.filter("NOT linked").alias("a"), rows.alias("b")
    both = like.most_apart(F.col("a.n") + F.col("b.n"))
    rest = F.least(F.col("a.apart") - F.col("a.at"), F.col("b.apart") - F.col("b.at"))
    near = (
        (F.col("a.leader") == F.col("b.leader")) & (F.col("a.element") == F.col("b.element"))
        & (F.col("b.linked") | (F.col("a.class") < F.col("b.class")))
        & (F.col("a.at") + F.col("b.at") <= both) & (F.col("a.apart") + F.col("b.apart") - 2 * rest <= both)
    )
    return a.join(b, near).select(F.col("a.class").alias("one"), F.col("b.class").alias("two")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``class, component`` (the smallest class reachable) of all classes in ``links`` (``one, two``)."""
    edges = cut(links.unionByName(links.select(F.col("two").alias("one"), F.col("one").alias("two"))).distinct())
    labels = cut(edges.groupBy("one").agg(F.least(F.col("one"), F.min("two")).alias("label")))
    while True:
        at_ends = labels.select(F.col("one").alias("two"), F.col("label").alias("near"))
        lower = edges.join(at_ends, "two").groupBy("one").agg(F.min("near").alias("near"))
        moved = labels.join(lower, "one").select("one", "label", F.least("label", "near").alias("next"))
        # Jump to the label's own label.
        jump = labels.select(F.col("one").alias("next"), F.col("label").alias("further"))
        moved = cut(moved.join(jump, "next").select("one", "label", F.least("next", "further").alias("next")))
        if moved.filter("next <> label").isEmpty():
            return labels.select(F.col("one").alias("class"), F.col("label").alias("component"))
        labels = moved.select("one", F.col("next").alias("label"))


def jaccard_links(docs: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """Linked pairs of classes (``one, two``), enough of them to connect every linked pair."""
    texts = cut(linkable_texts(docs, sketches, like))
    members = cut(groups(texts, like))
    release(docs.sparkSession)
    pairs = cut(led(members, like))
    release(docs.sparkSession)
    counted = pairs.join(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("members")), "leader")
    diffs = compared(counted, texts, like, "leader", "class", lambda rows: differences(rows, like))
    links = diffs.filter("linked").select(F.col("leader").alias("one"), F.col("class").alias("two"))
    apart = cut(members_apart(diffs, like))
    if apart.isEmpty():
        return links
    linked = like.links(F.col("n"), F.col("m"), F.size(F.array_intersect("a", "b")))
    return links.unionByName(compared(apart, texts, like, "one", "two", lambda rows: rows.filter(linked).select("one", "two")))


def near_duplicates(docs: DataFrame, like: Likeness = EXACT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    sketches = cut(sketched(docs, like))
    joined = components(jaccard_links(docs, sketches, like))
    names = sketches.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = names.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.filter("component <> class").unionByName(named.join(joined.select("component").distinct(), "component", "left_semi").filter("component = class"))
    lowest = least.groupBy("component").agg(F.min("least").alias("lowest"))
    # Only classes with copies or links have another component than the document's own id.
    other = named.join(lowest, "component", "left").select("class", F.coalesce("lowest", "least").alias("lowest"), "copies", F.col("lowest").isNotNull().alias("linked"))
    # Written first: a join on the partitioning of an aggregate is not split at a class with many copies.
    other = cut(other.filter("copies > 1 OR linked").select("class", "lowest"))
    rows = sketches.select("doc_id", "n", "class").join(other, "class", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, like: Likeness = EXACT) -> DataFrame:
    """One row of each component: that with the smallest id; columns stay as they are.

    Each row is decided by its own text, so one of a repeated id goes if its text links with that of a
    smaller id, and rows without an id go if they link with any other row. Equal ids with equal
    texts are one row. Texts without words link with nothing: only those of one id are one row.
    """
    sketches = cut(sketched(docs, like))
    joined = components(jaccard_links(docs, sketches, like))
    members = cut(sketches.filter("class IS NOT NULL").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")).drop("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "class")).alias("first")
    kept = cut(members.groupBy("component").agg(first, F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    leaves = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("class") == F.col("first.class")))
    gone = cut(members.join(kept, "component").filter(leaves).select(F.col("doc_id").alias("named_id"), F.col("key").alias("named_key")).distinct())
    key = unused(docs, "text_key")
    keyed = docs.withColumn(key, text_key())

    def row_of(named: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(named["named_id"]) & (keyed[key] == named["named_key"])

    rows = keyed.join(few(gone), row_of(gone), "left_anti")
    # The row of a component may be there several times.
    again = sketches.filter("doc_id IS NOT NULL OR class IS NOT NULL").groupBy(F.col("doc_id").alias("named_id"), F.col("key").alias("named_key")).count().filter("count > 1").drop("count")
    again = cut(again)
    if again.isEmpty():
        return rows.drop(key)
    several = rows.join(few(again), row_of(again), "left_semi").dropDuplicates(["doc_id", key])
    return rows.join(few(again), row_of(again), "left_anti").unionByName(several).drop(key)


def op5_parity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
