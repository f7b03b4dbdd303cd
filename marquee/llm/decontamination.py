"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores postings (term, document, position) of the documents' tokens
for the terms that a search needs, and the length of every document. A benchmark
item is searched in windows of ``WINDOW`` consecutive words. For each window the
lists of its two rarest terms are fetched, adjusted by the terms' offsets in the
item and intersected: both must start at the same place of the same document. The
few places that remain are compared word by word with the words stored around the
rarest term's posting. So no list of a frequent term is ever moved.

``phrase_matches`` wants the words of a window next to each other and in order,
``proximity_matches`` all of them, in any order, within a distance.

All of it is DataFrame operations. Terms are broadcast if there are at most
``BROADCAST_TERMS`` (terms of a test set, not of the corpus); with more, the same
join shuffles. Documents are told apart by id and text, so equal ids with other
texts do not mix. A posting list is spread by document, so a passage that a third
of all documents share makes no hot task.

Edge cases: null and empty texts have no words and no hits; an item without id or
words is ignored; items with equal ids count as one item; repeated documents get a
row each; empty tables give no hits, or no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.common import LOWER, UPPER, documents, only
from marquee.session import cut

WINDOW = 10
BROADCAST_TERMS = 500_000
#: Everything that is not part of a word, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands before and after the words of a document, and of an item; neither is a word.
DOC_EDGE, ITEM_EDGE = " ", "-"
#: The term under which the index keeps the length of each document.
LENGTH = ""


def words_of(text: str = "text") -> Column:
    """The words of a text; null has none."""
    # Only A-Z change, so a text of ASCII alone may take the faster way.
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def padded(words: Column, edge: str, reach: int) -> Column:
    pad = F.array_repeat(F.lit(edge), reach)
    return F.concat(pad, words, pad)


def few(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The rows, with the hint to broadcast them if their number allows it."""
    small = rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return (F.broadcast(rows) if small else rows), small


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words_of().alias("words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (column ``term``) occurs in all documents."""
    tokens = docs.select(F.explode(words_of()).alias("term"))
    found = tokens.join(few(terms)[0], "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def build_index(docs: DataFrame, terms: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """Postings ``term, doc_id, text_key, pos, around`` for ``terms`` (``term``, ``leads``).

    ``around`` has the ``reach`` words before and after, for terms that lead a search.
    One more row per document, with the term ``LENGTH``, has its number of words as ``pos``.
    """
    wanted = terms.unionByName(docs.sparkSession.range(1).select(F.lit(LENGTH).alias("term"), F.lit(False).alias("leads")))
    wanted, small = few(wanted)
    rows = keyed(docs).select("doc_id", "text_key", padded(F.col("words"), DOC_EDGE, reach).alias("line"), F.array_prepend("words", LENGTH).alias("terms"))
    line = F.slice("line", F.greatest(F.col("at"), F.lit(1)), 2 * reach + 1)
    tokens = rows.select("doc_id", "text_key", "line", F.posexplode("terms").alias("at", "term"))
    if not small:  # then tokens are shuffled, and must not drag their whole document along
        tokens = tokens.withColumn("line", line)
    found = tokens.join(wanted, "term")
    length = F.size("line") - 2 * reach if small else F.lit(None).cast("int")
    postings = found.select(
        "term", "doc_id", "text_key",
        F.when(F.col("term") == LENGTH, length).otherwise(F.col("at") - 1).alias("pos"),
        F.when(F.col("leads"), line if small else F.col("line")).alias("around"),
    )
    if not small:
        lengths = keyed(docs).select(F.lit(LENGTH).alias("term"), "doc_id", "text_key", F.size("words").alias("pos"), F.lit(None).cast("array<string>").alias("around"))
        postings = postings.filter(F.col("term") != LENGTH).unionByName(lengths)
    return cut(postings)


def item_words(items: DataFrame) -> DataFrame:
    """``item_id`` and ``words`` of each different item that has words."""
    return items.select("item_id", words_of().alias("words")).filter("item_id IS NOT NULL AND size(words) > 0").distinct()


def rarest_pairs(items: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every window its two rarest terms as ``item_id, words, first, second`` (positions in the item).

    ``least`` is the length of the item's windows. Windows with the same two are one
    row; a window of one word has it twice.
    """
    long = items.withColumn("least", F.least(F.lit(window), F.size("words")))
    starts = long.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("least"))))
    places = starts.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("least") - 1)))
    places = places.withColumn("term", F.col("words")[F.col("at")])
    counted = places.join(cut(term_counts(docs, places.select("term").distinct())), "term")
    # Windows next to each other should choose alike: equal counts go by the term, equal terms by the place.
    rank = F.row_number().over(W.partitionBy("item_id", "words", "start").orderBy("n", "term", "at"))
    two = counted.withColumn("rank", rank).filter("rank <= 2")
    chosen = two.groupBy("item_id", "words", "least", "start").agg(
        F.max(F.when(F.col("rank") == 1, F.col("at"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("at"))).alias("second")
    )
    return chosen.select("item_id", "words", "least", "first", F.coalesce("second", "first").alias("second")).distinct()


def terms_of(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("words")[F.col("first")].alias("term"), F.lit(True).alias("leads")).unionByName(
        pairs.select(F.col("words")[F.col("second")].alias("term"), F.lit(False).alias("leads"))
    )
    return both.groupBy("term").agg(F.max("leads").alias("leads"))


def phrase_matches(index: DataFrame, pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of document words equal to a run of the item's, long enough for a window.

    Returns ``item_id, doc_id, text_key, start, stop`` (positions, both included). The
    runs reach at most ``window - 1`` words away from the rarest term, so longer ones
    come in overlapping parts.
    """
    reach = window - 1
    line = F.slice(padded(F.col("words"), ITEM_EDGE, reach), F.col("first") + 1, 2 * reach + 1)
    wanted = pairs.select(
        F.xxhash64("item_id", "words", "first", "second").alias("pair"), "item_id", "least", "first", "second", line.alias("item_line"),
        F.col("words")[F.col("first")].alias("first_term"), F.col("words")[F.col("second")].alias("second_term"),
    )
    leads = few(wanted.select(F.col("first_term").alias("term"), "pair", "first", "item_id", "least", "item_line"))[0]
    lists = index.filter("around IS NOT NULL").join(leads, "term")
    lists = lists.select("pair", "doc_id", "text_key", (F.col("pos") - F.col("first")).alias("shift"), "pos", "around", "item_id", "least", "item_line")
    followers = few(wanted.select(F.col("second_term").alias("term"), "pair", "second"))[0]
    second = index.filter(F.col("term") != LENGTH).join(followers, "term").select("pair", "doc_id", "text_key", (F.col("pos") - F.col("second")).alias("shift"))
    both = lists.alias("a").join(
        second.alias("b"),
        (F.col("a.pair") == F.col("b.pair")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.shift") == F.col("b.shift")),
        "left_semi",
    )
    same = both.withColumn("same", F.zip_with("around", "item_line", lambda a, b: a == b))

    def run(side: Column) -> Column:
        """How many words are equal before the first that is not."""
        stop = F.array_position(side, False)
        return F.when(stop == 0, F.lit(reach)).otherwise(stop - 1).cast("int")

    before = run(F.reverse(F.slice("same", 1, reach))) if reach else F.lit(0)
    after = run(F.slice("same", reach + 2, reach)) if reach else F.lit(0)
    runs = same.select("item_id", "doc_id", "text_key", "least", (F.col("pos") - before).alias("start"), (F.col("pos") + after).alias("stop"))
    return runs.filter(F.col("stop") - F.col("start") + 1 >= F.col("least")).drop("least")


def proximity_matches(index: DataFrame, pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Places of a window's rarest term with all words of some window around it, in any order.

    ``index`` must be built with the wanted distance as ``reach``. Returns ``item_id,
    doc_id, text_key, pos``.
    """
    lead = F.col("words")[F.col("first")]
    starts = F.sequence(F.greatest(F.lit(0), F.col("first") - F.col("least") + 1), F.least(F.col("first"), F.size("words") - F.col("least")))
    wanted = pairs.select("item_id", lead.alias("term"), F.col("words")[F.col("second")].alias("second_term"), F.transform(starts, lambda s: F.slice(F.col("words"), s + 1, F.col("least"))).alias("choices"))
    near = index.filter("around IS NOT NULL").join(few(wanted)[0], "term").filter(F.array_contains(F.col("around"), F.col("second_term")))
    whole = F.exists("choices", lambda c: F.size(F.array_except(c, F.col("around"))) == 0)
    return near.filter(whole).select("item_id", "doc_id", "text_key", "pos").distinct()


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` for ``items``, and the phrase matches."""
    pairs = cut(rarest_pairs(item_words(items), docs, window))
    index = build_index(docs, terms_of(pairs), window - 1)
    return index, phrase_matches(index, pairs, window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside an occurring window), ``items`` (ids that occur, as sorted strings)."""
    index, matches = search(only(docs, "doc_id", "text"), only(items, "item_id", "text"), window)
    found = matches.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.collect_set(F.struct("start", "stop")).alias("runs")
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["stop"])))))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "items", words.alias("n_hit"))
    lengths = index.filter(F.col("term") == LENGTH).select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    rows = lengths.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    return rows.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item; columns stay as they are."""
    names = docs.columns
    _, matches = search(only(docs, "doc_id", "text"), only(items, "item_id", "text"), window)
    bad = few(cut(matches.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()))[0]
    rows = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_anti").select(*[F.col(f"`{c}`") for c in names])


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, list_slice(w, s, s + least({WINDOW}, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, n, s, list_slice(w, s, s + n - 1) AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))
), h AS (
  SELECT r, s, n, item_id FROM dw JOIN iw USING (n, g)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM h GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""
