"""Pairwise matching: listing to stored event by URL, fingerprint or similar title.

The fuzzy rule is "same city, starts at most three hours apart, numbers do not
conflict, edit distance below a fifth of the longer title". It is evaluated in
two exact steps so that no city or time slot is ever paired with itself:

* ``similar_titles`` works on the *distinct* titles of a city and period. The
  longer title of a pair is cut into one more piece than the edits it allows, so
  one piece survives unchanged in the shorter title; the join key is that piece.
* ``near_blocks`` spreads an event to the three-hour blocks around it, once per
  similar title, so events and listings meet on an equi-key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.config import FUZZY_DIVISOR, FUZZY_WINDOW_MS, TITLE_PERIOD_MS
from marquee.functions import dates, text

BLOCK_KEY = ["city", "title_key", "block"]
_PIECE_SIZES = (3, 4, 5)


def url_match(listings: DataFrame, event_sources: DataFrame) -> DataFrame:
    """Add the event a listing URL already belongs to; NULL for a new URL."""
    return listings.join(event_sources.select("url", F.col("event_id").alias("known_event_id")), "url", "left")


def fingerprint_match(listings: DataFrame, events: DataFrame) -> DataFrame:
    """Add the event with the same fingerprint, if any."""
    return listings.join(events.select("fingerprint", F.col("id").alias("matched_event_id")), "fingerprint", "left")


def block_of(ms: Column) -> Column:
    return F.floor(ms / FUZZY_WINDOW_MS)


def with_block(rows: DataFrame) -> DataFrame:
    """Start time in milliseconds and the three-hour block it falls in."""
    return rows.withColumn("starts_ms", dates.epoch_ms(F.col("starts_at"))).withColumn("block", block_of(F.col("starts_ms")))


def keyed_events(events: DataFrame) -> DataFrame:
    """The columns of stored events that matching needs."""
    return with_block(
        events.select("id", "created_at", "fingerprint", "city", text.normalize_text(F.col("title")).alias("title_key"), "starts_at")
    ).drop("starts_at")


def _period(ms: Column) -> Column:
    return F.floor(ms / TITLE_PERIOD_MS)


def _pieces(title: Column, parts: Column) -> Column:
    """Cut into ``parts`` even pieces: array of (piece, position)."""
    size = F.length(title)

    def cut_at(i: Column) -> Column:
        return F.floor(i * size / parts).cast("int")

    return F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda i: F.struct(
            F.substring(title, cut_at(i) + 1, cut_at(i + 1) - cut_at(i)).alias("piece"), (cut_at(i) + 1).alias("position")
        ),
    )


def _substrings(title: Column) -> Column:
    """Every substring as long as a piece can be: array of (piece, position)."""
    nothing = F.array().cast("array<struct<piece:string,position:int>>")

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(title) - n + 1, F.lit(1)))
        found = F.transform(starts, lambda p: F.struct(F.substring(title, p, F.lit(n)).alias("piece"), p.alias("position")))
        return F.when(F.length(title) >= n, found).otherwise(nothing)

    return F.concat(*map(of_size, _PIECE_SIZES))


def similar_titles(rows: DataFrame) -> DataFrame:
    """Titles of one city that may name the same event, both ways and each with itself.

    ``rows`` carries ``city``, ``title_key`` and ``starts_ms``. The result has one row
    per (city, title_key, other_key) with the edit distance and the longer length.
    """
    usable = rows.filter(F.col("title_key") != "").select("city", "title_key", "starts_ms")
    plain = usable.select("city", "title_key", _period(F.col("starts_ms")).alias("period")).distinct()
    edges = F.array_distinct(F.array(_period(F.col("starts_ms") - FUZZY_WINDOW_MS), _period(F.col("starts_ms") + FUZZY_WINDOW_MS)))
    widened = usable.select("city", "title_key", F.explode(edges).alias("period")).distinct()

    def measured(titles: DataFrame, name: str, *filed: list[Column]) -> DataFrame:
        """Size of each title and the number keys it is filed under, with and without numbers."""
        numbered = titles.withColumn("numbers", text.numbers_in(F.col("title_key")))
        keys = F.when(F.col("numbers") != "", F.array(*filed[0])).otherwise(F.array(*filed[1]))
        return numbered.select(
            "city", "period", F.col("title_key").alias(name), F.length("title_key").alias(f"{name}_size"), F.explode(keys).alias("numbers")
        )

    # Equal numbers meet under the numbers, a title without any meets all others: each pair
    # that may match has exactly one key in common, one with different numbers has none.
    numbers, nothing, anything = F.col("numbers"), F.lit(""), F.lit("*")

    # One piece of up to five characters allows no edit: only an equal title would match.
    edits_allowed = text.allowed_edits(F.col("long_size"))
    longer = (
        measured(widened, "long", [numbers, anything], [nothing])
        .filter(F.col("long_size") > FUZZY_DIVISOR)
        .withColumn("edits_allowed", edits_allowed)
        .withColumn("cut", F.explode(_pieces(F.col("long"), F.col("edits_allowed") + 1)))
        .select("*", F.col("cut.piece").alias("piece"), F.col("cut.position").alias("long_at"))
        .drop("cut")
    )
    shorter = (
        measured(plain, "short", [numbers, nothing], [nothing, anything])
        .withColumn("cut", F.explode(_substrings(F.col("short"))))
        .select("*", F.col("cut.piece").alias("piece"), F.col("cut.position").alias("short_at"))
        .drop("cut")
    )
    edits = F.call_function("levenshtein", F.col("short"), F.col("long"), F.col("edits_allowed"))
    pairs = (
        longer.join(shorter, ["city", "period", "numbers", "piece"])
        .filter(
            ((F.col("short_size") < F.col("long_size")) | ((F.col("short_size") == F.col("long_size")) & (F.col("short") < F.col("long"))))
            & (F.col("long_size") - F.col("short_size") <= F.col("edits_allowed"))
            & (F.abs(F.col("long_at") - F.col("short_at")) <= F.col("edits_allowed"))
            & (edits >= 0)
        )
        .select("city", "short", "long", edits.alias("edits"), F.col("long_size").alias("size"))
        .distinct()
    )
    both = F.explode(F.array(F.struct("short", "long"), F.struct(F.col("long").alias("short"), F.col("short").alias("long"))))
    near = pairs.select("city", "edits", "size", both.alias("pair")).select(
        "city", F.col("pair.short").alias("title_key"), F.col("pair.long").alias("other_key"), "edits", "size"
    )
    own = usable.select("city", "title_key").distinct()
    same = own.select(
        "city", "title_key", F.col("title_key").alias("other_key"), F.lit(0).alias("edits"), F.length("title_key").alias("size")
    )
    return near.unionByName(same)


def near_blocks(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Repeat each row for every similar title and the three blocks in reach.

    ``title_key`` and ``block`` of the result are where the row can be *found*.
    """
    return (
        rows.join(titles, ["city", "title_key"])
        .withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumn("title_key", F.col("other_key"))
        .withColumn("block", F.col("block") + F.col("step"))
        .drop("other_key", "step")
    )


def in_window(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= FUZZY_WINDOW_MS


def fuzzy_candidates(listings: DataFrame, events: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Stored events each listing matches by title and time, with the distance."""
    probes = with_block(listings.select("seq", "city", "title_key", "starts_at")).drop("starts_at")
    stored = keyed_events(events)
    shape = ["city", "title_key", "starts_ms"]
    titles = similar_titles(probes.select(shape).unionByName(stored.select(shape))) if titles is None else titles
    reach = near_blocks(stored, titles).select(
        *BLOCK_KEY, "id", "created_at", F.col("starts_ms").alias("event_ms"), (F.col("edits") / F.col("size")).alias("distance")
    )
    return (
        probes.join(reach, BLOCK_KEY)
        .filter(in_window(F.col("starts_ms"), F.col("event_ms")))
        .select("seq", F.col("id").alias("event_id"), "created_at", "distance")
    )


def fuzzy_match(listings: DataFrame, events: DataFrame) -> DataFrame:
    """The closest stored event per listing; ties go to the older event.

    Events of one block that are equally far and start together are reduced to
    the oldest before the join, so a listing meets a bounded number of rows.
    """
    probes = with_block(listings.select("seq", "city", "title_key", "starts_at")).drop("starts_at")
    stored = keyed_events(events)
    shape = ["city", "title_key", "starts_ms"]
    titles = similar_titles(probes.select(shape).unionByName(stored.select(shape)))
    best = closest(probes, near_blocks(stored, titles), F.struct("created_at", "id"))
    return best.select("seq", F.col("best.order.id").alias("event_id"), F.col("best.distance").alias("distance"))


def closest(probes: DataFrame, reach: DataFrame, order: Column, extra: Column | None = None) -> DataFrame:
    """``best`` = struct<distance, order> per ``seq`` over the rows in reach.

    ``extra`` may restrict the pair further; it may name ``seq`` and ``first``.
    """
    reduced = reach.groupBy(*BLOCK_KEY, F.col("starts_ms").alias("event_ms"), (F.col("edits") / F.col("size")).alias("distance")).agg(
        F.min(order).alias("first")
    )
    condition = in_window(F.col("starts_ms"), F.col("event_ms"))
    return (
        probes.join(reduced, BLOCK_KEY)
        .filter(condition if extra is None else condition & extra)
        .groupBy("seq")
        .agg(F.min(F.struct("distance", F.col("first").alias("order"))).alias("best"))
    )
