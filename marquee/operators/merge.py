"""Apply resolved listings and re-scrapes to the canonical tables.

Groups are reduced with mergeable aggregates (min, max, min_by, max_by) before
they meet their event, so an event with very many listings stays cheap.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.drift import starts_in_effect
from marquee.operators.normalize import derive_sort_fields
from marquee.session import cut

REPLACED_FIELDS = ["starts_at", "title", "venue", "ends_at", "fingerprint"]


# --- price and blank fields ------------------------------------------------
def event_price(events: DataFrame, event_sources: DataFrame) -> DataFrame:
    """Lowest known listing price in the event's own currency: ``id, price_from``."""
    lowest = event_sources.groupBy(F.col("event_id").alias("id"), "currency").agg(F.min("price_from").alias("price_from"))
    return events.select("id", "currency").join(lowest, ["id", "currency"], "left").select("id", "price_from")


def blank_fill(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Values for blank fields: ``id, image_fill, ends_fill``.

    ``incoming`` has ``event_id, seq, image_url, ends_at`` and ``starts_in_effect``,
    the event's start when the listing arrived. The first usable value wins.
    """
    ends = F.col("ends_at").isNotNull() & (F.col("ends_at") > F.col("starts_in_effect"))
    first = incoming.groupBy(F.col("event_id").alias("id")).agg(
        F.min(F.when(F.col("image_url") != "", F.struct("seq", "image_url"))).alias("image"),
        F.min(F.when(ends, F.struct("seq", "ends_at"))).alias("ends"),
    )
    blank_image = F.col("image_url").isNull() | (F.col("image_url") == "")
    return events.select("id", "image_url", "ends_at").join(first, "id").select(
        "id",
        F.when(blank_image, F.col("image.image_url")).alias("image_fill"),
        F.when(F.col("ends_at").isNull(), F.col("ends.ends_at")).alias("ends_fill"),
    )


def refresh_events(events: DataFrame, event_sources: DataFrame, fills: DataFrame, now: Column) -> DataFrame:
    """Fill blanks, then recompute price and sort fields of the events in ``fills``."""
    touched = fills.withColumn("touched", F.lit(True))
    priced = event_price(events, event_sources).withColumnRenamed("price_from", "new_price")
    joined = events.join(touched, "id", "left").join(priced, "id", "left")
    hit = F.col("touched").isNotNull()
    # An empty image counts as blank but stays when there is nothing to fill it with.
    return derive_sort_fields(
        joined.withColumn("image_url", F.coalesce("image_fill", "image_url"))
        .withColumn("ends_at", F.coalesce("ends_at", "ends_fill"))
        .withColumn("price_from", F.when(hit, F.col("new_price")).otherwise(F.col("price_from")))
        .withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    ).select(events.columns)


# --- new URLs --------------------------------------------------------------
def first_of_url(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into the first listing of every URL and the later repeats."""
    first = listings.groupBy("url").agg(F.min("seq").alias("seq")).select("seq")
    return listings.join(first, "seq", "left_semi"), listings.join(first, "seq", "left_anti")


def split_by_url(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``first_of_url``, written in one pass for callers that read both parts, or one of them several times."""
    first = listings.groupBy("url").agg(F.min("seq").alias("seq")).select("seq").distinct().withColumn("first", F.lit(True))
    marked = cut(listings.join(first, "seq", "left"))
    return marked.filter("first").select(listings.columns), marked.filter("first IS NULL").select(listings.columns)


def new_events(listings: DataFrame, assignments: DataFrame, now: Column) -> DataFrame:
    """Rows for the events founded in this batch."""
    founded = assignments.filter("matched_by = 'new'").select("seq", F.col("event_id").alias("id"))
    own_price = F.when(F.col("price_currency") == F.col("currency"), F.col("price"))
    return derive_sort_fields(
        listings.join(founded, "seq").withColumn("price_from", own_price).withColumn("created_at", now).withColumn("updated_at", now)
    ).select(
        "id", "title", "venue", "city", "country", "starts_at", "ends_at", "price_from", "currency",
        "start_day", "price_known", "genre", "image_url", "fingerprint", "created_at", "updated_at",
    )


def new_event_sources(listings: DataFrame, assignments: DataFrame, now: Column) -> DataFrame:
    """One listing row per new URL, on the event it was resolved to."""
    return listings.join(assignments.select("seq", "event_id"), "seq").select(
        F.sha2(F.concat(F.lit("listing|"), "url"), 256).alias("id"),
        "event_id",
        "source_id",
        "url",
        F.col("price").alias("price_from"),
        F.col("price_currency").alias("currency"),
        now.alias("last_seen_at"),
        now.alias("last_detail_fetched_at"),
    )


def attach_new(
    events: DataFrame, event_sources: DataFrame, listings: DataFrame, assignments: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Events and listings after a resolved batch of new URLs."""
    grown = events.unionByName(new_events(listings, assignments, now))
    rows = event_sources.unionByName(new_event_sources(listings, assignments, now))
    attached = listings.select("seq", "image_url", "ends_at").join(assignments.filter("matched_by <> 'new'"), "seq")
    in_effect = attached.join(grown.select(F.col("id").alias("event_id"), F.col("starts_at").alias("starts_in_effect")), "event_id")
    return refresh_events(grown, rows, blank_fill(grown, in_effect), now), rows


# --- known URLs ------------------------------------------------------------
def rescrape_update(event_sources: DataFrame, rescrapes: DataFrame, now: Column) -> DataFrame:
    """Listing rows with the price of their latest re-scrape; both times move to ``now``."""
    last = rescrapes.groupBy("url").agg(F.max(F.struct("seq", "price", "price_currency")).alias("last"))
    seen = F.col("last").isNotNull()
    return (
        event_sources.join(last, "url", "left")
        .withColumn("price_from", F.when(seen, F.col("last.price")).otherwise(F.col("price_from")))
        .withColumn("currency", F.when(seen, F.col("last.price_currency")).otherwise(F.col("currency")))
        .withColumn("last_seen_at", F.when(seen, now).otherwise(F.col("last_seen_at")))
        .withColumn("last_detail_fetched_at", F.when(seen, now).otherwise(F.col("last_detail_fetched_at")))
        .select(event_sources.columns)
    )


def of_events(rescrapes: DataFrame, event_sources: DataFrame) -> DataFrame:
    """Re-scrapes with their event and whether other listings back it."""
    # Written first: a join on the partitioning of an aggregate is not split at a hot event.
    backing = cut(event_sources.groupBy("event_id").agg(F.count(F.lit(1)).alias("listings")))
    return (
        rescrapes.join(event_sources.select("url", "event_id"), "url")
        .join(backing, "event_id")
        .withColumn("has_others", F.col("listings") > 1)
        .drop("listings")
    )


def _drift(events: DataFrame, backed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reschedules of events with several listings, in arrival order.

    Returns the final starts and the rows with ``starts_in_effect``.
    """
    starts = events.select(F.col("id").alias("event_id"), F.col("starts_at").alias("first"))
    rows = cut(backed.select("event_id", "seq", "starts_at", "ends_at", "image_url").join(starts, "event_id"))
    scanned = cut(starts_in_effect(rows))
    settled = rows.drop("first").join(scanned.drop("moved"), ["event_id", "seq"])
    final = scanned.filter("moved").groupBy("event_id").agg(F.max_by("starts_in_effect", "seq").alias("moved_start"))
    return final, settled


def rescrape_reconcile(events: DataFrame, rescrapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What re-scrapes make of their events.

    ``rescrapes`` come from ``of_events``. An event with one listing takes five
    fields from its latest re-scrape; one with several only a start that drifted.
    Returns the events with those overrides and the blank-fill input.
    """
    alone = rescrapes.filter("NOT has_others")
    latest = (
        alone.groupBy(F.col("event_id").alias("id"))
        .agg(F.max(F.struct("seq", *REPLACED_FIELDS)).alias("fresh"), F.max("seq").alias("fresh_seq"))
    )
    drifted, settled = _drift(events, rescrapes.filter("has_others"))
    drifted = drifted.withColumnRenamed("event_id", "id")
    joined = events.join(latest, "id", "left").join(drifted, "id", "left")
    replaced = F.col("fresh").isNotNull()
    changed = joined
    for name in REPLACED_FIELDS:
        kept = F.coalesce("moved_start", name) if name == "starts_at" else F.col(name)
        changed = changed.withColumn(name, F.when(replaced, F.col(f"fresh.{name}")).otherwise(kept))
    own = alone.select("event_id", "seq", "starts_at", F.lit(None).cast("timestamp").alias("ends_at"), "image_url").withColumn(
        "starts_in_effect", F.col("starts_at")
    )
    return changed.select(*events.columns, "fresh_seq"), settled.unionByName(own)


def rescrape_collision(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events whose rewritten fingerprint belongs to another event: ``id, owner_id``.

    The owner is an event that kept that fingerprint, else the first to take it.
    ``after`` has ``fresh_seq``, the latest re-scrape of a rewritten event.
    """
    movers = (
        before.select("id", F.col("fingerprint").alias("old"))
        .join(after.filter("fresh_seq IS NOT NULL").select("id", "fingerprint", "fresh_seq"), "id")
        .filter(F.col("old") != F.col("fingerprint"))
        .select("id", "fingerprint", "fresh_seq")
    )
    stayed = after.select("id", "fingerprint").join(movers.select("id"), "id", "left_anti")
    claims = movers.select("fingerprint", F.col("fresh_seq").alias("rank"), "id").unionByName(
        stayed.select("fingerprint", F.lit(-1).cast("long").alias("rank"), "id")
    )
    owners = claims.groupBy("fingerprint").agg(F.min(F.struct("rank", "id")).alias("owner"))
    return movers.join(owners, "fingerprint").filter(F.col("owner.id") != F.col("id")).select("id", F.col("owner.id").alias("owner_id"))


def apply_rescrapes(
    events: DataFrame, event_sources: DataFrame, rescrapes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, listings and outcomes (``seq, outcome, event_id``) after re-scrapes of known URLs."""
    known = cut(of_events(rescrapes, event_sources))
    if known.isEmpty():
        return events, event_sources, known.select("seq", F.lit("updated").alias("outcome"), "event_id")
    rows = rescrape_update(event_sources, known, now)
    after, incoming = rescrape_reconcile(events, known)
    after = cut(after)
    gone = cut(rescrape_collision(events, after))
    left = after.join(gone, "id", "left_anti")
    moved = F.coalesce("owner_id", "event_id")
    rows = rows.join(gone.withColumnRenamed("id", "event_id"), "event_id", "left").withColumn("event_id", moved)
    rows = cut(rows.select(event_sources.columns))

    # What a vanished event last said may fill blanks of the event that took its listing.
    latest = known.join(gone.withColumnRenamed("id", "event_id"), "event_id").join(
        after.select(F.col("id").alias("event_id"), F.col("fresh_seq").alias("seq")), ["event_id", "seq"]
    )
    handed = (
        latest.join(left.select(F.col("id").alias("owner_id"), F.col("starts_at").alias("starts_in_effect")), "owner_id")
        .withColumn("event_id", F.col("owner_id"))
        .select("event_id", "seq", "starts_at", "ends_at", "image_url", "starts_in_effect")
    )
    fills = blank_fill(left, incoming.unionByName(handed))
    refreshed = refresh_events(left.select(events.columns), rows, fills, now)
    outcomes = (
        known.select("seq", "event_id")
        .join(latest.select("seq", "owner_id"), "seq", "left")
        .select("seq", F.when(F.col("owner_id").isNull(), "updated").otherwise("merged").alias("outcome"), F.coalesce("owner_id", "event_id").alias("event_id"))
    )
    return refreshed, rows, outcomes


# --- integrity -------------------------------------------------------------
def integrity_checks(events: DataFrame, event_sources: DataFrame, sources: DataFrame, favorites: DataFrame | None = None) -> DataFrame:
    """Number of rows that break each rule: ``rule, violations``."""

    def duplicates(rows: DataFrame, key: str, rule: str) -> DataFrame:
        extra = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return extra.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))

    def orphans(rows: DataFrame, key: str, parents: DataFrame, rule: str) -> DataFrame:
        lost = rows.select(F.col(key).alias("id")).join(parents.select("id"), "id", "left_anti")
        return lost.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))

    checks = (
        duplicates(events, "fingerprint", "duplicate fingerprint")
        .unionByName(duplicates(event_sources, "url", "duplicate url"))
        .unionByName(duplicates(sources, "slug", "duplicate slug"))
        .unionByName(orphans(event_sources, "event_id", events, "listing without event"))
        .unionByName(orphans(event_sources, "source_id", sources, "listing without source"))
    )
    if favorites is not None:
        checks = checks.unionByName(orphans(favorites, "event_id", events, "favorite without event"))
    return checks
