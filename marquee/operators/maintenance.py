"""Clean-up and reporting jobs over the canonical tables."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drop_source(event_sources: DataFrame, sources: DataFrame, slug: str) -> DataFrame:
    """Listings without those of one seller."""
    gone = sources.filter(F.col("slug") == slug).select(F.col("id").alias("source_id"))
    return event_sources.join(gone, "source_id", "left_anti").select(event_sources.columns)


def orphan_events(events: DataFrame, event_sources: DataFrame) -> DataFrame:
    """Events that no listing backs."""
    return events.join(event_sources.select(F.col("event_id").alias("id")), "id", "left_anti")


def without_orphans(events: DataFrame, event_sources: DataFrame) -> DataFrame:
    return events.join(event_sources.select(F.col("event_id").alias("id")), "id", "left_semi")


def cascade(children: DataFrame, events: DataFrame) -> DataFrame:
    """Listings or favourites of events that still exist."""
    return children.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def listing_counts(event_sources: DataFrame) -> DataFrame:
    return event_sources.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("listings"))


def source_report(events: DataFrame, event_sources: DataFrame, sources: DataFrame, slug: str) -> DataFrame:
    """Events one seller lists, newest first, with how many listings each has and who else sells them."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name"))
    sellers = (
        event_sources.select(F.col("event_id").alias("id"), "source_id").join(names, "source_id").groupBy("id")
        .agg(F.array_sort(F.collect_set("name")).alias("sellers"))
    )
    seller = sources.filter(F.col("slug") == slug).select(F.col("id").alias("source_id"))
    listed = event_sources.join(seller, "source_id", "left_semi").select(F.col("event_id").alias("id"))
    return (
        events.join(listed, "id", "left_semi")
        .join(listing_counts(event_sources), "id")
        .join(sellers, "id")
        .select("id", "title", "venue", "city", "starts_at", "price_from", "currency", "genre", "created_at", "listings", "sellers")
        .orderBy(F.desc("created_at"), "id")
    )


def multi_source_events(event_sources: DataFrame) -> DataFrame:
    """Events with more than one listing."""
    return listing_counts(event_sources).filter("listings > 1")


def title_contains(events: DataFrame, event_sources: DataFrame, text: str) -> DataFrame:
    """Events whose title contains the text, with price and number of listings."""
    return (
        events.filter(F.col("title").contains(text))
        .join(listing_counts(event_sources), "id", "left")
        .select("id", "title", "price_from", F.coalesce("listings", F.lit(0)).alias("listings"))
    )


def stale_listings(event_sources: DataFrame, runs: DataFrame, keep_runs: int = 2) -> DataFrame:
    """Listings their seller's last runs did not see. ``runs`` is ``source_id, run_at``."""
    place = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("run_at")))
    edge = runs.withColumn("place", place).filter(F.col("place") <= keep_runs)
    oldest = edge.groupBy("source_id").agg(F.min("run_at").alias("oldest"), F.count(F.lit(1)).alias("n"))
    return (
        event_sources.join(oldest.filter(F.col("n") == keep_runs), "source_id")
        .filter(F.col("last_seen_at") < F.col("oldest"))
        .select(event_sources.columns)
    )
