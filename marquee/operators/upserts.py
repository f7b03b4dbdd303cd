"""Keyed writes of the small state tables, as new DataFrames."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add sellers whose slug is new; leave the others as they are."""
    return existing.unionByName(incoming.join(existing.select("slug"), "slug", "left_anti").select(existing.columns))


def source_upsert_overwrite(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add new sellers and take over name and address of known ones."""
    old, new = existing.alias("old"), incoming.alias("new")

    def pick(name: str, *order: str) -> Column:
        return F.coalesce(*[F.col(f"{side}.{name}") for side in order]).alias(name)

    return old.join(new, F.col("old.slug") == F.col("new.slug"), "full").select(
        pick("id", "old", "new"),
        pick("slug", "old", "new"),
        pick("name", "new", "old"),
        pick("base_url", "new", "old"),
        pick("last_scraped_at", "old", "new"),
    )


def stamp_source(sources: DataFrame, slug: str, now: Column) -> DataFrame:
    """Record when a seller was last scraped."""
    return sources.withColumn("last_scraped_at", F.when(F.col("slug") == slug, now).otherwise(F.col("last_scraped_at")))


def scraped_pages_upsert(scraped_pages: DataFrame, fetched_urls: DataFrame, now: Column) -> DataFrame:
    """Every fetched URL is known and was fetched now; other rows keep their time."""
    fetched = fetched_urls.select("url", now.alias("last_fetched_at"))
    return scraped_pages.select("url", "last_fetched_at").unionByName(fetched).groupBy("url").agg(
        F.max("last_fetched_at").alias("last_fetched_at")
    )


def touch_last_seen(event_sources: DataFrame, touched_urls: DataFrame, now: Column) -> DataFrame:
    """Listings that were seen but not fetched only get a new ``last_seen_at``."""
    seen = touched_urls.select("url").distinct().withColumn("seen", F.lit(True))
    return (
        event_sources.join(seen, "url", "left")
        .withColumn("last_seen_at", F.when(F.col("seen"), now).otherwise(F.col("last_seen_at")))
        .select(event_sources.columns)
    )
