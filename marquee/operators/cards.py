"""Event cards: an event with its listings in the order they are offered."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import normalize_text
from marquee.operators.ranking import ranked


def event_cards(events: DataFrame, event_sources: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per listing of a card with its ``position``; a bare event keeps one row.

    Own currency first, then known prices, then cheap, then by seller name. Rows
    stay flat: an event may have more listings than fit into one array.
    """
    sellers = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    own = events.select(F.col("id").alias("event_id"), F.col("currency").alias("event_currency"))
    offers = (
        event_sources.select(
            "event_id", F.col("id").alias("listing_id"), "source_id", "url", F.col("price_from").alias("listing_price"), "currency"
        )
        .join(own, "event_id")
        .join(sellers, "source_id")
        .select(
            "event_id",
            "listing_id",
            "source_name",
            "url",
            F.col("listing_price").cast("double").alias("listing_price"),
            F.col("currency").alias("listing_currency"),
            (F.col("currency") != F.col("event_currency")).alias("foreign"),
            F.col("listing_price").isNull().alias("unpriced"),
            F.coalesce("listing_price", F.lit(0)).alias("sort_price"),
            normalize_text(F.col("source_name")).alias("name_key"),
        )
    )
    order = ["foreign", "unpriced", "sort_price", "name_key", "source_name", "listing_id"]
    placed = ranked(offers, ["event_id"], order).drop("foreign", "unpriced", "sort_price", "name_key")
    card = events.select(
        F.col("id").alias("event_id"), "title", "venue", "city", "country", "starts_at", "ends_at",
        F.col("price_from").cast("double").alias("price_from"), "currency", "genre", "image_url",
    )
    # Inner, so that Spark may split the rows of a hot event; bare events are added apart.
    bare = card.join(event_sources.select("event_id"), "event_id", "left_anti")
    empty = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in placed.columns if c != "event_id"]
    return card.join(placed, "event_id").unionByName(bare.select("*", *empty))
