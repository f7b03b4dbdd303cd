"""Untrusted listings to validated rows, with a reason for every rejected one."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import dates, genres, places, prices, text, urls


def fingerprint(title_key: Column, venue_key: Column, starts: Column) -> Column:
    """Exact identity of an event: title, venue and Prague day."""
    return F.concat_ws("|", title_key, venue_key, dates.prague_day(starts).cast("string"))


def derive_sort_fields(events: DataFrame) -> DataFrame:
    return events.withColumn("start_day", dates.prague_day(F.col("starts_at"))).withColumn(
        "price_known", F.col("price_from").isNotNull()
    )


def check_listings(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Normalised columns next to ``reason``, which is NULL for a valid listing."""
    starts, ends, image = F.col("starts_at"), F.col("ends_at"), F.trim(F.col("image_url"))
    cleaned = raw.select(
        "seq",
        F.col("source").alias("source_slug"),
        "source_url",
        urls.url_parts(F.col("source_url")).alias("url_parts"),
        text.collapse_space(F.col("title")).alias("title"),
        text.collapse_space(F.col("venue")).alias("venue"),
        F.col("city").alias("raw_city"),
        text.normalize_text(F.col("city")).alias("city_key"),
        F.col("country").alias("raw_country"),
        dates.to_ms(starts).alias("starts_at"),
        dates.to_ms(F.when(ends > starts, ends)).alias("ends_at"),
        F.when(image.rlike("(?i)^https?://"), image).alias("image_url"),
        text.normalize_text(F.coalesce("raw_genre", F.lit(""))).alias("genre_key"),
        prices.price_sanitize(F.col("price_from")).alias("price"),
        prices.price_overflow(F.col("price_from")).alias("price_too_big"),
        F.col("currency").alias("raw_currency"),
    )
    # Shared sub-results are columns of their own step, so each is computed once.
    keyed = cleaned.withColumns(
        {
            "title_key": text.normalize_text(F.col("title")),
            "city": places.city_from_key(F.col("raw_city"), F.col("city_key")),
            "genre": genres.genre_from_key(F.col("genre_key")),
            "url": urls.url_from_parts(F.col("url_parts")),
        }
    )
    placed = keyed.withColumn("country", F.coalesce(places.country_for_city(F.col("city")), F.col("raw_country")))
    known = sources.select(F.col("slug").alias("source_slug"), F.col("id").alias("source_id"))
    reason = (
        F.when(F.col("title_key") == "", "empty title")
        .when(F.col("starts_at").isNull(), "invalid startsAt")
        .when(F.col("city") == "", "empty city")
        .when(F.col("country").isNull(), F.concat(F.lit('unknown country for city "'), "city", F.lit('"')))
        .when(F.col("url").isNull(), "Invalid URL")
        .when(F.col("source_id").isNull(), F.concat(F.lit('unknown source "'), "source_slug", F.lit('"')))
        .when(F.col("price_too_big"), "price overflow")
    )
    currency = prices.currency_of(F.col("country"))
    return placed.join(known, "source_slug", "left").select(
        "seq",
        "source_slug",
        "source_id",
        "source_url",
        "url",
        "title",
        "venue",
        "city",
        "country",
        currency.alias("currency"),
        "genre",
        "starts_at",
        "ends_at",
        "image_url",
        fingerprint(F.col("title_key"), text.normalize_text(F.col("venue")), F.col("starts_at")).alias("fingerprint"),
        "title_key",
        "price",
        F.coalesce("raw_currency", currency).alias("price_currency"),
        reason.alias("reason"),
    )


def normalized(checked: DataFrame) -> DataFrame:
    return checked.filter("reason IS NULL").drop("reason", "source_url")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.filter("reason IS NOT NULL").select("seq", F.col("source_url").alias("url"), "reason")
