"""Weekly digest: favourites coming up and new events that fit a user's taste."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.dates import effective_end
from marquee.session import cut


def _week() -> Column:
    return F.expr("INTERVAL '168' HOUR")


def _subscribers(favorites: DataFrame, users: DataFrame) -> DataFrame:
    wanted = users.filter(~F.col("digest_opt_out")).select(F.col("id").alias("user_id"))
    return favorites.select("user_id", "event_id").join(wanted, "user_id", "left_semi")


def digest_favorites(favorites: DataFrame, users: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """``user_id, event_id`` of favourites that overlap the next seven days."""
    ends = effective_end(F.col("starts_at"), F.col("ends_at"))
    week = events.filter((F.col("starts_at") <= now + _week()) & (ends >= now)).select(F.col("id").alias("event_id"))
    return _subscribers(favorites, users).join(week, "event_id", "left_semi").select("user_id", "event_id")


def suggestion_members(favorites: DataFrame, users: DataFrame, events: DataFrame) -> DataFrame:
    """``user_id, city, genre``: the taste groups of a user, each favourite city with each favourite genre."""
    liked = cut(_subscribers(favorites, users).join(events.select(F.col("id").alias("event_id"), "city", "genre"), "event_id").select("user_id", "city", "genre").distinct())
    # A user has few cities and at most seven genres.
    return liked.select("user_id", "city").distinct().join(liked.select("user_id", "genre").distinct(), "user_id")


def suggestion_groups(events: DataFrame, now: Column) -> DataFrame:
    """``city, genre, event_id``: the new upcoming events of a taste group, once for all its members."""
    fresh = events.filter((F.col("created_at") >= now - _week()) & (F.col("created_at") <= now) & (F.col("starts_at") >= now))
    return fresh.select("city", "genre", F.col("id").alias("event_id"))


def digest_suggestions(favorites: DataFrame, users: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """``user_id, event_id`` of new upcoming events in a favourite city and a favourite genre: the members' groups, written out."""
    return suggestion_members(favorites, users, events).join(suggestion_groups(events, now), ["city", "genre"]).select("user_id", "event_id")


def digest(favorites: DataFrame, users: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Both parts, each event once per user; a favourite beats a suggestion."""
    parts = digest_favorites(favorites, users, events, now).withColumn("part", F.lit("a")).unionByName(
        digest_suggestions(favorites, users, events, now).withColumn("part", F.lit("b"))
    )
    return parts.groupBy("user_id", "event_id").agg(F.min("part").alias("part"))
