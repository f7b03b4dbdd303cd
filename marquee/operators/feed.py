"""Feed queries: upcoming grid, happening-now row, city options, saved searches."""

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.config import (
    CZK_PER_EUR,
    DAY_MS,
    GENRES,
    HAPPENING_NOW_LIMIT,
    MAX_FILTER_CITIES,
    MAX_PAGE,
    PAGE_SIZE,
    SINGLE_EVENT_HOURS,
    WHEN_VALUES,
)
from marquee.functions.dates import effective_end, epoch_ms, range_of, resolve_range
from marquee.functions.prices import within_max_price
from marquee.session import cut

# --- fixed value: the only accepted spelling of a price limit --------------
PLAIN_DECIMAL = r"^[0-9]+(\.[0-9]+)?$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


# --- request parameters ------------------------------------------------------
@dataclass(frozen=True)
class Filters:
    cities: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    when: str | None = None
    max_price: float | None = None
    page: int = 1


def parse_filters(params: Mapping[str, str | list[str]]) -> Filters:
    """One request. Values that make no sense fall back to their default."""

    def values(name: str) -> list[str]:
        found = params.get(name, [])
        return [found] if isinstance(found, str) else list(found)

    cities = dict.fromkeys(c.strip() for c in values("city") if c.strip())
    genres = dict.fromkeys(g for g in values("genre") if g in GENRES)
    when, price, page = ((values(name) or [""])[0] for name in ("when", "maxPrice", "page"))
    limit = float(price) if re.fullmatch(PLAIN_DECIMAL[1:-1], price, re.ASCII) else math.nan
    number = float(page) if re.match(_NUMBER, page, re.ASCII) else math.nan
    return Filters(
        tuple(cities)[:MAX_FILTER_CITIES],
        tuple(genres),
        when if when in WHEN_VALUES else None,
        limit if math.isfinite(limit * CZK_PER_EUR) else None,
        min(math.floor(number), MAX_PAGE) if math.isfinite(number) and number >= 1 else 1,
    )


def _decoded(text: Column) -> Column:
    return F.when(text.rlike("[%+]"), F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(text)


def parse_filter_rows(requests: DataFrame, query: str = "query") -> DataFrame:
    """The same for a table of query strings; adds one column per filter."""
    pairs = F.transform(
        F.filter(F.split(F.ltrim(F.col(query), F.lit("?")), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("name"),
            _decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).alias("value"),
        ),
    )

    def values(name: str) -> Column:
        return F.transform(F.filter(F.col("pairs"), lambda p: p["name"] == name), lambda p: p["value"])

    def first(name: str) -> Column:
        return F.get(values(name), 0)

    staged = requests.withColumn("pairs", pairs).withColumns(
        {
            "cities": F.slice(
                F.array_distinct(F.filter(F.transform(values("city"), lambda c: F.trim(c)), lambda c: c != "")), 1, MAX_FILTER_CITIES
            ),
            "genres": F.array_distinct(F.filter(values("genre"), lambda g: g.isin(GENRES))),
            "when": first("when"),
            "limit": F.when(first("maxPrice").rlike(PLAIN_DECIMAL), first("maxPrice").try_cast("double")),
            "wanted_page": F.when(first("page").rlike(_NUMBER), F.trim(first("page")).try_cast("double")),
        }
    )
    finite = F.col("limit") * CZK_PER_EUR < float("inf")
    page = F.when((F.col("wanted_page") >= 1) & (F.col("wanted_page") < float("inf")), F.least(F.floor("wanted_page"), F.lit(MAX_PAGE)))
    return (
        staged.withColumn("when", F.when(F.col("when").isin(WHEN_VALUES), F.col("when")))
        .withColumn("max_price", F.when(finite, F.col("limit")))
        .withColumn("page", F.coalesce(page, F.lit(1)).cast("int"))
        .drop("pairs", "limit", "wanted_page")
    )


# --- one request -------------------------------------------------------------
def _instant(value: datetime) -> Column:
    """A literal a parquet scan can compare with."""
    value = value.astimezone(timezone.utc) if value.tzinfo else value
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def common_filter(filters: Filters) -> Column:
    """City, genre and price."""
    keep = F.lit(True)
    if filters.cities:
        keep = keep & F.col("city").isin(list(filters.cities))
    if filters.genres:
        keep = keep & F.col("genre").isin(list(filters.genres))
    if filters.max_price is not None:
        keep = keep & within_max_price(F.col("price_from"), F.col("currency"), F.lit(filters.max_price))
    return keep


def feed_grid(events: DataFrame, filters: Filters, now: datetime) -> DataFrame:
    """Events that have not started yet, inside the chosen range.

    Events that carry the ``month`` of their layout are pruned to the months of the range.
    """
    start, end = range_of(filters.when, now)
    rows = events.filter(F.col("starts_at") >= _instant(start))
    if "month" in events.columns:
        months = [None if at is None else _aware(at).astimezone(ZoneInfo("Europe/Prague")).strftime("%Y-%m") for at in (start, end)]
        rows = rows.filter(F.col("month") >= months[0])
        rows = rows if end is None else rows.filter(F.col("month") <= months[1])
    return (rows if end is None else rows.filter(F.col("starts_at") <= _instant(end))).filter(common_filter(filters))


def in_grid_order(events: DataFrame) -> DataFrame:
    """By day, known prices first within the day."""
    return events.orderBy("start_day", F.desc("price_known"), "starts_at", "id")


def feed_page(events: DataFrame, filters: Filters, now: datetime) -> DataFrame:
    """All rows up to the requested page and one more, which tells if there is a next."""
    return in_grid_order(feed_grid(events, filters, now)).limit(filters.page * PAGE_SIZE + 1)


def feed_has_more(events: DataFrame, filters: Filters, now: datetime) -> DataFrame:
    """``shown`` rows of the cumulative pages and whether "load more" is offered."""
    take = filters.page * PAGE_SIZE
    counted = feed_grid(events, filters, now).limit(take + 1).agg(F.count(F.lit(1)).alias("n"))
    more = (F.col("n") > take) & F.lit(filters.page < MAX_PAGE)
    return counted.select(F.least("n", F.lit(take)).alias("shown"), more.alias("has_more"))


def has_next_page(has_more: Column, page: Column) -> Column:
    return has_more & (page < MAX_PAGE)


def ongoing(now: datetime) -> Column:
    """Started and not over; written so that both bounds reach the scan."""
    recent = now - timedelta(hours=SINGLE_EVENT_HOURS)
    return (F.col("starts_at") < _instant(now)) & (
        (F.col("ends_at") >= _instant(now)) | (F.col("ends_at").isNull() & (F.col("starts_at") >= _instant(recent)))
    )


def _soonest_end(rows: DataFrame, limit: int) -> DataFrame:
    return (
        rows.withColumn("effective_end", effective_end(F.col("starts_at"), F.col("ends_at")))
        .orderBy("effective_end", "starts_at", "id")
        .limit(limit)
    )


def happening_now(events: DataFrame, filters: Filters, now: datetime, limit: int = HAPPENING_NOW_LIMIT) -> DataFrame:
    """Events on right now, soonest end first; empty when the range is yet to begin."""
    hidden = range_of(filters.when, now)[0] > _aware(now)
    rows = events.filter(F.lit(not hidden) & ongoing(now) & common_filter(filters))
    return _soonest_end(rows, limit)


def _aware(now: datetime) -> datetime:
    return now if now.tzinfo else now.replace(tzinfo=timezone.utc)


def happening_union(multi_day: DataFrame, single_time: DataFrame, limit: int = HAPPENING_NOW_LIMIT) -> DataFrame:
    """Merge two lists of ongoing events into one, soonest end first."""
    return _soonest_end(multi_day.unionByName(single_time), limit)


def visible_events(events: DataFrame, now: datetime) -> DataFrame:
    """Not over yet, started or not."""
    recent = now - timedelta(hours=SINGLE_EVENT_HOURS)
    return events.filter(
        (F.col("ends_at") >= _instant(now)) | (F.col("ends_at").isNull() & (F.col("starts_at") >= _instant(recent)))
    )


def city_options(events: DataFrame, now: datetime, selected: list[str] | None = None, locale: str = "sk") -> DataFrame:
    """Cities with a visible event, and the selected ones, in the order of the language."""
    cities = visible_events(events, now).select("city")
    if selected:
        named = events.sparkSession.createDataFrame([(c,) for c in selected], "city string")
        cities = cities.unionByName(named)
    return cities.distinct().orderBy(F.collate(F.col("city"), locale))


def home_feed(events: DataFrame, filters: Filters, now: datetime) -> DataFrame:
    """The front page at one instant: ``section`` is happening, grid or city, in order of ``place``.

    All three are bounded by the page size, the row's length and the number of cities.
    """
    order = {
        "happening": [F.col("effective_end"), F.col("starts_at"), F.col("id")],
        "grid": [F.col("start_day"), F.desc("price_known"), F.col("starts_at"), F.col("id")],
        "city": [F.collate(F.col("city"), "sk")],
    }
    parts = {
        "happening": happening_now(events, filters, now),
        "grid": feed_page(events, filters, now).limit(filters.page * PAGE_SIZE),
        "city": city_options(events, now, list(filters.cities)),
    }
    columns = {"id": "string", "title": "string", "city": "string", "starts_at": "timestamp"}
    shown = [
        rows.withColumn("place", F.row_number().over(W.partitionBy(F.lit(name)).orderBy(*order[name]))).select(
            F.lit(name).alias("section"), "place", *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        )
        for name, rows in parts.items()
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


# --- many requests -----------------------------------------------------------
ANY = "*"


def day_slab(at: Column) -> Column:
    """The number of the (UTC) day."""
    return F.floor(epoch_ms(at) / DAY_MS)


def saved_search_match(events: DataFrame, searches: DataFrame, now: Column) -> DataFrame:
    """``search_id, id`` of every upcoming event a stored search finds.

    ``searches`` has ``search_id, cities, genres, when, max_price``. A search is
    filed under each of its (city, genre) pairs, an empty list under a wildcard, on every day of its
    range between the first and the last upcoming event; an event is looked up under its four possible
    keys of its day. So the match is an equi-join, and no key holds more than the events of a day.
    """
    upcoming = events.filter(F.col("starts_at") >= now).withColumn("slab", day_slab(F.col("starts_at")))
    first, last = upcoming.agg(F.min("slab"), F.max("slab")).first()
    first, last = F.lit(0 if first is None else first), F.lit(-1 if last is None else last)
    anything = F.array(F.lit(ANY))

    def key(values: str) -> Column:
        return F.explode(F.when(F.size(values) > 0, F.col(values)).otherwise(anything))

    ranges = resolve_range(F.col("when"), now)
    filed = (
        searches.withColumn("span", ranges)
        .select("search_id", "max_price", "genres", "span", key("cities").alias("city_key"))
        .withColumn("genre_key", key("genres"))
        .withColumn("low", F.greatest(first, day_slab(F.col("span.start"))))
        .withColumn("high", F.least(last, F.coalesce(day_slab(F.col("span.end")), last)))
        .filter("low <= high")
        .withColumn("slab", F.explode(F.sequence("low", "high")))
        .drop("genres", "low", "high")
    )
    found = (
        upcoming.select("id", "starts_at", "price_from", "currency", "slab", F.col("genre"), F.explode(F.array("city", F.lit(ANY))).alias("city_key"))
        .withColumn("genre_key", F.explode(F.array("genre", F.lit(ANY))))
    )
    in_range = (F.col("starts_at") >= F.col("span.start")) & (F.col("span.end").isNull() | (F.col("starts_at") <= F.col("span.end")))
    affordable = F.col("max_price").isNull() | within_max_price(F.col("price_from"), F.col("currency"), F.col("max_price"))
    return found.join(filed, ["slab", "city_key", "genre_key"]).filter(in_range & affordable).select("search_id", "id", "starts_at")


def saved_search_counts(events: DataFrame, searches: DataFrame, now: Column) -> DataFrame:
    """``search_id, matches, first_start`` of every stored search that finds something.

    Equal searches are matched once, however many users stored them.
    """
    named, distinct = same_searches(searches)
    found = saved_search_match(events, distinct, now).groupBy("search_id")
    counts = found.agg(F.count(F.lit(1)).alias("matches"), F.min("starts_at").alias("first_start"))
    return named.join(counts.withColumnRenamed("search_id", "same"), "same").drop("same")


def same_searches(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``search_id, same`` with the smallest id of an equal search, and the searches of those ids."""
    terms = ["cities", "genres", "when", "max_price"]
    sets = [F.array_sort(F.array_distinct(c)).alias(c) for c in terms[:2]]
    keyed = searches.select("search_id", *sets, *terms[2:]).withColumn("terms", F.sha2(F.to_json(F.struct(*terms)), 256))
    distinct = cut(keyed.groupBy("terms").agg(F.min("search_id").alias("same"), *[F.first(c).alias(c) for c in terms]))
    named = keyed.select("search_id", "terms").join(distinct.select("terms", "same"), "terms").select("search_id", "same")
    return named, distinct.withColumnRenamed("same", "search_id").drop("terms")
