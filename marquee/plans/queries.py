"""Every operator as a query over the provided tables."""

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.config import WHEN_VALUES
from marquee.functions import dates, markup, places, prices, text, urls
from marquee.operators import cards, digest, extract, feed, frontier, linkage, maintenance, merge, normalize, upserts
from marquee.operators.ranking import ranked
from marquee.operators.resolve import resolve_batch
from marquee.plans import scrape
from marquee.plans.ingest import ingest, ingest_stats
from marquee.session import checkpoint_dir, cut
from marquee.sources import sample
from marquee.sources.store import commit
from marquee.sources.tables import Tables, empty_tables, read_events, read_snapshot, stream_listings, write_snapshot
from marquee.streaming.ingest import first_deliveries, stream_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
FILTERS = feed.Filters(cities=("Praha", "Bratislava", "Poprad"), genres=("concert", "theatre", "other"), when="week", max_price=60.0)
SELLER = "src3"


def plain(df: DataFrame) -> DataFrame:
    """Results in types every SQL engine reports alike."""

    def cast(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.TimestampType):
            return F.col(field.name).cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(field.name, ",").alias(field.name)
        return F.col(field.name)

    return df.select(*[cast(f) for f in df.schema.fields])


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: plain(build(spark, sf_dir))
    return build


# --- shared inputs -------------------------------------------------------------
def checked(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.check_listings(sample.raw_listings(spark, sf), sample.sources(spark, sf))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalized(checked(spark, sf))


# Queries about matching, merging and the feed read stored tables, as they would
# after an ingest run. The tables are written on first use and kept for the session.
def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    session = (spark.sparkContext.applicationId, sf)
    if (session, name) not in _STORED:
        _STORED[session, name] = cut(build())
    return _STORED[session, name]


_STORED: dict[tuple, DataFrame] = {}


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "listings", lambda: listings(spark, sf))


def first_listings(spark: SparkSession, sf: str) -> DataFrame:
    return merge.first_of_url(valid(spark, sf))[0]


def repeats(spark: SparkSession, sf: str) -> DataFrame:
    return merge.first_of_url(valid(spark, sf))[1]


def listed_at() -> Column:
    """Listings went on sale five days before their start."""
    return F.col("starts_at") - F.expr("INTERVAL '120' HOUR")


def exact_targets(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_batch(first_listings(spark, sf), empty_tables(spark).events, fuzzy=False)


def catalogue(spark: SparkSession, sf: str) -> Tables:
    """Events and listings after ingesting each URL once, matched by fingerprint."""
    empty = empty_tables(spark)

    def built() -> tuple[DataFrame, DataFrame]:
        # Resolved once, for the events and for the listings.
        targets = stored(spark, sf, "targets", lambda: exact_targets(spark, sf))
        return merge.attach_new(empty.events, empty.event_sources, first_listings(spark, sf), targets, listed_at())

    events = stored(spark, sf, "events", lambda: built()[0])
    rows = stored(spark, sf, "event_sources", lambda: built()[1])
    return Tables(events, rows, sample.sources(spark, sf))


def favorites(spark: SparkSession, sf: str) -> DataFrame:
    return sample.favorites_from_orders(sample.table(spark, sf, "orders"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return sample.users_from_customer(sample.table(spark, sf, "customer"))


def page_cards(spark: SparkSession, sf: str) -> DataFrame:
    return sample.cards_from_pages(sample.table(spark, sf, "pages"))


def scraped(spark: SparkSession, sf: str) -> DataFrame:
    return sample.scraped_from_pages(sample.table(spark, sf, "pages"), urls.canonical_url(F.col("url")))


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.refetch_plan(page_cards(spark, sf), scraped(spark, sf), sample.now())


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    return sample.detail_pages_from_events(sample.table(spark, sf, "events"))


# --- sources and sinks ---------------------------------------------------------
@query
def raw_listings(spark, sf):
    return sample.raw_listings(spark, sf)


@query
def page_scan(spark, sf):
    return sample.table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("chars"))


@query
def scan_project(spark, sf):
    return sample.table(spark, sf, "events").select("user_id", "value")


@query
def source_upsert(spark, sf):
    new = sample.sellers_from_supplier(sample.table(spark, sf, "supplier"))
    return upserts.source_upsert(sample.sources(spark, sf), new).drop("last_scraped_at")


@query
def source_upsert_overwrite(spark, sf):
    new = sample.sellers_from_supplier(sample.table(spark, sf, "supplier"))
    return upserts.source_upsert_overwrite(sample.sources(spark, sf), new).drop("last_scraped_at")


@query
def scraped_pages_upsert(spark, sf):
    fetched = plan(spark, sf).filter("decision <> 'fresh'")
    return upserts.scraped_pages_upsert(scraped(spark, sf), fetched, sample.now())


@query
def mock_listings(spark, sf):
    return sample.vendor_listings(sample.raw_listings(spark, sf), ["alpha", "beta", "gamma"]).select(
        "seq", "source_url", "title", "price_from"
    )


# --- page extraction -----------------------------------------------------------
@query
def page_links(spark, sf):
    return extract.page_links(sample.table(spark, sf, "pages"))


@query
def page_links_filtered(spark, sf):
    links = extract.with_path_prefix(extract.page_links(sample.table(spark, sf, "pages")), "/t")
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query
def listing_cards(spark, sf):
    return extract.listing_cards(sample.category_pages_from_events(sample.table(spark, sf, "events"))).drop("position")


@query
def disallow_anti_join(spark, sf):
    # Written first, as the cards are read for their hosts and again for their paths.
    found = cut(extract.listing_cards(sample.category_pages_from_events(sample.table(spark, sf, "events"))))
    rules = "User-agent: *\nDisallow: /*7/\nDisallow: /sk/listky/1\nDisallow:\nAllow: /sk"
    robots = found.select(F.lower(F.regexp_extract("href", "//([^/]+)", 1)).alias("host")).distinct().withColumn("body", F.lit(rules))
    return frontier.disallow_anti_join(found, frontier.robots_patterns(robots), "href").select("page_id", "href")


def _embedded(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", F.col("embedded.name").alias("name"), F.col("embedded.startDate").alias("start_date"))


@query
def jsonld_extract(spark, sf):
    return _embedded(extract.jsonld_extract(detail_pages(spark, sf)))


@query
def jsonld_repair(spark, sf):
    return _embedded(extract.jsonld_repair(extract.jsonld_extract(detail_pages(spark, sf)).drop("html")))


@query
def page_shape(spark, sf):
    """Rendered event pages, and the given pages, which are of no known shape."""
    given = sample.table(spark, sf, "pages").select("page_id", "url", F.lit("koncert").alias("category"), "html")
    return extract.page_details(detail_pages(spark, sf).unionByName(given)).select("page_id", "kind", "reason")


@query
def tour_explode(spark, sf):
    stops = extract.tour_explode(extract.page_details(detail_pages(spark, sf)))
    return stops.select("page_id", "stop", "title", "starts_at", F.col("place.venue").alias("venue"), F.col("place.city").alias("city"), "href")


@query
def min_price_tiers(spark, sf):
    return detail_pages(spark, sf).select("page_id", extract.min_price_tiers(F.col("html")).alias("price"))


@query
def entity_decode(spark, sf):
    return sample.table(spark, sf, "pages").select("page_id", markup.entity_decode(F.col("html")).alias("decoded"))


@query
def split_address(spark, sf):
    address = F.concat(
        F.lit(" Hall "), F.col("c_nationkey").cast("string"), F.lit(" ,, "), F.col("c_name"), F.lit(", 080 01  "), F.col("c_mktsegment")
    )
    parts = markup.split_address(address)
    return sample.table(spark, sf, "customer").select("c_custkey", parts["venue"].alias("venue"), parts["city"].alias("city"))


@query
def parse_local_datetime(spark, sf):
    local = dates.prague_local(F.col("ts").cast("timestamp"))
    return sample.table(spark, sf, "events").select(
        "event_id",
        dates.local_datetime(F.date_format(local, "dd.MM.yyyy HH:mm")).alias("day_first"),
        dates.local_datetime(F.date_format(local, "yyyy-MM-dd HH:mm")).alias("year_first"),
    )


@query
def pages_to_listings(spark, sf):
    found = extract.pages_to_listings(detail_pages(spark, sf), "tickets", "SK", "EUR")
    return found.select("seq", "source_url", "title", "venue", "city", "starts_at", "price_from", "raw_genre", "image_url")


@query
def rejects(spark, sf):
    return normalize.rejects(checked(spark, sf))


# --- crawl planning --------------------------------------------------------------
@query
def refetch_jitter(spark, sf):
    canonical = sample.table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))
    return canonical.select("page_id", frontier.refetch_jitter(F.col("url")).alias("jitter_ms"))


@query
def refetch_plan(spark, sf):
    return plan(spark, sf).select("category", "position", "url", "decision")


@query
def refetch_cap(spark, sf):
    return frontier.refetch_cap(plan(spark, sf), 5).select("category", "position", "url", "decision")


@query
def touch_last_seen(spark, sf):
    rows = catalogue(spark, sf).event_sources
    return upserts.touch_last_seen(rows, rows.filter("price_from IS NULL").select("url"), sample.now()).select("url", "last_seen_at")


def site_run(spark: SparkSession, sf: str, limit: int | None, fuzzy: bool) -> scrape.ScrapeResult:
    """A scheduled run over a site with a page per event row."""
    pages = detail_pages(spark, sf)
    linked = pages.select("category", F.col("page_id").alias("position"), F.col("url").alias("href"))
    known = sample.scraped_from_pages(pages, urls.canonical_url(F.col("url")))
    return scrape.scheduled_run(empty_tables(spark, sample.sources(spark, sf)), known, linked, pages, SELLER, "SK", "EUR", sample.now(), limit=limit, fuzzy=fuzzy)


@query
def scheduled_run(spark, sf):
    """Counters of a run over all pages that are new or due, matched by URL and fingerprint."""
    return site_run(spark, sf, limit=None, fuzzy=False).counts


@query
def scheduled_run_all(spark, sf):
    """Counters of a run over all pages that are new or due, with fuzzy matching, and its listings per outcome."""
    run = site_run(spark, sf, limit=None, fuzzy=True)
    counters = run.counts.unpivot([], run.counts.columns, "counter", "n")
    return counters.unionByName(run.ingested.stats().select(F.col("outcome").alias("counter"), F.col("listings").alias("n")))


@query
def stamp_source(spark, sf):
    return upserts.stamp_source(sample.sources(spark, sf), SELLER, sample.now()).select("slug", "last_scraped_at")


@query
def refetch_counts(spark, sf):
    decided = plan(spark, sf)
    return frontier.refetch_counts(decided, frontier.refetch_cap(decided, None))


# --- normalisation -----------------------------------------------------------------
@query
def normalize_text(spark, sf):
    return sample.table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query
def canonical_url(spark, sf):
    return sample.table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query
def normalize_city(spark, sf):
    return sample.raw_listings(spark, sf).select("seq", places.normalize_city(F.col("city")).alias("city"))


@query
def city_country(spark, sf):
    return checked(spark, sf).select("seq", "city", "country", "currency")


@query
def normalize_genre(spark, sf):
    return checked(spark, sf).select("seq", "genre")


@query
def fingerprint(spark, sf):
    return checked(spark, sf).filter("starts_at IS NOT NULL").select("seq", "fingerprint")


@query
def price_sanitize(spark, sf):
    return sample.raw_listings(spark, sf).select("seq", prices.price_sanitize(F.col("price_from")).alias("price"))


@query
def normalize_listings(spark, sf):
    return listings(spark, sf)


@query
def prague_day(spark, sf):
    return sample.table(spark, sf, "events").select("event_id", dates.prague_day(F.col("ts").cast("timestamp")).alias("day"))


@query
def is_multi_day(spark, sf):
    starts, ends = F.col("starts_at"), F.col("ends_at")
    return valid(spark, sf).select(
        "seq", dates.is_multi_day(starts, ends).alias("multi_day"), dates.date_label_kind(starts, ends).alias("label")
    )


@query
def derive_sort_fields(spark, sf):
    return normalize.derive_sort_fields(catalogue(spark, sf).events).select("id", "start_day", "price_known")


# --- matching and merge --------------------------------------------------------------
@query
def url_match(spark, sf):
    return linkage.url_match(valid(spark, sf), catalogue(spark, sf).event_sources).select("seq", "known_event_id")


@query
def fingerprint_match(spark, sf):
    return linkage.fingerprint_match(valid(spark, sf), catalogue(spark, sf).events).select("seq", "matched_event_id")


@query
def title_distance(spark, sf):
    """Each title of a city with the next one in the alphabet: near variants, and different titles."""
    titles = ranked(valid(spark, sf).select("city", F.col("title_key").alias("a")).distinct(), ["city"], ["a"])
    following = titles.select("city", F.col("a").alias("b"), (F.col("position") - 1).alias("position"))
    pairs = titles.join(following, ["city", "position"])
    return pairs.select("city", "a", "b", text.title_distance(F.col("a"), F.col("b")).alias("distance"))


@query
def numbers_conflict(spark, sf):
    title = F.col("title_key")
    return valid(spark, sf).select(
        "seq",
        text.numbers_in(title).alias("numbers"),
        text.numbers_conflict(title, text.normalize_text(F.col("venue"))).alias("conflict"),
    )


@query
def fuzzy_candidates(spark, sf):
    return linkage.fuzzy_candidates(valid(spark, sf), catalogue(spark, sf).events).drop("created_at")


@query
def fuzzy_match(spark, sf):
    return linkage.fuzzy_match(valid(spark, sf), catalogue(spark, sf).events)


@query
def resolve_batch_exact(spark, sf):
    return exact_targets(spark, sf).drop("distance")


QUERIES["resolve_batch"] = QUERIES.pop("resolve_batch_exact")


@query
def resolve_batch_fuzzy(spark, sf):
    return resolve_batch(first_listings(spark, sf), empty_tables(spark).events)


@query
def new_events(spark, sf):
    founded = merge.new_events(first_listings(spark, sf), exact_targets(spark, sf), listed_at())
    return founded.select("id", "title", "city", "currency", "price_from", "genre", "starts_at")


@query
def rescrape_update(spark, sf):
    rows = merge.rescrape_update(catalogue(spark, sf).event_sources, repeats(spark, sf), sample.now())
    return rows.select("url", "price_from", "currency", "last_seen_at")


def _after_rescrape(spark, sf) -> tuple[DataFrame, DataFrame]:
    tables = catalogue(spark, sf)
    after, _ = merge.rescrape_reconcile(tables.events, merge.of_events(repeats(spark, sf), tables.event_sources))
    return tables.events, after


@query
def rescrape_reconcile(spark, sf):
    return _after_rescrape(spark, sf)[1].select("id", "starts_at", "title", "venue", "ends_at", "fingerprint")


@query
def rescrape_collision(spark, sf):
    return merge.rescrape_collision(*_after_rescrape(spark, sf))


@query
def blank_fill(spark, sf):
    first, targets = first_listings(spark, sf), exact_targets(spark, sf)
    events = merge.new_events(first, targets, listed_at())
    attached = first.select("seq", "image_url", "ends_at").join(targets.filter("matched_by <> 'new'"), "seq")
    in_effect = events.select(F.col("id").alias("event_id"), F.col("starts_at").alias("starts_in_effect"))
    return merge.blank_fill(events, attached.join(in_effect, "event_id"))


@query
def event_price(spark, sf):
    tables = catalogue(spark, sf)
    return merge.event_price(tables.events, tables.event_sources)


@query
def refresh_events(spark, sf):
    first, targets, empty = first_listings(spark, sf), exact_targets(spark, sf), empty_tables(spark)
    events, _ = merge.attach_new(empty.events, empty.event_sources, first, targets, listed_at())
    return events.select("id", "ends_at", "image_url", "price_from", "start_day", "price_known")


@query
def ingest_stats_query(spark, sf):
    result = ingest(empty_tables(spark, sample.sources(spark, sf)), sample.raw_listings(spark, sf), sample.now(), fuzzy=False)
    return ingest_stats(result.outcomes, result.rejects)


QUERIES["ingest_stats"] = QUERIES.pop("ingest_stats_query")


@query
def ingest_run(spark, sf):
    """The whole job with fuzzy matching: the catalogue it leaves."""
    raw, sellers = sample.raw_listings(spark, sf), sample.sources(spark, sf)
    return ingest(empty_tables(spark, sellers), raw, sample.now()).tables.events


@query
def integrity_checks(spark, sf):
    tables = catalogue(spark, sf)
    return merge.integrity_checks(tables.events, tables.event_sources, tables.sources, favorites(spark, sf))


@query
def snapshot_reload(spark, sf):
    """Events after a wipe and a reload over a store that held others."""
    tables, root = catalogue(spark, sf), own_folder(spark, "store")
    write_snapshot(tables.with_(events=tables.events.filter("price_from IS NULL").withColumn("title", F.lit("old"))), root, 0)
    write_snapshot(tables, root, 1)
    return read_snapshot(spark, root).events.select("id", "title", "starts_at", "price_from")


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query
def snapshot_increment(spark, sf):
    """Seller listings of a store that took the last hundredth of the listings as a second version."""
    raw, root = sample.raw_listings(spark, sf), own_folder(spark, "store")
    last = (raw.agg(F.max("seq")).first()[0] or 0) * 99 // 100
    first = ingest(empty_tables(spark, sample.sources(spark, sf)), raw.filter(F.col("seq") <= last), sample.now(), fuzzy=False)
    write_snapshot(first.tables, root, 0)
    second = ingest(read_snapshot(spark, root), raw.filter(F.col("seq") > last), sample.now(), fuzzy=False)
    commit(spark, root, 1, second.changes, second.tables.events, base=0)
    return read_snapshot(spark, root).event_sources.select("url", "price_from", "currency")


@query
def cascade_commit(spark, sf):
    """Favourites after re-scrapes that merge events: those of a vanished event go in the same version."""
    root = own_folder(spark, "store")
    write_snapshot(catalogue(spark, sf).with_(favorites=favorites(spark, sf)), root, 0)
    again = sample.raw_listings(spark, sf).join(repeats(spark, sf).select("seq"), "seq", "left_semi")
    result = ingest(read_snapshot(spark, root), again, sample.now(), fuzzy=False)
    commit(spark, root, 1, result.changes, result.tables.events, base=0)
    return read_snapshot(spark, root).favorites.select("user_id", "event_id")


# --- feed ----------------------------------------------------------------------------
@query
def resolve_range(spark, sf):
    now = F.col("ts").cast("timestamp")
    chosen = sample.table(spark, sf, "events").select(
        "event_id", now.alias("ts"), F.explode(F.array(*map(F.lit, [*WHEN_VALUES, "none"]))).alias("when")
    )
    span = dates.resolve_range(F.col("when"), F.col("ts"))
    return chosen.select("event_id", "when", span["start"].alias("range_start"), span["end"].alias("range_end"))


@query
def parse_filters(spark, sf):
    return feed.parse_filter_rows(sample.requests_from_customer(sample.table(spark, sf, "customer"))).drop("query")


@query
def feed_grid(spark, sf):
    return feed.feed_grid(catalogue(spark, sf).events, FILTERS, NOW).select("id", "title", "city", "starts_at", "price_from")


@query
def feed_grid_stored(spark, sf):
    """The grid over a written snapshot, of which it opens only the months in range."""
    root = own_folder(spark, "snapshot")
    write_snapshot(catalogue(spark, sf), root, 0)
    return feed.feed_grid(read_events(spark, root), FILTERS, NOW).select("id", "title", "city", "starts_at", "price_from")


@query
def max_price(spark, sf):
    affordable = prices.within_max_price(F.col("price_from"), F.col("currency"), F.lit(30))
    return catalogue(spark, sf).events.select("id", affordable.alias("affordable"))


@query
def feed_page(spark, sf):
    page = feed.feed_page(catalogue(spark, sf).events, feed.Filters(page=2), NOW)
    return page.select("id", "start_day", "price_known", "starts_at", "title")


@query
def feed_has_more(spark, sf):
    return feed.feed_has_more(catalogue(spark, sf).events, feed.Filters(page=2), NOW)


@query
def effective_end(spark, sf):
    return catalogue(spark, sf).events.select("id", dates.effective_end(F.col("starts_at"), F.col("ends_at")).alias("effective_end"))


@query
def happening_now(spark, sf):
    return feed.happening_now(catalogue(spark, sf).events, feed.Filters(), NOW).select("id", "title", "effective_end")


@query
def happening_union(spark, sf):
    on = catalogue(spark, sf).events.filter(feed.ongoing(NOW))
    merged = feed.happening_union(on.filter("ends_at IS NOT NULL"), on.filter("ends_at IS NULL"))
    return merged.select("id", "title", "effective_end")


@query
def visible_events(spark, sf):
    return feed.visible_events(catalogue(spark, sf).events, NOW).select("id", "city")


@query
def city_options(spark, sf):
    return feed.city_options(catalogue(spark, sf).events, NOW)


@query
def city_options_union(spark, sf):
    return feed.city_options(catalogue(spark, sf).events, NOW, ["Žilina", "Praha"])


@query
def home_feed(spark, sf):
    return feed.home_feed(catalogue(spark, sf).events, feed.Filters(), NOW)


@query
def event_cards(spark, sf):
    tables = catalogue(spark, sf)
    rows = cards.event_cards(tables.events, tables.event_sources, tables.sources)
    return rows.select(
        "event_id", "title", "price_from", "currency", "url", "source_name", "listing_price", "listing_currency", "position"
    )


@query
def price_label_kind(spark, sf):
    return catalogue(spark, sf).events.select("id", prices.price_label_kind(F.col("price_from")).alias("label"))


@query
def saved_search_match(spark, sf):
    searches = feed.parse_filter_rows(sample.requests_from_customer(sample.table(spark, sf, "customer")))
    return feed.saved_search_counts(catalogue(spark, sf).events, searches, sample.now())


@query
def saved_search_events(spark, sf):
    """Every event that a search finds, once for all equal searches."""
    searches = feed.parse_filter_rows(sample.requests_from_customer(sample.table(spark, sf, "customer")))
    return feed.saved_search_match(catalogue(spark, sf).events, feed.same_searches(searches)[1], sample.now()).select("search_id", "id")


# --- maintenance -----------------------------------------------------------------------
@query
def drop_source(spark, sf):
    tables = catalogue(spark, sf)
    return maintenance.drop_source(tables.event_sources, tables.sources, SELLER).select("url", "event_id")


@query
def orphan_events(spark, sf):
    tables = catalogue(spark, sf)
    left = maintenance.drop_source(tables.event_sources, tables.sources, SELLER)
    return maintenance.orphan_events(tables.events, left).select("id", "title")


@query
def source_report(spark, sf):
    tables = catalogue(spark, sf)
    report = maintenance.source_report(tables.events, tables.event_sources, tables.sources, SELLER)
    return report.select("id", "title", "city", "created_at", "listings", "sellers")


@query
def multi_source_events(spark, sf):
    return maintenance.multi_source_events(catalogue(spark, sf).event_sources)


@query
def title_contains(spark, sf):
    tables = catalogue(spark, sf)
    return maintenance.title_contains(tables.events, tables.event_sources, "click")


@query
def stale_listings(spark, sf):
    rows = catalogue(spark, sf).event_sources
    runs = rows.select("source_id", F.date_trunc("day", "last_seen_at").alias("run_at")).distinct()
    return maintenance.stale_listings(rows, runs).select("url")


# --- digest --------------------------------------------------------------------------
def _digest(part, spark, sf) -> DataFrame:
    return part(favorites(spark, sf), users(spark, sf), catalogue(spark, sf).events, sample.now())


@query
def digest_favorites(spark, sf):
    return _digest(digest.digest_favorites, spark, sf)


@query
def digest_suggestions(spark, sf):
    return _digest(digest.digest_suggestions, spark, sf)


@query
def digest_groups(spark, sf):
    """New events by taste group, one row each however many users share the group."""
    return digest.suggestion_groups(catalogue(spark, sf).events, sample.now())


@query
def digest_group_members(spark, sf):
    return digest.suggestion_members(favorites(spark, sf), users(spark, sf), catalogue(spark, sf).events)


@query
def digest_merge(spark, sf):
    return _digest(digest.digest, spark, sf)


QUERIES["digest"] = QUERIES.pop("digest_merge")


# --- streaming -------------------------------------------------------------------------
@query
def stream_ingest_run(spark, sf):
    """Listings that landed as files, taken in by one triggered run; the seller listings it leaves."""
    base = own_folder(spark, "stream")
    sample.raw_listings(spark, sf).write.parquet(f"{base}/landing")
    run = stream_ingest(spark, f"{base}/landing", f"{base}/tables", f"{base}/progress", sample.sources(spark, sf), fuzzy=False)
    run.awaitTermination()
    return read_snapshot(spark, f"{base}/tables").event_sources.select("url", "price_from", "currency")


QUERIES["stream_ingest"] = QUERIES.pop("stream_ingest_run")


@query
def stream_redeliveries(spark, sf):
    """What passes of three deliveries: all listings, then with a tenth of the prices changed, then as at first."""
    base, raw = own_folder(spark, "stream"), sample.raw_listings(spark, sf)
    changed = raw.withColumn("price_from", F.when(F.col("seq") % 10 == 0, 1.25).otherwise(F.col("price_from")))
    for batch in (raw, changed, raw):
        batch.write.mode("append").parquet(f"{base}/landing")
        passed = first_deliveries(stream_listings(spark, f"{base}/landing"))
        passed.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start(f"{base}/passed").awaitTermination()
    return spark.read.schema(raw.schema).parquet(f"{base}/passed").select("seq", "source_url", "price_from")
