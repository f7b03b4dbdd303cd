"""One ingest run: validate, re-scrape known URLs, resolve new ones, merge."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators import merge
from marquee.operators.linkage import keyed_events, with_block
from marquee.operators.maintenance import cascade
from marquee.operators.normalize import check_listings, normalized, rejects
from marquee.operators.resolve import resolve_batch
from marquee.session import cut
from marquee.sources.store import KEYS, Changes, difference
from marquee.sources.tables import Tables


@dataclass(frozen=True)
class IngestResult:
    tables: Tables
    outcomes: DataFrame
    rejects: DataFrame
    #: By table, what the batch changed; a commit copies only the files that hold it.
    changes: dict[str, Changes]

    def surviving(self, children: DataFrame) -> DataFrame:
        """Favourites and other rows with an ``event_id``, without those whose event was merged away."""
        return cascade(children, self.tables.events)

    def stats(self) -> DataFrame:
        """Listings per outcome, rejected ones as ``skipped``."""
        return ingest_stats(self.outcomes, self.rejects)


def ingest_stats(outcomes: DataFrame, rejected: DataFrame) -> DataFrame:
    return (
        outcomes.select("outcome")
        .unionByName(rejected.select(F.lit("skipped").alias("outcome")))
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("listings"))
    )


def in_scope(tables: Tables, listings: DataFrame) -> DataFrame:
    """Ids of the stored events a batch can touch: by URL, fingerprint, or city and time."""
    blocks = (
        with_block(listings.select("city", "starts_at"))
        .select("city", F.explode(F.array(*[F.col("block") + step for step in (-1, 0, 1)])).alias("block"))
        .distinct()
    )
    by_url = tables.event_sources.join(listings.select("url").distinct(), "url", "left_semi").select(F.col("event_id").alias("id"))
    by_fingerprint = tables.events.join(listings.select("fingerprint").distinct(), "fingerprint", "left_semi").select("id")
    by_time = keyed_events(tables.events).join(blocks, ["city", "block"], "left_semi").select("id")
    return by_url.unionByName(by_fingerprint).unionByName(by_time).distinct()


def ingest(tables: Tables, raw: DataFrame, now: Column, fuzzy: bool = True) -> IngestResult:
    """Tables after a batch.

    Order inside a batch: re-scrapes of URLs known before it, then new URLs in
    arrival order, then repeats of those new URLs. Only events the batch can touch
    are worked on; the rest is passed through.
    """
    checked = cut(check_listings(raw, tables.sources))
    listings = normalized(checked)
    scope = cut(in_scope(tables, listings))
    events = cut(tables.events.join(scope, "id", "left_semi"))
    in_events = scope.withColumnRenamed("id", "event_id")
    rows = cut(tables.event_sources.join(in_events, "event_id", "left_semi").select(tables.event_sources.columns))

    before = events.select(tables.events.columns), rows
    known_urls = rows.select("url")
    known = listings.join(known_urls, "url", "left_semi")
    fresh, repeats = merge.split_by_url(listings.join(known_urls, "url", "left_anti"))

    # Listing rows come back written.
    events, rows, updated = merge.apply_rescrapes(events, rows, known, now)
    events = cut(events)
    assignments = cut(resolve_batch(fresh, events, fuzzy))
    events, rows = merge.attach_new(events, rows, fresh, assignments, now)
    events, rows = cut(events), cut(rows)
    events, rows, repeated = merge.apply_rescrapes(events, rows, repeats, now)

    resolved = assignments.select(
        "seq", F.when(F.col("matched_by") == "new", "created").otherwise("merged").alias("outcome"), "event_id"
    )
    outcomes = updated.unionByName(resolved).unionByName(repeated)
    untouched = tables.events.join(scope, "id", "left_anti").select(tables.events.columns)
    kept_rows = tables.event_sources.join(in_events, "event_id", "left_anti").select(tables.event_sources.columns)
    events, rows = cut(events.select(tables.events.columns)), rows.select(tables.event_sources.columns)
    merged = tables.with_(events=untouched.unionByName(events), event_sources=kept_rows.unionByName(rows))
    changes = {"events": difference("events", before[0], events), "event_sources": difference("event_sources", before[1], rows)}
    if tables.favorites is not None:
        # Favourites of an event that a collision removed go with it, in the same version.
        lost = before[0].select("id").join(events, "id", "left_anti").withColumnRenamed("id", "event_id")
        merged = merged.with_(favorites=tables.favorites.join(lost, "event_id", "left_anti").select(tables.favorites.columns))
        gone = cut(tables.favorites.join(lost, "event_id", "left_semi").select(*KEYS["favorites"]))
        changes["favorites"] = Changes(tables.favorites.limit(0), gone)
    return IngestResult(merged, outcomes.join(listings.select("seq", "url"), "seq"), rejects(checked), changes)
