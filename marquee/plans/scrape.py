"""One scheduled run over a seller's site: plan, fetch, ingest, touch, write back, stamp, count."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.urls import canonical_url
from marquee.operators import frontier, upserts
from marquee.operators.extract import details_to_listings, page_details, page_rejects
from marquee.plans.ingest import IngestResult, ingest
from marquee.session import cut
from marquee.sources.store import Changes, difference
from marquee.sources.tables import Tables


@dataclass(frozen=True)
class ScrapeResult:
    """Everything a run changes, and what it reports."""

    tables: Tables
    scraped_pages: DataFrame
    counts: DataFrame
    unreadable: DataFrame
    ingested: IngestResult

    def changes(self, before: Tables) -> dict[str, Changes]:
        """What the run changed in the tables ``before`` it, for a commit."""
        known = {name: rows for name, rows in before.held().items() if name not in self.ingested.changes or name == "event_sources"}
        after = self.tables.held()
        return self.ingested.changes | {name: difference(name, rows, after[name]) for name, rows in known.items()}


def scheduled_run(
    tables: Tables, scraped_pages: DataFrame, cards: DataFrame, pages: DataFrame, slug: str, country: str, currency: str, now: Column,
    limit: int | None = None, fuzzy: bool = True,
) -> ScrapeResult:
    """Absorb the pages that are new or due among the listed ``cards``.

    ``pages`` stands for what fetching returns: ``page_id, url, category, html``. A
    wanted page that is not among them is not recorded as fetched, so the next run
    asks for it again.
    """
    plan = cut(frontier.refetch_plan(cards, scraped_pages, now))
    wanted = cut(frontier.refetch_cap(plan, limit))
    got = cut(
        pages.withColumn("canonical", canonical_url(F.col("url"))).join(wanted.select(F.col("url").alias("canonical")).distinct(), "canonical", "left_semi")
    )
    # Read once, for the listings and for the pages that yield none.
    details = cut(page_details(got.drop("canonical")))
    listings = details_to_listings(details, slug, country, currency)
    ingested = ingest(tables, listings, now, fuzzy)
    after = ingested.tables
    # A listing that is listed but not due only shows that it is still there.
    rows = upserts.touch_last_seen(after.event_sources, frontier.touched(plan), now)
    fetched = got.select(F.col("canonical").alias("url")).distinct()
    seen = upserts.scraped_pages_upsert(scraped_pages, fetched, now)
    return ScrapeResult(
        after.with_(event_sources=rows, sources=upserts.stamp_source(after.sources, slug, now), scraped_pages=seen),
        seen,
        frontier.refetch_counts(plan, wanted.join(fetched, "url", "left_semi").select(wanted.columns)),
        page_rejects(details),
        ingested,
    )
