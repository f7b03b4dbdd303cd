"""Set-based resolution equals the one-at-a-time fold on many random batches at once."""

import collections
import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions.urls import canonical_url
from marquee.operators import frontier, merge, resolve
from marquee.operators.extract import pages_to_listings
from marquee.operators.normalize import check_listings, normalized
from marquee.operators.components import components
from marquee.operators.linkage import similar_titles, with_block
from marquee.operators.resolve import SEGMENT, resolve_batch, segments
from marquee.plans.ingest import ingest
from marquee.plans.queries import QUERIES, SELLER, detail_pages
from marquee.sources import sample
from marquee.sources.tables import empty_tables
from tests.sequential import Catalogue

T0 = datetime(2026, 9, 30, 18)
WORDS = ["jazz night", "jazz nights", "jazz nite", "rock opera gala", "rock opera galas", "rok opera galas", "jazz night 1", "jazz night 2"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def listings(rng, group, count, first_seq):
    """A small town of similar titles and close times, with fingerprint clashes."""
    for i in range(count):
        start = T0 + timedelta(minutes=30 * rng.randrange(40))
        title, venue = rng.choice(WORDS), f"hall {group} {rng.randrange(3)}"
        yield {
            "seq": first_seq + i,
            "url": f"https://x.example.com/{group}/{i}",
            "title": title,
            "title_key": title,
            "venue": venue,
            "city": f"Town{group}",
            "starts_at": start,
            "fingerprint": f"{title}|{venue}|{(start + timedelta(hours=2)).date()}",
        }


@pytest.mark.parametrize("most", [SEGMENT, 6])
def test_founders_and_targets_match_the_fold(spark, most):
    """All segments folded in tasks, and the larger ones by rounds."""
    rng, rows, expected, stored = random.Random(7), [], {}, []
    for group in range(120):
        batch = list(listings(rng, group, rng.randrange(2, 26), group * 1000))
        kept, cat = rng.randrange(0, 4), Catalogue()
        blank = {"price": None, "price_currency": "EUR", "currency": "EUR", "image_url": None, "ends_at": None}
        # The first rows are stored events; they need not be consistent with each other.
        for row in batch[:kept]:
            if cat.owner(row["fingerprint"]) is None:
                cat.events[row["url"]] = {**row, **blank}
                stored.append((digest(row["url"]), row["title"], row["city"], row["starts_at"], row["fingerprint"], T0 + timedelta(seconds=row["seq"])))
        for row in batch[kept:]:
            outcome = cat.add({**row, **blank})
            expected[row["seq"]] = (digest(cat.listings[row["url"]]["event"]), outcome)
            rows.append(row)
    fields = "seq long, url string, title string, title_key string, venue string, city string, starts_at timestamp, fingerprint string"
    new = spark.createDataFrame([tuple(r[f.split()[0]] for f in fields.split(", ")) for r in rows], fields)
    events = spark.createDataFrame(stored, "id string, title string, city string, starts_at timestamp, fingerprint string, created_at timestamp")
    got = {
        r.seq: (r.event_id, "created" if r.matched_by == "new" else "merged") for r in resolve_batch(new, events, most=most).collect()
    }
    assert got == expected
    assert {o for _, o in expected.values()} == {"created", "merged"}


def test_segments_are_cut_at_gaps_and_joined_by_fingerprints(spark):
    rows = [
        (0, "jazz night", "T", T0, "a"), (1, "jazz nights", "T", T0 + timedelta(hours=4), "b"), (2, "jazz night", "T", T0 + timedelta(hours=20), "c"),
        (3, "rock", "T", T0, "d"), (4, "opera", "U", T0 + timedelta(hours=20), "d"), (5, "jazz night", "U", T0, "e"), (6, "opera", "U", T0 + timedelta(hours=60), "f"),
    ]
    frame = with_block(spark.createDataFrame(rows, "seq long, title_key string, city string, starts_at timestamp, fingerprint string"))
    got = {r["seq"]: r["segment"] for r in segments(frame, similar_titles(frame)).collect()}
    assert got[0] == got[1] and got[3] == got[4] and len(set(got.values())) == 5


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(200)] + [(500, 600), (600, 700), (900, 900)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(25)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: k for e in edges for k in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {k: c for k, c in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_is_not_a_component(spark):
    rows = [(i, f"https://x.example.com/{i}", "jazz night", "T", T0 + timedelta(hours=2 * i), f"f{i}") for i in range(3)]
    new = spark.createDataFrame(rows, "seq long, url string, title_key string, city string, starts_at timestamp, fingerprint string")
    got = {r.seq: r.matched_by for r in resolve_batch(new, empty_tables(spark).events).collect()}
    assert got == {0: "new", 1: "fuzzy", 2: "new"}


def test_a_long_chain_takes_no_step_per_founder(spark, monkeypatch):
    """Listings that arrive in order of their starts, each in reach of the one before it."""
    written, cut = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df: written.append(1) or cut(df))
    rows = [(i, f"https://x.example.com/{i}", "jazz night", "T", T0 + timedelta(hours=2 * i), f"f{i}") for i in range(90)]
    new = spark.createDataFrame(rows, "seq long, url string, title_key string, city string, starts_at timestamp, fingerprint string")
    got = {r.seq: r.matched_by for r in resolve_batch(new, empty_tables(spark).events, most=40).collect()}
    assert got == {i: "fuzzy" if i % 2 else "new" for i in range(90)}
    assert len(written) < 30


def test_listings_are_split_by_url_in_one_pass(spark, monkeypatch):
    """The same rows as by two joins, numbers that come twice or are missing included; read often, computed once."""
    rows = [(4, "a"), (2, "a"), (2, "b"), (2, "a"), (7, "c"), (None, "c"), (None, "d"), (3, None), (1, "b")]
    new = spark.createDataFrame(rows, "seq long, url string")
    written, cut = [], merge.cut
    monkeypatch.setattr(merge, "cut", lambda df: written.append(1) or cut(df))
    parts = merge.split_by_url(new)
    assert len(written) == 1 and all("Join" not in p._jdf.queryExecution().toString() for p in parts)
    for got, want in zip(parts, merge.first_of_url(new), strict=True):
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_a_merged_listing_does_not_lend_its_fingerprint(spark):
    rows = [
        (0, "https://x.example.com/0", "jazz night", "T", T0, "a"),
        (1, "https://x.example.com/1", "jazz nights", "T", T0, "b"),
        (2, "https://x.example.com/2", "jazz nights", "Elsewhere", T0, "b"),
    ]
    new = spark.createDataFrame(rows, "seq long, url string, title_key string, city string, starts_at timestamp, fingerprint string")
    got = {r.seq: r.matched_by for r in resolve_batch(new, empty_tables(spark).events).collect()}
    assert got == {0: "new", 1: "fuzzy", 2: "new"}


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("s1", "one", "One", "https://one.example.com", None)], schemas.SOURCES)


def raw_rows(batch, rng):
    for row in batch:
        price = rng.choice([None, 0.0, 10.0, 12.5])
        ends = rng.choice([None, row["starts_at"] + timedelta(hours=4)])
        image = rng.choice([None, f"https://img/{row['seq']}"])
        yield (
            row["seq"], "one", row["url"], row["title"], row["venue"], row["city"], "SK", row["starts_at"], ends, price,
            rng.choice([None, "CZK"]), None, image,
        )


def test_ingest_runs_match_the_fold(spark, registry):
    """Three runs: new listings, then re-scrapes with changed times, new ones and repeats."""
    rng = random.Random(11)
    tables, seq = empty_tables(spark, registry), 0
    cats = {g: Catalogue() for g in range(40)}
    for run in range(3):
        now = T0 + timedelta(days=run)
        raws, order = [], []
        for group, cat in cats.items():
            fresh = [dict(r, url=r["url"] + f"-{run}") for r in listings(rng, group, rng.randrange(2, 7), 0)]
            known = []
            for url in rng.sample(sorted(cat.listings), min(len(cat.listings), 3)):
                # A vendor moves its show by hours but keeps title and hall, so no fingerprint collides.
                event = cat.events[cat.listings[url]["event"]]
                moved = event["starts_at"] + timedelta(hours=rng.choice([0, 1, 4]))
                known.append({"url": url, "title": event["title"] + f" {group} {url[-3:]}", "venue": "moved " + url, "city": event["city"], "starts_at": moved})
            repeats = [dict(r) for r in rng.sample(fresh, 1)]
            order.append((group, known, fresh, repeats))
        for phase in (1, 2, 3):
            for entry in order:
                for row in entry[phase]:
                    row["seq"], seq = seq, seq + 1
                    raws.append((entry[0], row))
        rows = [(g, next(raw_rows([r], rng))) for g, r in raws]
        outcomes = {}
        for group, raw in rows:
            outcomes[raw[0]] = cats[group].add(
                {
                    "url": raw[2], "title": raw[3], "title_key": raw[3].replace("-", " "), "venue": raw[4], "city": raw[5],
                    "starts_at": raw[7], "ends_at": raw[8], "price": raw[9], "price_currency": raw[10] or "EUR",
                    "currency": "EUR", "image_url": raw[12],
                    "fingerprint": fingerprint(raw[3], raw[4], raw[7]),
                }
            )
        result = ingest(tables, spark.createDataFrame([r for _, r in rows], schemas.RAW_LISTINGS), F.lit(now))
        tables = result.tables
        assert {r.seq: r.outcome for r in result.outcomes.collect()} == outcomes
        assert result.rejects.count() == 0
    want = {
        (digest(k), e["title"], e["starts_at"], e["ends_at"], e["image_url"], e["fingerprint"], e["price_from"])
        for cat in cats.values()
        for k, e in cat.events.items()
    }
    got = {
        (r.id, r.title, r.starts_at, r.ends_at, r.image_url, r.fingerprint, None if r.price_from is None else float(r.price_from))
        for r in tables.events.collect()
    }
    assert got == want
    assert {(r.url, r.event_id) for r in tables.event_sources.collect()} == {
        (u, digest(s["event"])) for cat in cats.values() for u, s in cat.listings.items()
    }


def test_a_scheduled_run_over_all_pages_matches_the_fold(spark):
    """Every page that is new or due is fetched, and its listings are resolved with similar titles."""
    sf = "/root/testdata/sf0.001"
    got = {r.counter: r.n for r in QUERIES["scheduled_run_all"](spark, sf).collect()}
    pages = detail_pages(spark, sf)
    known = sample.scraped_from_pages(pages, canonical_url(F.col("url")))
    wanted = frontier.refetch_plan(pages.withColumn("href", F.col("url")), known, sample.now()).filter("decision <> 'fresh'")
    decided = collections.Counter(r.decision for r in wanted.select("decision").collect())
    assert (got["new_pages"], got["due_pages"]) == (decided["new"], decided["due"])
    assert max(r["count"] for r in wanted.groupBy("category").count().collect()) > 20
    fetched = pages.join(wanted.select("page_id"), "page_id", "left_semi")
    checked = check_listings(pages_to_listings(fetched, SELLER, "SK", "EUR"), sample.sources(spark, sf))
    rows = [r.asDict() for r in normalized(checked).orderBy("seq").collect()]
    first = {r["url"]: r["seq"] for r in reversed(rows)}
    cat, want = Catalogue(), collections.Counter({"skipped": checked.count() - len(rows)})
    for row in sorted(rows, key=lambda r: (first[r["url"]] != r["seq"], r["seq"])):
        want[cat.add(row)] += 1
    outcomes = {k: n for k, n in got.items() if k in ("created", "merged", "updated", "skipped")}
    assert outcomes == {k: n for k, n in want.items() if n} and want["merged"] > 0


def fingerprint(title, venue, start):
    def key(text):
        return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())

    return f"{key(title)}|{key(venue)}|{(start + timedelta(hours=2)).date()}"
