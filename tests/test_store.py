"""Versions that share files, cascading removals and re-deliveries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee import schemas
from marquee.plans.ingest import ingest
from marquee.session import utc
from marquee.sources import store
from marquee.sources import tables as tables_module
from marquee.sources.store import Changes, commit, committed_version, difference, manifest
from marquee.sources.tables import Tables, empty_tables, read_snapshot, stream_listings, write_snapshot
from marquee.streaming.ingest import STATE_BUCKETS, first_deliveries, stream_ingest

NOW = dt.datetime(2024, 1, 1)


def raw(spark, rows):
    values = [dict.fromkeys(schemas.RAW_LISTINGS.names) | {"source": "s1", "venue": "Hall", "city": "Praha", "country": "CZ", "title": "Show"} | r for r in rows]
    return spark.createDataFrame([tuple(v[n] for n in schemas.RAW_LISTINGS.names) for v in values], schemas.RAW_LISTINGS)


def listing(k, day=None, **more):
    start = dt.datetime(2024, 2, 1, 18) + dt.timedelta(days=k if day is None else day)
    return {"seq": k, "source_url": f"https://t.example.com/e/{k}", "title": f"Title number {k}", "starts_at": start, "price_from": 10.0} | more


@pytest.fixture(scope="module")
def sellers(spark):
    return spark.createDataFrame([("s1", "s1", "Seller", "https://t.example.com", None)], schemas.SOURCES)


def contents(rows):
    return sorted(map(str, rows.collect()))


def test_a_small_batch_copies_few_buckets(spark, sellers, tmp_path):
    root = f"{tmp_path}/t"
    first = ingest(empty_tables(spark, sellers), raw(spark, [listing(k, k % 100) for k in range(600)]), F.lit(NOW), fuzzy=False)
    write_snapshot(first.tables, root, 0)
    before, whole = contents(read_snapshot(spark, root, 0).events), manifest(spark, root, 0)
    # Six new listings on one day, and one known listing with a new price.
    batch = raw(spark, [listing(600 + k, 7) for k in range(6)] + [listing(7, 7, price_from=5.0)])
    second = ingest(read_snapshot(spark, root), batch, F.lit(NOW + dt.timedelta(days=1)), fuzzy=False)
    entries = commit(spark, root, 1, second.changes, second.tables.events, base=0)
    new = {(e["name"], e["month"], e["bucket"]) for e in entries if e["write"] not in {w["write"] for w in whole}}
    assert {n for n, *_ in new} == {"events", "event_sources"} and len(new) < 0.05 * len(entries)
    after = read_snapshot(spark, root)
    assert contents(after.events) == contents(second.tables.events) and contents(after.event_sources) == contents(second.tables.event_sources)
    assert after.events.count() == 606 and contents(after.sources) == contents(sellers)
    assert contents(read_snapshot(spark, root, 0).events) == before
    assert sum(e["rows"] for e in entries if e["name"] == "events") == 606


def test_a_commit_that_ends_early_changes_nothing(spark, sellers, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    first = ingest(empty_tables(spark, sellers), raw(spark, [listing(k) for k in range(5)]), F.lit(NOW), fuzzy=False)
    write_snapshot(first.tables, root, 0)
    second = ingest(read_snapshot(spark, root), raw(spark, [listing(9)]), F.lit(NOW), fuzzy=False)
    row, calls = store.Row, []

    def failing(**fields):
        calls.append(fields)
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(store, "Row", failing)  # after the files of the first table, before the manifest
    with pytest.raises(RuntimeError, match="lost"):
        commit(spark, root, 1, second.changes, second.tables.events, base=0)
    monkeypatch.setattr(store, "Row", row)
    assert calls and committed_version(spark, root) == 0 and read_snapshot(spark, root).events.count() == 5
    commit(spark, root, 1, second.changes, second.tables.events, base=0)
    assert committed_version(spark, root) == 1 and read_snapshot(spark, root).events.count() == 6


def test_a_listing_stays_in_its_bucket(spark, sellers, tmp_path):
    """Its event moves to another month; neither the listing nor the other way round is lost or doubled."""
    root = f"{tmp_path}/t"
    first = ingest(empty_tables(spark, sellers), raw(spark, [listing(k) for k in range(3)]), F.lit(NOW), fuzzy=False)
    write_snapshot(first.tables, root, 0)
    moved = ingest(read_snapshot(spark, root), raw(spark, [listing(1, 60)]), F.lit(NOW), fuzzy=False)
    commit(spark, root, 1, moved.changes, moved.tables.events, base=0)
    after = read_snapshot(spark, root)
    assert contents(after.events) == contents(moved.tables.events) and contents(after.event_sources) == contents(moved.tables.event_sources)
    place = {(e["month"], e["bucket"]) for e in manifest(spark, root, 0) if e["name"] == "event_sources"}
    assert {(e["month"], e["bucket"]) for e in manifest(spark, root, 1) if e["name"] == "event_sources"} == place


def test_favourites_go_with_their_event(spark, sellers, tmp_path):
    """A re-scrape gives one event the fingerprint of another; both tables change in one version."""
    root = f"{tmp_path}/t"
    first = ingest(empty_tables(spark, sellers), raw(spark, [listing(0), listing(1)]), F.lit(NOW), fuzzy=False).tables
    ids = {r["title"]: r["id"] for r in first.events.collect()}
    likes = spark.createDataFrame([("u1", ids["Title number 0"], NOW), ("u2", ids["Title number 1"], NOW), ("u3", "elsewhere", NOW)], schemas.FAVORITES)
    write_snapshot(first.with_(favorites=likes), root, 0)
    taken = raw(spark, [listing(1) | {"seq": 9, "source_url": "https://t.example.com/e/0"}])
    result = ingest(read_snapshot(spark, root), taken, F.lit(NOW), fuzzy=False)
    assert {r["outcome"] for r in result.outcomes.collect()} == {"merged"}
    commit(spark, root, 1, result.changes, result.tables.events, base=0)
    after = read_snapshot(spark, root)
    assert {r["title"] for r in after.events.collect()} == {"Title number 1"}
    assert {r["user_id"] for r in after.favorites.collect()} == {"u2", "u3"} == {r["user_id"] for r in result.tables.favorites.collect()}
    assert {r["event_id"] for r in after.event_sources.collect()} == {ids["Title number 1"]}
    assert read_snapshot(spark, root, 0).favorites.count() == 3


def test_difference(spark):
    def pages(*rows):
        return spark.createDataFrame([(u, NOW if t else None) for u, t in rows], schemas.SCRAPED_PAGES)

    change = difference("scraped_pages", pages(("a", 1), ("b", None), ("c", 1)), pages(("a", 1), ("b", 1), ("d", None)))
    assert {r["url"] for r in change.rows.collect()} == {"b", "d"} and {r["url"] for r in change.gone.collect()} == {"b", "c", "d"}


def test_empty_tables_and_no_changes(spark, sellers, tmp_path):
    write_snapshot(empty_tables(spark), f"{tmp_path}/t", 0)
    assert [rows.count() for rows in read_snapshot(spark, f"{tmp_path}/t").held().values()] == [0] * 5
    none = spark.createDataFrame([], schemas.SOURCES)
    assert commit(spark, f"{tmp_path}/t", 1, {"sources": Changes(none, none.select("id"))}, base=0) == []
    assert isinstance(read_snapshot(spark, f"{tmp_path}/t"), Tables) and committed_version(spark, f"{tmp_path}/t") == 1


def test_an_input_is_spread_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables_module, "TASK_ROWS", 100)
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/in")
    dealt = tables_module.spread(spark.read.parquet(f"{tmp_path}/in"))
    assert dealt.rdd.getNumPartitions() == 50 and dealt.distinct().count() == 5000
    assert tables_module.spread(dealt).rdd.getNumPartitions() == 50


def test_stored_rows_are_not_taken_for_their_compressed_size(spark, tmp_path):
    """A million numbers lie in a small file; Spark took its size for that of the rows and sent them all through the driver."""
    rows = spark.range(1_000_000).selectExpr("id", "sha2(cast(id % 5 as string), 256) AS a", "'x' AS b")
    rows.write.parquet(f"{tmp_path}/in")
    stored = utc(spark).read.parquet(f"{tmp_path}/in")
    limit = int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b"))
    assert stored.select("id")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > limit


# --- re-deliveries ----------------------------------------------------------------
def test_only_changed_deliveries_pass(spark, tmp_path):
    def deliver(*rows):
        raw(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        passed = first_deliveries(stream_listings(spark, f"{tmp_path}/in"))
        passed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(r["seq"] for r in spark.read.schema(schemas.RAW_LISTINGS).parquet(f"{tmp_path}/out").collect())

    one, dear = listing(1), listing(1, price_from=99.0)
    assert deliver(one, one | {"seq": 2}, dear | {"seq": 3}, listing(4)) == [1, 3, 4]
    assert deliver(dear | {"seq": 10}, listing(4) | {"seq": 11}) == [1, 3, 4]  # replayed
    assert deliver(one | {"seq": 0}) == [0, 1, 3, 4]  # late, but not what was said last
    assert deliver(one | {"seq": 20, "price_from": None}) == [0, 1, 3, 4, 20]


def test_the_state_of_the_stream_is_shared_by_many_urls(spark, tmp_path):
    """A call for each URL took milliseconds each; now the number of states is bounded, and the URLs of one stay apart."""
    rows = [listing(k) for k in range(2000)]
    raw(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    for again in (rows, [r | {"price_from": 3.0} if r["seq"] % 100 == 0 else r for r in rows]):
        passed = first_deliveries(stream_listings(spark, f"{tmp_path}/in"))
        run = passed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination()
        raw(spark, again).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    passed = first_deliveries(stream_listings(spark, f"{tmp_path}/in"))
    run = passed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= STATE_BUCKETS
    seqs = [r["seq"] for r in spark.read.schema(schemas.RAW_LISTINGS).parquet(f"{tmp_path}/out").select("seq").collect()]
    assert sorted(seqs) == sorted([*range(2000), *range(0, 2000, 100)])


def test_a_stream_without_redeliveries(spark, sellers, tmp_path):
    def run(rows):
        raw(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/p", sellers, fuzzy=False, redeliveries=False).awaitTermination()
        return {r["url"]: (float(r["price_from"]), r["last_seen_at"]) for r in read_snapshot(spark, f"{tmp_path}/t").event_sources.collect()}

    first = run([listing(k) for k in range(4)])
    second = run([listing(k, price_from=7.0 if k == 2 else 10.0) for k in range(4)])
    assert {u for u in first if first[u] != second[u]} == {"https://t.example.com/e/2"} and second["https://t.example.com/e/2"][0] == 7.0
