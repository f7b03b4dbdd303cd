"""Awkward pages, ids, folders and hot groups."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions import markup, text
from marquee.operators import cards, extract, feed, frontier, merge
from marquee.plans.ingest import ingest
from marquee.plans.scrape import scheduled_run
from marquee.session import cut
from marquee.sources import sample
from marquee.sources.tables import committed_version, empty_tables, read_events, read_page_files, read_snapshot, write_snapshot
from marquee.streaming.ingest import stream_ingest, without_redeliveries


def one(spark, column):
    return spark.range(1).select(column.alias("value")).first()[0]


@pytest.mark.parametrize(
    ("given", "once", "page"),
    [
        ("&#" + "9" * 40 + ";", None, "�"), ("a\x00b&#65;", "a\x00bA", "a\x00bA"), ("&#" + "38".zfill(40) + ";", "&", "&"), ("&#" + "7" * 400 + ";x", None, "�x"),
        ("&#x" + "0" * 30 + "41;", "A", "A"), ("A &amp;amp; B", "A &amp; B", "A &amp; B"), ("x&nbsp;y&eacute;&unknown;", "x&nbsp;y&eacute;&unknown;", "x yé&unknown;"),
        ("\x00&#0;\x01&#1;", "\x00\x00\x01\x01", "\x00�\x01\x01"), ("&#128512;", None, "😀"), ("no reference & none", "no reference & none", "no reference & none"),
    ],
)
def test_references(spark, given, once, page):
    if once is not None:
        assert one(spark, markup.entity_decode(F.lit(given))) == once
    else:
        assert one(spark, markup.entity_decode(F.lit(given))) is not None
    assert one(spark, markup.reference_decode(F.lit(given))) == page


def page(body, page_id=1):
    return (page_id, f"https://t.example.com/sk/listky/{page_id}/", "koncert", f"<html><body>{body}</body></html>")


PAGE = "page_id long, url string, category string, html string"


def test_whole_class_tokens(spark):
    visible = '<h1>A &amp;amp; B</h1><p class="mb-4-lg">x</p><p class="lead mb-4">01.02.2024 20:00 Rock &amp; Pop&nbsp;Club, Brno</p>'
    read = extract.page_details(spark.createDataFrame([page(visible)], PAGE)).first()
    assert (read["kind"], read["title"], read["place"]["venue"]) == ("single", "A & B", "Rock & Pop Club")
    box = '<section class="box-content"><em class="box-item-title"><span>T</span></em><a class="box-item-btn" href="/sk/listky/1?x=1&amp;y=2">go</a></section>'
    old = box.replace("box-content", "box-content-x").replace("/1?", "/9?")
    found = extract.listing_cards(spark.createDataFrame([page(box + old)], PAGE)).collect()
    assert [(r["title"], r["href"]) for r in found][:1] == [("T", "https://t.example.com/sk/listky/1?x=1&y=2")]


def test_a_bad_page_leaves_the_others(spark):
    bad = page("<h1>&#" + "9" * 40 + ';\x00&#1;</h1><p class="mb-4">never</p>', 2)
    good = page('<h1>Fine</h1><p class="mb-4">01.02.2024 20:00 Hall, Brno</p>', 3)
    pages = spark.createDataFrame([bad, good], PAGE)
    assert [r["title"] for r in extract.pages_to_listings(pages, "s", "SK", "EUR").collect()] == ["Fine"]
    assert [r["page_id"] for r in extract.page_rejects(extract.page_details(pages)).collect()] == [2]


def test_listing_numbers_of_any_page_ids(spark):
    body = '<h1>Fine</h1><p class="mb-4">01.02.2024 20:00 Hall, Brno</p>'
    ids = [1, 1 + 2**44, -(2**62), 2**63 - 1]
    rows = extract.pages_to_listings(spark.createDataFrame([page(body, i) for i in ids], PAGE), "s", "SK", "EUR").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [0, 1, 2, 3]
    assert [int(r["source_url"].split("/")[-2]) for r in rows] == sorted(ids)


def test_page_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.html").write_text(f"<p>page {k}</p>\nnext line")
    pages = read_page_files(spark, str(tmp_path)).collect()
    assert len({r["page_id"] for r in pages}) == 3 and sorted(r["html"] for r in pages)[2] == "<p>page 2</p>\nnext line"


def test_invalid_links_are_not_fetched(spark):
    linked = spark.createDataFrame([("koncert", 1, "not a url"), ("koncert", 2, "https://t.example.com/a")], "category string, position int, href string")
    known = spark.createDataFrame([], "url string, last_fetched_at timestamp")
    plan = frontier.refetch_plan(linked, known, sample.now())
    assert {r["position"]: r["decision"] for r in plan.collect()} == {1: "invalid", 2: "new"}
    assert [r["position"] for r in frontier.refetch_cap(plan, None).collect()] == [2]


def test_title_distance_bounds(spark):
    pairs = [("abcde", "abcdf", 0.2), ("abcdef", "abcdeg", 1 / 6), ("", "abc", 1.0), ("", "", 1.0)]
    for a, b, want in pairs:
        assert one(spark, text.title_distance(F.lit(a), F.lit(b))) == pytest.approx(want)


# --- streaming -------------------------------------------------------------------
def listing(k):
    return spark_row(k, f"https://t.example.com/e/{k}", f"Title number {k}")


def spark_row(seq, url, title):
    values = dict.fromkeys(schemas.RAW_LISTINGS.names)
    values.update(seq=seq, source="s1", source_url=url, title=title, venue=f"Hall {seq}", city="Praha", country="CZ", starts_at=dt.datetime(2024, 2, 1, 20) + dt.timedelta(days=seq))
    return tuple(values[n] for n in schemas.RAW_LISTINGS.names)


def test_a_second_run_with_new_progress_adds_its_files(spark, tmp_path):
    sellers = spark.createDataFrame([("s1", "s1", "Seller", "https://t.example.com", None)], schemas.SOURCES)

    def run(landing, progress, rows):
        if rows:
            spark.createDataFrame(rows, schemas.RAW_LISTINGS).write.mode("append").parquet(f"{tmp_path}/{landing}")
        stream_ingest(spark, f"{tmp_path}/{landing}", f"{tmp_path}/tables", f"{tmp_path}/{progress}", sellers, fuzzy=False).awaitTermination()
        return read_snapshot(spark, f"{tmp_path}/tables").event_sources.count()

    assert run("a", "p1", [listing(k) for k in range(4)]) == 4
    assert run("b", "p2", [listing(k) for k in range(4, 8)]) == 8
    assert run("b", "p2", []) == 8  # nothing new
    assert run("b", "p2", [listing(9)]) == 9
    assert committed_version(spark, f"{tmp_path}/tables") == 2


def test_only_a_missing_folder_means_no_snapshot(spark, tmp_path):
    assert committed_version(spark, f"{tmp_path}/none") is None
    write_snapshot(empty_tables(spark), f"{tmp_path}/t", 3)
    assert committed_version(spark, f"{tmp_path}/t") == 3
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "commits").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        committed_version(spark, f"{tmp_path}/odd")
    assert issubclass(AnalysisException, Exception)


def test_redeliveries(spark, tmp_path):
    rows = [listing(1), listing(1), listing(2)]
    frame = spark.createDataFrame(rows, schemas.RAW_LISTINGS).withColumn("seen_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = without_redeliveries(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), "seen_at")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


# --- feed ------------------------------------------------------------------------
def test_happening_row_is_hidden_for_a_later_range(spark):
    events = ingest(empty_tables(spark, spark.createDataFrame([("s1", "s1", "Seller", "u", None)], schemas.SOURCES)), spark.createDataFrame([listing(0)], schemas.RAW_LISTINGS), sample.now(), fuzzy=False).tables.events
    now = dt.datetime(2024, 2, 1, 21, tzinfo=dt.timezone.utc)
    assert feed.happening_now(events, feed.Filters(), now).count() == 1
    assert feed.happening_now(events, feed.Filters(when="weekend"), now).count() == 0
    home = feed.home_feed(events, feed.Filters(), now).collect()
    assert [(r["section"], r["place"], r["city"]) for r in home] == [("happening", 1, "Praha"), ("city", 1, "Praha")]


# --- hot groups --------------------------------------------------------------------
def largest_task(spark, frame):
    """Rows of the fullest partition of a result, and their number."""
    # Every column is used, so that none is pruned and the shuffled rows keep their size.
    used = F.max(F.xxhash64(*frame.columns))
    sizes = [r["n"] for r in frame.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), used).collect()]
    return max(sizes), sum(sizes)


@pytest.fixture
def split_early(spark):
    wanted = {
        "spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_event_spreads_over_tasks(spark, split_early):
    n = 60_000
    event = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("e"), (F.col("id") % 5000).cast("string")))
    rows = spark.range(n).select(F.col("id").alias("seq"), event.alias("event_id"), F.concat(F.lit("u"), "id").alias("url"))
    known = merge.of_events(rows.select("seq", "url"), rows.select("event_id", "url"))
    most, total = largest_task(spark, known)
    assert total == n and most < n / 6

    filled = {f.name: F.lit(None).cast(f.dataType) for f in schemas.EVENTS}
    # A stored table, as events are.
    events = cut(rows.select("event_id").distinct()).select(*[F.col("event_id").alias("id") if k == "id" else F.lit("EUR").alias(k) if k == "currency" else v.alias(k) for k, v in filled.items()])
    filled = {f.name: F.lit(None).cast(f.dataType) for f in schemas.EVENT_SOURCES}
    given = {"id": F.col("url"), "event_id": F.col("event_id"), "url": F.col("url"), "source_id": F.lit("s1"), "currency": F.lit("EUR")}
    offers = rows.select(*[given.get(k, v).alias(k) for k, v in filled.items()])
    sellers = spark.createDataFrame([("s1", "s1", "Seller", "u", None)], schemas.SOURCES)
    most, total = largest_task(spark, cards.event_cards(events, offers, sellers))
    assert total == n and most < n / 6


def test_the_feed_opens_only_the_months_in_range(spark, tmp_path):
    sellers = spark.createDataFrame([("s1", "s1", "Seller", "u", None)], schemas.SOURCES)
    rows = [spark_row(k, f"https://t.example.com/e/{k}", f"Title {k}")[:7] + (dt.datetime(2024, 1 + k % 12, 5, 20),) + spark_row(k, "", "")[8:] for k in range(24)]
    tables = ingest(empty_tables(spark, sellers), spark.createDataFrame(rows, schemas.RAW_LISTINGS), sample.now(), fuzzy=False).tables
    write_snapshot(tables, f"{tmp_path}/t", 1)
    now = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    grid = feed.feed_grid(read_events(spark, f"{tmp_path}/t"), feed.Filters(when="month"), now)
    assert {r["month"] for r in grid.collect()} == {"2024-03"}
    assert len({f.split("month=")[1][:7] for f in grid.inputFiles()}) == 12
    plan = grid._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan.replace("\n", " ")


def test_a_scheduled_run(spark):
    sellers = spark.createDataFrame([("s1", "s1", "Seller", "u", None)], schemas.SOURCES)
    body = '<h1>Title {0}</h1><p class="mb-4">0{0}.02.2024 20:00 Hall, Brno</p>'
    pages = spark.createDataFrame([page(body.format(k), k) for k in range(1, 6)] + [page("<p>odd</p>", 6)], PAGE)
    linked = pages.select("category", F.col("page_id").cast("int").alias("position"), F.col("url").alias("href"))
    none = spark.createDataFrame([], "url string, last_fetched_at timestamp")
    first = scheduled_run(empty_tables(spark, sellers), none, linked, pages, "s1", "CZ", "CZK", sample.now(), fuzzy=False)
    assert first.counts.first()["new_pages"] == 6 and first.unreadable.count() == 1
    assert first.tables.events.count() == 5 and first.scraped_pages.count() == 6
    assert first.tables.sources.first()["last_scraped_at"] is not None
    later = sample.now() + F.expr("INTERVAL '1' HOUR")
    again = scheduled_run(first.tables, first.scraped_pages, linked, pages, "s1", "CZ", "CZK", later, fuzzy=False)
    assert (again.counts.first()["fresh_skips"], again.counts.first()["new_pages"]) == (6, 0)
    assert again.tables.event_sources.filter(F.col("last_seen_at") == later).count() == 5
    favorites = spark.createDataFrame([("u", "gone"), ("u", first.tables.events.first()["id"])], "user_id string, event_id string")
    assert first.ingested.surviving(favorites).count() == 1


def test_equal_searches_are_matched_once(spark):
    sellers = spark.createDataFrame([("s1", "s1", "Seller", "u", None)], schemas.SOURCES)
    events = ingest(empty_tables(spark, sellers), spark.createDataFrame([listing(k) for k in range(5)], schemas.RAW_LISTINGS), sample.now(), fuzzy=False).tables.events
    rows = [(k, ["Praha", "Brno"] if k % 2 else ["Brno", "Praha"], [], None, None) for k in range(6)] + [(9, ["Brno"], [], None, None)]
    searches = spark.createDataFrame(rows, "search_id long, cities array<string>, genres array<string>, when string, max_price double")
    assert {r["search_id"]: r["matches"] for r in feed.saved_search_counts(events, searches, sample.now()).collect()} == {k: 5 for k in range(6)}
