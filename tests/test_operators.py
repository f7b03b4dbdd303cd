"""Operators on small tables, one boundary per row."""

from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marquee import schemas
from marquee.operators import cards, digest, extract, feed, frontier, linkage, maintenance, merge, upserts
from marquee.operators.normalize import check_listings, normalized, rejects
from marquee.operators.ranking import ranked
from marquee.operators.resolve import resolve_batch
from marquee.plans.ingest import ingest
from marquee.sources.tables import empty_tables, read_snapshot
from marquee.streaming.ingest import ingest_batch, stream_ingest

NOW = datetime(2026, 9, 30, 10, tzinfo=timezone.utc)
AT = NOW.replace(tzinfo=None)
HOUR = timedelta(hours=1)


def events(spark, *rows):
    """Rows as dicts over a complete default event."""
    base = dict(
        title="T", venue="V", city="Praha", country="CZ", starts_at=AT, ends_at=None, price_from=None, currency="CZK",
        start_day=date(2026, 9, 30), price_known=False, genre="concert", image_url=None, created_at=AT, updated_at=AT,
    )
    full = [{**base, "fingerprint": f"fp {r['id']}", **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.EVENTS) for r in full], schemas.EVENTS)


def offers(spark, *rows):
    """(url, event, price, currency) with the rest filled in."""
    full = [(f"l-{u}", e, "s1", u, None if p is None else Decimal(p), c, AT - 24 * HOUR, None) for u, e, p, c in rows]
    return spark.createDataFrame(full, schemas.EVENT_SOURCES)


@pytest.fixture(scope="module")
def sellers(spark):
    rows = [("s1", "one", "Zeta", "https://one.example.com", None), ("s2", "two", "Alpha", "https://two.example.com", None)]
    return spark.createDataFrame(rows, schemas.SOURCES)


def raw(spark, *rows):
    base = dict(
        source="one", title="Jazz", venue="Hall", city="Praha", country=None, starts_at=AT, ends_at=None, price_from=None,
        currency=None, raw_genre=None, image_url=None,
    )
    full = [{**base, "seq": i, "source_url": f"https://x.example.com/{i}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.RAW_LISTINGS) for r in full], schemas.RAW_LISTINGS)


def ids(df):
    return [r.id for r in df.collect()]


def test_listing_validation(spark, sellers):
    rows = raw(
        spark,
        {"title": " Nočný  jazz ", "city": "Prague", "country": "SK", "price_from": 12.345, "ends_at": AT - HOUR, "image_url": "data:x"},
        {"title": "🎉"},
        {"starts_at": None},
        {"city": " "},
        {"city": "Nowhere"},
        {"city": "Nowhere", "country": "SK", "image_url": " HTTPS://img/1 "},
        {"source_url": "nope"},
        {"source": "none"},
        {"price_from": 123456789.0},
        {"title": "!!!", "starts_at": None, "city": ""},
    )
    checked = check_listings(rows, sellers)
    good = {r.seq: r for r in normalized(checked).collect()}
    assert sorted(good) == [0, 5]
    assert (good[0].title, good[0].country, good[0].currency, good[0].price) == ("Nočný jazz", "CZ", "CZK", Decimal("12.35"))
    assert (good[0].ends_at, good[0].image_url) == (None, None)
    assert (good[0].fingerprint, good[5].image_url) == ("nocny jazz|hall|2026-09-30", "HTTPS://img/1")
    assert {r.seq: r.reason for r in rejects(checked).collect()} == {
        1: "empty title",
        2: "invalid startsAt",
        3: "empty city",
        4: 'unknown country for city "Nowhere"',
        6: "Invalid URL",
        7: 'unknown source "none"',
        8: "price overflow",
        9: "empty title",
    }


def test_fuzzy_match_boundaries(spark):
    stored = events(
        spark,
        {"id": "a", "title": "abcdefghix", "created_at": AT - HOUR},
        {"id": "b", "title": "abcdefghiy"},
        {"id": "c", "title": "abcdefghij", "starts_at": AT + 3 * HOUR},
        {"id": "far", "title": "abcdefghij", "starts_at": AT + 3 * HOUR + timedelta(milliseconds=1)},
        {"id": "brno", "title": "zzzzzzzzzz", "city": "Brno"},
        {"id": "n2", "title": "Jazz Night 2"},
        {"id": "two", "title": "qwerty"},
    )
    probes = [(0, "abcdefghij"), (1, "abcdefghiz"), (2, "zzzzzzzzzz"), (3, "jazz night"), (4, "jazz night 1"), (5, "qwerxx"), (6, "abcdefghkk")]
    rows = spark.createDataFrame([(s, "Praha", t, AT) for s, t in probes], "seq long, city string, title_key string, starts_at timestamp")
    got = {r.seq: (r.event_id, r.distance) for r in linkage.fuzzy_match(rows, stored).collect()}
    assert got == {0: ("c", 0.0), 1: ("a", 0.1), 3: ("n2", 2 / 12)}


def test_all_similar_titles_are_found(spark):
    """The piece join equals comparing everything with everything."""
    import random

    from tests.sequential import distance

    rng = random.Random(3)
    titles = set()
    while len(titles) < 160:
        title = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 23))).strip()
        base = rng.choice(["summer festival of light", "jazz 12", "club night", title]) if rng.random() < 0.5 else title
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(base) + 1)
            base = base[:at] + rng.choice(["", "x", "1"]) + base[at + rng.randrange(2) :]
        if base:
            titles.add(base)
    rows = spark.createDataFrame([("T", t, 1_000_000 * i) for i, t in enumerate(sorted(titles))], "city string, title_key string, starts_ms long")
    rows = rows.withColumn("starts_ms", F.col("starts_ms") * 0)
    got = {(r.title_key, r.other_key) for r in linkage.similar_titles(rows).collect()}
    assert got == {(a, b) for a in titles for b in titles if a == b or distance(a, b) < 0.2}


def test_a_hot_group_resolves(spark):
    """A third of all listings are copies in one city, time and title; another third one title at many times."""
    n = 6000
    rows = spark.range(n).select(
        F.col("id").alias("seq"),
        F.concat(F.lit("https://x.example.com/"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 3 == 2, F.concat(F.lit("show "), F.col("id").cast("string"))).otherwise("jazz night").alias("title_key"),
        F.when(F.col("id") % 3 == 0, "Praha").otherwise("Brno").alias("city"),
        (F.lit(AT).cast("timestamp") + F.make_interval(secs=F.when(F.col("id") % 3 == 1, F.col("id")).otherwise(0))).alias("starts_at"),
    )
    rows = rows.withColumn("fingerprint", F.concat_ws("|", "title_key", "city", "starts_at"))
    got = resolve_batch(rows, empty_tables(spark).events).groupBy("matched_by").count().collect()
    assert {r.matched_by: r["count"] for r in got} == {"new": n // 3 + 2, "fuzzy": n // 3 - 1, "fingerprint": n // 3 - 1}


def test_event_price(spark):
    rows = [
        ("u1", "min", "20", "CZK"), ("u2", "min", "15", "CZK"), ("u3", "min", "5", "EUR"), ("u4", "zero", "0", "CZK"),
        ("u5", "zero", "9", "CZK"), ("u6", "null", None, "CZK"), ("u7", "other", "3", "EUR"),
    ]
    found = merge.event_price(events(spark, *[{"id": i} for i in ("min", "zero", "null", "other", "bare")]), offers(spark, *rows))
    assert {r.id: r.price_from for r in found.collect()} == {"min": 15, "zero": 0, "null": None, "other": None, "bare": None}


def rescraped(spark, *rows):
    fields = "seq long, url string, title string, venue string, starts_at timestamp, ends_at timestamp, fingerprint string, price decimal(10,2), price_currency string, image_url string"
    return spark.createDataFrame([(s, u, t, "V2", at, None, fp, Decimal("7.00"), "CZK", img) for s, u, t, at, fp, img in rows], fields)


def test_rescrapes(spark):
    stored = events(
        spark,
        {"id": "solo", "image_url": ""},
        {"id": "near"},
        {"id": "edge"},
        {"id": "jump"},
        {"id": "loser"},
        {"id": "owner", "fingerprint": "taken"},
    )
    rows = [("solo", "solo"), ("near", "near"), ("edge", "edge"), ("jump", "jump"), ("loser", "loser"), ("owner", "owner")]
    rows += [("near2", "near"), ("edge2", "edge"), ("jump2", "jump"), ("jump3", "jump")]
    listed = offers(spark, *[(u, e, None, "CZK") for u, e in rows])
    batch = rescraped(
        spark,
        (1, "solo", "New", AT + 9 * HOUR, "fresh", "https://img/1"),
        (2, "near", "New", AT + HOUR / 2, "x", None),
        (3, "edge", "New", AT + 3 * HOUR, "x", None),
        (4, "jump", "New", AT + 4 * HOUR, "x", None),
        (5, "jump2", "New", AT, "x", None),
        (6, "jump3", "New", AT + 2 * HOUR, "x", None),
        (7, "loser", "New", AT, "taken", "https://img/7"),
    )
    after, offered, outcomes = merge.apply_rescrapes(stored, listed, batch, F.lit(AT))
    got = {r.id: r for r in after.collect()}
    assert (got["solo"].title, got["solo"].starts_at, got["solo"].fingerprint, got["solo"].image_url) == ("New", AT + 9 * HOUR, "fresh", "https://img/1")
    assert got["solo"].price_from == 7 and got["solo"].price_known
    assert (got["near"].starts_at, got["edge"].starts_at, got["near"].title) == (AT, AT, "T")
    # Off by four hours moves, back by four hours moves again, two hours stays.
    assert got["jump"].starts_at == AT
    assert "loser" not in got and got["owner"].image_url == "https://img/7"
    assert {r.event_id for r in offered.filter("url = 'loser'").collect()} == {"owner"}
    assert {r.seq: r.outcome for r in outcomes.collect()} == {**dict.fromkeys(range(1, 7), "updated"), 7: "merged"}


def test_upserts(spark, sellers):
    new = spark.createDataFrame([("s9", "one", "Renamed", "https://n.example.com", None), ("s3", "three", "Three", "https://3.example.com", None)], schemas.SOURCES)
    kept = {r.slug: r.name for r in upserts.source_upsert(sellers, new).collect()}
    assert kept == {"one": "Zeta", "two": "Alpha", "three": "Three"}
    over = {r.slug: (r.id, r.name) for r in upserts.source_upsert_overwrite(sellers, new).collect()}
    assert over == {"one": ("s1", "Renamed"), "two": ("s2", "Alpha"), "three": ("s3", "Three")}
    pages = spark.createDataFrame([("a", AT - HOUR), ("b", None)], schemas.SCRAPED_PAGES)
    fetched = spark.createDataFrame([("a",), ("c",)], "url string")
    got = {r.url: r.last_fetched_at for r in upserts.scraped_pages_upsert(pages, fetched, F.lit(AT)).collect()}
    assert got == {"a": AT, "b": None, "c": AT}
    seen = upserts.touch_last_seen(offers(spark, ("a", "e", None, "CZK"), ("z", "e", None, "CZK")), fetched, F.lit(AT))
    assert {r.url: (r.last_seen_at == AT, r.last_detail_fetched_at) for r in seen.collect()} == {"a": (True, None), "z": (False, None)}
    assert upserts.stamp_source(sellers, "one", F.lit(AT)).filter("last_scraped_at IS NOT NULL").count() == 1


def test_feed(spark):
    rows = events(
        spark,
        {"id": "now"},
        {"id": "past", "starts_at": AT - 3 * HOUR},
        {"id": "edge", "starts_at": AT - 2 * HOUR},
        {"id": "show", "starts_at": AT - 48 * HOUR, "ends_at": AT + HOUR / 2},
        {"id": "over", "starts_at": AT - 48 * HOUR, "ends_at": AT - HOUR},
        {"id": "late", "starts_at": AT + 2 * HOUR, "price_known": True, "price_from": Decimal("700"), "city": "Brno"},
        {"id": "dear", "starts_at": AT + HOUR, "price_known": True, "price_from": Decimal("800"), "genre": "sport"},
        {"id": "next", "starts_at": AT + 24 * HOUR, "start_day": date(2026, 10, 1)},
    )
    assert ids(feed.feed_page(rows, feed.Filters(), NOW)) == ["dear", "late", "now", "next"]
    assert ids(feed.feed_page(rows, feed.Filters(when="today", max_price=30.0), NOW)) == ["late", "now"]
    assert ids(feed.feed_page(rows, feed.Filters(cities=("Brno",), genres=("concert",)), NOW)) == ["late"]
    assert ids(feed.happening_now(rows, feed.Filters(), NOW)) == ["edge", "show"]
    assert ids(feed.happening_now(rows, feed.Filters(), NOW, 1)) == ["edge"]
    assert ids(feed.happening_now(rows, feed.Filters(when="weekend"), NOW)) == []
    saturday = NOW + timedelta(days=3)
    assert ids(feed.happening_now(rows.withColumn("ends_at", F.lit(saturday)), feed.Filters(when="weekend"), saturday, 2)) != []
    on = rows.filter(feed.ongoing(NOW))
    assert ids(feed.happening_union(on.filter("ends_at IS NOT NULL"), on.filter("ends_at IS NULL"))) == ["edge", "show"]
    assert set(ids(feed.visible_events(rows, NOW))) == {"now", "edge", "show", "late", "dear", "next"}
    assert [r.city for r in feed.city_options(rows, NOW, ["Žilina", "Čadca", "Zvolen"]).collect()] == ["Brno", "Čadca", "Praha", "Zvolen", "Žilina"]
    more = [(True, 1, True), (False, 1, False), (True, 50, False), (True, 49, True)]
    table = spark.createDataFrame(more, "more boolean, page int, want boolean")
    assert table.filter(feed.has_next_page(F.col("more"), F.col("page")) != F.col("want")).count() == 0


def test_saved_searches_agree_with_single_requests(spark):
    rows = events(
        spark,
        *[
            {"id": f"{c}{g}{h}", "city": c, "genre": g, "starts_at": AT + h * HOUR, "price_from": Decimal(h), "currency": "EUR"}
            for c in ("Praha", "Brno")
            for g in ("concert", "sport")
            for h in (1, 30, 100)
        ],
    )
    wanted = {
        1: feed.Filters(),
        2: feed.Filters(cities=("Praha",)),
        3: feed.Filters(genres=("sport",), when="today"),
        4: feed.Filters(cities=("Praha", "Brno"), genres=("concert",), when="weekend", max_price=50.0),
    }
    fields = "search_id int, cities array<string>, genres array<string>, when string, max_price double"
    table = spark.createDataFrame([(k, list(f.cities), list(f.genres), f.when, f.max_price) for k, f in wanted.items()], fields)
    got = {(r.search_id, r.id) for r in feed.saved_search_match(rows, table, F.lit(AT)).collect()}
    assert got == {(k, i) for k, f in wanted.items() for i in ids(feed.feed_grid(rows, f, NOW))}


def test_card_order(spark, sellers):
    named = sellers.unionByName(
        spark.createDataFrame([("s3", "x", "Beta", "", None), ("s4", "y", "Gamma", "", None)], schemas.SOURCES)
    )
    rows = [("a", "s1", "10", "CZK"), ("b", "s3", "10", "CZK"), ("c", "s2", None, "CZK"), ("d", "s4", "1", "EUR")]
    listed = spark.createDataFrame([(u, "e", s, u, p and Decimal(p), c, AT, None) for u, s, p, c in rows], schemas.EVENT_SOURCES)
    got = cards.event_cards(events(spark, {"id": "e"}, {"id": "bare"}), listed, named).collect()
    assert [r.source_name for r in sorted((r for r in got if r.event_id == "e"), key=lambda r: r.position)] == ["Beta", "Zeta", "Alpha", "Gamma"]
    assert [(r.position, r.url) for r in got if r.event_id == "bare"] == [(None, None)]


def test_ranking_spreads_a_hot_group(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"), F.xxhash64("id").alias("o"))
    got = ranked(rows, ["g"], ["o"])
    want = rows.selectExpr("g", "o", "row_number() OVER (PARTITION BY g ORDER BY o) AS position")
    assert got.select("g", "o", "position").exceptAll(want.withColumn("position", F.col("position").cast("long"))).count() == 0
    assert got.count() == 9000


def test_frontier(spark):
    day = timedelta(days=1)
    base = "https://tickets.example.com/sk/listky/"
    jitter = spark.range(1).select(frontier.refetch_jitter(F.lit(base + "known"))).first()[0]
    listed = [("c", 1, "new/"), ("c", 2, "fresh/?utm_source=x"), ("c", 3, "due"), ("c", 4, "null"), ("c", 5, "known"), ("d", 1, "known2")]
    table = spark.createDataFrame([(c, p, base + u) for c, p, u in listed], "category string, position int, href string")
    known = [("fresh", AT - HOUR), ("due", AT - 5 * day), ("null", None), ("known", AT - 3 * day - timedelta(milliseconds=jitter)), ("known2", AT - 3 * day)]
    pages = spark.createDataFrame([(base + u, t) for u, t in known], schemas.SCRAPED_PAGES)
    plan = frontier.refetch_plan(table, pages, F.lit(AT))
    assert {r.url.removeprefix(base): r.decision for r in plan.collect()} == {
        "new": "new", "fresh": "fresh", "due": "due", "null": "due", "known": "due", "known2": "fresh",
    }
    capped = frontier.refetch_cap(plan, 2)
    assert {r.url.removeprefix(base) for r in capped.collect()} == {"new", "due"}
    assert {r.url.removeprefix(base) for r in frontier.touched(plan).collect()} == {"fresh", "known2"}
    counts = frontier.refetch_counts(plan, capped).first()
    assert (counts.listing_pages, counts.new_pages, counts.due_pages, counts.fresh_skips) == (2, 1, 1, 2)


def test_disallowed_paths(spark):
    body = "User-agent: *\nDisallow: /*blocked\n disallow: /a.b$\nDisallow:\nAllow: /"
    rules = frontier.robots_patterns(spark.createDataFrame([("X.example.com", body)], "host string, body string"))
    assert {r.pattern for r in rules.collect()} == {"/*blocked", "/a.b$"}
    urls = ["https://x.example.com/sk/blocked-1", "https://x.example.com/a.b", "https://x.example.com/a.b$", "https://x.example.com/axb", "https://y.example.com/blocked"]
    left = frontier.disallow_anti_join(spark.createDataFrame([(u,) for u in urls], "url string"), rules)
    assert {r.url for r in left.collect()} == {urls[1], urls[3], urls[4]}


def test_rules_of_a_host_are_one_lookup(spark):
    """Many rules, of which a path meets only those whose fixed text it begins with."""
    body = "\n".join(["Disallow: /sk", "Disallow: /skip*now", "Disallow: /ab?c", "Disallow: *.pdf", *[f"Disallow: /p{k}/*/x" for k in range(50)], "Disallow: /p7/q/*z"])
    rules = frontier.robots_patterns(spark.createDataFrame([("h.example.com", body), ("i.example.com", "Disallow: /")], "host string, body string"))
    sets = {r["host"]: r for r in frontier.rule_sets(rules).collect()}
    assert sets["h.example.com"]["rules"]["/sk"] == "" and len(sets["h.example.com"]["rules"]) == 55 and len(sets["h.example.com"]["lengths"]) == 6
    paths = ["/sk", "/skip", "/ski", "/s", "/ac", "/abc", "/abbc", "/a/b.pdf", "/p7/q/x", "/p7/q/y/z", "/p7/q", "/p9/q/x/more", "/p99/q/x", ""]
    urls = [f"https://{h}.example.com{p}" for h in "hij" for p in paths]
    frame = spark.createDataFrame([(u, "z") for u in [*urls, None, "no url"]], "url string, rules string")
    left = frontier.disallow_anti_join(frame, rules)
    plain = frame.join(rules.withColumn("regex", frontier.pattern_regex(F.col("pattern"))), F.expr("url LIKE concat('%://', host, '%') AND rlike(substring(url, 22), regex)"), "left_anti")
    assert left.columns == frame.columns
    assert sorted(str(r["url"]) for r in left.collect()) == sorted(str(r["url"]) for r in plain.collect() if not str(r["url"]).startswith("https://i"))


@pytest.mark.parametrize("limit", [2, 1001])
def test_cap_counts_positions_over_slices(spark, monkeypatch, limit):
    monkeypatch.setattr(frontier, "GROUP_LIMIT", 1 if limit == 2 else 1000)
    plan = spark.range(3000).select(F.lit("c").alias("category"), (F.col("id") * 7 % 3000).alias("position"), F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 2 == 0, "new").otherwise("fresh").alias("decision"))
    got = sorted(r["position"] for r in frontier.refetch_cap(plan, limit).collect())
    assert got == sorted(k * 7 % 3000 for k in range(0, 3000, 2))[:limit]


def test_page_shapes(spark):
    script = '<script type="application/ld+json">{}</script>'
    single = '{"name":"A &amp; B","startDate":"2026-12-05 17:00","location":{"name":"Hall, X","address":"Poprad"},"image":"","description":"%s"}'
    stop = '<li class="list-group-item x"><a href="/sk/listky/t-1"><strong>Tour</strong> <span class="text-readable"> {} </span></a></li>'
    pages = {
        0: script.replace("{}", single % "raw\nline"),
        1: script.replace("{}", single % 'a "quoted" phrase,\nand more'),
        2: "<ul>" + stop.format("05.12.2026 17:00 - Hall, Street, 080 01  Prešov") + "</ul>",
        3: "<ul>" + stop.format("soon - Hall, Prešov") + "</ul>",
        4: "<h1>Dom</h1><p class='mb-4'>05.12.2026 17:00 Hall, 811 01 Bratislava</p><meta property='og:image' content='https://og/1'>"
        "<div><small class='color-blue'>Cena</small> 19,90</div><div><small class='color-blue'>Cena</small> 9,90</div><div><small class='color-blue'>Iné</small> 1,00</div>",
        5: "<h1>No date</h1>",
        6: script.replace("{}", "{not json at all") + "<h1>Dom</h1><p class='mb-4'>05.12.2026 17:00 Hall</p>",
        7: script.replace("{}", (single % "x").replace("2026-12-05 17:00", "soon")),
    }
    table = spark.createDataFrame([(i, f"https://t.example.com/sk/listky/{i}/", "sport", h) for i, h in pages.items()], "page_id long, url string, category string, html string")
    details = extract.page_details(table)
    assert {r.page_id: (r.kind, r.reason) for r in details.collect()} == {
        0: ("single", None), 1: ("single", None), 2: ("tour", None), 3: ("tour", "invalid date"), 4: ("single", None),
        5: (None, "unrecognized event page shape"), 6: ("single", None), 7: ("single", "invalid date"),
    }
    rows = sorted(extract.pages_to_listings(table, "one", "SK", "EUR").collect())
    assert [r.seq for r in rows] == [0, 1, 2, 3, 4]
    got = dict(zip([0, 1, 2, 4, 6], rows, strict=True))  # listings are numbered in the order of their pages
    assert (got[0].title, got[0].venue, got[0].city, got[0].image_url, got[0].raw_genre) == ("A & B", "Hall", "Poprad", None, "Šport")
    assert got[1].starts_at == datetime(2026, 12, 5, 16)
    assert (got[2].source_url, got[2].city, got[2].price_from) == ("https://t.example.com/sk/listky/t-1", "Prešov", None)
    assert (got[4].price_from, got[4].image_url, got[4].city) == (9.9, "https://og/1", "Bratislava")
    assert {r.page_id for r in extract.page_rejects(details).collect()} == {3, 5, 7}


def test_cards_of_a_category_page(spark):
    box = '<div class="box-content"><p class="box-item-title"><span> {} </span></p><a class="btn box-item-btn" href="{}">x</a></div>'
    html = box.format("One &amp; two", "/sk/listky/one/") + box.format("Gift", "/sk/gift") + box.format("Out", "https://o.example.org/a")
    table = spark.createDataFrame([(1, "https://t.example.com/k/", "sport", html)], "page_id long, url string, category string, html string")
    got = extract.listing_cards(table).collect()
    assert [(r.title, r.href, r.position) for r in got] == [("One & two", "https://t.example.com/sk/listky/one/", 1)]


def test_maintenance(spark, sellers):
    rows = events(spark, {"id": "a"}, {"id": "b", "title": "Aurora Bloom"}, {"id": "c"})
    listed = offers(spark, ("u1", "a", None, "CZK"), ("u2", "b", None, "CZK"), ("u3", "b", None, "CZK"))
    listed = listed.withColumn("source_id", F.when(F.col("url") == "u3", "s2").otherwise("s1"))
    left = maintenance.drop_source(listed, sellers, "one")
    assert {r.url for r in left.collect()} == {"u3"}
    assert set(ids(maintenance.orphan_events(rows, left))) == {"a", "c"}
    assert ids(maintenance.without_orphans(rows, left)) == ["b"]
    assert {r.url for r in maintenance.cascade(listed, maintenance.without_orphans(rows, left)).collect()} == {"u2", "u3"}
    assert ids(maintenance.multi_source_events(listed)) == ["b"]
    assert [(r.id, r.listings) for r in maintenance.source_report(rows, listed, sellers, "two").collect()] == [("b", 2)]
    assert [(r.id, r.listings) for r in maintenance.title_contains(rows, listed, "Aurora").collect()] == [("b", 2)]
    runs = spark.createDataFrame([("s1", AT), ("s1", AT - HOUR), ("s2", AT)], "source_id string, run_at timestamp")
    assert {r.url for r in maintenance.stale_listings(listed, runs).collect()} == {"u1", "u2"}
    broken = merge.integrity_checks(rows.union(rows.limit(1)), listed.withColumn("event_id", F.lit("gone")), sellers)
    assert {r.rule: r.violations for r in broken.collect()}["listing without event"] == 3


def test_digest(spark):
    rows = events(
        spark,
        {"id": "liked", "starts_at": AT + 48 * HOUR},
        {"id": "old", "starts_at": AT - 48 * HOUR},
        {"id": "fits", "starts_at": AT + 240 * HOUR},
        {"id": "stale", "starts_at": AT + 240 * HOUR, "created_at": AT - 200 * HOUR},
        {"id": "brno", "city": "Brno", "starts_at": AT + 240 * HOUR},
    )
    likes = spark.createDataFrame([("u", "liked", AT), ("u", "old", AT), ("quiet", "liked", AT)], schemas.FAVORITES)
    people = spark.createDataFrame([("u", "u@example.com", False), ("quiet", "q@example.com", True)], schemas.USERS)
    got = {(r.user_id, r.event_id, r.part) for r in digest.digest(likes, people, rows, F.lit(AT)).collect()}
    assert got == {("u", "liked", "a"), ("u", "fits", "b")}


def test_rerun_of_a_batch_changes_nothing_new(spark, sellers):
    batch = raw(
        spark,
        {"title": "Aurora Bloom – Tour 2026", "venue": "O2 arena", "starts_at": AT + 9 * HOUR, "price_from": 990.0},
        {"title": "Aurora Bloom Tour 2026", "venue": "O2 arena Praha", "starts_at": AT + 9.5 * HOUR, "price_from": 1010.0},
        {"title": "Metal Tribute", "price_from": 890.0},
        {"title": "METAL TRIBUTE", "price_from": 35.0, "currency": "EUR"},
        {"title": "Metal Tribute", "price_from": 900.0, "source_url": "https://x.example.com/2/?utm_source=again"},
    )
    first = ingest(empty_tables(spark, sellers), batch, F.lit(AT))
    assert {r.outcome: r.listings for r in first.stats().collect()} == {"created": 2, "merged": 2, "updated": 1}
    price = {r.title: (float(r.price_from), r.currency) for r in first.tables.events.collect()}
    assert price == {"Aurora Bloom – Tour 2026": (990.0, "CZK"), "Metal Tribute": (900.0, "CZK")}
    again = ingest(first.tables, batch, F.lit(AT + HOUR))
    assert {r.outcome: r.listings for r in again.stats().collect()} == {"updated": 5}
    assert again.tables.event_sources.count() == 4


def test_streamed_folders_equal_one_run_each(spark, sellers, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):
        raw(spark, {"seq": n, "source_url": f"https://x.example.com/{n}", "title": f"Show {n}"}).write.mode("append").parquet(landing)
        stream = stream_ingest(spark, landing, root, str(tmp_path / "check"), sellers)
        stream.awaitTermination()
        assert stream.exception() is None
    tables = read_snapshot(spark, root)
    assert sorted(r.title for r in tables.events.collect()) == ["Show 0", "Show 1"]
    # A batch that is replayed after its snapshot was committed is not applied again.
    ingest_batch(spark, raw(spark, {"title": "Again"}), root, str(stream.id), 1, sellers)
    assert read_snapshot(spark, root).events.count() == 2
