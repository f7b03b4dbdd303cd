"""Boundary rows of the column functions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates, genres, markup, places, prices, text, urls
from marquee.operators import feed
from marquee.operators.frontier import refetch_jitter


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, function, expected, kind="string"):
    assert apply(spark, function, list(expected), kind) == list(expected.values())


def test_normalize_text(spark):
    check(
        spark,
        text.normalize_text,
        {
            "Košice": "kosice",
            "  Ľudia   Žijú ": "ludia ziju",
            "Nočný Jazz – LIVE!": "nocny jazz live",
            "AC/DC": "ac dc",
            "a​b": "a b",
            "🎉🎉": "",
            "ﬁne ½ Ⅷ": "fine 1 2 viii",
            "Straße Łódź": "straße łodz",
            "a b": "a b",
            "한": "한",
        },
    )


def test_canonical_url(spark):
    check(
        spark,
        urls.canonical_url,
        {
            "HTTPS://Tickets.net/en/event/123/?utm_source=x&b=2&a=1&fbclid=z#top": "https://tickets.net/en/event/123?a=1&b=2",
            "https://example.com/": "https://example.com/",
            "not a url": None,
            " https://example.com/Path/?ref=x ": "https://example.com/Path",
            "http://a.com:80/x/../y z/?a": "http://a.com/y%20z?a=",
            "https://a.com/?b=1&a=%20x&a=1+2&REF=1&refx=3": "https://a.com/?a=+x&a=1+2&b=1&refx=3",
            "https://a.com:8443/ž?q=100%": "https://a.com:8443/%C5%BE?q=100%25",
            "https://a.com:99999/": None,
            "mailto:x@y.z": None,
        },
    )


def test_refetch_jitter(spark):
    url, h = "https://tickets.example.com/sk/listky/known", 5381
    for char in url:
        h = (h * 33 + ord(char)) % 2**32
    check(spark, refetch_jitter, {url: h % 86_400_000})


def test_city_and_country(spark):
    expected = {
        "BA": "Bratislava",
        "bratislava": "Bratislava",
        "Prague": "Praha",
        "PRAHA": "Praha",
        "Praha 7": "Praha",
        "Kosice": "Košice",
        "Bratislava - Petržalka": "Bratislava",
        "Brno-střed": "Brno",
        "nové mesto nad váhom": "Nové Mesto Nad Váhom",
        "frýdek-místek": "Frýdek-místek",
        "bax": "Bax",
        "  ": "",
    }
    check(spark, places.normalize_city, expected)
    check(spark, places.country_for_city, {"Praha": "CZ", "Košice": "SK", "Poprad": None})


def test_genre(spark):
    check(
        spark,
        genres.normalize_genre,
        {
            "Koncerty": "concert",
            "Hudobné divadlo": "theatre",
            "Electronic music": "electronic",
            "Stand-up": "standup",
            "Výstavy": "exhibition",
            "Fotbal": "sport",
            "DJ set": "electronic",
            "Pop": "concert",
            "Popularna veda": "other",
            "": "other",
            None: "other",
        },
    )


@pytest.mark.parametrize(
    "a, b, distance",
    [("kitten", "sitting", 3 / 7), ("abcdefghij", "abcdefghix", 0.1), ("", "", 1.0), ("same", "same", 0.0)],
)
def test_title_distance(spark, a, b, distance):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.title_distance(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(distance)


def test_numbers_conflict(spark):
    rows = [("jazz night 1", "jazz night 2", True), ("jazz night", "jazz night 2", False), ("tour 2026", "tour 2026", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert got.filter(text.numbers_conflict(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_prague_days(spark):
    check(
        spark,
        dates.prague_day,
        {
            datetime(2026, 9, 30, 21, 59): date(2026, 9, 30),
            datetime(2026, 9, 30, 22, 30): date(2026, 10, 1),
            datetime(2026, 12, 31, 22, 30): date(2026, 12, 31),
            datetime(2026, 12, 31, 23, 30): date(2027, 1, 1),
        },
        "timestamp",
    )


RANGES = [
    ("today", datetime(2026, 9, 30, 10), datetime(2026, 9, 30, 10), datetime(2026, 9, 30, 21, 59, 59, 999000)),
    ("today", datetime(2026, 9, 30, 22, 30), datetime(2026, 9, 30, 22, 30), datetime(2026, 10, 1, 21, 59, 59, 999000)),
    ("weekend", datetime(2026, 9, 30, 10), datetime(2026, 10, 2, 16), datetime(2026, 10, 4, 21, 59, 59, 999000)),
    ("weekend", datetime(2026, 10, 3, 10), datetime(2026, 10, 3, 10), datetime(2026, 10, 4, 21, 59, 59, 999000)),
    ("weekend", datetime(2026, 10, 4, 10), datetime(2026, 10, 4, 10), datetime(2026, 10, 4, 21, 59, 59, 999000)),
    ("weekend", datetime(2026, 10, 5, 10), datetime(2026, 10, 9, 16), datetime(2026, 10, 11, 21, 59, 59, 999000)),
    ("weekend", datetime(2026, 10, 21, 10), datetime(2026, 10, 23, 16), datetime(2026, 10, 25, 22, 59, 59, 999000)),
    ("week", datetime(2026, 10, 21, 10), datetime(2026, 10, 21, 10), datetime(2026, 10, 28, 10)),
    ("month", datetime(2026, 10, 21, 10), datetime(2026, 10, 21, 10), datetime(2026, 11, 20, 10)),
    (None, datetime(2026, 10, 21, 10), datetime(2026, 10, 21, 10), None),
]


def test_ranges(spark):
    rows = spark.createDataFrame(RANGES, "choice string, now timestamp, start timestamp, end timestamp")
    span = dates.resolve_range(F.col("choice"), F.col("now"))
    got = [(r.choice, r.now, r.s, r.e) for r in rows.select("choice", "now", span["start"].alias("s"), span["end"].alias("e")).collect()]
    assert got == RANGES
    for choice, now, start, end in RANGES:
        lo, hi = dates.range_of(choice, now)
        assert (lo.replace(tzinfo=None), hi and hi.replace(tzinfo=None)) == (start, end)


def test_local_datetime(spark):
    check(
        spark,
        dates.local_datetime,
        {
            "05.12.2026 17:00": datetime(2026, 12, 5, 16),
            "2026-07-01 08:30": datetime(2026, 7, 1, 6, 30),
            "31.02.2026 10:00": None,
            "tomorrow": None,
        },
    )


def test_prices(spark):
    cents = {0.0: 0.0, 12.5: 12.5, -5.0: None, float("inf"): None, 10.005: 10.01, 123456789.0: None}
    assert [None if p is None else float(p) for p in apply(spark, prices.price_sanitize, list(cents), "double")] == list(cents.values())
    assert apply(spark, prices.price_sanitize, [float("nan"), None], "double") == [None, None]
    check(spark, prices.price_label_kind, {None: "tba", 0.0: "free", 12.0: "from"}, "double")
    rows = [("EUR", 30.0, True), ("EUR", 30.01, False), ("CZK", 750.0, True), ("CZK", 750.5, False), ("CZK", None, True)]
    got = spark.createDataFrame(rows, "c string, p double, want boolean")
    assert got.filter(prices.within_max_price(F.col("p"), F.col("c"), F.lit(30)) != F.col("want")).count() == 0


def test_markup(spark):
    check(
        spark,
        markup.entity_decode,
        {
            "a &amp;lt; b": "a < b",
            "&quot;x&#39; &apos;": "\"x' '",
            "Ko&#353;ice &#x160;": "Košice Š",
            "plain & simple": "plain & simple",
            "&#38;#65;": "&#65;",
        },
    )
    places_of = apply(spark, markup.split_address, ["Hall, Main 1, 080 01  Prešov", "One", " , ,", "A,,811 01 Bratislava"])
    assert [tuple(p) for p in places_of] == [("Hall", "Prešov"), ("One", "One"), ("", ""), ("A", "Bratislava")]
    check(spark, markup.min_price_from_blocks, {}, "array<string>")
    assert apply(spark, markup.min_price_from_blocks, [["Cena 19,90 EUR", "od 7,50"], ["none"], []], "array<string>") == [7.5, None, None]
    dated = apply(spark, markup.split_date_address, ["05.12.2026 17:00 - Hall, Street - 2, City", "no date"])
    assert (dated[0].starts_at, dated[0].address) == (datetime(2026, 12, 5, 16), "Hall, Street - 2, City")
    assert dated[1].starts_at is None


REQUESTS = {
    "city=+Praha+&city=Brno&city=Praha&genre=concert&genre=bogus&when=week&maxPrice=30&page=2.7": (["Praha", "Brno"], ["concert"], "week", 30.0, 2),
    "?maxPrice=0&page=0": ([], [], None, 0.0, 1),
    "maxPrice=12.5&page=-3": ([], [], None, 12.5, 1),
    "maxPrice=&page=abc": ([], [], None, None, 1),
    "maxPrice=abc&page=999": ([], [], None, None, 50),
    "maxPrice=-5": ([], [], None, None, 1),
    "maxPrice=Infinity&page=Infinity": ([], [], None, None, 1),
    "maxPrice=0x10": ([], [], None, None, 1),
    "maxPrice=1e2&page=1e1": ([], [], None, None, 10),
    "maxPrice=30%20": ([], [], None, None, 1),
    "maxPrice=%2B30&when=never": ([], [], None, None, 1),
    "maxPrice=1" + "0" * 306: ([], [], None, 1e306, 1),
    "maxPrice=9" + "0" * 307: ([], [], None, None, 1),
    "&".join(f"city=c{i}" for i in range(25)): ([f"c{i}" for i in range(20)], [], None, None, 1),
}


def test_request_parsing(spark):
    rows = spark.createDataFrame([(q,) for q in REQUESTS], "query string")
    got = {r.query: (r.cities, r.genres, r.when, r.max_price, r.page) for r in feed.parse_filter_rows(rows).collect()}
    assert got == REQUESTS
    from urllib.parse import parse_qs

    for query, want in REQUESTS.items():
        f = feed.parse_filters(parse_qs(query.lstrip("?"), keep_blank_values=True))
        assert (list(f.cities), list(f.genres), f.when, f.max_price, f.page) == want
