"""Adapters from the provided star-schema tables to the listing data model.

They only shape columns; every row of the given table takes part. The same
expressions are written a second time, in SQL, for the comparison queries.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.dates import to_ms
from marquee.session import utc
from marquee.sources.tables import spread

NOW = "2024-01-15 12:00:00"
CITY_TEXTS = [
    "BA",
    "bratislava",
    "Prague",
    "Praha 7",
    "Brno-střed",
    "Kosice",
    "Pilsen",
    "ostrava",
    "nové mesto nad váhom",
    "Poprad",
    "Nowhereville",
    "",
]
GENRE_TEXTS = {"click": "Koncert", "view": "Výstavy", "purchase": "Divadlo", "error": "DJ set"}


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(utc(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def listings_from_events(events: DataFrame) -> DataFrame:
    """Raw listings: one per event row, one in a hundred re-lists an earlier URL."""
    number = F.col("event_id")
    listed = F.when(number % 100 == 50, number - 50).otherwise(number)
    word = F.when(number % 11 == 0, " Nights ").otherwise(" Night ")
    title = F.concat(
        F.when(number % 5 == 0, "Nočný ").otherwise(""), F.col("event_type"), word, (F.col("user_id") % 10).cast("string")
    )
    title = F.when(number % 223 == 222, "!!!").when(number % 4 == 1, F.upper(title)).otherwise(title)
    url = F.concat(
        F.lit("HTTPS://Tickets"),
        (listed % 3).cast("string"),
        F.lit(".Example.com/e/"),
        listed.cast("string"),
        F.lit("/?utm_source=x&b=2&a=1#t"),
    )
    starts = to_ms(F.col("ts").cast("timestamp"))
    return events.select(
        number.alias("seq"),
        F.concat(F.lit("src"), (listed % 28).cast("string")).alias("source"),
        F.when(number % 227 == 226, "not a url").otherwise(url).alias("source_url"),
        title.alias("title"),
        F.concat(F.lit("Hall "), (F.col("user_id") % 20).cast("string")).alias("venue"),
        F.element_at(F.array(*map(F.lit, CITY_TEXTS)), (F.col("user_id") % 12 + 1).cast("int")).alias("city"),
        F.when((F.col("user_id") % 12).isin(8, 9), "SK").alias("country"),
        F.when(number % 211 != 210, starts).alias("starts_at"),
        F.when(F.col("event_type") == "view", starts + F.expr("INTERVAL '72' HOUR")).alias("ends_at"),
        F.when(number % 229 == 228, 123456789.0)
        .when(number % 233 == 232, -5.0)
        .when(F.col("event_type") != "error", F.col("value"))
        .alias("price_from"),
        F.when(number % 7 == 0, "EUR").alias("currency"),
        F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in GENRE_TEXTS.items()]).alias("raw_genre"),
        F.when(number % 3 == 0, F.concat(F.lit("https://img/"), number.cast("string")))
        .when(number % 3 == 1, "data:x")
        .alias("image_url"),
    )


def sources_from_nation(nation: DataFrame) -> DataFrame:
    """Seller registry: 25 sellers, so listings of src25..src27 are unknown."""
    key = F.col("n_nationkey").cast("string")
    return nation.select(
        F.concat(F.lit("s"), key).alias("id"),
        F.concat(F.lit("src"), key).alias("slug"),
        F.concat(F.lit("Seller "), F.col("n_name")).alias("name"),
        F.concat(F.lit("https://seller"), key, F.lit(".example.com")).alias("base_url"),
        F.lit(None).cast("timestamp").alias("last_scraped_at"),
    )


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings_from_events(table(spark, sf_dir, "events"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources_from_nation(table(spark, sf_dir, "nation"))


# --- pages rendered from event rows ------------------------------------------------
CATEGORIES = ["koncert", "sport", "show", "divadlo", "festival", "pre-deti", "ostatne"]
SITE = "https://tickets.example.com"


def detail_pages_from_events(events: DataFrame) -> DataFrame:
    """One event page per row, in the six shapes a crawl meets (by ``event_id % 6``)."""
    number, shape = F.col("event_id").cast("string"), F.col("event_id") % 6
    name = F.concat("event_type", F.lit(" &amp; Night "), (F.col("user_id") % 10).cast("string"))
    hall = F.concat(F.lit("Hall "), (F.col("user_id") % 20).cast("string"))
    # The same, as pages write it: references to references, and spaces that do not break.
    twice, spaced = F.replace(name, F.lit("&amp;"), F.lit("&amp;amp;")), F.replace(hall, F.lit(" "), F.lit("&nbsp;"))
    long = F.replace(name, F.lit("&amp;"), F.lit("&#" + "38".zfill(40) + ";"))
    iso, local = F.date_format("ts", "yyyy-MM-dd HH:mm"), F.date_format("ts", "dd.MM.yyyy HH:mm")
    euros = F.floor(F.abs("value"))

    def embedded(start: Column, description: str) -> Column:
        return F.concat(
            F.lit('{"name":"'), name, F.lit('","startDate":"'), start, F.lit('","location":{"name":"'), hall,
            F.lit(', Main 1","address":"Ko&#353;ice"},"image":"https://img/'), number, F.lit(f'","description":"{description}"}}'),
        )

    def script(body: Column) -> Column:
        return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))

    def stop(at: int) -> Column:
        return F.concat(
            F.lit(f'<li class="wide list-group-item"><a href="/sk/listky/'), number, F.lit(f'-{at}?x=1&amp;y=2"><strong>'), twice,
            F.lit(f' {at}</strong><span class="text-readable-xs">!</span><span class="text-readable">'), local, F.lit(" - "), spaced,
            F.lit(", Main 2, 080 01  Prešov</span></a></li>"),
        )

    tiers = F.concat(
        *[
            F.concat(F.lit('<div><small class="color-blue">Cena</small> '), (euros + extra).cast("string"), F.lit(",50 EUR</div>"))
            for extra in (7, 0)
        ]
    )
    body = (
        F.when(shape == 0, F.concat(script(embedded(iso, "two\nlines")), tiers))
        .when(shape == 1, script(embedded(iso, 'a "quoted" phrase')))
        .when(shape == 2, F.concat(script(embedded(F.lit(""), "tour")), F.lit("<ul>"), stop(1), stop(2), F.lit("</ul>")))
        .when(shape == 3, F.concat(F.lit("<h1>"), long, F.lit('</h1><p class="mb-4-lg">\u0000 &#1;</p><p class="lead mb-4">'), local, F.lit(" "), spaced, F.lit(", 811 01 Bratislava</p>"), tiers))
        .when(shape == 4, F.lit("<p>Nothing here</p>"))
        .otherwise(script(F.concat(F.lit("["), embedded(iso, "list"), F.lit("]"))))
    )
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("event_id") % 7 + 1).cast("int"))
    head = F.concat(F.lit('<html><head><meta property="og:image" content="https://og/'), number, F.lit('?a=1&amp;b=2"></head><body>'))
    return events.select(
        F.col("event_id").alias("page_id"),
        F.concat(F.lit(f"{SITE}/sk/listky/"), number, F.lit("/")).alias("url"),
        category.alias("category"),
        F.concat(head, body, F.lit("</body></html>")).alias("html"),
    )


def category_pages_from_events(events: DataFrame) -> DataFrame:
    """One category page per row with an event card and a promotion."""
    number = F.col("event_id").cast("string")

    def box(href: Column, title: Column) -> Column:
        return F.concat(
            F.lit('<div class="box-content-old"></div><section class="wide box-content"><div class="box-item-title"><span> '), title,
            F.lit(' </span></div><a class="btn box-item-btn" href="'), href, F.lit('">Buy</a></section>'),
        )

    title = F.concat("event_type", F.lit(" &amp;amp; Night&nbsp;"))
    card, promotion = box(F.concat(F.lit("/sk/listky/"), number, F.lit("/")), title), box(F.lit("https://promo.example.org/x"), F.lit("Gift"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("event_id") % 7 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("page_id"),
        F.concat(F.lit(f"{SITE}/sk/kategoria/"), category, F.lit("/")).alias("url"),
        category.alias("category"),
        F.concat(F.lit("<html><body>"), promotion, card, F.lit("</body></html>")).alias("html"),
    )


def vendor_listings(listings: DataFrame, vendors: list[str]) -> DataFrame:
    """Every listing once per vendor; later vendors shout and charge five percent more each."""
    at = F.col("at")
    raised = F.floor(F.col("price_from") * (1 + at * 0.05) + 0.5).cast("double")
    return (
        listings.select("*", F.posexplode(F.array(*map(F.lit, vendors))).alias("at", "vendor"))
        .withColumn("source_url", F.concat(F.lit("https://"), "vendor", F.lit(".example.com/demo/"), F.col("seq").cast("string")))
        .withColumn("title", F.when(at > 0, F.upper("title")).otherwise(F.col("title")))
        .withColumn("price_from", raised)
        .withColumn("seq", F.col("seq") * len(vendors) + at)
        .drop("at", "vendor")
    )


# --- other tables --------------------------------------------------------------
def users_from_customer(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return customer.select(
        F.concat(F.lit("u"), key).alias("id"),
        F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
        (F.col("c_mktsegment") == "BUILDING").alias("digest_opt_out"),
    )


def favorites_from_orders(orders: DataFrame) -> DataFrame:
    """A customer likes the event whose founding listing has the order's number."""
    key = F.col("o_orderkey").cast("string")
    url = F.concat(
        F.lit("https://tickets"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".example.com/e/"), key, F.lit("?a=1&b=2")
    )
    return orders.select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.sha2(url, 256).alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def sellers_from_supplier(supplier: DataFrame) -> DataFrame:
    """Seller rows to upsert: some slugs are known already, the others new."""
    key = F.col("s_suppkey").cast("string")
    return supplier.select(
        F.concat(F.lit("p"), key).alias("id"),
        F.concat(F.lit("src"), key).alias("slug"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://shop"), key, F.lit(".example.com")).alias("base_url"),
        F.lit(None).cast("timestamp").alias("last_scraped_at"),
    )


def cards_from_pages(pages: DataFrame) -> DataFrame:
    """Listing cards: each page is linked from the category of its number."""
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("page_id") % 7 + 1).cast("int"))
    return pages.select(category.alias("category"), F.col("page_id").alias("position"), F.col("url").alias("href"))


def scraped_from_pages(pages: DataFrame, url: Column) -> DataFrame:
    """Known pages, fetched up to six days ago; some were never timed."""
    number = F.col("page_id")
    fetched = now() - F.make_interval(hours=(number % 144).cast("int"))
    known = pages.withColumn("url", url).filter(number % 4 != 3)
    return known.groupBy("url").agg(F.max(F.when(number % 9 != 0, fetched)).alias("last_fetched_at"))


PRICE_TEXTS = ["30", "12.5", "", "abc", "-5", "0x10", "1e2", "30 ", "0", "120"]
PAGE_TEXTS = ["0", "-3", "abc", "2.7", "999", "3", ""]
SEARCH_CITIES = ["Praha", "Brno", "Bratislava", "Poprad", "Plzeň"]
SEARCH_GENRES = ["concert", "theatre", "exhibition", "bogus", "other"]
SEARCH_WHENS = ["today", "weekend", "week", "month", "never"]


def requests_from_customer(customer: DataFrame) -> DataFrame:
    """Query strings of feed requests; one in three names no city, one in four no genre."""
    key = F.col("c_custkey")

    def pick(values: list[str], at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))

    cities = F.concat(F.lit("city=%20"), pick(SEARCH_CITIES, key), F.lit("+&city="), pick(SEARCH_CITIES, key + 2), F.lit("&city="), pick(SEARCH_CITIES, key))
    genres = F.concat(F.lit("&genre="), pick(SEARCH_GENRES, key), F.lit("&genre="), pick(SEARCH_GENRES, key + 1))
    query = F.concat(
        F.lit("?"),
        F.when(key % 3 != 0, cities).otherwise("x=1"),
        F.when(key % 4 != 0, genres).otherwise(""),
        F.lit("&when="), pick(SEARCH_WHENS, key), F.lit("&maxPrice="), pick(PRICE_TEXTS, key), F.lit("&page="), pick(PAGE_TEXTS, key),
    )
    return customer.select(key.alias("search_id"), query.alias("query"))
