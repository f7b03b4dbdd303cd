"""Crawled pages to raw listings: links, embedded JSON, tour stops, visible fields.

All of it is built-in expressions over one scan of the pages; only the repair of
broken embedded JSON is a Python function, and it is handed NULL for every page
whose JSON already parses.
"""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions import let
from marquee.functions.dates import local_datetime
from marquee.functions.markup import entity_decode, has_class, min_price_from_blocks, reference_decode, split_address, split_date_address, tag_text
from marquee.functions.urls import absolute_url, url_path
from marquee.operators.ranking import ranked
from marquee.session import cut

# --- fixed values: listing category to genre label, path of an event page ---
CATEGORY_LABELS = {
    "koncert": "Koncert",
    "sport": "Šport",
    "show": "Show",
    "divadlo": "Divadlo",
    "festival": "Festival",
    "pre-deti": "Pre deti",
    "ostatne": "Ostatné",
}
EVENT_PATH = "/sk/listky/"
PRICE_WORD = "Cena"

_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
_JSON_BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_EMBEDDED = "array<struct<name:string,startDate:string,image:string,location:struct<name:string,address:string>,_bad:string>>"


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of a page in order: ``page_id, position, href, url, text``."""
    found = F.regexp_extract_all("html", F.lit(_LINK), F.lit(0))
    return pages.select("page_id", F.col("url").alias("base"), F.posexplode(found).alias("position", "tag")).select(
        "page_id",
        "position",
        "base",
        "tag",
        reference_decode(F.regexp_extract("tag", _LINK, 1)).alias("href"),
    ).select(
        "page_id",
        "position",
        "href",
        absolute_url(F.col("href"), F.col("base")).alias("url"),
        entity_decode(tag_text(F.regexp_extract("tag", _LINK, 2))).alias("text"),
    )


def with_path_prefix(links: DataFrame, prefix: str = EVENT_PATH) -> DataFrame:
    """Links to pages below a path."""
    return links.filter(url_path(F.col("url")).startswith(prefix))


def listing_cards(pages: DataFrame, prefix: str = EVENT_PATH) -> DataFrame:
    """Event cards of category pages: ``category, position, title, href``."""
    boxes = F.split("html", "(?i)" + has_class("box-content"))
    button = "(?is)" + has_class("box-item-btn", "a") + "[^>]*>"
    cards = (
        pages.select("page_id", "category", F.col("url").alias("base"), F.posexplode(boxes).alias("box_at", "box"))
        .filter("box_at > 0")
        .withColumn("tag", F.explode(F.regexp_extract_all("box", F.lit(button), F.lit(0))))
        .withColumn("href", reference_decode(F.regexp_extract("tag", r"""(?i)\shref=["']([^"']+)["']""", 1)))
        .filter("href <> ''")
        .withColumn("url", absolute_url(F.col("href"), F.col("base")))
    )
    title = F.regexp_extract("box", "(?is)" + has_class("box-item-title") + r"[^>]*>.*?<span[^>]*>(.*?)</span>", 1)
    return with_path_prefix(cards, prefix).select(
        "page_id", "category", F.col("box_at").alias("position"), entity_decode(tag_text(title)).alias("title"), F.col("url").alias("href")
    )


# --- embedded JSON -----------------------------------------------------------
def json_repairer():
    """Function that escapes raw control characters and stray quotes inside strings.

    A quote ends a string only when structure, or nothing, follows it. Everything it
    needs is inside, so workers do not have to have this package installed.
    """
    token = re.compile(r'\\.|["\n\r\t]|[^"\\\n\r\t]+|\\', re.S)
    after_string = re.compile(r"\s*(?:[,}\]:]|\Z)")
    control = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def escape(text: str) -> str:
        out, inside = [], False
        for found in token.finditer(text):
            piece = found.group()
            if piece == '"':
                ends = not inside or after_string.match(text, found.end())
                out.append('"' if ends else '\\"')
                inside = inside != bool(ends)
            else:
                out.append(control.get(piece, piece) if inside else piece)
        return "".join(out)

    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(escape, na_action="ignore")

    return F.pandas_udf(repair, T.StringType())


def _parsed(text: Column) -> Column:
    """First object of a JSON text, NULL when the text is broken."""
    options = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    first = F.get(F.from_json(text, _EMBEDDED, options), 0)
    fields = ["name", "startDate", "image", "location"]
    return let(first, lambda e: F.when(e["_bad"].isNull() & e.isNotNull(), F.struct(*[e[f].alias(f) for f in fields])))


def jsonld_extract(pages: DataFrame, raw: str = "embedded_text") -> DataFrame:
    """Add the first embedded JSON block as text and parsed (``embedded``, NULL if broken)."""
    block = F.regexp_extract("html", _JSON_BLOCK, 1)
    return pages.withColumn(raw, F.nullif(F.trim(block), F.lit(""))).withColumn("embedded", _parsed(F.col(raw)))


def jsonld_repair(extracted: DataFrame, raw: str = "embedded_text") -> DataFrame:
    """Parse broken blocks again after repair; parsed ones are left alone."""
    broken = F.col("embedded").isNull() & F.col(raw).isNotNull()
    again = extracted.withColumn("repaired", json_repairer()(F.when(broken, F.col(raw))))
    return again.withColumn("embedded", F.coalesce("embedded", _parsed(F.col("repaired")))).drop("repaired")


# --- detail pages --------------------------------------------------------------
def _tour_stops(html: Column, base: Column, prefix: str) -> Column:
    item = (
        "(?is)"
        + has_class("list-group-item", "li")
        + r"""[^>]*>\s*<a[^>]*href=["']("""
        + re.escape(prefix)
        + r"""[^"']*)["'][^>]*>(.*?)</a>"""
    )

    def stop(tag: Column) -> Column:
        body = F.regexp_extract(tag, item, 2)
        span = tag_text(F.regexp_extract(body, "(?is)" + has_class("text-readable", "span") + r"[^>]*>(.*?)</span>", 1))
        read = F.struct(
            entity_decode(tag_text(F.regexp_extract(body, r"(?is)<strong[^>]*>(.*?)</strong>", 1))).alias("title"),
            span.alias("text"),
            split_date_address(span).alias("dated"),
        )
        return let(
            read,
            lambda r: F.struct(
                r["title"].alias("title"),
                r["text"].alias("text"),
                r["dated"]["starts_at"].alias("starts_at"),
                split_address(r["dated"]["address"]).alias("place"),
                absolute_url(reference_decode(F.regexp_extract(tag, item, 1)), base).alias("href"),
            ),
        )

    stops = F.transform(F.regexp_extract_all(html, F.lit(item), F.lit(0)), stop)
    # Most pages have no stops; NULL spares them the patterns.
    return F.when(html.contains("list-group-item"), F.filter(stops, lambda s: (s["title"] != "") & (s["text"] != "")))


def min_price_tiers(html: Column) -> Column:
    """Lowest price among the blocks labelled as price."""
    label = has_class("color-blue", "small") + r"""[^>]*>\s*""" + PRICE_WORD + r"""\s*</small>"""
    block = r"(?is)<(\w+)[^>]*>\s*" + label + r"(.*?)</\1>"
    # A price has digits, a comma and a word; nothing of that is ever written as a reference.
    blocks = F.transform(F.regexp_extract_all(html, F.lit(block), F.lit(2)), lambda b: F.regexp_replace(b, r"<[^>]*>", ""))
    return F.when(html.contains("color-blue"), min_price_from_blocks(blocks))


def _image_tag(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<meta[^>]*property=["']og:image["'][^>]*>""", 0)
    return F.nullif(reference_decode(F.regexp_extract(tag, r"""(?is)\bcontent=["']([^"']*)["']""", 1)), F.lit(""))


def page_details(pages: DataFrame, prefix: str = EVENT_PATH) -> DataFrame:
    """One row per page: ``kind`` is single, tour or NULL, with what was read from it."""
    html = F.col("html")
    visible = tag_text(F.regexp_extract(html, "(?is)" + has_class("mb-4", "p") + r"[^>]*>(.*?)</p>", 1))
    read = jsonld_extract(pages).withColumns(
        {
            "stops": _tour_stops(html, F.col("url"), prefix),
            "heading": entity_decode(tag_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))),
            "visible": split_date_address(visible, r"\s*"),
            "price": min_price_tiers(html),
            "shown_image": _image_tag(html),
        }
    )
    fields = jsonld_repair(read.drop("html"))
    start = F.col("embedded.startDate")
    dom = (F.col("heading") != "") & (F.col("visible.address") != "")
    kind = F.when(F.coalesce(start, F.lit("")) != "", "embedded").when(F.size("stops") > 0, "tour").when(dom, "visible")
    named = fields.withColumn("shape", kind).withColumns(
        {
            "title": F.when(F.col("shape") == "embedded", entity_decode(F.col("embedded.name"))).otherwise(F.col("heading")),
            "starts_at": F.when(F.col("shape") == "embedded", local_datetime(start)).otherwise(F.col("visible.starts_at")),
            "place": F.when(
                F.col("shape") == "embedded",
                F.struct(
                    split_address(entity_decode(F.col("embedded.location.name")))["venue"].alias("venue"),
                    entity_decode(F.col("embedded.location.address")).alias("city"),
                ),
            ).otherwise(split_address(F.col("visible.address"))),
            "image_url": F.when(F.col("shape") == "embedded", F.nullif(F.col("embedded.image"), F.lit(""))).otherwise(
                F.coalesce(F.nullif(F.col("embedded.image"), F.lit("")), F.col("shown_image"))
            ),
        }
    )
    undated = F.when(F.col("shape") == "tour", F.exists("stops", lambda s: s["starts_at"].isNull())).otherwise(F.col("starts_at").isNull())
    return named.withColumn(
        "reason",
        F.when(F.col("shape").isNull(), "unrecognized event page shape").when(undated, "invalid date"),
    ).withColumn("kind", F.when(F.col("shape") == "tour", "tour").when(F.col("shape").isNotNull(), "single"))


def listed(details: DataFrame) -> DataFrame:
    """One row per listing of the readable pages: a single date, or each stop of a tour."""
    url, price = F.col("url"), F.col("price")
    # A stop has its own address and no price; the image is the tour's.
    stops = F.transform(
        "stops",
        lambda s: F.struct(
            s["href"].alias("href"),
            s["title"].alias("title"),
            s["starts_at"].alias("starts_at"),
            s["place"].alias("place"),
            F.lit(None).cast("double").alias("price"),
        ),
    )
    alone = F.array(F.struct(url.alias("href"), "title", "starts_at", "place", price.alias("price")))
    # An unreadable page has no entries, so no separate filter evaluates the page again.
    entries = F.when(F.col("reason").isNotNull(), None).when(F.col("kind") == "tour", stops).otherwise(alone)
    kept = [c for c in ("page_id", "category", "kind", "image_url") if c in details.columns]
    return details.select(*kept, F.posexplode(entries).alias("stop", "at")).select(*kept, "stop", "at.*")


def tour_explode(details: DataFrame) -> DataFrame:
    """The stops of the tour pages."""
    return listed(details).filter("kind = 'tour'")


def page_rejects(details: DataFrame) -> DataFrame:
    """Pages nothing could be read from; the others go on."""
    return details.filter("reason IS NOT NULL").select("page_id", "url", "reason")


def pages_to_listings(pages: DataFrame, source: str, country: str, currency: str, prefix: str = EVENT_PATH) -> DataFrame:
    """Raw listings of detail pages with ``page_id, category, url, html``."""
    return details_to_listings(page_details(pages, prefix), source, country, currency)


def details_to_listings(details: DataFrame, source: str, country: str, currency: str) -> DataFrame:
    """Raw listings of pages that were read by ``page_details``.

    ``seq`` counts the listings from 0, in page order, then stop order inside a tour,
    so page ids may be any numbers.
    """
    # Written first, as dealing rows out by range reads them twice.
    rows = ranked(cut(listed(details)), [], ["page_id", "stop"])
    label = F.coalesce(*[F.when(F.col("category") == slug, name) for slug, name in CATEGORY_LABELS.items()])
    return rows.select(
        (F.col("position") - 1).alias("seq"),
        F.lit(source).alias("source"),
        F.col("href").alias("source_url"),
        "title",
        F.col("place.venue").alias("venue"),
        F.col("place.city").alias("city"),
        F.lit(country).alias("country"),
        "starts_at",
        F.lit(None).cast("timestamp").alias("ends_at"),
        F.col("price").alias("price_from"),
        F.lit(currency).alias("currency"),
        label.alias("raw_genre"),
        "image_url",
    )
