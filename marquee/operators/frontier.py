"""Crawl planning: which listed pages to fetch, which only to touch."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.config import JITTER_WINDOW_MS, REFETCH_INTERVAL_MS
from marquee.functions.dates import epoch_ms
from marquee.functions.markup import url_hash
from marquee.functions.urls import canonical_url, url_path
from marquee.operators.ranking import ranked
from marquee.session import cut

#: Up to here Spark limits each task to so many rows of a group before it ranks them.
GROUP_LIMIT = 1_000


def refetch_jitter(canonical: Column) -> Column:
    """Milliseconds added to a URL's interval; always the same for the same URL."""
    return url_hash(canonical) % JITTER_WINDOW_MS


def robots_patterns(robots: DataFrame) -> DataFrame:
    """``host, pattern`` of every Disallow line of ``host, body``."""
    lines = robots.select("host", F.explode(F.split("body", "\n")).alias("line")).withColumn("line", F.trim("line"))
    lines = lines.filter(F.lower("line").startswith("disallow:"))
    return lines.select("host", F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("pattern")).filter("pattern <> ''")


def pattern_regex(pattern: Column) -> Column:
    """Anchored expression of a pattern: "*" is any text, "?" keeps its regex meaning."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"))


def rule_sets(patterns: DataFrame) -> DataFrame:
    """``host, lengths, rules``: the patterns of a host, compiled into one lookup.

    ``rules`` maps the text that a path has to begin with to one expression for all patterns
    that begin so; it is empty if that text alone forbids the path. ``lengths`` are those of the texts, so a
    path meets one expression for each of its forbidden beginnings, however many rules there are.
    """
    # A "?" makes the character before it optional, so the fixed text ends before that one.
    head = F.regexp_extract("pattern", r"^((?:[^*?](?![?]))*)", 1)
    regex = F.when(F.regexp_like("pattern", F.lit("[*?]")), pattern_regex(F.col("pattern"))).otherwise("")
    rows = patterns.select(F.lower("host").alias("host"), head.alias("head"), regex.alias("regex"))
    whole = F.when(F.min("regex") == "", "").otherwise(F.array_join(F.array_sort(F.collect_set("regex")), "|"))
    heads = rows.groupBy("host", "head").agg(whole.alias("regex"))
    return heads.groupBy("host").agg(
        F.array_sort(F.collect_set(F.length("head"))).alias("lengths"), F.map_from_entries(F.collect_list(F.struct("head", "regex"))).alias("rules")
    )


def disallow_anti_join(cards: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Cards whose path no pattern of their host forbids."""
    host = F.lower(F.regexp_extract(cards[url], r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    # Written first: a join on the partitioning of an aggregate is not split at a host with many cards.
    sets = cut(rule_sets(patterns))
    path = url_path(cards[url])
    hit = F.exists(sets["lengths"], lambda n: F.regexp_like(path, F.try_element_at(sets["rules"], F.substring(path, F.lit(1), n))))
    ruled = cards.join(sets, host == sets["host"], "left").filter(~F.coalesce(hit, F.lit(False)))
    return ruled.select(*[cards[f"`{c}`"] for c in cards.columns])


def refetch_plan(cards: DataFrame, scraped_pages: DataFrame, now: Column) -> DataFrame:
    """Add canonical ``url`` and ``decision``: new, due, fresh or invalid.

    A page known without a time is due, one never known is new. A link that is no
    valid URL has no canonical one and is never fetched.
    """
    known = scraped_pages.select("url", "last_fetched_at", F.lit(True).alias("known"))
    age = epoch_ms(now) - epoch_ms(F.col("last_fetched_at"))
    decision = (
        F.when(F.col("url").isNull(), "invalid")
        .when(F.col("known").isNull(), "new")
        .when(F.col("last_fetched_at").isNull(), "due")
        .when(age >= REFETCH_INTERVAL_MS + refetch_jitter(F.col("url")), "due")
        .otherwise("fresh")
    )
    canonical = cards.withColumn("url", canonical_url(F.col("href")))
    return canonical.join(known, "url", "left").withColumn("decision", decision).drop("known", "last_fetched_at")


def refetch_cap(plan: DataFrame, limit: int | None) -> DataFrame:
    """The pages to fetch: the first ``limit`` per category, fresh ones not counted."""
    wanted = plan.filter("decision IN ('new', 'due')")
    if limit is None:
        return wanted
    if limit > GROUP_LIMIT:
        # Positions are counted over slices of a category, so that none is in one task.
        placed = ranked(wanted, ["category"], ["position", "url"], "place")
    else:
        placed = wanted.withColumn("place", F.row_number().over(W.partitionBy("category").orderBy("position", "url")))
    return placed.filter(F.col("place") <= limit).select(*wanted.columns)


def touched(plan: DataFrame) -> DataFrame:
    """URLs that were listed but need no fetch."""
    return plan.filter("decision = 'fresh'").select("url")


def refetch_counts(plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """Run counters: category pages, new and due pages fetched, fresh ones skipped."""
    columns = ["category", "decision"]
    rows = plan.select(*columns, F.lit(False).alias("got")).unionByName(fetched.select(*columns, F.lit(True).alias("got")))

    def number(condition: Column) -> Column:
        return F.count(F.when(condition, F.lit(1)))

    return rows.agg(
        F.countDistinct(F.when(~F.col("got"), F.col("category"))).alias("listing_pages"),
        number(~F.col("got") & (F.col("decision") == "fresh")).alias("fresh_skips"),
        number(F.col("got") & (F.col("decision") == "new")).alias("new_pages"),
        number(F.col("got") & (F.col("decision") == "due")).alias("due_pages"),
    )
