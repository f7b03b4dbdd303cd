"""Scans with declared schemas and versioned snapshots of the canonical tables."""

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import schemas
from marquee.session import utc
from marquee.sources.store import KEYS, PLACE, Changes, commit, committed_version, is_committed, manifest, placed_rows

__all__ = ["Tables", "commit", "committed_version", "is_committed"]


@dataclass(frozen=True)
class Tables:
    """The canonical tables at one point in time; favourites and fetched pages, where they are kept with them."""

    events: DataFrame
    event_sources: DataFrame
    sources: DataFrame
    favorites: DataFrame | None = None
    scraped_pages: DataFrame | None = None

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def held(self) -> dict[str, DataFrame]:
        """The tables that are there, by name."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


#: Rows of one task, about: narrow rows compress so well that a split of a file holds millions.
TASK_ROWS = 100_000


def spread(rows: DataFrame) -> DataFrame:
    """Use every core on an input of a few large files, in tasks of bounded rows; an input with enough splits stays as it is."""
    cores, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    wanted = max(cores, -(-rows.count() // TASK_ROWS))
    return rows.repartition(wanted) if splits < wanted else rows


def empty_tables(spark: SparkSession, sources: DataFrame | None = None) -> Tables:
    return Tables(
        spark.createDataFrame([], schemas.EVENTS),
        spark.createDataFrame([], schemas.EVENT_SOURCES),
        sources if sources is not None else spark.createDataFrame([], schemas.SOURCES),
    )


def read_listings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw listings from parquet, JSON lines, CSV or ORC."""
    reader = utc(spark).read.schema(schemas.RAW_LISTINGS)
    return spread((reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path))


def stream_listings(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Raw listings as they land in a folder."""
    return (
        utc(spark)
        .readStream.schema(schemas.RAW_LISTINGS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spread(utc(spark).read.schema(schemas.PAGES).parquet(path))


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """A crawl dump of one HTML file per page."""
    return (
        utc(spark)
        .read.text(path, wholetext=True)
        .select(F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html"))
    )


def write_snapshot(tables: Tables, root: str, version: int, run: str | None = None, batch: int | None = None) -> None:
    """Write all tables as a version that shares nothing with others.

    Events are laid out by month of their day and sorted by city and time, so feed
    filters prune. ``commit`` writes a version that differs little from another one.
    """
    spark = tables.events.sparkSession
    changes = {name: Changes(rows, rows.select(*KEYS[name]).limit(0)) for name, rows in tables.held().items()}
    commit(spark, root, version, changes, tables.events, None, run, batch)


def read_events(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The events of a version with their ``month``, by which the files are laid out; the feed prunes by it."""
    version = committed_version(utc(spark), root) if version is None else version
    return None if version is None else placed_rows(spark, root, "events", manifest(spark, root, version)).drop("bucket")


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Tables | None:
    """Tables of a version, the latest marked one by default."""
    version = committed_version(utc(spark), root) if version is None else version
    if version is None:
        return None
    entries = manifest(spark, root, version)
    return Tables(**{f.name: placed_rows(spark, root, f.name, entries).drop(*PLACE) for f in fields(Tables)})
