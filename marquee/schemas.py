"""Declared schemas of the canonical tables; nothing is inferred."""

from pyspark.sql import types as T

_S, _TS, _L = T.StringType(), T.TimestampType(), T.LongType()
PRICE = T.DecimalType(10, 2)


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


RAW_LISTINGS = _struct(
    ("seq", _L, False),
    ("source", _S, False),
    ("source_url", _S, False),
    ("title", _S, False),
    ("venue", _S, False),
    ("city", _S, False),
    ("country", _S, True),
    ("starts_at", _TS, True),
    ("ends_at", _TS, True),
    ("price_from", T.DoubleType(), True),
    ("currency", _S, True),
    ("raw_genre", _S, True),
    ("image_url", _S, True),
)

EVENTS = _struct(
    ("id", _S, False),
    ("title", _S, False),
    ("venue", _S, False),
    ("city", _S, False),
    ("country", _S, False),
    ("starts_at", _TS, False),
    ("ends_at", _TS, True),
    ("price_from", PRICE, True),
    ("currency", _S, False),
    ("start_day", T.DateType(), False),
    ("price_known", T.BooleanType(), False),
    ("genre", _S, False),
    ("image_url", _S, True),
    ("fingerprint", _S, False),
    ("created_at", _TS, False),
    ("updated_at", _TS, False),
)

EVENT_SOURCES = _struct(
    ("id", _S, False),
    ("event_id", _S, False),
    ("source_id", _S, False),
    ("url", _S, False),
    ("price_from", PRICE, True),
    ("currency", _S, False),
    ("last_seen_at", _TS, False),
    ("last_detail_fetched_at", _TS, True),
)

SOURCES = _struct(
    ("id", _S, False),
    ("slug", _S, False),
    ("name", _S, False),
    ("base_url", _S, False),
    ("last_scraped_at", _TS, True),
)

SCRAPED_PAGES = _struct(("url", _S, False), ("last_fetched_at", _TS, True))
FAVORITES = _struct(("user_id", _S, False), ("event_id", _S, False), ("created_at", _TS, False))
USERS = _struct(("id", _S, False), ("email", _S, False), ("digest_opt_out", T.BooleanType(), False))
PAGES = _struct(("page_id", _L, False), ("url", _S, False), ("html", _S, True))
