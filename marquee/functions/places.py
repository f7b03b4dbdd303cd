"""City names and the country they belong to."""

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import let
from marquee.functions.text import normalize_text

# --- fixed values: canonical city, country, other spellings ---------------
CITIES = [
    ("Bratislava", "SK", ["ba", "pressburg"]),
    ("Košice", "SK", ["ke"]),
    ("Prešov", "SK", []),
    ("Žilina", "SK", []),
    ("Banská Bystrica", "SK", ["bb"]),
    ("Nitra", "SK", []),
    ("Trnava", "SK", []),
    ("Trenčín", "SK", []),
    ("Praha", "CZ", ["prague", "prag"]),
    ("Brno", "CZ", []),
    ("Ostrava", "CZ", []),
    ("Plzeň", "CZ", ["pilsen"]),
    ("Olomouc", "CZ", []),
    ("Liberec", "CZ", []),
    ("České Budějovice", "CZ", []),
    ("Hradec Králové", "CZ", []),
    ("Pardubice", "CZ", []),
]
# Shorter spellings ("ba") match the whole text only.
MIN_PREFIX = 4


def _key(name: str) -> str:
    bare = unicodedata.normalize("NFKD", name)
    return "".join(c for c in bare if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=1)
def aliases() -> dict[str, str]:
    return {_key(spelling): name for name, _, more in CITIES for spelling in [name, *more]}


def _by_value(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(key == spelling, F.lit(value)) for spelling, value in table.items()])


def normalize_city(raw: Column) -> Column:
    """Canonical name, else the text in title case, else the empty string."""
    return let(normalize_text(raw), lambda key: city_from_key(raw, key))


def city_from_key(raw: Column, key: Column) -> Column:
    """``normalize_city`` where the normalised text is already a column."""
    exact = _by_value(key, aliases())
    prefixed = F.coalesce(*[F.when(key.startswith(a + " "), F.lit(n)) for a, n in aliases().items() if len(a) >= MIN_PREFIX])
    titled = F.array_join(
        F.transform(
            F.split(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")), " "),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))),
        ),
        " ",
    )
    return F.when(key == "", "").otherwise(F.coalesce(exact, prefixed, titled))


def country_for_city(city: Column) -> Column:
    """Country of a canonical city, NULL for any other."""
    return _by_value(city, {name: country for name, country, _ in CITIES})
