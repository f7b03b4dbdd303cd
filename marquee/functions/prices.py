"""Prices: validation, cross-currency limit and label class."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.config import CURRENCY_BY_COUNTRY, CZK_PER_EUR


def usable_price(price: Column) -> Column:
    """Finite and not negative; zero means free."""
    return price.isNotNull() & ~F.isnan(price) & (price >= 0) & (price < float("inf"))


def rounded_price(price: Column) -> Column:
    """Half-up on the binary value times 100, as a double."""
    return F.when(usable_price(price), F.floor(price * 100 + 0.5) / 100)


def price_sanitize(price: Column) -> Column:
    """Stored price; NULL when unusable or beyond ten digits."""
    return F.when(rounded_price(price) < 1e8, rounded_price(price)).try_cast("decimal(10,2)")


def price_overflow(price: Column) -> Column:
    return F.coalesce(rounded_price(price) >= 1e8, F.lit(False))


def currency_of(country: Column) -> Column:
    return F.coalesce(*[F.when(country == c, F.lit(money)) for c, money in CURRENCY_BY_COUNTRY.items()])


def within_max_price(price: Column, currency: Column, limit: Column) -> Column:
    """Unknown prices pass; the limit is in EUR and scaled for CZK."""
    return price.isNull() | ((currency == "EUR") & (price <= limit)) | ((currency == "CZK") & (price <= limit * CZK_PER_EUR))


def price_label_kind(price: Column) -> Column:
    return F.when(price.isNull(), "tba").when(price == 0, "free").otherwise("from")
