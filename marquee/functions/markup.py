"""Text helpers for scraped pages: entities, addresses, price tiers, link parts."""

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import let
from marquee.functions.dates import local_datetime

# --- fixed values: the named entities that are decoded, "&amp;" first -----
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]


# A reference as a browser reads it: decimal, hexadecimal or by name.
_REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
_SPACES = " \t\n\r\f\u000b\u00a0"


def _code_unit(number: Column) -> Column:
    """Character of a 16-bit code, through its UTF-16 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(number % 65536), 4, "0")), "UTF-16BE")


def _woven(text: Column, pattern: str, char: Callable[[Column], Column]) -> Column:
    """Replace every match of the pattern by a function of its group; the text between stays as it is."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_join(F.zip_with(pieces, F.transform(found, char), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def _numeric(text: Column, pattern: str, value: Callable[[Column], Column]) -> Column:
    """Replace every numeric reference by the character of its 16-bit code."""
    return let(text, lambda known: F.when(known.contains("&#"), _woven(known, pattern, lambda d: _code_unit(value(d)))).otherwise(known))


def _low_bits(digits: Column) -> Column:
    """The lowest 16 bits of a decimal number of any length, read as floating point."""
    rest = digits.try_cast("double") % 65536
    return F.when(F.isnan(rest), 0).otherwise(rest.try_cast("long"))


def entity_decode(text: Column) -> Column:
    """Named references in order, then decimal, then hexadecimal ones."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = _numeric(text, "&#([0-9]+);", _low_bits)
    return _numeric(text, "&#x([0-9a-fA-F]+);", lambda digits: F.conv(F.right(digits, F.lit(4)), 16, 10).cast("long"))


def _code_point(digits: Column, base: int) -> Column:
    """Character of a code point; U+FFFD for what is none."""
    short = F.length(digits).between(1, 7)
    number = F.when(short, F.conv(F.when(short, digits).otherwise("0"), base, 10).cast("long")).otherwise(0)
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def reference_decode(html: Column) -> Column:
    """Character references of text or attributes, each decoded once, as a browser does."""
    names = F.create_map(*[F.lit(x) for name, point in sorted(name2codepoint.items()) for x in (name, chr(point))], F.lit("apos"), F.lit("'"))

    def char(reference: Column) -> Column:
        named = F.coalesce(F.try_element_at(names, reference), F.concat(F.lit("&"), reference, F.lit(";")))
        return (
            F.when(reference.rlike("^#[xX]"), _code_point(F.regexp_replace(reference, "^#[xX]0*", ""), 16))
            .when(reference.startswith("#"), _code_point(F.regexp_replace(reference, "^#0*", ""), 10))
            .otherwise(named)
        )

    return let(html, lambda text: F.when(text.contains("&"), _woven(text, _REFERENCE, char)).otherwise(text))


def has_class(token: str, tag: str = "[a-zA-Z][a-zA-Z0-9]*") -> str:
    """Pattern of an opening tag, up to its class attribute, that has the whole token among its classes."""
    return rf"""<{tag}(?=\s)[^>]*?\sclass\s*=\s*["'](?:[^"'>]*\s)?{re.escape(token)}(?:\s[^"'>]*)?["']"""


def strip_postal_code(city: Column) -> Column:
    return F.trim(F.regexp_replace(city, r"^\d{3}\s?\d{2}\s+", ""))


def split_address(address: Column) -> Column:
    """``struct<venue, city>``: the first and the last non-empty comma part."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")

    def ends(found: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("venue"),
            strip_postal_code(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))).alias("city"),
        )

    return let(parts, ends)


_DATED = r"(?s)^(\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2})"


def split_date_address(text: Column, separator: str = r"\s+-\s+") -> Column:
    """``struct<starts_at, address>`` of a text that leads with a date."""
    pattern = _DATED + separator + "(.+)$"
    return let(
        F.trim(text),
        lambda trimmed: F.struct(
            local_datetime(F.regexp_extract(trimmed, pattern, 1)).alias("starts_at"),
            F.trim(F.regexp_extract(trimmed, pattern, 2)).alias("address"),
        ),
    )


def min_price_from_blocks(blocks: Column) -> Column:
    """Lowest of the first ``N,NN`` price in each text block."""
    first = F.transform(blocks, lambda b: F.regexp_extract(b, r"(\d+,\d{2})", 1))
    return F.array_min(F.transform(F.filter(first, lambda p: p != ""), lambda p: F.replace(p, F.lit(","), F.lit(".")).cast("double")))


def tag_text(html: Column) -> Column:
    """Visible text of a markup fragment, references decoded."""
    return F.btrim(reference_decode(F.regexp_replace(html, r"<[^>]*>", "")), F.lit(_SPACES))


def url_hash(text: Column) -> Column:
    """Multiply-by-33 hash of the characters, modulo 2**32."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))
