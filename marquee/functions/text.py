"""Title and venue normalisation, number guard and title distance."""

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.config import FUZZY_DIVISOR

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_LEADS = "".join(map(chr, range(0x1100, 0x1113)))
_VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
_HANGUL = f"[{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}]"
_TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))


@lru_cache(maxsize=1)
def _compatibility_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose mark-free NFKD form differs, split by the form's length."""
    one_from, one_to, many = [], [], {}
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        char = chr(code)
        form = unicodedata.normalize("NFKD", char)
        if form == char:
            continue
        bare = "".join(c for c in form if not unicodedata.category(c).startswith("M"))
        if len(bare) == 1:
            one_from.append(char)
            one_to.append(bare)
        elif len(bare) > 1 and any(unicodedata.category(c)[0] in "LN" for c in bare):
            many[char] = bare
    return "".join(one_from), "".join(one_to), many


def _expand(text: Column) -> Column:
    """Spell out ligatures, squared letters and Hangul syllables character by character."""
    many = _compatibility_tables()[2]
    table = F.str_to_map(F.lit("\u0002".join(f"{c}\u0001{form}" for c, form in many.items())), F.lit("\u0002"), F.lit("\u0001"))

    def spell(char: Column) -> Column:
        offset = F.ascii(char) - _HANGUL_FIRST
        tail = offset % 28
        jamo = F.concat(
            F.substring(F.lit(_LEADS), F.floor(offset / 588).cast("int") + 1, F.lit(1)),
            F.substring(F.lit(_VOWELS), F.floor((offset % 588) / 28).cast("int") + 1, F.lit(1)),
            F.when(tail > 0, F.substring(F.lit(_TAILS), tail, F.lit(1))).otherwise(""),
        )
        return F.when(char.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST)), jamo).otherwise(
            F.coalesce(F.try_element_at(table, char), char)
        )

    return F.array_join(F.transform(F.split(text, ""), spell), "")


def normalize_text(text: Column) -> Column:
    """Lower-case, without diacritics and punctuation, single spaces; any script."""
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), _fold(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", " "))


def _fold(text: Column) -> Column:
    """Compatibility form without combining marks."""
    one_from, one_to, many = _compatibility_tables()
    expands = (F.translate(text, "".join(many), "") != text) | text.rlike(_HANGUL)
    spelled = F.when(expands, _expand(text)).otherwise(text)
    return F.regexp_replace(F.translate(spelled, one_from, one_to), r"\p{M}+", "")


def collapse_space(text: Column) -> Column:
    """Any run of Unicode white space becomes one blank."""
    return F.trim(F.regexp_replace(text, "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+", " "))


def numbers_in(normalized: Column) -> Column:
    """Digit runs of a normalised title, comma-joined."""
    return F.array_join(F.regexp_extract_all(normalized, F.lit(r"[0-9]+"), F.lit(0)), ",")


def numbers_conflict(left: Column, right: Column) -> Column:
    """Both normalised titles carry numbers and the numbers differ."""
    a, b = numbers_in(left), numbers_in(right)
    return (a != "") & (b != "") & (a != b)


def longest(left: Column, right: Column) -> Column:
    return F.greatest(F.length(left), F.length(right))


def title_distance(left: Column, right: Column) -> Column:
    """Edit distance over the longer length; two empty titles are fully distinct."""
    size = longest(left, right)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.levenshtein(left, right) / size)


def allowed_edits(size: Column) -> Column:
    """Largest edit distance that is still below the threshold for this length."""
    return F.when(size > 0, F.floor((size - 1) / FUZZY_DIVISOR)).otherwise(-1).cast("int")
