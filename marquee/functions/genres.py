"""Genre from a free-text category label."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import let
from marquee.functions.text import normalize_text

# --- fixed values: ordered rules, the first genre with a hit wins ---------
# A keyword matches at a word start; "=" asks for the whole word.
GENRE_RULES = [
    ("theatre", ["divadl", "theatre", "theater", "muzikal", "musical", "opera", "balet", "ballet", "cinohra", "tanec", "loutk"]),
    ("standup", ["stand up", "standup", "komedi", "comedy"]),
    ("exhibition", ["vystav", "exhibition", "galeri", "muzeum", "museum", "expozic"]),
    (
        "sport",
        ["sport", "futbal", "fotbal", "football", "hokej", "hockey", "basket", "tenis", "tennis", "zapas", "maraton", "marathon"],
    ),
    (
        "electronic",
        ["electro", "elektron", "techno", "house", "trance", "drum and bass", "rave", "klub", "club", "=dj", "=dnb", "=edm"],
    ),
    (
        "concert",
        [
            "koncert", "concert", "festival", "hudba", "hudob", "music", "rock", "jazz", "hip hop", "metal", "folk",
            "klasick", "classical", "orchestr", "live", "=pop", "=rap",
        ],
    ),
]
FALLBACK = "other"


def genre_pattern(keywords: list[str]) -> str:
    """One alternation per genre over the blank-padded text."""
    return " (?:" + "|".join(k[1:] + " " if k.startswith("=") else k for k in keywords) + ")"


def normalize_genre(raw: Column) -> Column:
    return let(normalize_text(F.coalesce(raw, F.lit(""))), genre_from_key)


def genre_from_key(key: Column) -> Column:
    """``normalize_genre`` where the normalised label is already a column."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    hits = [F.when(padded.rlike(genre_pattern(words)), F.lit(genre)) for genre, words in GENRE_RULES]
    return F.coalesce(*hits, F.lit(FALLBACK))
