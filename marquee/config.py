"""Fixed values of the data contract and tunables of the jobs."""

# --- fixed values ---------------------------------------------------------
CZK_PER_EUR = 25
PAGE_SIZE = 24
MAX_PAGE = 50
HAPPENING_NOW_LIMIT = 12
MAX_FILTER_CITIES = 20
HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
SINGLE_EVENT_HOURS = 2
FUZZY_WINDOW_MS = 3 * HOUR_MS
# A title matches when distance / longest < 1/5, i.e. distance <= (longest - 1) div 5.
FUZZY_DIVISOR = 5
REFETCH_INTERVAL_MS = 3 * DAY_MS
JITTER_WINDOW_MS = DAY_MS
TIME_ZONE = "Europe/Prague"

GENRES = ["concert", "electronic", "theatre", "exhibition", "standup", "sport", "other"]
WHEN_VALUES = ["today", "weekend", "week", "month"]
CURRENCY_BY_COUNTRY = {"SK": "EUR", "CZ": "CZK"}

# --- tunables -------------------------------------------------------------
# Titles are compared only inside one coarse period (plus its edges), so the
# candidate set of a city does not grow with the length of its history.
TITLE_PERIOD_MS = 7 * DAY_MS
