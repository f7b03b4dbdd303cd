"""One-listing-at-a-time restatement of the ingest rules, for comparison only."""

from datetime import timedelta

WINDOW = timedelta(hours=3)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def numbers(title):
    return ["".join(g) for g in "".join(c if c.isdigit() else " " for c in title).split()]


def distance(a, b):
    x, y = numbers(a), numbers(b)
    if x and y and x != y or not (a or b):
        return 1.0
    return edit_distance(a, b) / max(len(a), len(b))


class Catalogue:
    """Events in creation order; listings by URL."""

    def __init__(self):
        self.events, self.listings = {}, {}

    def owner(self, fingerprint):
        return next((i for i, e in self.events.items() if e["fingerprint"] == fingerprint), None)

    def closest(self, row):
        best, limit = None, 0.2
        for key, event in self.events.items():
            if event["city"] == row["city"] and abs(event["starts_at"] - row["starts_at"]) <= WINDOW:
                d = distance(row["title_key"], event["title_key"])
                if d < limit:
                    best, limit = key, d
        return best

    def refresh(self, key, row):
        event = self.events[key]
        if not event["image_url"] and row["image_url"]:
            event["image_url"] = row["image_url"]
        if event["ends_at"] is None and row["ends_at"] and row["ends_at"] > event["starts_at"]:
            event["ends_at"] = row["ends_at"]
        own = [s["price"] for s in self.listings.values() if s["event"] == key and s["currency"] == event["currency"]]
        event["price_from"] = min((p for p in own if p is not None), default=None)

    def add(self, row):
        listing = {"price": row["price"], "currency": row["price_currency"]}
        known = self.listings.get(row["url"])
        if known:
            known.update(listing)
            key, event = known["event"], self.events[known["event"]]
            if sum(s["event"] == key for s in self.listings.values()) > 1:
                if abs(row["starts_at"] - event["starts_at"]) > WINDOW:
                    event["starts_at"] = row["starts_at"]
            else:
                other = self.owner(row["fingerprint"])
                if other not in (None, key):
                    known["event"] = other
                    del self.events[key]
                    self.refresh(other, row)
                    return "merged"
                event.update({k: row[k] for k in ("starts_at", "title", "title_key", "venue", "ends_at", "fingerprint")})
            self.refresh(key, row)
            return "updated"
        key = self.owner(row["fingerprint"]) or self.closest(row)
        if key:
            self.listings[row["url"]] = {"event": key, **listing}
            self.refresh(key, row)
            return "merged"
        key = row["url"]
        self.listings[key] = {"event": key, **listing}
        self.events[key] = {**row, "price_from": None}
        self.refresh(key, {**row, "image_url": None, "ends_at": None})
        return "created"
