"""The registered queries once more, as SQL over the provided tables."""

NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def prague(ts: str) -> str:
    return f"timezone('Europe/Prague', timezone('UTC', {ts}))"


def utc(wall: str) -> str:
    return f"timezone('UTC', timezone('Europe/Prague', {wall}))"


def key(text: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({text})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def canonical(url: str) -> str:
    head = rf"lower(regexp_extract({url}, '^\s*([A-Za-z]+://[^/?#\s]+)', 1))"
    path = rf"rtrim(regexp_extract({url}, '^\s*[A-Za-z]+://[^/?#\s]+([^?#]*)', 1), '/')"
    query = (
        rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '[?]([^#]*)', 1), '&'),"
        rf" lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_|fbclid=|gclid=|mc_|ref=|ref_)', 'i'))), '&')"
    )
    return (
        f"CASE WHEN {head} <> '' THEN {head} || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
        f" || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"
    )


ALIASES = """(VALUES ('bratislava','Bratislava','SK'),('ba','Bratislava','SK'),('pressburg','Bratislava','SK'),
 ('kosice','Košice','SK'),('ke','Košice','SK'),('presov','Prešov','SK'),('zilina','Žilina','SK'),
 ('banska bystrica','Banská Bystrica','SK'),('bb','Banská Bystrica','SK'),('nitra','Nitra','SK'),('trnava','Trnava','SK'),
 ('trencin','Trenčín','SK'),('praha','Praha','CZ'),('prague','Praha','CZ'),('prag','Praha','CZ'),('brno','Brno','CZ'),
 ('ostrava','Ostrava','CZ'),('plzen','Plzeň','CZ'),('pilsen','Plzeň','CZ'),('olomouc','Olomouc','CZ'),
 ('liberec','Liberec','CZ'),('ceske budejovice','České Budějovice','CZ'),('hradec kralove','Hradec Králové','CZ'),
 ('pardubice','Pardubice','CZ')) a(alias, name, country)"""

GENRE = r"""CASE
 WHEN regexp_matches(g, ' (divadl|theatre|theater|muzikal|musical|opera|balet|ballet|cinohra|tanec|loutk)') THEN 'theatre'
 WHEN regexp_matches(g, ' (stand up|standup|komedi|comedy)') THEN 'standup'
 WHEN regexp_matches(g, ' (vystav|exhibition|galeri|muzeum|museum|expozic)') THEN 'exhibition'
 WHEN regexp_matches(g, ' (sport|futbal|fotbal|football|hokej|hockey|basket|tenis|tennis|zapas|maraton|marathon)') THEN 'sport'
 WHEN regexp_matches(g, ' (electro|elektron|techno|house|trance|drum and bass|rave|klub|club|dj |dnb |edm )') THEN 'electronic'
 WHEN regexp_matches(g, ' (koncert|concert|festival|hudba|hudob|music|rock|jazz|hip hop|metal|folk|klasick|classical|orchestr|live|pop |rap )')
  THEN 'concert' ELSE 'other' END"""

# Raw listings, validated listings, the seller registry and the catalogue of exact matches.
BASE = rf"""
aliases AS (SELECT * FROM {ALIASES}),
numbered AS (SELECT *, CASE WHEN event_id % 100 = 50 THEN event_id - 50 ELSE event_id END AS lid,
  CASE WHEN event_id % 5 = 0 THEN 'Nočný ' ELSE '' END || event_type
   || CASE WHEN event_id % 11 = 0 THEN ' Nights ' ELSE ' Night ' END || (user_id % 10) AS name,
  date_trunc('millisecond', ts) AS t0 FROM events),
raw AS (SELECT event_id AS seq, 'src' || (lid % 28) AS source,
  CASE WHEN event_id % 227 = 226 THEN 'not a url' ELSE 'HTTPS://Tickets' || (lid % 3) || '.Example.com/e/' || lid
   || '/?utm_source=x&b=2&a=1#t' END AS source_url,
  CASE WHEN event_id % 223 = 222 THEN '!!!' WHEN event_id % 4 = 1 THEN upper(name) ELSE name END AS title,
  'Hall ' || (user_id % 20) AS venue,
  ['BA','bratislava','Prague','Praha 7','Brno-střed','Kosice','Pilsen','ostrava','nové mesto nad váhom','Poprad','Nowhereville',''][user_id % 12 + 1] AS city,
  CASE WHEN user_id % 12 IN (8, 9) THEN 'SK' END AS country,
  CASE WHEN event_id % 211 <> 210 THEN t0 END AS starts_at,
  CASE WHEN event_type = 'view' THEN t0 + INTERVAL 72 HOUR END AS ends_at,
  CASE WHEN event_id % 229 = 228 THEN 123456789.0 WHEN event_id % 233 = 232 THEN -5.0 WHEN event_type <> 'error' THEN value END AS price_from,
  CASE WHEN event_id % 7 = 0 THEN 'EUR' END AS currency,
  CASE event_type WHEN 'click' THEN 'Koncert' WHEN 'view' THEN 'Výstavy' WHEN 'purchase' THEN 'Divadlo' WHEN 'error' THEN 'DJ set' END AS raw_genre,
  CASE event_id % 3 WHEN 0 THEN 'https://img/' || event_id WHEN 1 THEN 'data:x' END AS image_url FROM numbered),
sources AS (SELECT 's' || n_nationkey AS id, 'src' || n_nationkey AS slug, 'Seller ' || n_name AS name,
  'https://seller' || n_nationkey || '.example.com' AS base_url FROM nation),
keyed AS (SELECT *, {key('title')} AS title_key, {key('venue')} AS venue_key, {key('city')} AS city_key,
  ' ' || {key("coalesce(raw_genre, '')")} || ' ' AS g, {canonical('source_url')} AS url FROM raw),
placed AS (SELECT k.*, CASE WHEN city_key = '' THEN '' ELSE coalesce(e.name, p.name,
   array_to_string(list_transform(string_split(trim(k.city), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) END AS place
  FROM keyed k LEFT JOIN aliases e ON e.alias = city_key
  LEFT JOIN aliases p ON length(p.alias) >= 4 AND starts_with(city_key, p.alias || ' ')),
checked AS (SELECT p.seq, p.source AS source_slug, s.id AS source_id, p.source_url, p.url, trim(p.title) AS title, p.venue,
  p.place AS city, coalesce(c.country, p.country) AS country,
  CASE coalesce(c.country, p.country) WHEN 'SK' THEN 'EUR' WHEN 'CZ' THEN 'CZK' END AS own_currency,
  {GENRE} AS genre, p.starts_at, CASE WHEN p.ends_at > p.starts_at THEN p.ends_at END AS ends_at,
  CASE WHEN regexp_matches(p.image_url, '^https?://', 'i') THEN p.image_url END AS image_url,
  title_key || '|' || venue_key || '|' || CAST(CAST({prague('p.starts_at')} AS DATE) AS VARCHAR) AS fingerprint, title_key,
  CASE WHEN p.price_from >= 0 AND floor(p.price_from * 100 + 0.5) / 100 < 1e8 THEN CAST(floor(p.price_from * 100 + 0.5) / 100 AS DECIMAL(10,2)) END AS price,
  CASE WHEN title_key = '' THEN 'empty title' WHEN p.starts_at IS NULL THEN 'invalid startsAt' WHEN p.place = '' THEN 'empty city'
   WHEN coalesce(c.country, p.country) IS NULL THEN 'unknown country for city "' || p.place || '"'
   WHEN p.url IS NULL THEN 'Invalid URL' WHEN s.id IS NULL THEN 'unknown source "' || p.source || '"'
   WHEN p.price_from >= 1e8 THEN 'price overflow' END AS reason, p.currency AS raw_currency
  FROM placed p LEFT JOIN (SELECT DISTINCT name, country FROM aliases) c ON c.name = p.place LEFT JOIN sources s ON s.slug = p.source),
ok AS (SELECT * EXCLUDE (reason, raw_currency, own_currency), own_currency AS currency, coalesce(raw_currency, own_currency) AS price_currency
  FROM checked WHERE reason IS NULL),
firsts AS (SELECT * FROM ok WHERE seq IN (SELECT min(seq) FROM ok GROUP BY url)),
repeats AS (SELECT * FROM ok WHERE seq NOT IN (SELECT min(seq) FROM ok GROUP BY url)),
founders AS (SELECT fingerprint, min(seq) AS seq FROM firsts GROUP BY fingerprint),
founded AS (SELECT l.*, sha256(l.url) AS id, l.starts_at - INTERVAL 120 HOUR AS created_at FROM firsts l JOIN founders USING (seq)),
es AS (SELECT sha256('listing|' || l.url) AS id, f.id AS event_id, l.source_id, l.url, l.price AS price_from, l.price_currency AS currency,
  l.starts_at - INTERVAL 120 HOUR AS last_seen_at, l.seq, l.image_url, l.ends_at FROM firsts l JOIN founded f USING (fingerprint)),
prices AS (SELECT event_id, currency, min(price_from) AS low FROM es GROUP BY ALL),
fills AS (SELECT f.id, arg_min(e.image_url, e.seq) FILTER (e.image_url <> '') AS image_fill,
  arg_min(e.ends_at, e.seq) FILTER (e.ends_at > f.starts_at) AS ends_fill
  FROM founded f JOIN es e ON e.event_id = f.id AND e.seq <> f.seq GROUP BY f.id),
ev AS (SELECT f.id, f.title, f.title_key, f.venue, f.city, f.country, f.starts_at, coalesce(f.ends_at, l.ends_fill) AS ends_at, p.low AS price_from,
  f.currency, CAST({prague('f.starts_at')} AS DATE) AS start_day, p.low IS NOT NULL AS price_known, f.genre,
  coalesce(f.image_url, l.image_fill) AS image_url, f.fingerprint, f.created_at
  FROM founded f LEFT JOIN prices p ON p.event_id = f.id AND p.currency = f.currency LEFT JOIN fills l ON l.id = f.id),
favorites AS (SELECT 'u' || o_custkey AS user_id, o_orderdate AS created_at,
  sha256('https://tickets' || (o_orderkey % 3) || '.example.com/e/' || o_orderkey || '?a=1&b=2') AS event_id FROM orders),
users AS (SELECT 'u' || c_custkey AS id, c_mktsegment = 'BUILDING' AS digest_opt_out FROM customer)"""
# BASE up to the listings with each URL once, and from the prices of listings on.
LISTINGS, CATALOGUE = BASE[: BASE.index("founders AS (")].rstrip().rstrip(","), BASE[BASE.index("prices AS (") :]

TITLE_DISTANCE = "levenshtein(a.title_key, b.title_key) / greatest(length(a.title_key), length(b.title_key))"
# The fold in arrival order over ``firsts``: a listing founds an event unless an earlier founder matches it.
FOLD = rf"""
title_keys AS (SELECT DISTINCT city, title_key, regexp_extract_all(title_key, '\d+') AS numbers FROM firsts),
alike AS MATERIALIZED (SELECT a.city, a.title_key AS x, b.title_key AS y, {TITLE_DISTANCE} AS distance FROM title_keys a JOIN title_keys b USING (city)
  WHERE {TITLE_DISTANCE} < 0.2 AND (a.numbers = b.numbers OR len(a.numbers) = 0 OR len(b.numbers) = 0)),
nearby AS MATERIALIZED (SELECT i.seq AS later, j.seq AS earlier, s.distance FROM firsts i JOIN alike s ON s.city = i.city AND s.x = i.title_key
  JOIN firsts j ON j.city = s.city AND j.title_key = s.y AND j.seq < i.seq AND abs(epoch_ms(j.starts_at) - epoch_ms(i.starts_at)) <= 10800000),
earlier_matches AS MATERIALIZED (SELECT later, earlier FROM nearby UNION SELECT i.seq, j.seq FROM firsts i JOIN firsts j ON j.fingerprint = i.fingerprint AND j.seq < i.seq),
settled(round, seq, founds) AS (SELECT 0, seq, NULL::BOOLEAN FROM firsts UNION ALL
  SELECT s.round + 1, s.seq, CASE WHEN s.founds IS NOT NULL THEN s.founds WHEN d.later IS NULL OR d.joined_all THEN true WHEN d.founded_any THEN false END
  FROM settled s LEFT JOIN (SELECT m.later, bool_or(coalesce(e.founds, false)) AS founded_any, bool_and(coalesce(NOT e.founds, false)) AS joined_all
    FROM earlier_matches m JOIN settled e ON e.seq = m.earlier GROUP BY m.later) d ON d.later = s.seq
  WHERE (SELECT count(*) FROM settled WHERE founds IS NULL) > 0),
roots AS MATERIALIZED (SELECT l.seq, l.fingerprint FROM firsts l JOIN settled s USING (seq) WHERE s.round = (SELECT max(round) FROM settled) AND s.founds),
nearest AS (SELECT later AS seq, arg_min(earlier, {{'d': distance, 's': earlier}}) AS root, min(distance) AS distance FROM nearby WHERE earlier IN (SELECT seq FROM roots) GROUP BY later),
target AS (SELECT l.seq, coalesce(o.seq, x.seq, n.root) AS root, CASE WHEN o.seq IS NOT NULL THEN 'new' WHEN x.seq IS NOT NULL THEN 'fingerprint' ELSE 'fuzzy' END AS matched_by,
  CASE WHEN o.seq IS NULL AND x.seq IS NULL THEN n.distance END AS distance
  FROM firsts l LEFT JOIN roots o ON o.seq = l.seq LEFT JOIN roots x ON x.fingerprint = l.fingerprint AND x.seq < l.seq LEFT JOIN nearest n ON n.seq = l.seq),
founded AS (SELECT l.*, sha256(l.url) AS id, {NOW} AS created_at FROM firsts l JOIN roots USING (seq)),
es AS (SELECT sha256('listing|' || l.url) AS id, f.id AS event_id, l.source_id, l.url, l.price AS price_from, l.price_currency AS currency,
  {NOW} AS last_seen_at, l.seq, l.image_url, l.ends_at FROM firsts l JOIN target t USING (seq) JOIN founded f ON f.seq = t.root)"""


def cards_of(pages: str) -> str:
    """Cards that link the given pages, what is known of them, and the plan."""
    return f"""
cards AS (SELECT ['koncert','sport','show','divadlo','festival','pre-deti','ostatne'][page_id % 7 + 1] AS category, page_id AS position,
  page_id, {canonical('url')} AS url FROM {pages}),
scraped AS (SELECT url, max(CASE WHEN page_id % 9 <> 0 THEN {NOW} - to_hours(CAST(page_id % 144 AS INTEGER)) END) AS last_fetched_at
  FROM cards WHERE page_id % 4 <> 3 GROUP BY url),
jitter AS (SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT)),
  lambda h, c: (h * 33 + c) % 4294967296, 5381::BIGINT) % 86400000 AS ms FROM cards),
plan AS (SELECT c.category, c.position, c.url, CASE WHEN s.url IS NULL THEN 'new' WHEN s.last_fetched_at IS NULL THEN 'due'
  WHEN epoch_ms({NOW}) - epoch_ms(s.last_fetched_at) >= 259200000 + j.ms THEN 'due' ELSE 'fresh' END AS decision
  FROM cards c JOIN jitter j USING (page_id) LEFT JOIN scraped s ON s.url = c.url)"""


CARDS = cards_of("pages")

SEARCHES = """
picked AS (SELECT c_custkey AS k, ['Praha','Brno','Bratislava','Poprad','Plzeň'] AS cs, ['concert','theatre','exhibition','bogus','other'] AS gs,
  ['today','weekend','week','month','never'] AS ws, ['30','12.5','','abc','-5','0x10','1e2','30 ','0','120'] AS ps, ['0','-3','abc','2.7','999','3',''] AS qs FROM customer),
searches AS (SELECT k AS search_id, CASE WHEN k % 3 <> 0 THEN [cs[k % 5 + 1], cs[(k + 2) % 5 + 1]] ELSE [] END AS cities,
  CASE WHEN k % 4 <> 0 THEN list_filter([gs[k % 5 + 1], gs[(k + 1) % 5 + 1]], lambda x: x <> 'bogus') ELSE [] END AS genres,
  nullif(ws[k % 5 + 1], 'never') AS "when", CASE ps[k % 10 + 1] WHEN '30' THEN 30.0 WHEN '12.5' THEN 12.5 WHEN '0' THEN 0.0 WHEN '120' THEN 120.0 END::DOUBLE AS max_price,
  CASE qs[k % 7 + 1] WHEN '2.7' THEN 2 WHEN '999' THEN 50 WHEN '3' THEN 3 ELSE 1 END AS page FROM picked)"""

MATCHED = f"""
matched AS (SELECT search_id, e.id, e.starts_at FROM (SELECT *, CASE "when" WHEN 'weekend' THEN TIMESTAMP '2024-01-19 17:00:00' ELSE {NOW} END AS lo,
 CASE "when" WHEN 'today' THEN TIMESTAMP '2024-01-15 22:59:59.999' WHEN 'week' THEN {NOW} + INTERVAL 168 HOUR WHEN 'month' THEN {NOW} + INTERVAL 720 HOUR
 WHEN 'weekend' THEN TIMESTAMP '2024-01-21 22:59:59.999' END AS hi FROM searches) s JOIN ev e ON e.starts_at >= lo AND (hi IS NULL OR e.starts_at <= hi)
 AND (len(cities) = 0 OR list_contains(cities, city)) AND (len(genres) = 0 OR list_contains(genres, genre))
 AND (max_price IS NULL OR price_from IS NULL OR price_from <= max_price * CASE currency WHEN 'CZK' THEN 25 ELSE 1 END))"""

RESCRAPE = """
known AS (SELECT r.*, e.event_id, n.listings > 1 AS has_others FROM repeats r JOIN es e ON e.url = r.url
  JOIN (SELECT event_id, count(*) AS listings FROM es GROUP BY event_id) n ON n.event_id = e.event_id),
fresh AS (SELECT event_id, arg_max(starts_at, seq) AS starts_at, arg_max(title, seq) AS title, arg_max(venue, seq) AS venue,
  arg_max({'v': ends_at}, seq).v AS ends_at, arg_max(fingerprint, seq) AS fingerprint, max(seq) AS seq FROM known WHERE NOT has_others GROUP BY event_id),
moved AS (SELECT k.event_id, list_reduce(list(k.starts_at ORDER BY k.seq), lambda x, s:
  CASE WHEN abs(epoch_ms(s) - epoch_ms(x)) > 10800000 THEN s ELSE x END, any_value(e.starts_at)) AS starts_at
  FROM known k JOIN ev e ON e.id = k.event_id WHERE has_others GROUP BY k.event_id),
after_ev AS (SELECT e.id, CASE WHEN f.seq IS NOT NULL THEN f.starts_at ELSE coalesce(m.starts_at, e.starts_at) END AS starts_at,
  coalesce(f.title, e.title) AS title, coalesce(f.venue, e.venue) AS venue, CASE WHEN f.seq IS NOT NULL THEN f.ends_at ELSE e.ends_at END AS ends_at,
  coalesce(f.fingerprint, e.fingerprint) AS fingerprint, e.fingerprint AS old_fingerprint, f.seq AS fresh_seq
  FROM ev e LEFT JOIN fresh f ON f.event_id = e.id LEFT JOIN moved m ON m.event_id = e.id),
claims AS (SELECT fingerprint, id, CASE WHEN fresh_seq IS NOT NULL AND fingerprint <> old_fingerprint THEN fresh_seq ELSE -1 END AS rank FROM after_ev),
collided AS (SELECT c.id, o.owner_id FROM claims c JOIN (SELECT fingerprint, arg_min(id, rank) AS owner_id FROM claims GROUP BY fingerprint) o
  USING (fingerprint) WHERE c.rank >= 0 AND c.id <> o.owner_id)"""


# Events after the re-scrapes: what they leave blank is filled, and prices follow the listings.
REFRESHED = f"""
heard AS (SELECT k.event_id, k.seq, k.ends_at, k.image_url, list_reduce(list(k.starts_at) OVER arrived, lambda x, s:
    CASE WHEN abs(epoch_ms(s) - epoch_ms(x)) > 10800000 THEN s ELSE x END, e.starts_at) AS effect
  FROM known k JOIN ev e ON e.id = k.event_id WHERE has_others WINDOW arrived AS (PARTITION BY k.event_id ORDER BY k.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT event_id, seq, NULL, image_url, starts_at FROM known WHERE NOT has_others
  UNION ALL SELECT c.owner_id, k.seq, k.ends_at, k.image_url, o.starts_at FROM collided c JOIN after_ev a ON a.id = c.id
  JOIN known k ON k.event_id = c.id AND k.seq = a.fresh_seq JOIN after_ev o ON o.id = c.owner_id),
filled AS (SELECT event_id, arg_min(image_url, seq) FILTER (image_url <> '') AS image_fill, arg_min(ends_at, seq) FILTER (ends_at > effect) AS ends_fill FROM heard GROUP BY event_id),
es_after AS (SELECT coalesce(c.owner_id, e.event_id) AS event_id, CASE WHEN r.url IS NULL THEN e.price_from ELSE r.p.price END AS price_from, CASE WHEN r.url IS NULL THEN e.currency ELSE r.p.c END AS currency
  FROM es e LEFT JOIN (SELECT url, arg_max({{'price': price, 'c': price_currency}}, seq) AS p FROM repeats GROUP BY url) r ON r.url = e.url LEFT JOIN collided c ON c.id = e.event_id),
lows AS (SELECT event_id, currency, min(price_from) AS low FROM es_after GROUP BY ALL),
refreshed AS (SELECT a.id, a.title, a.venue, e.city, e.country, a.starts_at, coalesce(a.ends_at, f.ends_fill) AS ends_at,
  CASE WHEN f.event_id IS NULL THEN e.price_from ELSE l.low END::DOUBLE AS price_from, e.currency, CAST({prague('a.starts_at')} AS DATE) AS start_day, e.genre,
  CASE WHEN coalesce(e.image_url, '') = '' THEN coalesce(f.image_fill, e.image_url) ELSE e.image_url END AS image_url, a.fingerprint
  FROM after_ev a JOIN ev e ON e.id = a.id LEFT JOIN filled f ON f.event_id = a.id LEFT JOIN lows l ON l.event_id = a.id AND l.currency = e.currency
  WHERE a.id NOT IN (SELECT id FROM collided))"""

OUTCOMES = """SELECT * FROM (SELECT 'created' AS {0}, (SELECT count(*) FROM founded) AS {1} UNION ALL
 SELECT 'merged', (SELECT count(*) FROM firsts) - (SELECT count(*) FROM founded) + (SELECT count(*) FROM collided) UNION ALL
 SELECT 'updated', (SELECT count(*) FROM repeats) - (SELECT count(*) FROM collided) UNION ALL
 SELECT 'skipped', (SELECT count(*) FROM checked WHERE reason IS NOT NULL)) WHERE {1} > 0"""


def with_base(body: str, *more: str) -> str:
    return "WITH " + ",".join([BASE, *more]) + " " + body


def with_fold(body: str, *more: str, listings: str = LISTINGS) -> str:
    """As ``with_base``, over the catalogue that similar titles leave."""
    return "WITH RECURSIVE " + ",".join([listings, FOLD, CATALOGUE, *more]) + " " + body


def upcoming(*extra: str) -> str:
    return " AND ".join([f"starts_at >= {NOW}", *extra])


VISIBLE = f"(ends_at >= {NOW} OR (ends_at IS NULL AND starts_at >= {NOW} - INTERVAL 2 HOUR))"
END = "coalesce(ends_at, starts_at + INTERVAL 2 HOUR)"
GRID = (
    f"{upcoming()} AND starts_at <= {NOW} + INTERVAL 168 HOUR AND city IN ('Praha','Bratislava','Poprad') AND genre IN ('concert','theatre','other')"
    " AND (price_from IS NULL OR (currency = 'EUR' AND price_from <= 60) OR (currency = 'CZK' AND price_from <= 1500))"
)
PAGE_FIELDS = """shown AS (SELECT event_id, event_id % 6 AS shape, event_type || ' & Night ' || (user_id % 10) AS name, 'Hall ' || (user_id % 20) AS hall,
 date_trunc('minute', ts) - INTERVAL 1 HOUR AS t0, floor(abs(value)) + 0.5 AS low FROM events)"""


def page_listings(rows: str) -> str:
    """Listings of the event pages that ``rows`` describes, numbered in page order."""
    return f"""listed AS (SELECT *, ['Koncert','Šport','Show','Divadlo','Festival','Pre deti','Ostatné'][event_id % 7 + 1] AS raw_genre,
 'https://tickets.example.com/sk/listky/' || event_id AS page FROM {rows})
 SELECT row_number() OVER (ORDER BY event_id, i) - 1 AS seq, * EXCLUDE (event_id, i) FROM (
 SELECT event_id, 0 AS i, page || '/' AS source_url, name AS title, CASE WHEN shape = 3 THEN replace(hall, ' ', chr(160)) ELSE hall END AS venue, CASE WHEN shape = 3 THEN 'Bratislava' ELSE 'Košice' END AS city, t0 AS starts_at,
 CASE WHEN shape IN (0, 3) THEN low END AS price_from, raw_genre, CASE WHEN shape = 3 THEN 'https://og/' || event_id || '?a=1&b=2' ELSE 'https://img/' || event_id END AS image_url
 FROM listed WHERE shape IN (0, 1, 3, 5) UNION ALL
 SELECT event_id, i, page || '-' || (i + 1) || '?x=1&y=2', name || ' ' || (i + 1), replace(hall, ' ', chr(160)), 'Prešov', t0, NULL, raw_genre, 'https://img/' || event_id FROM listed, range(2) r(i) WHERE shape = 2)"""


SITE_PAGES = "(SELECT event_id AS page_id, 'https://tickets.example.com/sk/listky/' || event_id || '/' AS url FROM events)"
# A run over all pages that are new or due, up to the listings with each URL once.
SITE = (
    LISTINGS[: LISTINGS.index("numbered AS (")] + cards_of(SITE_PAGES) + f""", {PAGE_FIELDS},
due AS (SELECT * FROM shown WHERE event_id IN (SELECT position FROM plan WHERE decision <> 'fresh')),
found AS (WITH {page_listings('due')}),
raw AS (SELECT seq, 'src3' AS source, source_url, title, venue, city, 'SK' AS country, starts_at, NULL::TIMESTAMP AS ends_at, price_from, 'EUR' AS currency, raw_genre, image_url FROM found),
""" + LISTINGS[LISTINGS.index("sources AS (SELECT 's'") :]
)
WEEKEND_SUNDAY = f"CAST({prague('ts')} AS DATE) + CAST((7 - dayofweek({prague('ts')})) % 7 AS INTEGER)"

ORACLES: dict[str, str] = {
    "raw_listings": with_base("SELECT * FROM raw"),
    "page_scan": "SELECT page_id, url, CAST(length(html) AS INTEGER) AS chars FROM pages",
    "scan_project": "SELECT user_id, value FROM events",
    "url_match": with_base("SELECT l.seq, e.event_id AS known_event_id FROM ok l LEFT JOIN es e ON e.url = l.url"),
    "fingerprint_match": with_base("SELECT l.seq, e.id AS matched_event_id FROM ok l LEFT JOIN ev e ON e.fingerprint = l.fingerprint"),
    "source_upsert": with_base(
        "SELECT id, slug, name, base_url FROM sources UNION ALL SELECT 'p' || s_suppkey, 'src' || s_suppkey, s_name, 'https://shop' || s_suppkey || '.example.com'"
        " FROM supplier WHERE 'src' || s_suppkey NOT IN (SELECT slug FROM sources)"
    ),
    "source_upsert_overwrite": with_base(
        "SELECT coalesce(o.id, 'p' || s_suppkey) AS id, coalesce(o.slug, 'src' || s_suppkey) AS slug, coalesce(s_name, o.name) AS name,"
        " coalesce('https://shop' || s_suppkey || '.example.com', o.base_url) AS base_url FROM sources o FULL JOIN supplier ON o.slug = 'src' || s_suppkey"
    ),
    "scraped_pages_upsert": with_base(
        f"SELECT url, max(t) AS last_fetched_at FROM (SELECT url, last_fetched_at AS t FROM scraped UNION ALL SELECT url, {NOW} FROM plan WHERE decision <> 'fresh') GROUP BY url",
        CARDS,
    ),
    "mock_listings": with_base(
        "SELECT seq * 3 + i AS seq, 'https://' || ['alpha','beta','gamma'][i + 1] || '.example.com/demo/' || seq AS source_url,"
        " CASE WHEN i > 0 THEN upper(title) ELSE title END AS title, floor(price_from * (1 + i * 0.05::DOUBLE) + 0.5) AS price_from FROM raw, range(3) r(i)"
    ),
    "page_links": r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS position, regexp_extract(tags[i], 'href="([^"]*)"', 1) AS href,
 regexp_extract(url, '^[A-Za-z]+://[^/?#]+') || regexp_extract(tags[i], 'href="([^"]*)"', 1) AS url,
 regexp_replace(regexp_extract(tags[i], '>(.*)</a>', 1), '&amp;', '&', 'g') AS text
 FROM (SELECT *, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS tags FROM pages), range(1, 100) r(i) WHERE i <= len(tags)""",
    "page_links_filtered": r"""SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href FROM pages)
 WHERE starts_with(href, '/t') GROUP BY page_id""",
    "disallow_anti_join": "SELECT event_id AS page_id, 'https://tickets.example.com/sk/listky/' || event_id || '/' AS href FROM events"
    " WHERE NOT regexp_matches('/sk/listky/' || event_id || '/', '^/.*7/|^/sk/listky/1')",
    "jsonld_extract": f"WITH {PAGE_FIELDS} SELECT event_id AS page_id, CASE WHEN shape IN (0, 2, 5) THEN replace(name, '&', '&amp;') END AS name,"
    " CASE WHEN shape IN (0, 5) THEN strftime(t0 + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') WHEN shape = 2 THEN '' END AS start_date FROM shown",
    "jsonld_repair": f"WITH {PAGE_FIELDS} SELECT event_id AS page_id, CASE WHEN shape IN (0, 1, 2, 5) THEN replace(name, '&', '&amp;') END AS name,"
    " CASE WHEN shape IN (0, 1, 5) THEN strftime(t0 + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') WHEN shape = 2 THEN '' END AS start_date FROM shown",
    "page_shape": f"WITH {PAGE_FIELDS} SELECT event_id AS page_id, CASE shape WHEN 2 THEN 'tour' WHEN 4 THEN NULL ELSE 'single' END AS kind,"
    " CASE shape WHEN 4 THEN 'unrecognized event page shape' END AS reason FROM shown UNION ALL"
    " SELECT page_id, NULL, 'unrecognized event page shape' FROM pages",
    "tour_explode": f"WITH {PAGE_FIELDS} SELECT event_id AS page_id, CAST(i AS INTEGER) AS stop, name || ' ' || (i + 1) AS title, t0 AS starts_at, replace(hall, ' ', chr(160)) AS venue, 'Prešov' AS city,"
    " 'https://tickets.example.com/sk/listky/' || event_id || '-' || (i + 1) || '?x=1&y=2' AS href FROM shown, range(2) r(i) WHERE shape = 2",
    "min_price_tiers": f"WITH {PAGE_FIELDS} SELECT event_id AS page_id, CASE WHEN shape IN (0, 3) THEN low END AS price FROM shown",
    "pages_to_listings": f"WITH {PAGE_FIELDS}, {page_listings('shown')}",
    "listing_cards": "SELECT event_id AS page_id, ['koncert','sport','show','divadlo','festival','pre-deti','ostatne'][event_id % 7 + 1] AS category,"
    " event_type || ' & Night' AS title, 'https://tickets.example.com/sk/listky/' || event_id || '/' AS href FROM events",
    "entity_decode": "SELECT page_id, replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''') AS decoded FROM pages",
    "split_address": "SELECT c_custkey, 'Hall ' || c_nationkey AS venue, c_mktsegment AS city FROM customer",
    "parse_local_datetime": f"SELECT event_id, {utc(prague('date_trunc(' + chr(39) + 'minute' + chr(39) + ', ts)'))} AS day_first, date_trunc('minute', ts) AS year_first FROM events",
    "rejects": with_base("SELECT seq, source_url AS url, reason FROM checked WHERE reason IS NOT NULL"),
    "refetch_jitter": "WITH " + CARDS + " SELECT page_id, ms AS jitter_ms FROM jitter",
    "refetch_plan": "WITH " + CARDS + " SELECT category, position, url, decision FROM plan",
    "refetch_cap": "WITH " + CARDS + " SELECT category, position, url, decision FROM plan WHERE decision <> 'fresh'"
    " QUALIFY row_number() OVER (PARTITION BY category ORDER BY position) <= 5",
    "touch_last_seen": with_base(
        f"SELECT e.url, CASE WHEN e.price_from IS NULL THEN {NOW} ELSE e.last_seen_at END AS last_seen_at FROM es e"
    ),
    "scheduled_run": "WITH "
    + cards_of(SITE_PAGES)
    + """ SELECT count(DISTINCT category) AS listing_pages, count(*) FILTER (decision = 'fresh') AS fresh_skips,
 count(*) FILTER (decision = 'new') AS new_pages, count(*) FILTER (decision = 'due') AS due_pages FROM plan""",
    "scheduled_run_all": with_fold(
        "SELECT 'listing_pages' AS counter, count(DISTINCT category) AS n FROM plan UNION ALL SELECT 'fresh_skips', count(*) FILTER (decision = 'fresh') FROM plan"
        " UNION ALL SELECT 'new_pages', count(*) FILTER (decision = 'new') FROM plan UNION ALL SELECT 'due_pages', count(*) FILTER (decision = 'due') FROM plan UNION ALL "
        + OUTCOMES.format("counter", "n"),
        RESCRAPE,
        listings=SITE,
    ),
    "stamp_source": with_base(f"SELECT slug, CASE WHEN slug = 'src3' THEN {NOW} END AS last_scraped_at FROM sources"),
    "refetch_counts": "WITH " + CARDS + """ SELECT count(DISTINCT category) AS listing_pages, count(*) FILTER (decision = 'fresh') AS fresh_skips,
 (SELECT count(*) FROM plan WHERE decision = 'new') AS new_pages, (SELECT count(*) FROM plan WHERE decision = 'due') AS due_pages FROM plan""",
    "normalize_text": f"SELECT doc_id, {key('text')} AS normalized FROM documents",
    "canonical_url": f"SELECT page_id, {canonical('url')} AS canonical FROM pages",
    "normalize_city": with_base("SELECT seq, place AS city FROM placed"),
    "city_country": with_base("SELECT seq, city, country, own_currency AS currency FROM checked"),
    "normalize_genre": with_base("SELECT seq, genre FROM checked"),
    "fingerprint": with_base("SELECT seq, fingerprint FROM checked WHERE starts_at IS NOT NULL"),
    "price_sanitize": with_base("SELECT seq, price::DOUBLE AS price FROM checked"),
    "normalize_listings": with_base("SELECT * EXCLUDE (source_url) REPLACE (price::DOUBLE AS price) FROM ok"),
    "prague_day": f"SELECT event_id, CAST({prague('ts')} AS DATE) AS day FROM events",
    "is_multi_day": with_base(
        f"SELECT seq, ends_at IS NOT NULL AND CAST({prague('starts_at')} AS DATE) <> CAST({prague('ends_at')} AS DATE) AS multi_day,"
        f" CASE WHEN ends_at IS NOT NULL AND CAST({prague('starts_at')} AS DATE) <> CAST({prague('ends_at')} AS DATE) THEN 'range' ELSE 'single' END AS label FROM ok"
    ),
    "derive_sort_fields": with_base("SELECT id, start_day, price_known FROM ev"),
    "title_distance": with_base(
        "SELECT city, a, b, levenshtein(a, b) / greatest(length(a), length(b)) AS distance"
        " FROM (SELECT city, title_key AS a, lead(title_key) OVER (PARTITION BY city ORDER BY title_key) AS b FROM (SELECT DISTINCT city, title_key FROM ok)) WHERE b IS NOT NULL"
    ),
    "numbers_conflict": with_base(
        r"SELECT seq, array_to_string(regexp_extract_all(title_key, '\d+'), ',') AS numbers,"
        r" regexp_matches(title_key, '\d') AND regexp_matches(venue, '\d') AND array_to_string(regexp_extract_all(title_key, '\d+'), ',') <>"
        r" array_to_string(regexp_extract_all(venue, '\d+'), ',') AS conflict FROM ok"
    ),
    "fuzzy_candidates": with_base(
        r"SELECT l.seq, e.id AS event_id, levenshtein(l.title_key, e.title_key) / greatest(length(l.title_key), length(e.title_key)) AS distance"
        r" FROM ok l JOIN ev e ON e.city = l.city AND abs(epoch_ms(e.starts_at) - epoch_ms(l.starts_at)) <= 10800000"
        r" WHERE levenshtein(l.title_key, e.title_key) / greatest(length(l.title_key), length(e.title_key)) < 0.2"
        r" AND regexp_extract_all(l.title_key, '\d+') = regexp_extract_all(e.title_key, '\d+')"
    ),
    "fuzzy_match": with_base(
        r"SELECT seq, arg_min(id, {'d': d, 'c': created_at, 'i': id}) AS event_id, min(d) AS distance FROM (SELECT l.seq, e.id, e.created_at,"
        r" levenshtein(l.title_key, e.title_key) / greatest(length(l.title_key), length(e.title_key)) AS d"
        r" FROM ok l JOIN ev e ON e.city = l.city AND abs(epoch_ms(e.starts_at) - epoch_ms(l.starts_at)) <= 10800000"
        r" WHERE regexp_extract_all(l.title_key, '\d+') = regexp_extract_all(e.title_key, '\d+')) WHERE d < 0.2 GROUP BY seq"
    ),
    "resolve_batch": with_base(
        "SELECT l.seq, f.id AS event_id, CASE WHEN l.seq = f.seq THEN 'new' ELSE 'fingerprint' END AS matched_by FROM firsts l JOIN founded f USING (fingerprint)"
    ),
    "new_events": with_base(
        "SELECT id, title, city, currency, CASE WHEN price_currency = currency THEN price END::DOUBLE AS price_from, genre, starts_at FROM founded"
    ),
    "rescrape_update": with_base(
        f"SELECT e.url, CASE WHEN r.url IS NULL THEN e.price_from ELSE r.p.price END::DOUBLE AS price_from, CASE WHEN r.url IS NULL THEN e.currency ELSE r.p.c END AS currency,"
        f" CASE WHEN r.url IS NULL THEN e.last_seen_at ELSE {NOW} END AS last_seen_at FROM es e LEFT JOIN"
        " (SELECT url, arg_max({'price': price, 'c': price_currency}, seq) AS p FROM repeats GROUP BY url) r ON r.url = e.url"
    ),
    "rescrape_reconcile": with_base("SELECT id, starts_at, title, venue, ends_at, fingerprint FROM after_ev", RESCRAPE),
    "rescrape_collision": with_base("SELECT * FROM collided", RESCRAPE),
    "blank_fill": with_base(
        "SELECT f.id, CASE WHEN f.image_url IS NULL THEN l.image_fill END AS image_fill, CASE WHEN f.ends_at IS NULL THEN l.ends_fill END AS ends_fill"
        " FROM founded f JOIN fills l USING (id)"
    ),
    "event_price": with_base("SELECT id, price_from::DOUBLE AS price_from FROM ev"),
    "refresh_events": with_base("SELECT id, ends_at, image_url, price_from::DOUBLE AS price_from, start_day, price_known FROM ev"),
    "ingest_stats": with_base(OUTCOMES.format("outcome", "listings"), RESCRAPE),
    "resolve_batch_fuzzy": with_fold("SELECT l.seq, sha256(r.url) AS event_id, t.matched_by, t.distance FROM firsts l JOIN target t USING (seq) JOIN firsts r ON r.seq = t.root"),
    "ingest_run": with_fold(f"SELECT *, price_from IS NOT NULL AS price_known, {NOW} AS created_at, {NOW} AS updated_at FROM refreshed", RESCRAPE, REFRESHED),
    "snapshot_reload": with_base("SELECT id, title, starts_at, price_from::DOUBLE AS price_from FROM ev"),
    "cascade_commit": with_base("SELECT user_id, event_id FROM favorites WHERE event_id NOT IN (SELECT id FROM collided)", RESCRAPE),
    "stream_redeliveries": with_base(
        "SELECT seq, source_url, price_from FROM (SELECT seq, source_url, price_from, content, lag(content) OVER (PARTITION BY source_url ORDER BY batch, seq) AS before"
        " FROM (SELECT *, [source, source_url, title, venue, city, country, starts_at::VARCHAR, ends_at::VARCHAR, price_from::VARCHAR, currency, raw_genre, image_url] AS content"
        " FROM (SELECT r.* REPLACE (CASE WHEN batch = 1 AND seq % 10 = 0 THEN 1.25 ELSE price_from END AS price_from), batch FROM raw r, range(3) t(batch))))"
        " WHERE before IS NULL OR content IS DISTINCT FROM before"
    ),
    "integrity_checks": with_base(
        "SELECT 'duplicate fingerprint' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'duplicate url', 0 UNION ALL SELECT 'duplicate slug', 0"
        " UNION ALL SELECT 'listing without event', 0 UNION ALL SELECT 'listing without source', 0 UNION ALL"
        " SELECT 'favorite without event', (SELECT count(*) FROM favorites WHERE event_id NOT IN (SELECT id FROM ev))"
    ),
    "resolve_range": f"""SELECT event_id, w AS "when", CASE WHEN w = 'weekend' THEN greatest(ts, {utc(f'(({WEEKEND_SUNDAY}) - 2) + INTERVAL 18 HOUR')}) ELSE ts END AS range_start,
 CASE w WHEN 'today' THEN {utc(f"CAST({prague('ts')} AS DATE) + INTERVAL 86399999 MILLISECOND")} WHEN 'week' THEN ts + INTERVAL 168 HOUR WHEN 'month' THEN ts + INTERVAL 720 HOUR
 WHEN 'weekend' THEN {utc(f'({WEEKEND_SUNDAY}) + INTERVAL 86399999 MILLISECOND')} END AS range_end
 FROM (SELECT event_id, ts, unnest(['today','weekend','week','month','none']) AS w FROM events)""",
    "parse_filters": "WITH " + SEARCHES + """ SELECT search_id, array_to_string(cities, ',') AS cities, array_to_string(genres, ',') AS genres, "when", max_price, page FROM searches""",
    "feed_grid": with_base(f"SELECT id, title, city, starts_at, price_from::DOUBLE AS price_from FROM ev WHERE {GRID}"),
    "feed_grid_stored": with_base(f"SELECT id, title, city, starts_at, price_from::DOUBLE AS price_from FROM ev WHERE {GRID}"),
    "max_price": with_base(
        "SELECT id, price_from IS NULL OR (currency = 'EUR' AND price_from <= 30) OR (currency = 'CZK' AND price_from <= 750) AS affordable FROM ev"
    ),
    "feed_page": with_base(
        f"SELECT id, start_day, price_known, starts_at, title FROM ev WHERE {upcoming()} ORDER BY start_day, price_known DESC, starts_at, id LIMIT 49"
    ),
    "feed_has_more": with_base(f"SELECT least(count(*), 48) AS shown, count(*) > 48 AS has_more FROM ev WHERE {upcoming()}"),
    "effective_end": with_base(f"SELECT id, {END} AS effective_end FROM ev"),
    "happening_now": with_base(
        f"SELECT id, title, {END} AS effective_end FROM ev WHERE starts_at < {NOW} AND {END} >= {NOW} ORDER BY {END}, starts_at, id LIMIT 12"
    ),
    "happening_union": with_base(
        f"SELECT id, title, {END} AS effective_end FROM ev WHERE starts_at < {NOW} AND {END} >= {NOW} ORDER BY {END}, starts_at, id LIMIT 12"
    ),
    "visible_events": with_base(f"SELECT id, city FROM ev WHERE {VISIBLE}"),
    "city_options": with_base(f"SELECT DISTINCT city FROM ev WHERE {VISIBLE}"),
    "city_options_union": with_base(f"SELECT city FROM ev WHERE {VISIBLE} UNION SELECT unnest(['Žilina', 'Praha'])"),
    "home_feed": with_base(
        f"SELECT * FROM (SELECT 'happening' AS section, CAST(row_number() OVER (ORDER BY {END}, starts_at, id) AS INTEGER) AS place, id, title, city, starts_at FROM ev"
        f" WHERE starts_at < {NOW} AND {END} >= {NOW} QUALIFY place <= 12 UNION ALL"
        " SELECT 'grid', CAST(row_number() OVER (ORDER BY start_day, price_known DESC, starts_at, id) AS INTEGER) AS place, id, title, city, starts_at FROM ev"
        f" WHERE {upcoming()} QUALIFY place <= 24 UNION ALL"
        f" SELECT 'city', CAST(row_number() OVER (ORDER BY city COLLATE sk) AS INTEGER), NULL, NULL, city, NULL FROM (SELECT DISTINCT city FROM ev WHERE {VISIBLE}))"
    ),
    "event_cards": with_base(
        "SELECT v.id AS event_id, v.title, v.price_from::DOUBLE AS price_from, v.currency, e.url, s.name AS source_name, e.price_from::DOUBLE AS listing_price,"
        " e.currency AS listing_currency, row_number() OVER (PARTITION BY v.id ORDER BY e.currency <> v.currency, e.price_from IS NULL, coalesce(e.price_from, 0),"
        f" {key('s.name')}, s.name, e.id) AS position FROM ev v LEFT JOIN es e ON e.event_id = v.id LEFT JOIN sources s ON s.id = e.source_id"
    ),
    "price_label_kind": with_base("SELECT id, CASE WHEN price_from IS NULL THEN 'tba' WHEN price_from = 0 THEN 'free' ELSE 'from' END AS label FROM ev"),
    "saved_search_match": with_base("SELECT search_id, count(*) AS matches, min(starts_at) AS first_start FROM matched GROUP BY search_id", SEARCHES, MATCHED),
    "saved_search_events": with_base(
        "SELECT search_id, id FROM matched WHERE search_id IN (SELECT min(search_id) FROM searches GROUP BY list_sort(list_distinct(cities)), list_sort(list_distinct(genres)), \"when\", max_price)",
        SEARCHES,
        MATCHED,
    ),
    "drop_source": with_base("SELECT url, event_id FROM es WHERE source_id <> 's3'"),
    "orphan_events": with_base("SELECT id, title FROM ev WHERE id NOT IN (SELECT event_id FROM es WHERE source_id <> 's3')"),
    "source_report": with_base(
        "SELECT v.id, v.title, v.city, v.created_at, count(*) AS listings, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS sellers"
        " FROM ev v JOIN es e ON e.event_id = v.id JOIN sources s ON s.id = e.source_id GROUP BY v.id, v.title, v.city, v.created_at HAVING bool_or(e.source_id = 's3')"
    ),
    "multi_source_events": with_base("SELECT event_id AS id, count(*) AS listings FROM es GROUP BY event_id HAVING count(*) > 1"),
    "title_contains": with_base(
        "SELECT v.id, v.title, v.price_from::DOUBLE AS price_from, count(e.id) AS listings FROM ev v LEFT JOIN es e ON e.event_id = v.id WHERE contains(v.title, 'click') GROUP BY ALL"
    ),
    "stale_listings": with_base(
        "SELECT url FROM es JOIN (SELECT source_id, nth_value(run_at, 2) OVER (PARTITION BY source_id ORDER BY run_at DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS edge"
        " FROM (SELECT DISTINCT source_id, date_trunc('day', last_seen_at) AS run_at FROM es) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY run_at) = 1) r USING (source_id)"
        " WHERE last_seen_at < edge"
    ),
    "digest_favorites": with_base(
        f"SELECT f.user_id, f.event_id FROM favorites f JOIN users u ON u.id = f.user_id AND NOT u.digest_opt_out JOIN ev ON ev.id = f.event_id"
        f" WHERE starts_at <= {NOW} + INTERVAL 168 HOUR AND {END} >= {NOW}"
    ),
}
DIGEST = f"""
mine AS (SELECT f.user_id, ev.* FROM favorites f JOIN users u ON u.id = f.user_id AND NOT u.digest_opt_out JOIN ev ON ev.id = f.event_id),
part_a AS (SELECT user_id, id AS event_id FROM mine WHERE starts_at <= {NOW} + INTERVAL 168 HOUR AND {END} >= {NOW}),
tastes AS (SELECT c.user_id, c.city, g.genre FROM (SELECT DISTINCT user_id, city FROM mine) c JOIN (SELECT DISTINCT user_id, genre FROM mine) g USING (user_id)),
recent AS (SELECT city, genre, id AS event_id FROM ev WHERE created_at BETWEEN {NOW} - INTERVAL 168 HOUR AND {NOW} AND starts_at >= {NOW}),
part_b AS (SELECT user_id, event_id FROM tastes JOIN recent USING (city, genre))"""
ORACLES["stream_ingest"] = f"SELECT url, price_from, currency FROM ({ORACLES['rescrape_update']})"
ORACLES["snapshot_increment"] = ORACLES["stream_ingest"]
ORACLES["digest_groups"] = with_base("SELECT * FROM recent", DIGEST)
ORACLES["digest_group_members"] = with_base("SELECT * FROM tastes", DIGEST)
ORACLES["digest_suggestions"] = with_base("SELECT user_id, event_id FROM part_b", DIGEST)
ORACLES["digest"] = with_base(
    "SELECT user_id, event_id, min(part) AS part FROM (SELECT *, 'a' AS part FROM part_a UNION ALL SELECT *, 'b' FROM part_b) GROUP BY ALL", DIGEST
)
