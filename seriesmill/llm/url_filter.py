"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Listed are canonical URLs (host without a leading ``www.`` or ``m.``, and path
without closing slashes; scheme, query and fragment do not count) and rules
``host/pathprefix``, which fit their host and every subdomain when the URL's path
starts with theirs. Each distinct URL yields its canonical form and its rule keys
(host suffixes times path prefixes of the lengths that occur in the rules); a key is
tested against one 64-bit block of the filter, and only keys that may be listed
reach the exact join, which removes the false positives. The longest fitting rule
decides; where none fits, a listed URL is blocked and any other allowed.

Only DataFrame functions. The filter has ``BITS_PER_KEY`` bits for each listed key up
to ``MOST_BLOCKS`` blocks of 16 bytes, which bounds what is broadcast; a longer list
only lets more keys through to the exact join. The list is broadcast for that join
only if it has at most ``BROADCAST_RULES`` keys. Keys are distinct URLs' keys, so that
a hot URL is one row until its verdict goes back to its pages, in a join that the
adaptive planner splits.

Null URL or one without ``://``: empty host and path, no rule fits, nothing listed is
equal. Very long URLs are read whole. Repeated URLs: judged once, each page keeps its
row. Other columns may have any names: they travel inside ``__row``. Listed twice:
counts once; a rule listed with both verdicts allows. Empty table: no rows; empty
lists: all allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
BITS_PER_KEY = 16
MOST_BLOCKS = 1 << 20

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


#: The query's list is made by rule: of these hosts under each of these top-level domains, in each language, the pages numbered below LISTED_PAGES.
LISTED_HOSTS = ("adult-x", "casino-win")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
LISTED_LANGUAGES = ("de", "en", "es", "fr")
LISTED_PAGES = 10_000


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a key, and its four bits in there, from two hashes."""
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("long")
    for i in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h2, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(h1, F.lit(blocks)), mask


def judged_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, *, blocks: int | None = None) -> DataFrame:
    """__row (the page as a struct), host, path, rule, listed, verdict. rules: (verdict, rule); listed: (url), canonical URLs that are blocked; blocks: of the filter, by the number of keys if None."""
    slash = F.instr(F.col("rule"), "/")
    r = rules.select("verdict", "rule", F.substring(F.col("rule"), F.lit(1), slash - 1).alias("h"), F.substring(F.col("rule"), slash, F.length("rule")).alias("p"))
    r = r.select("verdict", "rule", F.concat_ws("\x1f", "h", "p").alias("key"), F.length("p").alias("len"))
    r = r.groupBy("key").agg(F.min("verdict").alias("verdict"), F.min("rule").alias("rule"), F.min("len").alias("len"))  # a rule listed twice: allow wins
    if listed is not None:
        own = listed.where(F.col("url").isNotNull()).select(F.concat(F.lit("\x1f"), "url").alias("key")).distinct()
        r = r.unionByName(own, allowMissingColumns=True)
    n, lengths = r.agg(F.count("*"), F.sort_array(F.collect_set("len"))).first()
    blocks = blocks or min(MOST_BLOCKS, n * BITS_PER_KEY // 64 + 1)
    block, mask = block_and_mask(F.col("key"), blocks)
    bloom = r.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))

    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = F.filter(F.array(*[F.lit(int(x)) for x in lengths]).cast("array<int>"), lambda x: x <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(wanted, lambda x: F.concat(h, F.lit("\x1f"), F.substring(F.col("path"), F.lit(1), x)))))
    keys = F.concat(keys, F.array(F.concat(F.lit("\x1f"), canonical(F.col("host"), F.col("path")))))
    cand = urls.where(F.col("host") != "").select("url", F.explode(keys).alias("key"))
    cand = cand.select("url", "key", *[c.alias(x) for c, x in zip(block_and_mask(F.col("key"), blocks), ("block", "mask"), strict=True)])
    possible = cand.join(F.broadcast(bloom), "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("url", "key")
    exact = F.broadcast(r) if n <= BROADCAST_RULES else r
    longest = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict")))
    hits = possible.join(exact, "key").groupBy("url").agg(longest.alias("hit"), F.max(F.col("rule").isNull()).alias("listed"))

    rows = pages.select(F.struct("*").alias("__row"), F.col("url").alias("url"))
    out = rows.join(hits, "url", "left")
    on_list = F.coalesce("listed", F.lit(False))
    return out.select("__row", host.alias("host"), path.alias("path"), F.col("hit.rule").alias("rule"), on_list.alias("listed"), F.coalesce("hit.verdict", F.when(on_list, "block").otherwise("allow")).alias("verdict"))


def listed_urls(spark) -> DataFrame:
    """(url): the canonical URLs that the query blocks."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    rows = spark.range(LISTED_PAGES).select("id", each(LISTED_HOSTS).alias("h")).select("*", each(LISTED_DOMAINS).alias("d")).select("*", each(LISTED_LANGUAGES).alias("l"))
    return rows.select(F.concat(F.concat_ws(".", "h", "d"), F.lit("/"), F.concat_ws("/", "l", F.col("id").cast("string"))).alias("url"))


def op7_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return judged_urls(pages, rules, listed_urls(spark)).select("__row.page_id", "host", "path", "rule", "verdict", "listed")


_NAMES = lambda values: "[" + ", ".join(f"'{x}'" for x in values) + "]"
URL_SQL = rf"""
WITH l AS (SELECT h || '.' || d || '/' || l || '/' || n AS url FROM (SELECT unnest({_NAMES(LISTED_HOSTS)}) AS h), (SELECT unnest({_NAMES(LISTED_DOMAINS)}) AS d),
  (SELECT unnest({_NAMES(LISTED_LANGUAGES)}) AS l), (SELECT unnest(range(0, {LISTED_PAGES})) AS n)),
r(verdict, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest, row_number() OVER () AS i FROM pages),
x AS (SELECT page_id, i, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM x JOIN r ON (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p) GROUP BY i)
SELECT page_id, host, path, rule, l.url IS NOT NULL AS listed, coalesce(verdict, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN m USING (i) LEFT JOIN l ON l.url = regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') AND host <> ''
"""

QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE = {"op7_url_filter": URL_SQL}
