"""Benchmark decontamination by exact comparison of item-sized windows.

Documents and items are folded (lower case, punctuation off) and compared in
5-word shingles. A document is contaminated by an item if any window of the item's
size reaches ``threshold`` in exact weighted-shingle (multiset) Jaccard similarity.

1. Every shingle of every document that is a shingle of an item is a hit: (row,
   place, hash), found by a bit map of the items' shingles and an exact join.
2. A window at the threshold holds that share of its item's shingles at least, so it
   holds one of any few more than the rest: for each item those that the corpus has
   least often lead to candidates, a row and a stretch of one item's length.
3. Only candidates' texts are read again. Every window that touches the stretch is
   laid, and those with enough shingles of the item are compared exactly, equal
   windows once. No window that could match is left out.

No fingerprint stands between the two: at similarity 0.8 some 15% of a SimHash's
bits differ, so a radius of 15 in 64 loses about 2% of the pairs, and one that loses
one in a million (24) has Hamming blocks that let nearly every pair pass.

Only DataFrame functions. The shingles of the items are broadcast if they are at most
``BROADCAST_SHINGLES``, with a bit map of at most MAP_BITS; beyond that every shingle
of the documents goes through a shuffle join.

Null text or one of fewer than five words: never contaminated; items of fewer than
five words match nothing. A document shorter than an item is compared as a whole.
Very long texts are read whole; what travels of them are stretches of three items'
length. Ties between equally good windows: the similarity is the same. Repeated items
each count; repeated rows and ids are rows of their own; ids may have any type. Empty
tables: no rows. Columns other than those named may be anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Tables, bit_map, row_id, with_mark
from .repeats import text_key

SIZE = 5
BROADCAST_SHINGLES = 1_000_000
MAP_BITS = 1 << 23
PUNCTUATION = ".,;:!?\"'()[]{}#*$%&|<>"


def folded_words(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.array_remove(F.split(plain, BLANKS), "")


def shingle_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(SIZE)])


def places(words: Column) -> Column:
    """0 up to the last shingle; empty for fewer words than a shingle has."""
    return F.when(F.size(words) >= SIZE, F.sequence(F.lit(0), F.size(words) - SIZE)).otherwise(F.array().cast("array<int>"))


def shingle_counts(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, g, c): the shingles of an array of words as strings, with how often each occurs."""
    g = F.transform(places(F.col(words)), lambda i: F.array_join(F.slice(F.col(words), i + 1, SIZE), " "))
    return df.select(*keys, F.explode(g).alias("g")).groupBy(*keys, "g").agg(F.count("*").alias("c"))


def marker(seeds: DataFrame, n: int):
    """A test of a shingle hash against a bit map of the n seeds (h): one constant of the plan, at most MAP_BITS / 64 numbers."""
    size = min(MAP_BITS, 1 << max(12, (64 * n).bit_length()))
    cells = ["0"] * (size // 64)
    for i, b in bit_map(seeds, F.col("h"), size).collect():
        cells[i] = str(b)
    bits = F.from_json(F.lit("[" + ",".join(cells) + "]"), "array<bigint>")  # folded to an array by the optimizer

    def marked(h: Column) -> Column:
        place = F.pmod(h, F.lit(size))
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return marked


def matches(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """key, doc_id, item_id, similarity: the best window of each contaminated row for each item. key is the text's key.

    docs: (doc_id, text); items: (item_id, text).
    """
    tables = Tables(docs.sparkSession, "decontamination")
    it = items.select(F.monotonically_increasing_id().alias("item"), "item_id", folded_words(F.col("text")).alias("words"))
    it = tables.save(it.where(F.size("words") >= SIZE).withColumn("m", F.size("words")), "items")
    hashes = F.transform(places(F.col("words")), lambda i: shingle_hash(F.col("words"), i))
    seeds = tables.save(it.select("item", "m", F.explode(hashes).alias("h")).groupBy("item", "m", "h").agg(F.count("*").alias("c")), "seeds")
    n = seeds.select("h").distinct().count()
    small = lambda df: F.broadcast(df) if n <= BROADCAST_SHINGLES else df

    uid = row_id(docs)
    if uid is None:  # the texts are read twice, and both scans must number them alike
        docs = tables.save(docs.select("doc_id", "text"), "docs")
        uid = row_id(docs)
    d = docs.select(uid.alias("uid"), folded_words(F.col("text")).alias("w"))
    at = places(F.col("w"))
    if n <= BROADCAST_SHINGLES:
        marked = marker(seeds, n)
        at = F.filter(at, lambda i: marked(shingle_hash(F.col("w"), i)))
    # no filter on the array: the planner would move it below the words, and fold the text again for each place
    hits = d.select("uid", "w", F.explode_outer(at).alias("p")).where(F.col("p").isNotNull()).select("uid", "p", shingle_hash(F.col("w"), F.col("p")).alias("h"))
    hits = tables.save(hits.join(small(seeds.select("h").distinct()), "h", "left_semi"), "hits")

    # of each item the rarest shingles, as many as a window at the threshold cannot miss all of
    often = seeds.join(hits.groupBy("h").agg(F.count("*").alias("often")), "h")
    rare = Window.partitionBy("item").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)
    spare = F.col("m") - SIZE + 1 - F.ceil(threshold * (F.col("m") - SIZE + 1) - 1e-9)
    absent = seeds.join(often.select("item", "h"), ["item", "h"], "left_anti").groupBy("item").agg(F.sum("c").alias("absent"))
    lead = often.join(absent, "item", "left").withColumn("before", F.coalesce(F.sum("c").over(rare), F.lit(0)) + F.coalesce("absent", F.lit(0)))
    lead = tables.save(lead.where(F.col("before") <= spare).select("h", "item", "m"), "lead")
    stretch = (F.floor(F.col("p") / F.col("m")) * F.col("m")).cast("int").alias("b")
    regions = tables.save(hits.join(small(lead), "h").select("uid", "item", "m", stretch).distinct(), "regions")

    cells = tables.save(bit_map(regions, F.col("uid"), MAP_BITS), "cells")
    rows = docs.select(uid.alias("uid"), "doc_id", "text")
    rows = with_mark(rows, F.col("uid"), cells, MAP_BITS).where("__maybe")
    rows = rows.select("uid", "doc_id", text_key(F.col("text")).alias("key"), folded_words(F.col("text")).alias("w"))
    first = F.greatest(F.lit(0), F.col("b") - F.col("m") + SIZE)
    last = F.greatest(F.lit(0), F.least(F.col("b") + F.col("m") - 1, F.size("w") - F.col("m")))
    near = rows.join(regions, "uid").select("uid", "doc_id", "key", "item", "m", (last - first).alias("starts"), F.least("m", F.size("w")).alias("long"), F.slice("w", first + 1, last - first + F.col("m")).alias("near"))
    near = near.join(small(it.select("item", hashes.alias("own"))), "item")
    # written, as the planner would else work out ``there`` again for every start
    near = tables.save(near.withColumn("there", F.transform(places(F.col("near")), lambda i: F.array_contains("own", shingle_hash(F.col("near"), i)))).drop("own"), "near")
    enough = threshold / (1 + threshold) * (F.col("long") + F.col("m") - 2 * (SIZE - 1)) - 1e-9
    starts = F.filter(F.sequence(F.lit(0), F.col("starts")), lambda s: F.size(F.filter(F.slice(F.col("there"), s + 1, F.col("long") - SIZE + 1), lambda x: x)) >= enough)
    near = near.select("uid", "doc_id", "key", "item", "m", "near", F.explode(starts).alias("s")).withColumn("window", F.array_join(F.slice("near", F.col("s") + 1, F.col("m")), " "))
    laid = tables.save(near.select("uid", "doc_id", "key", "item", F.xxhash64("window", "m").alias("wid"), "m", "window").distinct(), "laid")

    windows = tables.save(laid.groupBy("wid", "m").agg(F.min("window").alias("window")).select("wid", "m", F.split("window", " ").alias("words")), "windows")
    counts = tables.save(shingle_counts(windows, ["wid"], "words"), "counts")
    item_counts = tables.save(shingle_counts(it, ["item"], "words").withColumnRenamed("c", "item_c"), "item_counts")
    common = laid.select("wid", "item").distinct().join(counts, "wid").join(small(item_counts), ["item", "g"])
    common = common.groupBy("wid", "item").agg(F.sum(F.least("c", "item_c")).alias("both"))
    # shingles in all: the item's follow from its size, the window's may be fewer in a short document
    common = common.join(windows.select("wid", (F.size("words") - SIZE + 1).alias("total")), "wid").join(small(it.select("item", "item_id", (F.col("m") - SIZE + 1).alias("item_total"))), "item")
    similar = common.select("wid", "item", "item_id", (F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    similar = tables.save(similar, "similar")
    tables.drop("docs", "seeds", "hits", "lead", "regions", "cells", "near", "windows", "counts", "item_counts")
    best = laid.select("uid", "doc_id", "key", "wid", "item").join(similar, ["wid", "item"]).groupBy("uid", "doc_id", "key", "item_id").agg(F.max("similarity").alias("similarity"))
    return best.select("key", "doc_id", "item_id", "similarity")


def clean(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose text holds no item."""
    keys = matches(docs.select("doc_id", "text"), items, threshold=threshold).select(F.col("key").alias("__k")).distinct()
    keys = Tables(docs.sparkSession, "contaminated").save(keys, "keys")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_key(F.col("text")).alias("__k"))
    return rows.join(keys, "__k", "left_anti").select("__row.*")


def op10_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).select("doc_id", "item_id", "similarity")


QUERIES = {"op10_decontamination": op10_decontamination}
_FOLDED = r"""regexp_extract_all(translate(lower(coalesce(text, '')), '.,;:!?"''()[]{}#*$%&|<>', ''), '[^\x20\x09-\x0D]+')"""
#: All windows of an item's size in all documents that share a shingle with it.
ORACLE = {
    "op10_decontamination": f"""
WITH d AS (SELECT i, doc_id, w FROM (SELECT row_number() OVER () AS i, doc_id, {_FOLDED} AS w FROM documents) WHERE len(w) >= 5),
t AS (SELECT k, item_id, w, len(w) AS m FROM (SELECT row_number() OVER () AS k, item_id, {_FOLDED} AS w FROM benchmark) WHERE len(w) >= 5),
dg AS (SELECT DISTINCT i, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT i, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
ig AS (SELECT k, g, count(*) AS c FROM (SELECT k, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS p FROM t)) GROUP BY 1, 2),
x AS (SELECT DISTINCT i, k FROM dg JOIN ig USING (g)),
s AS (SELECT x.i, x.k, m, d.w, unnest(range(1, greatest(1, len(d.w) - m + 1) + 1)) AS s FROM x JOIN d ON d.i = x.i JOIN t ON t.k = x.k),
v AS (SELECT i, k, s, m, w, unnest(range(s, least(s + m - 1, len(w)) - 3)) AS p FROM s),
wg AS (SELECT i, k, s, m, array_to_string(w[p:p + 4], ' ') AS g, count(*) AS c FROM v GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT i, wg.k, s, m, sum(wg.c) AS total, sum(least(wg.c, coalesce(ig.c, 0))) AS both_ FROM wg LEFT JOIN ig ON ig.k = wg.k AND ig.g = wg.g GROUP BY 1, 2, 3, 4),
j AS (SELECT i, k, max(both_::DOUBLE / (total + m - 4 - both_)::DOUBLE) AS similarity FROM b GROUP BY 1, 2)
SELECT doc_id, item_id, max(similarity) AS similarity FROM j JOIN d USING (i) JOIN t ON t.k = j.k WHERE similarity >= 0.8 - 1e-12 GROUP BY d.i, doc_id, item_id
"""
}
