"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target over
source size. Inside a source the documents are ordered by size, then by the MD5
of their id; the prefix sum of expected copies plus one offset per source emits
a document once for each integer it crosses. The order by size makes the sample
a stratified one: the words taken differ from the target by about one document.

Only DataFrame functions; the prefix sum is a rank, and the rank is counted from
histograms by (source), (size) and two bytes of the MD5, so no task ever holds a
source or even all documents of one size.

Null text: size 0. Null source: a source of its own, last in order. Null or
repeated ids: ordered by text hash too; rows equal in all of these are
interchangeable. Empty table: no rows. Source of size 0: target 0, no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Target words of each source: sizes has (source, source_size), a row per source.

    Weights repeat over the sources in code point order, null last. A source's
    target is min(cap * size, level * weight) with the level at which all targets
    add up to all sizes; the window below runs over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    filled = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", w).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    s = (
        s.withColumn("place", F.row_number().over(filled))
        .withColumn("before", F.coalesce(F.sum("source_size").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    )
    s = s.withColumn("level", (F.col("all") - F.lit(float(cap)) * F.col("before")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    s = s.withColumn("level", F.min(fits).over(Window.partitionBy()).getField("level"))
    return s.select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def mixed_copies(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, seed: str = "mix", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """``__row`` (the columns ``keep`` of the document as a struct), size, source_size, target and copies, a row per document of ``docs``."""
    d = docs.select(
        F.struct(*keep).alias("__row"),
        word_count(F.col("text")).alias("size"),
        F.col("source").alias("source"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
        F.col("doc_id").alias("id"),
        F.xxhash64(F.col("text")).alias("t"),
    )
    d = d.withColumns({"s": source_key(F.col("source")), "b1": F.substring("h", 1, 2), "b2": F.substring("h", 3, 2)})
    narrow = docs.select(word_count(F.col("text")).alias("size"), F.col("source").alias("source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    narrow = narrow.select(source_key(F.col("source")).alias("s"), "source", "size", F.substring("h", 1, 2).alias("b1"), F.substring("h", 3, 2).alias("b2"))
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    targets = targets.select(source_key(F.col("source")).alias("s"), "source_size", "target")

    def before(counts: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    n3 = narrow.groupBy("s", "size", "b1", "b2").agg(F.count("*").alias("n"))
    n2 = n3.groupBy("s", "size", "b1").agg(F.sum("n").alias("n"))
    n1 = n2.groupBy("s", "size").agg(F.sum("n").alias("n"))
    o1 = before(n1, ["s"], "size", "o1").select("s", "size", "o1").join(targets, "s")
    o2 = before(n2, ["s", "size"], "b1", "o2").drop("n").join(o1, ["s", "size"])
    o3 = before(n3, ["s", "size", "b1"], "b2", "o3").drop("n").join(o2, ["s", "size", "b1"])
    o3 = o3.select("s", "size", "b1", "b2", (F.col("o1") + F.col("o2") + F.col("o3")).alias("offset"), "source_size", "target")

    keys = ["s", "size", "b1", "b2"]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("h", F.col("id").asc_nulls_first(), "t"))
    d = d.withColumn("inside", inside).join(o3, keys)
    rank = F.col("offset") + F.col("inside")
    # a multiple of 2^-16, so that adding it to whole numbers is exact
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("s")).cast("binary")), 1, 4), 16, 10).cast("double") / 65536
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u)
    return d.select("__row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    m = mixed_copies(docs, keep=("doc_id", "source"), **kw)
    return m.select("__row.doc_id", "__row.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each document's row as often as it is drawn, all columns kept."""
    m = mixed_copies(docs, **kw).where(F.col("copies") > 0)
    return m.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, text FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3.0::DOUBLE * source_size AS lim FROM s),
f AS (SELECT *, row_number() OVER x AS place, coalesce(sum(source_size) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
  (sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open, (sum(source_size) OVER ())::DOUBLE AS total
  FROM w WINDOW x AS (ORDER BY lim / weight, source NULLS LAST)),
l AS (SELECT *, (total - 3.0::DOUBLE * before) / open AS level FROM f),
t AS (SELECT source, source_size, least(lim, (SELECT arg_min(level, place) FROM l WHERE level * weight <= lim) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST) AS rnk,
  ('0x' || substr(md5('mix|' || CASE WHEN d.source IS NULL THEN '-' ELSE '+' || d.source END), 1, 4))::BIGINT::DOUBLE / 65536 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, (floor(rate * rnk + u) - floor(rate * (rnk - 1) + u))::BIGINT AS copies,
  ((floor(rate * rnk + u) - floor(rate * (rnk - 1) + u)) * size)::BIGINT AS taken FROM r
"""


def op3_mixing(spark, sf_dir):
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLE = {"op3_mixing": MIX_SQL}
