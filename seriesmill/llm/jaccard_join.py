"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents with the same set of word shingles are one class from the start. Sets
whose MinHash signatures agree on a band fall into a bucket; buckets that share
sets form coarse groups (connected components, distributed). A group is looked at
in tiles of at most ``BLOCK`` by ``BLOCK`` sets, in the way that sends fewer sets:
either all its pairs, or, for groups that hang together by small buckets, only the
pairs of each bucket, a pair in the first of its buckets alone. In a tile MinHash
values are compared ``STEP`` at a time, a pair is dropped once the posterior
probability that its similarity reaches the threshold (uniform prior) is below
``tolerance``, and the rest are verified on the exact shingle sets. Tiles return
counts of links and a spanning forest, never pairs, and a group of any size is
spread over tiles.

Cost: a group of n different texts whose buckets are as large as itself (near copies
of one text) takes n * n / 2 comparisons, as its links are to be counted, and sends
n * n / BLOCK sets; others take 40 times their sets at most times the blocks of
their largest bucket.

40 bands of 5 miss a pair at similarity 0.8 with probability (1 - 0.8**5)**40 =
1.3e-7, above that with less. Shingles and sets are compared by 64-bit hashes.

Null text or one without words: a class of its own, no links. A text shorter than
the shingle: one shingle, all its words. Very long texts: whole, as one set. Ids may
have any type with an order. Repeated rows and ids, and null ids: each row is its
own document; the class id is the smallest id of its class (null only if all are).
Empty table: no rows. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHashes, mixed, rolled, row_id, shuffle_partitions
from .components import components

BANDS, ROWS = 40, 5
STEP = 20
BLOCK = 512
#: Bits of the map of candidate sets: its size is fixed, more sets only let through more rows that the join drops.
MAP_BITS = 1 << 26

_seeds = np.random.default_rng(20240501).integers(1, 2**32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
XOR, ODD = _seeds[0], _seeds[1] | np.uint32(1)


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolled(hashes.of(words), min(size, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima over the shingles."""
    low = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    g = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(g), 4096):
        np.minimum(low, ((g[i : i + 4096, None] ^ XOR) * ODD).min(axis=0), out=low)
    return low


def set_key(found: np.ndarray) -> int:
    """64-bit hash of a whole shingle set."""
    with np.errstate(over="ignore"):
        x = mixed(found * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(found)))
        return int(np.array([x.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(x) >> np.uint64(1))], np.uint64).view(np.int64)[0])


def band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n values compared, the fewest matches that keep a pair: P(similarity >= threshold | m of n) >= tolerance."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def linked(sigs: np.ndarray, sets: list[np.ndarray], left: range, right: range, threshold: float, keep: dict[int, int], band: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left``, those of ``right`` (behind it, where they overlap) at or above the threshold; of a ``band`` from 0 up only pairs that agree on none before."""
    bands = np.array([band_hashes(s)[:band] for s in sigs]) if band > 0 else None
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    ids = np.unique(every, return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(every), bool)
    for i in left:
        js = np.arange(max(i + 1, right.start), right.stop)
        js = js[np.minimum(sizes[js], sizes[i]) >= threshold * np.maximum(sizes[js], sizes[i])]
        if bands is not None:
            js = js[~(bands[js] == bands[i]).any(axis=1)]
        matches = np.zeros(len(js), np.int64)
        for n in range(STEP, BANDS * ROWS + 1, STEP):
            if not len(js):
                break
            matches += (sigs[js, n - STEP : n] == sigs[i, n - STEP : n]).sum(axis=1)
            stay = matches >= keep[n]
            js, matches = js[stay], matches[stay]
        if not len(js):
            continue
        own = ids[ends[i] : ends[i + 1]]
        mark[own] = True
        common = np.array([mark[ids[ends[j] : ends[j + 1]]].sum() for j in js])
        mark[own] = False
        # in whole numbers, so that a similarity of exactly the threshold counts
        both = sizes[js] + sizes[i] - common
        hit = js[common >= threshold * both - 1e-9]
        if len(hit):
            yield i, hit


TILE = "k long, root long, links long, texts long"


def tile_links(rows: list[tuple], threshold: float, keep: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Rows (k, n, block, set, band, of two blocks?) of one tile -> (k, root, links, texts): linked documents and sets, and the smallest key reached."""
    seen: dict[int, tuple] = {}
    band, cross = rows[0][4:]
    for k, n, block, data, *_ in rows:
        seen.setdefault(k, (block, k, n, data))
    order = sorted(seen.values(), key=lambda x: x[:2])
    keys, n = [x[1] for x in order], np.array([x[2] for x in order])
    blocks = [x[0] for x in order]
    sets = [np.frombuffer(x[3], np.uint64) for x in order]
    sigs = np.stack([signature(s) for s in sets])
    split = blocks.index(blocks[-1])  # where the second block begins; 0 if only one has sets
    left, right = (range(split), range(split, len(keys))) if cross else (range(len(keys)), range(len(keys)))
    links, texts, root = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), list(range(len(keys)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, js in linked(sigs, sets, left, right, threshold, keep, band):
        links[i] += n[js].sum()
        texts[i] += len(js)
        links[js] += n[i]
        texts[js] += 1
        for j in js:
            a, b = top(i), top(int(j))
            if a != b:
                if keys[a] > keys[b]:
                    a, b = b, a
                root[b] = a
    return [(keys[i], keys[top(i)], int(links[i]), int(texts[i])) for i in range(len(keys)) if texts[i]]


def near_copies(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """uid, doc_id, class_id, class_key, n_links, n_text_links, first: a row per row of docs(doc_id, text).

    n_links: other documents at or above the threshold, copies too; n_text_links:
    other shingle sets. uid is row_id(docs), or of a copy of the table where that is None; first marks the row with the smallest (doc_id, uid) of its class.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    keep = least_matches(threshold, tolerance)
    parts = shuffle_partitions(spark)

    uid = row_id(docs)
    if uid is None:  # the texts are read twice, and both scans must number them alike
        docs = tables.save(docs.select("doc_id", "text"), "docs")
        uid = row_id(docs)
    docs = docs.select(uid.alias("uid"), "doc_id", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            keys, bands = [], []
            for t in b.column("text"):
                found = shingles(t.as_py(), size, hashes)
                key = set_key(found) if len(found) else None
                keys.append(key)
                if key is None or key in seen:
                    bands.append(None)
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                bands.append(band_hashes(signature(found)))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["uid", "doc_id", "k", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = tables.save(docs.mapInArrow(sketch, f"uid long, doc_id {id_type}, k long, bands array<long>"), "rows")

    # buckets of two or more sets, as stars around their smallest
    banded = rows.where(F.col("bands").isNotNull()).select("k", F.posexplode("bands").alias("band", "h"))
    heads = banded.groupBy("band", "h").agg(F.min("k").alias("u"), F.max("k").alias("m"), F.count("*").alias("size")).where("u < m")
    heads = tables.save(heads.select("band", "h", "u", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "size"), "heads")
    groups = components(banded.join(heads, ["band", "h"]).select("u", F.col("k").alias("v")), tables, "coarse")
    groups = tables.save(groups.select(F.col("node").alias("k"), "root"), "nodes")
    # sets sent: the group's times its blocks, or the same for each of its buckets
    sizes = groups.groupBy("root").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    by_bucket = heads.join(groups, heads["u"] == groups["k"]).groupBy("root").agg(F.sum(F.col("size") * F.col("blocks")).alias("cost"))
    sizes = sizes.join(by_bucket, "root").select("root", "blocks", ((F.col("blocks") > 1) & (F.col("cost") < F.col("size") * F.col("blocks"))).alias("split"))
    sizes = tables.save(sizes, "sizes")
    copies = rows.where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    groups = tables.save(groups.join(sizes, "root").join(copies, "k"), "groups")

    # one text of each candidate set is read again: a bit map of fixed size lets the scan pass over nearly all others
    place = F.pmod("uid", F.lit(MAP_BITS))
    words = groups.select(F.floor(place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # MAP_BITS / 64 rows at most
    bitmap = spark.sparkContext.broadcast((words["w"].to_numpy(np.int32), words["b"].to_numpy(np.int64)))

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bits = bitmap.value
        full = np.zeros(MAP_BITS // 64, np.int64)
        full[w] = bits
        hashes = WordHashes()
        for b in batches:
            uids = b.column("uid").to_numpy()
            at = uids % MAP_BITS
            kept, sets = [], []
            for i in np.flatnonzero((full[at >> 6] >> (at & 63)) & 1).tolist():
                found = shingles(b.column("text")[i].as_py(), size, hashes)
                if len(found):
                    kept.append(uids[i])
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sets, pa.binary())], names=["uid", "data"])

    sets = tables.save(groups.join(docs.select("uid", "text").mapInArrow(payload, "uid long, data binary"), "uid"), "sets")
    mine = lambda n: F.pmod(F.xxhash64("k", F.lit(3)), n).cast("int")

    def tiles_of(df: DataFrame, name: list, band) -> DataFrame:
        df = df.select(*name, "k", "n", "data", band.alias("band"), mine(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        return df.select(F.xxhash64(*name, F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "k", "n", "block", "data", "band", (F.col("block") != F.col("other")).alias("cross"))

    tiles = tiles_of(sets.where(~F.col("split")), ["root"], F.lit(-1))
    split = sets.where("split").drop("blocks", "root")
    if sizes.where("split").limit(1).count():
        split = split.join(banded.join(heads.select("band", "h", "blocks"), ["band", "h"]), "k").withColumnRenamed("band", "of")
        tiles = tiles.unionByName(tiles_of(split, ["of", "h"], F.col("of")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done):
            cols = list(zip(*done, strict=True)) if done else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "root", "links", "texts"])

        tile, held = None, []
        for b in batches:
            done: list[tuple] = []
            for t, k, n, block, data, band, cross in zip(*(b.column(x).to_pylist() for x in ("tile", "k", "n", "block", "data", "band", "cross")), strict=True):
                if t != tile:
                    if len(held) > 1:
                        done += tile_links(held, threshold, keep)
                    tile, held = t, []
                held.append((k, n, block, data, band, cross))
            yield out(done)
        if len(held) > 1:
            yield out(tile_links(held, threshold, keep))

    found = tables.save(tiles.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(compare, TILE), "links")
    counts = found.groupBy("k").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    copies = copies.drop("uid")
    roots = components(found.where("k <> root").select(F.col("k").alias("u"), F.col("root").alias("v")), tables, "classes")
    keys = tables.save(copies.join(roots.withColumnRenamed("node", "k"), "k", "left").join(counts, "k", "left").select("k", F.coalesce("root", "k").alias("class_key"), "n", "links", "texts"), "keys")
    out = rows.select("uid", "doc_id", "k").join(keys, "k", "left")
    best = out.where(F.col("k").isNotNull()).groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best"))
    best = tables.save(best.select("class_key", F.col("best.doc_id").alias("b_id"), F.col("best.uid").alias("b_uid")), "best")
    members = tables.save(out, "members")
    tables.drop("rows", "heads", "nodes", "sizes", "groups", "sets", "links", "keys", *tables.kept("coarse-", "classes-"))
    out = members.join(best, "class_key", "left")
    return out.select(
        "uid", "doc_id", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("b_id")).alias("class_id"), "class_key",
        F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        (F.col("k").isNull() | (F.col("uid") == F.col("b_uid"))).alias("first"),
    )


def op8_jaccard_join(spark, sf_dir):
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_text_links")


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLE = {
    "op8_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT i, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT i, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM g GROUP BY 1),
c AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.i <> b.i GROUP BY 1, 2),
e AS (SELECT a, b, y.s AS s, x.s <> y.s AS other FROM c JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r(i, j) AS (SELECT i, i FROM d UNION SELECT r.i, e.b FROM r JOIN e ON e.a = r.j),
k AS (SELECT r.i, min(d.doc_id) AS class_id FROM r JOIN d ON d.i = r.j GROUP BY 1),
l AS (SELECT a, count(*) AS links, count(DISTINCT s) FILTER (WHERE other) AS texts FROM e GROUP BY 1)
SELECT doc_id, class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(texts, 0)::BIGINT AS n_text_links FROM d JOIN k USING (i) LEFT JOIN l ON l.a = d.i
"""
}
