"""Suffix-array deduplication by the difference-cover algorithm.

Texts are treated as UTF-8 bytes. The corpus is dealt to shards by content
(``repeats``), and every shard builds the suffix array of its segments with the
difference cover {1, 2} mod 3: the triples at sampled places are sorted and named,
the names are sorted by recursion, the remaining suffixes are merged in; then
neighbours in the array are compared over the length of a window. A suffix array
of the whole corpus at once would shuffle every suffix once per recursion level.

Null text: empty. Texts shorter than the window keep all bytes, others are read
whole; equal texts of a window or more lose every byte. Matches never cross
texts. Empty table: no rows. Other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import Tables
from .repeats import Repeats

WINDOW = 400


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array of an array of integers from 1 up; fewer than 2**30 values, symbols below 2**30."""
    n = len(x)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
    top = int(x.max()) + 1
    p = np.concatenate([x.astype(np.int64), np.zeros(3, np.int64)])
    # a sampled place may lie just behind the end, so that every suffix outside the cover has a sampled next one
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    # of three values in one number the first two are named before, where all three would not fit
    pair = p[:-1] * top + p[1:]
    if top >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[sample] * top + p[sample + 2]
    names, name = np.unique(triple, return_inverse=True)
    if len(names) < len(sample):
        order = suffix_array(name + 1)
    else:
        order = np.empty(len(sample), np.int64)
        order[name] = np.arange(len(sample))
    rank = np.zeros(n + 4, np.int64)  # 0 behind the end
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    m = n + 4
    rest_key = p[rest] * m + rank[rest + 1]
    rest = rest[np.argsort(rest_key, kind="stable")]
    # where the rest goes among the sampled: two sorted lists to search, one for each class of the cover
    key1 = lambda i: p[i] * m + rank[i + 1]
    if top < 1 << 20 and top * top * m >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    key2 = lambda i: pair[i] * m + rank[i + 2]
    mod = sampled % 3
    first, second = sampled[mod == 1], sampled[mod == 2]
    r1, r2 = key1(rest), key2(rest)
    place_rest = np.arange(len(rest)) + np.searchsorted(key1(first), r1) + np.searchsorted(key2(second), r2)
    before = np.empty(len(sampled), np.int64)
    before[mod == 1] = np.searchsorted(r1, key1(first))
    before[mod == 2] = np.searchsorted(r2, key2(second))
    out = np.empty(n, np.int64)
    out[place_rest] = rest
    out[np.arange(len(sampled)) + before] = sampled
    return out


def decide(segments: list[tuple[bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """Flags of the windows of each (bytes, occurrences) that occur twice or more among all of them."""
    sizes = np.array([len(d) for d, _ in segments])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    joined = np.frombuffer(b"\0".join(d for d, _ in segments) + b"\0", np.uint8)
    x = joined.astype(np.int64) + len(segments) + 1
    x[ends - 1] = np.arange(1, len(segments) + 1)  # an end mark of its own for each segment
    array = suffix_array(x)
    room = np.zeros(len(x) + 1, np.int64)
    np.add.at(room, starts, 1)
    np.add.at(room, starts + sizes - window + 1, -1)
    valid = np.cumsum(room)[:-1] > 0  # places where a whole window fits into the segment
    array = array[valid[array]]
    a, b = array[:-1], array[1:]
    # eight bytes at a time
    wide = np.concatenate([joined, np.zeros(8, np.uint8)])
    packed = np.zeros(len(joined), np.uint64)
    for i in range(8):
        packed = (packed << np.uint64(8)) | wide[i : i + len(joined)].astype(np.uint64)
    same = np.arange(len(a))
    steps = [*range(0, window - 7, 8)] + ([window - 8] if window % 8 and window >= 8 else [])
    for d in steps:
        same = same[packed[a[same] + d] == packed[b[same] + d]]
    if window < 8:
        for d in range(window):
            same = same[joined[a[same] + d] == joined[b[same] + d]]
    twice = np.zeros(len(x), bool)
    twice[a[same]] = True
    twice[b[same]] = True
    return [np.ones(n - window + 1, bool) if times > 1 else twice[s : s + n - window + 1] for s, n, (_, times) in zip(starts, sizes, segments, strict=True)]


def byte_values(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)


def bytes_of(window: int) -> Repeats:
    return Repeats("bytes", window, max(1, window // 6), str.encode, lambda: byte_values, lambda u, i, j: u[i:j], lambda s: decide(s, window), 500_000)


def without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in ranges:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def digest(data: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept = without(data, ranges)
    return len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row per row of docs(doc_id, text)."""
    repeats, tables = bytes_of(window), Tables(docs.sparkSession, "suffix")
    kept = repeats.cut(docs, tables, digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return repeats.joined(docs.select("doc_id", "text"), kept).select("__row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_suffix_dedup(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE = {
    "op2_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM d),
w AS (SELECT i, p, md5(array_slice(b, p, p + 399)) AS g FROM (SELECT i, b, unnest(range(1, n - 398)) AS p FROM n WHERE n >= 400)),
r AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
s AS (SELECT i, p, sum(fresh) OVER (PARTITION BY i ORDER BY p) AS run FROM (SELECT i, p, CASE WHEN p - lag(p) OVER (PARTITION BY i ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM r)),
c AS (SELECT i, min(p) AS a, max(p) + 400 AS z FROM s GROUP BY i, run),
e AS (SELECT i, z AS start FROM c UNION ALL SELECT i, 1 FROM n),
k AS (SELECT e.i, e.start, coalesce(min(c.a), any_value(n.n) + 1) AS stop FROM e JOIN n ON n.i = e.i LEFT JOIN c ON c.i = e.i AND c.a >= e.start GROUP BY 1, 2),
t AS (SELECT k.i, string_agg(CASE WHEN stop > start THEN hex(array_slice(b, start, stop - 1)) ELSE '' END, '' ORDER BY start) AS kept FROM k JOIN n ON n.i = k.i GROUP BY 1),
u AS (SELECT i, sum(z - a) AS gone, count(*) AS spans FROM c GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN t USING (i) LEFT JOIN u USING (i)
"""
}
