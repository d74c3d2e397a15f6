"""Exact repeats over a whole corpus, sharded by content.

Both substring and suffix-array deduplication ask which windows of W units (words
or bytes) start at two places or more. Windows are dealt to shards by their
minimizer, the smallest hash among their K-unit grams: equal windows have equal
minimizers, so all occurrences of a window meet in one shard, and a run of
neighbouring windows with the same minimizer travels as one segment. Only
minimizers that occur twice send segments at all.

1. Equal texts become one text with its number of copies (a text that occurs twice
   is all repeats), kept in a table bucketed by text key; later joins on the key
   read it without a shuffle.
2. Minimizers are counted. One that more than ``HOT`` runs share (a line in a third
   of all documents) is not a shard: the common grams around it are found, and its
   windows are dealt again with those grams last in order. Windows that reach out of
   a common passage then go with a rare gram; those wholly inside it are equal
   between documents, so their segments collapse. What is still too common without
   being made of common grams only is dealt by the whole window.
3. Segments of candidate runs, collapsed per task, go to their shard with the number
   of their places; there the operator's own structure (suffix automaton or suffix
   array) decides exactly. A shard of very many different segments is dealt again
   first, by whole windows.
4. What a shard found meets the segments' places in a join of two tables, which is
   split where a segment is hot; the ranges go by text key and are cut out.

Text keys are 64 bits that hash the SHA-256 of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, rolled, shuffle_partitions, sliding_min

HOT = 2000
#: No segment has more windows than this.
LONGEST = 2048
#: Bytes of different segments in a shard, beyond which its windows are dealt one by one.
LARGEST = 16_000_000

RUNS = "mini long, k long, s int, n int, weight int"


def text_key(text):
    """64 bits of the SHA-256 of a text, null counting as empty."""
    return F.xxhash64(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


#: Common grams that are set last; a bound on what is broadcast.
COMMON = 200_000


def marked(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which of n places lie in ranges of (start, length)."""
    step = np.zeros(n + 1, np.int64)
    for a, m in ranges:
        step[a] += 1
        step[min(n, a + m)] -= 1
    return np.cumsum(step)[:n] > 0


def gram_order(values: np.ndarray, k: int, common: np.ndarray | None) -> np.ndarray:
    """The hashes that grams are ordered by: 63 bits, common grams (sorted) after all others."""
    grams = rolled(values, k) >> np.uint64(1)
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        grams = grams | ((common[at] == grams).astype(np.uint64) << np.uint64(63))
    return grams


def window_runs(values: np.ndarray, w: int, k: int, ranges: list[tuple[int, int]] | None = None, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, weight) of each run; weight is 2 where the gram occurs again in this text. A negative minimizer is a common gram."""
    empty = np.empty(0, np.int64)
    n = len(values) - w + 1
    if n <= 0:
        return empty, empty, empty, empty
    grams = gram_order(values, k, common)
    mini = sliding_min(grams, w - k + 1)
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(mini[1:], mini[:-1], out=cut[1:])
    inside = None
    if ranges is not None:
        inside = marked(n, ranges)
        cut[1:] |= inside[1:] != inside[:-1]
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, n))
    if size.max() > LONGEST:
        more = [np.arange(s, s + m, LONGEST) for s, m in zip(start, size, strict=True)]
        start = np.concatenate(more)
        size = np.diff(np.append(start, n))
    if inside is not None:
        start, size = start[inside[start]], size[inside[start]]
    m = mini[start]
    found, counts = np.unique(grams, return_counts=True)
    weight = np.ones(len(m), np.int64)
    if len(found) < len(grams):
        weight += counts[np.searchsorted(found, m)] > 1
    return m.view(np.int64), start, size, weight


def ranges_of(flags: np.ndarray, w: int) -> list[tuple[int, int]]:
    """[from, to) of the units covered by flagged windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > w)
    return list(zip(at[np.append(0, new + 1)].tolist(), (at[np.append(new, len(at) - 1)] + w).tolist(), strict=True))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Repeats:
    """The stages above for one kind of unit.

    split(text) -> units; values(units) -> uint64 array; packed(units, i, j) -> bytes of a segment;
    decide(segments) -> flags of repeated windows for each (bytes, occurrences) of whole shards.
    """

    def __init__(self, name: str, window: int, gram: int, split: Callable, values: Callable[[], Callable], packed: Callable, decide: Callable, batch: int):
        self.name, self.window, self.gram = name, window, gram
        self.split, self.values, self.packed, self.decide, self.batch = split, values, packed, decide, batch

    def texts(self, docs: DataFrame, tables: Tables) -> DataFrame:
        """(k, n, text), a row per different text, bucketed by k."""
        t = docs.select(text_key(F.col("text")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
        t = t.groupBy("k").agg(F.count("*").alias("n"), F.first("text").alias("text"))
        return tables.save_bucketed(t, "texts", "k", shuffle_partitions(docs.sparkSession))

    def common(self, part: DataFrame) -> np.ndarray:
        """The grams that many of the ranges of part(k, text, ranges) hold. Any set will do, as long as all tasks use the same: what tasks see once each is left out."""
        w, k, split, make = self.window, self.gram, self.split, self.values

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, held, size = make(), [], 0

            def out():
                grams, counts = np.unique(np.concatenate(held), return_counts=True)
                keep = counts > 1
                return pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(counts[keep])], names=["g", "c"])

            for b in batches:
                for t, ranges in zip(b.column("text"), b.column("ranges").to_pylist(), strict=True):
                    grams = gram_order(values(split(t.as_py())), k, None)
                    held.append(grams[marked(len(grams), [(r["s"], r["n"] + w - k) for r in ranges])])
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()

        found = part.mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") > HOT // 4)
        rows = found.orderBy(F.col("c").desc(), "g").limit(COMMON).select("g").toPandas()
        return np.sort(rows["g"].to_numpy(np.int64).view(np.uint64))

    def runs(self, texts: DataFrame, k: int, common: np.ndarray | None = None) -> DataFrame:
        """Runs of texts(k, text) or, where they are given, of the windows in texts(k, text, ranges)."""
        shared = None if common is None else texts.sparkSession.sparkContext.broadcast(common)
        ranged, w, split, make = "ranges" in texts.columns, self.window, self.split, self.values

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, last = make(), None if shared is None else shared.value
            for b in batches:
                got: list[list] = [[], [], [], [], []]
                size = 0
                ranges = b.column("ranges").to_pylist() if ranged else [None] * len(b)
                for key, t, r in zip(b.column("k").to_pylist(), b.column("text"), ranges, strict=True):
                    found = window_runs(values(split(t.as_py())), w, k, None if r is None else [(x["s"], x["n"]) for x in r], last)
                    if len(found[0]):
                        for c, x in zip(got, (found[0], np.full(len(found[0]), key), *found[1:]), strict=True):
                            c.append(x)
                        size += len(found[0])
                    if size > 200_000:
                        yield arrow(got)
                        got, size = [[], [], [], [], []], 0
                if size:
                    yield arrow(got)

        def arrow(got):
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(got, types, strict=True)], names=["mini", "k", "s", "n", "weight"])

        return texts.mapInArrow(rows, RUNS)

    def candidates(self, texts: DataFrame, tables: Tables) -> DataFrame:
        """(k, ranges: array of (s, n, shard)): the runs of each text whose windows may repeat."""
        kept, part, common = [], texts.select("k", "text"), None
        for level, k in enumerate((self.gram, self.gram, self.window)):
            runs = tables.save(self.runs(part, k, common if level == 1 else None), f"runs{level}")
            counts = tables.save(runs.groupBy("mini").agg(F.sum("weight").alias("c")).where("c > 1"), f"counts{level}")
            hot = (F.col("c") > HOT) & (F.col("mini") >= 0) if level < 2 else F.lit(False)
            found = tables.save(runs.join(counts, "mini").select("k", "s", "n", F.xxhash64("mini", F.lit(level)).alias("shard"), hot.alias("hot")), f"found{level}")
            tables.drop(f"runs{level}", f"counts{level}")
            kept.append(found.where(~F.col("hot")))
            if not found.where("hot").limit(1).count():
                break
            ranges = found.where("hot").groupBy("k").agg(F.collect_list(F.struct("s", "n")).alias("ranges"))
            part = texts.select("k", "text").join(ranges, "k")
            if level == 0:
                common = self.common(part)
        out = kept[0]
        for x in kept[1:]:
            out = out.unionByName(x)
        return out.groupBy("k").agg(F.collect_list(F.struct("s", "n", "shard")).alias("ranges"))

    def segments(self, texts: DataFrame, candidates: DataFrame) -> DataFrame:
        """(shard, seg, data, n, occ): the segments of the candidate runs, equal ones collapsed per task; n are their windows, occ the places (k, s)."""
        w, split, packed = self.window, self.split, self.packed
        places = pa.list_(pa.struct([("k", pa.int64()), ("s", pa.int32())]))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, bytes], list] = {}
            size = 0

            def out():
                keys, at = list(held), list(held.values())
                cols = [pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.binary()), pa.array([x[0] for x in at], pa.int32()), pa.array([x[1:] for x in at], places)]
                return pa.RecordBatch.from_arrays(cols, names=["shard", "data", "n", "occ"])

            for b in batches:
                for key, t, ranges in zip(b.column("k").to_pylist(), b.column("text"), b.column("ranges").to_pylist(), strict=True):
                    units = split(t.as_py())
                    for r in ranges:
                        data = packed(units, r["s"], r["s"] + r["n"] + w - 1)
                        at = held.get((r["shard"], data))
                        if at is None:
                            held[r["shard"], data] = at = [r["n"]]
                            size += len(data) + 200
                        at.append({"k": key, "s": r["s"]})
                        size += 100
                    if size > 48_000_000:
                        yield out()
                        held.clear()
                        size = 0
            if held:
                yield out()

        wanted = texts.select("k", "text").join(candidates, "k")
        return wanted.mapInArrow(rows, "shard long, data binary, n int, occ array<struct<k:long,s:int>>").withColumn("seg", F.xxhash64("data"))

    def dealt(self, texts: DataFrame, tables: Tables) -> DataFrame:
        """The segments of all candidates; a shard of more than ``LARGEST`` bytes of different segments is dealt again by whole windows."""
        found = tables.save(self.segments(texts, self.candidates(texts, tables)), "segments")
        sizes = found.groupBy("shard", "seg").agg(F.max(F.length("data")).alias("m")).groupBy("shard").agg(F.sum("m").alias("m"))
        large = tables.save(sizes.where(F.col("m") > LARGEST).select("shard"), "large")
        if not large.limit(1).count():
            return found
        back = found.join(large, "shard", "left_semi").select("n", F.explode("occ").alias("o")).groupBy("o.k").agg(F.collect_list(F.struct("o.s", "n")).alias("ranges"))
        runs = tables.save(self.runs(texts.select("k", "text").join(back, "k"), self.window), "runs3")
        counts = tables.save(runs.groupBy("mini").agg(F.sum("weight").alias("c")).where("c > 1"), "counts3")
        again = runs.join(counts, "mini").groupBy("k").agg(F.collect_list(F.struct("s", "n", F.xxhash64("mini", F.lit(3)).alias("shard"))).alias("ranges"))
        again = tables.save(self.segments(texts, again), "segments3")
        return found.join(large, "shard", "left_anti").unionByName(again)

    def removed(self, texts: DataFrame, tables: Tables) -> DataFrame:
        """(k, cuts: array of (a, b)): the units of each text that repeated windows cover."""
        w, decide, batch = self.window, self.decide, self.batch

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(groups: dict):
                whole = [(shard, data, x) for shard, g in groups.items() for data, x in g.items()]
                rows: list[tuple] = []
                for (shard, _, (seg, _)), flags in zip(whole, decide([(data, times) for _, data, (_, times) in whole]), strict=True):
                    rows += [(shard, seg, a, b) for a, b in ranges_of(flags, w)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["shard", "seg", "a", "b"])

            groups: dict[int, dict[bytes, list]] = {}
            size = 0
            for b in batches:
                for shard, seg, data, times in zip(*(b.column(x).to_pylist() for x in ("shard", "seg", "data", "times")), strict=True):
                    if shard not in groups and size > batch:  # rows come sorted by shard, so all in hand are whole
                        yield out(groups)
                        groups, size = {}, 0
                    g = groups.setdefault(shard, {})
                    if data in g:
                        g[data][1] += times
                    else:
                        g[data] = [seg, times]
                        size += len(data)
            if groups:
                yield out(groups)

        # a shard gets each different segment once a task at most, and only their number: the places stay, and what was found goes to them by a join
        found = self.dealt(texts, tables)
        sent = found.select("shard", "seg", "data", F.size("occ").alias("times")).repartition(shuffle_partitions(texts.sparkSession), "shard").sortWithinPartitions("shard")
        flags = tables.save(sent.mapInArrow(shards, "shard long, seg long, a int, b int"), "flags")
        cuts = found.select("shard", "seg", F.explode("occ").alias("o")).join(flags, ["shard", "seg"])
        return cuts.groupBy("o.k").agg(F.collect_list(F.struct((F.col("o.s") + F.col("a")).alias("a"), (F.col("o.s") + F.col("b")).alias("b"))).alias("cuts"))

    def cut(self, docs: DataFrame, tables: Tables, keep: Callable, kind: str) -> DataFrame:
        """(k, ...): keep(units, ranges) of each different text, where ranges are the maximal removed ones; ``kind`` names and types its values."""
        texts = self.texts(docs, tables)
        cuts = self.removed(texts, tables)
        w, split = self.window, self.split
        names = [x.split()[0] for x in kind.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in kind.split(", ")]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for t, n, c in zip(b.column("text"), b.column("n").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                    units = split(t.as_py())
                    ranges = [(0, len(units))] if n > 1 and len(units) >= w else merged([(x["a"], x["b"]) for x in c or ()])
                    out.append(keep(units, ranges))
                cols = list(zip(*out, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(x, y) for x, y in zip(cols, types, strict=True))], names=["k", *names])

        kept = tables.save(texts.join(cuts, "k", "left").mapInArrow(rows, f"k long, {kind}"), "kept")
        tables.drop("texts", *tables.kept("found", "segments", "large", "flags", "runs3", "counts3"))
        return kept

    def joined(self, docs: DataFrame, kept: DataFrame) -> DataFrame:
        """Each row of docs, as ``__row``, with what was kept of its text."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_key(F.col("text")).alias("k"))
        return rows.join(kept, "k").drop("k")
