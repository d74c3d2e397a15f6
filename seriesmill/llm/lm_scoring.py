"""Language-model scoring with a log-frequency Bloom filter.

The model is a bigram model interpolated with unigrams. Quantised counts of all
unigrams and bigrams of the training texts are kept in one Bloom filter: an n-gram
of count c is inserted with the levels 1..q, q = 1 + floor(log_ratio(c)), and its
count is read back by probing level after level until one is absent. The filter is
cut into shards of the n-gram hash, each built by the task that adds up the shard's
counts, and has ``bits`` bits for each insert at every size. No n-gram is dropped.

A filter that is sure to fit (two inserts a training token at most) below
``filter_mb``, the session's broadcast threshold unless given, is joined on the
driver and broadcast. Any other stays in its shards: the different n-grams of some
300,000 tokens at a time are sent there with their training counts, and the levels
come back. Both ways give the same scores. Shards are as many as keep the keys of
one task at some ``SHARD_TOKENS``, whatever the size of the corpus.

The base score needs exact counts. Those of up to ``HEAD`` of the most frequent
words are broadcast; those of all others meet their documents in a shuffle join, so
that no frequent word is a join key. ``score`` takes no count from there.

Null text: empty, so only the end token. Null doc_id: its text is taken as '',
which puts it into training. Ids may have any type. Repeated rows and ids are
scored each for itself. Very long texts are processed whole. Empty table: no rows.
Other columns, of any name, are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Tables, mixed, shuffle_partitions, word_hash

END = b"\n"  # no word holds a blank, so the end token is none of them
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HEAD = 100_000
RATIO = 1.5
BITS_PER_INSERT = 10
PROBES = 5
CHUNK_TOKENS = 300_000
SHARD_TOKENS = 4_000_000
START = np.uint64(0x1234567)
ONE = np.uint64(0xA5A5A5A5A5A5A5A5)  # sets unigram keys apart from bigram keys
#: Inside its shard a key is its last 48 bits.
LOW = np.uint64((1 << 48) - 1)


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode().translate(FOLD).split()
    words.append(END)
    return words


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it."""
    return mixed(before + h * BASE)


def shifted(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value before each one of some texts; ``start`` for the first of each."""
    out = np.concatenate([x[:1], x[:-1]])
    out[first] = start
    return out


def unigram_keys(h: np.ndarray) -> np.ndarray:
    return mixed(h ^ ONE)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(RATIO) + 1e-9).astype(np.int64)


#: No 64-bit count has more levels; a filter whose bits are all set answers this.
MOST = int(levels(np.array([2.0**63]))[0])
#: The least count of a level, and a bound that no count of the level exceeds; level 0 is an n-gram not seen.
LEAST = np.concatenate([[0.0], np.ceil(RATIO ** np.arange(MOST) - 1e-9)])
BOUND = np.concatenate([[0.0], RATIO ** np.arange(1, MOST + 1)])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 1


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the key, so that sorted keys lie shard by shard."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def positions(keys: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits that an n-gram at a level has inside its shard of ``bits`` bits."""
    a = mixed((keys & LOW) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    b = mixed(a) | np.uint64(1)
    size = np.asarray(bits).astype(np.uint64)
    for _ in range(PROBES):
        yield (((a >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)
        a = a + b


def filled(keys: np.ndarray, q: np.ndarray, per_insert: int) -> np.ndarray:
    """The bytes of a shard that holds the keys with their levels."""
    bits = max(64, -(-int(q.sum()) * per_insert // 8) * 8)
    data = np.zeros(bits, bool)
    level = 1
    while len(keys):
        for p in positions(keys, level, bits):
            data[p] = True
        level += 1
        keys, q = keys[q >= level], q[q >= level]
    return np.packbits(data, bitorder="little")


class Filter:
    """Shards one after the other; ``sizes`` are their bytes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.bits = data, sizes * 8
        self.starts = np.cumsum(self.bits) - self.bits

    def level_of(self, keys: np.ndarray) -> np.ndarray:
        """How many levels each of some different keys has, 0 where it is absent."""
        out = np.zeros(len(keys), np.uint8)
        shard = shard_of(keys, len(self.bits)) if len(self.bits) > 1 else np.zeros(len(keys), np.int64)
        start, bits = self.starts[shard], self.bits[shard]
        at, level = np.flatnonzero(bits), 0
        while len(at) and level < MOST:
            level += 1
            a = mixed((keys[at] & LOW) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
            b = mixed(a) | np.uint64(1)
            for _ in range(PROBES):  # the same places as positions(), but only for keys not yet ruled out
                p = start[at] + (((a >> np.uint64(32)) * bits[at].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                there = (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                at, a, b = at[there], (a + b)[there], b[there]
            out[at] = level
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over docs(text); counted in each partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        for b in batches:
            for t in b.column("text"):
                seen.update(tokens(t.as_py()))
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Words(dict):
    """Number of each word seen by a task, with its hash and its place among the head words; ``of`` empties it when it is large."""

    def __init__(self, head: dict[bytes, int], limit: int = 400_000):
        super().__init__()
        self.head, self.limit, self.hashes, self.places = head, limit, array("Q"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(word_hash(word))
        self.places.append(self.head.get(word, -1))
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words among the different ones in hand, and the hashes and places of those."""
        if len(self) > self.limit:
            self.clear()
            self.hashes, self.places = array("Q"), array("q")
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        used = np.zeros(len(self), bool)
        used[n] = True
        number = np.cumsum(used) - 1
        at = np.flatnonzero(used)
        # copies: an array that numpy looks into cannot grow
        return number[n], np.array(self.hashes, np.uint64)[at], np.array(self.places, np.int64)[at]


#: The texts of one chunk, in the row of the first of them: their uids, sizes and whether they train; the number of each token's word, and the words' hashes.
PART = ("uids", "sizes", "train", "words", "hashes")


def packed(x: np.ndarray, top: int) -> bytes:
    """Whole numbers up to ``top`` in as few bytes as hold it."""
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.empty(0, np.uint8)


class Chunk:
    """A part, opened: what its n-grams are and how often its training texts have them."""

    def __init__(self, part: dict):
        self.uids = np.frombuffer(part["uids"], np.int64)
        self.sizes = unpacked(part["sizes"], len(self.uids)).astype(np.int64)
        self.hashes = np.frombuffer(part["hashes"], np.uint64)
        self.words = unpacked(part["words"], int(self.sizes.sum())).astype(np.int64)
        self.train = np.frombuffer(part["train"], bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.zeros(len(self.words), bool)
        self.first[self.starts] = True
        h = self.hashes[self.words]
        every = np.concatenate([unigram_keys(self.hashes), pair_keys(shifted(h, self.first, START), h)])
        self.keys, self.place = np.unique(every, return_inverse=True)

    def counts(self) -> np.ndarray:
        """Training count of each key."""
        own = np.repeat(self.train, self.sizes).astype(float)
        weights = np.concatenate([np.bincount(self.words, own, len(self.hashes)), own])
        return np.bincount(self.place, weights, len(self.keys)).astype(np.int64)

    def scores(self, found: np.ndarray, n: int, v: int, texts: int, weight: float) -> np.ndarray:
        """log10 probability of each text, from the level of each key.

        Lower bounds of the counts above, upper bounds below, so that no history's
        words add up to more than one but for the filter's false positives.
        """
        q = found[self.place]
        word, pair = q[: len(self.hashes)], q[len(self.hashes) :]
        uni = ((LEAST[word] + 0.5) / (n + 0.5 * (v + 1)))[self.words]
        history = shifted(BOUND[word][self.words], self.first, texts)
        share = np.minimum(1.0, LEAST[pair] / np.maximum(1.0, history))
        return np.add.reduceat(np.log10(weight * share + (1 - weight) * uni), self.starts)


ASKS = "shard long, chunk long, keys binary, counts binary"


def asks_of(parts: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, keys, counts): the different n-grams of each chunk, by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, part in zip(b.column("chunk").to_pylist(), b.column("part"), strict=True):
                c = Chunk(part.as_py())
                counts, ends = c.counts(), np.searchsorted(shard_of(c.keys, shards), np.arange(shards + 1))
                low = np.ascontiguousarray(c.keys[:, None].view(np.uint8)[:, :6])
                at = [(s, i, j) for s, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i]
                cols = ([s for s, _, _ in at], [chunk] * len(at), [low[i:j].tobytes() for _, i, j in at], [packed(counts[i:j], int(counts[i:j].max())) for _, i, j in at])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "chunk", "keys", "counts"])

    # one shard to a task: by hash some tasks would get several
    return parts.mapInArrow(ask, ASKS).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")


ANSWERS = "shard long, chunk long, data binary"


def answers_of(asks: DataFrame, per_insert: int, whole: bool) -> DataFrame:
    """Each shard's filter (whole; chunk is null), or the levels that it has for the keys of each chunk."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(shard):
            wide = np.zeros((sum(len(k) for _, k, _ in held), 8), np.uint8)
            wide[:, :6] = np.concatenate([k for _, k, _ in held])
            keys, back = np.unique(wide.view(np.uint64)[:, 0], return_inverse=True)
            total = np.bincount(back, np.concatenate([c for _, _, c in held]), len(keys))
            data = filled(keys[total > 0], levels(total[total > 0]), per_insert)
            if whole:
                rows = [(None, data.tobytes())]
            else:
                found = Filter(data, np.array([len(data)])).level_of(keys)[back]
                ends = np.cumsum([0] + [len(k) for _, k, _ in held])
                rows = [(chunk, found[i:j].tobytes()) for (chunk, _, _), i, j in zip(held, ends, ends[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["shard", "chunk", "data"])

        now = None
        for b in batches:  # rows come sorted by shard
            for shard, chunk, keys, counts in zip(b.column("shard").to_pylist(), b.column("chunk").to_pylist(), b.column("keys"), b.column("counts"), strict=True):
                if held and shard != now:
                    yield out(now)
                    held.clear()
                now = shard
                low = np.frombuffer(keys.as_py(), np.uint8).reshape(-1, 6)
                held.append((chunk, low, unpacked(counts.as_py(), len(low))))
        if held:
            yield out(now)

    return asks.mapInArrow(answer, ANSWERS)


class Model:
    """Exact counts and numbers of the training texts, and where the n-grams' levels come from: a whole filter, or the answers of its shards."""

    def __init__(self, vocabulary: DataFrame, n: int, v: int, texts: int, weight: float):
        self.vocabulary, self.n, self.v, self.texts, self.weight = vocabulary, n, v, texts, weight
        self.denominator = n + 0.5 * (v + 1)
        self.filter: Filter | None = None

    def head(self) -> tuple[dict[bytes, int], np.ndarray]:
        """Places of the most frequent words, at most HEAD, and their counts; place -1 reads the last."""
        # the count that at most HEAD words reach, from a histogram of some hundred rows; no sort of the vocabulary
        bin_ = F.floor(F.log(F.col("c").cast("double")) / F.log(F.lit(1.05))).cast("int")
        bins = self.vocabulary.groupBy(bin_.alias("b")).agg(F.count("*").alias("m")).orderBy(F.col("b").desc()).collect()
        fits = [b for b, total in zip((r.b for r in bins), accumulate(r.m for r in bins), strict=True) if total <= HEAD]
        top = self.vocabulary.where(bin_ >= (fits[-1] if fits else 2**30)).toPandas()
        return {bytes(t): i for i, t in enumerate(top["token"])}, np.concatenate([top["c"].to_numpy(np.int64), [0]])

    def scored(self, parts: DataFrame, answers: DataFrame | None) -> DataFrame:
        """(uid, score) of the texts in parts(chunk, part)."""
        n, v, texts, weight = self.n, self.v, self.texts, self.weight

        def rows(c: Chunk, found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.uids), pa.array(c.scores(found, n, v, texts, weight))], names=["uid", "score"])

        if answers is None:
            shared = parts.sparkSession.sparkContext.broadcast((self.filter.data, self.filter.bits // 8))

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                f = Filter(*shared.value)
                for b in batches:
                    for part in b.column("part"):
                        c = Chunk(part.as_py())
                        yield rows(c, f.level_of(c.keys))

            return parts.select("part").mapInArrow(probe, "uid long, score double")

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, found = None, []
            for b in batches:
                for part, data in zip(b.column("part"), b.column("data"), strict=True):
                    if part.is_valid:  # first among the rows of its chunk; the answers follow shard by shard, as the keys lie
                        if c is not None:
                            yield rows(c, np.frombuffer(b"".join(found), np.uint8))
                        c, found = Chunk(part.as_py()), []
                    else:
                        found.append(data.as_py())
            if c is not None:
                yield rows(c, np.frombuffer(b"".join(found), np.uint8))

        own = parts.select(F.lit(-1).cast("long").alias("shard"), "chunk", F.lit(None).cast("binary").alias("data"), "part")
        both = own.unionByName(answers, allowMissingColumns=True)
        return both.repartition(shuffle_partitions(parts.sparkSession), "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(finish, "uid long, score double")


def counted(docs: DataFrame, tables: Tables, weight: float = 0.3) -> Model:
    """The exact counts of docs(text)."""
    vocabulary = tables.save(word_counts(docs), "words")
    n, v, texts = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("token") == F.lit(END), F.col("c"))), F.lit(0))).first()
    return Model(vocabulary, int(n), int(v), int(texts), weight)


def chunks(docs: DataFrame, model: Model) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, head_known, head_sum, tail, part for docs(uid, doc_id, held_out, text): all that needs the texts, read once."""
    head, head_counts = model.head()
    shared = docs.sparkSession.sparkContext.broadcast((head, head_counts))
    denominator = model.denominator

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_counts = shared.value
        table = Words(head)
        logs = np.log10((head_counts + 0.5) / denominator)
        names = ["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "tail", "part"]
        kinds = pa.struct([(x, pa.binary()) for x in PART])
        for b in batches:
            cols: list[list] = [[], [], []]
            tail_tokens, tail_counts, tail_ends = [], [], [0]
            held: list[list[bytes]] = []
            uids, train, parts = b.column("uid").to_numpy(), ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool), []

            def flush():
                size = np.array([len(x) for x in held])
                ends = np.cumsum(size)
                starts = ends - size
                words = [w for x in held for w in x]
                number, hashes, places = table.of(words)
                place = places[number]
                known = place >= 0
                own = slice(len(cols[0]), len(cols[0]) + len(held))
                parts.extend([dict(zip(PART, (uids[own].tobytes(), packed(size, int(size.max())), train[own].tobytes(), packed(number, len(hashes)), hashes.tobytes()), strict=True))] + [None] * (len(held) - 1))
                cols[0] += size.tolist()
                cols[1] += np.add.reduceat(known.astype(np.int64), starts).tolist()
                cols[2] += np.add.reduceat(np.where(known, logs[place], 0.0), starts).tolist()
                rare = np.flatnonzero(~known)
                bounds = np.searchsorted(rare, np.concatenate([starts, ends[-1:]])).tolist()
                rare = rare.tolist()
                for i, j in zip(bounds, bounds[1:], strict=False):
                    found = Counter([words[x] for x in rare[i:j]])
                    tail_tokens.extend(found)
                    tail_counts.extend(found.values())
                    tail_ends.append(len(tail_tokens))
                held.clear()

            size = 0
            for t in b.column("text"):
                held.append(tokens(t.as_py()))
                size += len(held[-1])
                if size > CHUNK_TOKENS:
                    flush()
                    size = 0
            if held:
                flush()
            pairs = pa.StructArray.from_arrays([pa.array(tail_tokens, pa.binary()), pa.array(tail_counts, pa.int32())], ["token", "n"])
            tail = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), pairs)
            types = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(x) for x in names[:3]] + [pa.array(c, k) for c, k in zip(cols, types, strict=True)] + [tail, pa.array(parts, kinds)], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"uid long, doc_id {id_type}, held_out boolean, n_tokens long, head_known long, head_sum double, tail array<struct<token:binary,n:int>>, part struct<{','.join(f'{x}:binary' for x in PART)}>"
    return docs.mapInArrow(read, kind)


def scores_of(parts: DataFrame, model: Model, tables: Tables, filter_mb: float | None, per_insert: int) -> DataFrame:
    """(uid, score) of parts(chunk, part): builds the filter, and reads it where it is."""
    spark = parts.sparkSession
    shards = max(shuffle_partitions(spark), model.n // SHARD_TOKENS + 1)
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() if filter_mb is None else filter_mb * 1e6
    # a token adds two counts, and a count of c has at most c levels
    whole = 2 * model.n * per_insert / 8 + 8 * shards <= most
    answers = tables.save(answers_of(asks_of(parts, shards), per_insert, whole), "answers")
    if whole:
        found = {r.shard: np.frombuffer(r.data, np.uint8) for r in answers.select("shard", "data").toLocalIterator()}
        pieces = [found.get(s, np.empty(0, np.uint8)) for s in range(shards)]
        model.filter = Filter(np.concatenate(pieces), np.array([len(p) for p in pieces]))
    scores = tables.save(model.scored(parts, None if whole else answers), "scores")
    tables.drop("answers")
    return scores


def score_documents(docs: DataFrame, *, weight: float = 0.3, filter_mb: float | None = None, per_insert: int = BITS_PER_INSERT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per row of docs(doc_id, text).

    weight: of the bigrams. filter_mb: the largest filter that is broadcast, the session's broadcast threshold if None. per_insert: bits.
    """
    tables = Tables(docs.sparkSession, "lm")
    d = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = counted(d.where(~F.col("held_out")).select("text"), tables, weight)
    # the ids given to rows are fixed by writing them
    rows = tables.save(chunks(d.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text"), model), "rows")
    parts = rows.where(F.col("part").isNotNull()).select(F.col("uid").alias("chunk"), "part")
    scores = scores_of(parts, model, tables, filter_mb, per_insert)
    tail = rows.select("uid", F.explode("tail").alias("x")).select("uid", "x.token", "x.n").join(model.vocabulary, "token", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / model.denominator)
    tail = tail.groupBy("uid").agg(F.sum(F.col("n") * log).alias("tail_sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    out = rows.drop("tail", "part").join(scores, "uid").join(tail, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known")).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + zero("tail_sum")).alias("base_score"), "score",
    )


def op5_lm_scoring(spark, sf_dir):
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLE = {}
