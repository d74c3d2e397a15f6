"""Quality classifier by co-training of a text view and a page-metadata view.

Two targets are learnt, quality and toxicity. For each, one logistic model sees
the words (hashed words, prefixes and suffixes), the other only metadata and
layout (language, source, lengths, shares of symbols, capitals and repeats). The
unlabelled documents are dealt to ``rounds`` parts; in each round all documents of
a part are scored, and each view hands the ``exchange`` different ones that it is
surest of, for either label, to the other view as pseudo-labelled rows. So every
unlabelled document is a candidate once. Both views are then calibrated (Platt) on
labelled rows that neither trained on, and a last logistic step on the calibrated
log-odds combines them. Every document is scored over its whole text.

Bounds: the models are fitted on at most ``labelled`` labelled rows, the first by a
hash of the id, and of those on at most ``fit_mb`` of features; a text has at most
2**BITS features, whatever its length. Pseudo-labelled rows are the method's own
number, 8 * exchange a round. These rows come to the driver; what is broadcast are
the labelled ids and weight vectors of 2**BITS floats. All else is a map over the
table; of a part only its tasks' surest rows are written and shuffled.

Null text: empty. Null language or source: a category of its own. Labels with a
null are ignored; labels of one class only, or none: the prior decides. Repeated
ids: each row is scored, all different copies of a labelled id may be fitted on.
Very long texts: read whole. Ties of confidence: by a hash of the row. Empty table:
no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, row_id

BITS = 18
META_BITS = 10
TARGETS = ("quality", "toxic")
VIEWS = ("text", "meta")
LAYOUT = 12
#: Log-odds from which a view is sure: more than nine in ten.
SURE = 2.2


def word_features(word: str) -> tuple[int, ...]:
    """Feature ids of a word: itself, its first five and its last three characters, case folded but for the last."""
    low = word.lower().strip(".,;:?\"'()")
    return crc32(low.encode(), WHOLE) >> SHIFT, crc32(low[:5].encode(), PREFIX) >> SHIFT, crc32(word[-3:].encode(), SUFFIX) >> SHIFT


crc32, SHIFT = zlib.crc32, 32 - BITS
#: Checksums that begin with the kind of the feature.
WHOLE, PREFIX, SUFFIX = crc32(b"w"), crc32(b"p"), crc32(b"s")


class Ids(dict):
    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        self[word] = value = word_features(word)
        return value


def text_features(text: str) -> bytes:
    """Distinct features of the distinct words, and in how many of those each is (at most 65535)."""
    found, counts = np.unique(np.array([i for w in set(text.split()) for i in IDS[w]], np.int32), return_counts=True)
    return found.tobytes() + np.minimum(counts, 65535).astype(np.uint16).tobytes()


IDS = Ids()


def meta_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """LAYOUT numbers, then one-hot places of language and source as floats."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    of = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
    capitals = sum(map(str.isupper, words))
    if capitals:
        capitals = sum(1 for w in words if len(w) > 1 and w.isupper())
    numbers = [
        np.log1p(n) / 5,
        np.log1p(len(lines)) / 3,
        min(2.0, 5 * of[SYMBOLS].sum() / n),
        min(1.0, capitals / n),
        min(1.0, of[33] / n),  # !
        len(set(words)) / n,
        min(2.0, chars / n / 8),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, 10 * of[48:58].sum() / chars),  # digits
        min(1.0, 5 * (of[46] + of[44]) / n),  # full stops and commas
        sum(map(operator.eq, words[1:], words)) / n,
        1.0 if n < 10 else 0.0,
    ]
    return np.asarray([*numbers, place("l", lang), place("s", source)], np.float32)


SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def place(kind: str, x: str | None) -> float:
    return float(zlib.crc32(f"{kind}{x}".encode()) % ((1 << META_BITS) - LAYOUT) + LAYOUT)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regressions for all targets by Adagrad over one row at a time; rows are (ids, values)."""

    def __init__(self, size: int):
        self.w, self.g = np.zeros((size, len(TARGETS))), np.full((size, len(TARGETS)), 1e-2)
        self.b, self.gb = np.zeros(len(TARGETS)), np.full(len(TARGETS), 1e-2)

    def score(self, ids, values) -> np.ndarray:
        return values @ self.w[ids] + self.b

    def fit(self, rows, y, weight, epochs: int, rate: float = 0.3, l2: float = 1e-5, seed: int = 1):
        """y and weight have a column for each target; weight 0: the row says nothing of it."""
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                ids, values = rows[k]
                own = self.w[ids]
                e = (sigmoid(values @ own + self.b) - y[k]) * weight[k]
                d = values[:, None] * e + l2 * own
                g = self.g[ids] + d * d
                self.g[ids] = g
                self.w[ids] = own - rate * d / np.sqrt(g)
                self.gb += e * e
                self.b -= rate * e / np.sqrt(self.gb)
        return self


def text_row(data: bytes):
    """Feature ids, and their counts scaled by the root of the number of all."""
    n = len(data) // 6
    counts = np.frombuffer(data, np.uint16, n, 4 * n).astype(float)
    return np.frombuffer(data, np.int32, n), counts / np.sqrt(max(1.0, counts.sum()))


def meta_row(data: bytes):
    x = np.frombuffer(data, np.float32)
    return np.concatenate([np.arange(LAYOUT), x[LAYOUT:].astype(np.int64)]), np.concatenate([x[:LAYOUT].astype(float), [0.5, 0.5]])


def platt(scores: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """(slope per column..., bias) of a logistic model by Newton steps with a small ridge."""
    x = np.column_stack([scores.reshape(len(y), -1), np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def log_odds(model: dict, text_score, meta_score) -> tuple:
    """Calibrated log-odds of the text view, of the metadata view, and combined."""
    a, b = (model["cal"][v] for v in VIEWS)
    t, m = a[0] * text_score + a[1], b[0] * meta_score + b[1]
    return t, m, model["mix"][0] * t + model["mix"][1] * m + model["mix"][2]


class Numbers(dict):
    """Numbers of the words asked for, in order; ``fresh`` are those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Scorer:
    """Raw scores of whole batches of texts under both views, a column for each target."""

    def __init__(self, views: dict):
        self.views, self.words, self.values = views, Numbers(), np.zeros((0, len(TARGETS)))

    def text(self, texts: list[str]) -> np.ndarray:
        out, at = np.zeros((len(texts), len(TARGETS))), 0
        while at < len(texts):
            flat: list[str] = []
            sizes, start = [], at
            while at < len(texts) and len(flat) < 200_000:
                own = set(texts[at].split())
                flat.extend(own)
                sizes.append(len(own))
                at += 1
            out[start:at] = self._some(flat, np.array(sizes))
        return out

    def _some(self, flat: list[str], sizes: np.ndarray) -> np.ndarray:
        w, b = self.views["text"]
        if len(self.words) > 400_000:
            self.words, self.values = Numbers(), np.zeros((0, len(TARGETS)))
        at = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        if fresh := self.words.fresh:
            ids = np.fromiter((i for x in fresh for i in word_features(x)), np.int64, 3 * len(fresh)).reshape(-1, 3)
            self.values = np.concatenate([self.values, w[ids].sum(axis=1, dtype=float)])
            fresh.clear()
        each = self.values[at]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.column_stack([np.bincount(doc, each[:, t], len(sizes)) for t in range(len(TARGETS))])
        return sums / np.sqrt(np.maximum(1, 3 * sizes))[:, None] + b

    def meta(self, x: np.ndarray) -> np.ndarray:
        w, b = self.views["meta"]
        return x[:, :LAYOUT].astype(float) @ w[:LAYOUT] + 0.5 * w[x[:, LAYOUT:].astype(np.int64)].sum(axis=1) + b


def metadata(texts, langs, sources) -> np.ndarray:
    return np.array([meta_features(t, x, s) for t, x, s in zip(texts, langs, sources, strict=True)]).reshape(-1, LAYOUT + 2)


FEATURES = "quality int, toxic int, text binary, meta binary"
SUREST = "target int, view int, label int, score double, place long, text binary, meta binary"


def surest(pool: DataFrame, views: dict, exchange: int) -> DataFrame:
    """Of pool(place, text, lang, source) the rows that each view is surest of, ``exchange`` different ones for each target and label."""
    shared = pool.sparkSession.sparkContext.broadcast(views)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            x = metadata(texts, b["lang"], b["source"])
            rows = []
            for v, scores in enumerate((scorer.text(texts), scorer.meta(x))):
                for t in range(len(TARGETS)):
                    for label in (0, 1):
                        s = scores[:, t] * (1 if label else -1)
                        # copies of one text are one row, so look at more than are wanted until there are enough different ones
                        seen = set()
                        for i in np.argsort(-s, kind="stable").tolist():
                            if s[i] <= SURE or len(seen) == exchange:
                                break
                            own = (texts[i], b["lang"].iloc[i], b["source"].iloc[i])
                            if own not in seen:
                                seen.add(own)
                                rows.append((t, v, label, s[i], b["place"].iloc[i], text_features(texts[i]), x[i].tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUREST.split(", ")])

    found = pool.mapInPandas(best, SUREST)
    keys = ["target", "view", "label"]
    # the same features twice: the first by place
    found = found.withColumn("same", F.xxhash64("text", "meta"))
    for part, most in (("same", 1), (F.pmod("place", F.lit(64)), exchange), (F.lit(0), exchange)):
        w = Window.partitionBy(*keys, part).orderBy(F.col("score").desc(), "place")
        found = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")
    return found.select("target", "view", "label", "score", "place", "text", "meta").orderBy(*keys, F.col("score").desc(), "place")


def labelled_rows(docs: DataFrame, known: DataFrame, tables: Tables, labelled: int, fit_mb: float) -> pd.DataFrame:
    """Features of the labelled documents, in hash order: at most ``labelled`` rows and ``fit_mb``."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            meta = [x.tobytes() for x in metadata(texts, b["lang"], b["source"])]
            yield pd.DataFrame({"quality": b["quality"].astype("Int32"), "toxic": b["toxic"].astype("Int32"), "text": list(map(text_features, texts)), "meta": meta})

    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(known), "doc_id").select("text", "lang", "source", "quality", "toxic")
    rows = rows.mapInPandas(features, FEATURES).distinct().withColumn("by", F.xxhash64("text", "meta", "quality", "toxic"))
    rows = tables.save(rows, "labelled")
    sizes = rows.select("by", F.length("text").alias("n")).orderBy("by").limit(labelled).toPandas()
    last = int((sizes["n"].cumsum() <= fit_mb * 1e6).sum())
    if not last:
        return rows.limit(0).toPandas()
    return rows.where(F.col("by") <= int(sizes["by"].iloc[last - 1])).orderBy("by").limit(last).toPandas()


def fit_classifier(docs: DataFrame, labels: DataFrame, *, labelled: int = 8000, fit_mb: float = 256, exchange: int = 60, rounds: int = 3) -> dict:
    """Co-trains both targets: {"views": weights, target: calibration and combination, or the prior}."""
    tables = Tables(docs.sparkSession, "classifier")
    if row_id(docs) is None:  # rows are dealt to the rounds by number, so all scans must number them alike
        docs = tables.save(docs.select("doc_id", "text", "lang", "source"), "docs")
    known = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = tables.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "known")
    got = labelled_rows(docs, known, tables, labelled, fit_mb)
    rows = {"text": list(map(text_row, got["text"])), "meta": list(map(meta_row, got["meta"]))}
    y = got[list(TARGETS)].to_numpy(float)
    n = len(y)
    learnt = [n >= 20 and 0 < y[:, t].mean() < 1 for t in range(len(TARGETS))]
    out: dict = {"views": {}}
    for t, target in enumerate(TARGETS):
        if not learnt[t]:
            prior = (y[:, t].sum() + 1) / (n + 2)
            out[target] = {"prior": float(np.log(prior / (1 - prior)))}
    if not any(learnt):
        tables.drop("docs", "known", "labelled")
        return out
    held = np.arange(n) % 5 == 0  # rows came in hash order
    train, rest = np.flatnonzero(~held), np.flatnonzero(held)
    share = y[train].mean(axis=0)
    balance = np.where(y[train] == 1, 0.5 / np.maximum(1e-9, share), 0.5 / np.maximum(1e-9, 1 - share)).clip(0.2, 5) * learnt
    models = {"text": Linear(1 << BITS), "meta": Linear(1 << META_BITS)}
    extra: dict = {v: ([], [], []) for v in VIEWS}
    pool = docs.select(row_id(docs).alias("place"), "doc_id", "text", "lang", "source").join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").drop("doc_id")
    for round_ in range(rounds + 1):
        for v in VIEWS:
            er, ey, ew = extra[v]
            models[v].fit([rows[v][i] for i in train] + er, np.concatenate([y[train], np.array(ey).reshape(-1, len(TARGETS))]), np.concatenate([balance, np.array(ew).reshape(-1, len(TARGETS))]), epochs=1 if round_ else 4, seed=round_ + 1)
        if round_ == rounds:
            break
        views = {v: (m.w.astype(np.float32), m.b.copy()) for v, m in models.items()}
        part = pool.where(F.pmod(F.xxhash64("place"), F.lit(rounds)) == round_)
        for r in tables.save(surest(part, views, exchange), f"surest{round_}").collect():  # 8 * exchange rows at most
            if learnt[r.target]:
                er, ey, ew = extra[VIEWS[1 - r.view]]
                er.append(text_row(r.text) if r.view else meta_row(r.meta))
                own = np.arange(len(TARGETS)) == r.target
                ey.append(np.where(own, float(r.label), 0.0))
                ew.append(0.5 * own)
    tables.drop("docs", "known", "labelled", *tables.kept("surest"))
    out["views"] = {v: (m.w.astype(np.float32), m.b) for v, m in models.items()}
    raw = {v: np.array([models[v].score(*rows[v][i]) for i in rest]) for v in VIEWS}
    for t, target in enumerate(TARGETS):
        if learnt[t]:
            cal = {v: platt(raw[v][:, t], y[rest, t]) for v in VIEWS}
            logits = np.column_stack([cal[v][0] * raw[v][:, t] + cal[v][1] for v in VIEWS])
            out[target] = {"cal": cal, "mix": platt(logits, y[rest, t])}
    return out


SCORES = "quality_text double, quality_meta double, quality_score double, toxic_text double, toxic_meta double, toxic_score double"


def classify(docs: DataFrame, models: dict, *, quality: float = 0.5, toxic: float = 0.5) -> DataFrame:
    """__row, the calibrated probabilities of each view and both combined, and kept (good and not toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ms = shared.value
        scorer = Scorer(ms["views"])
        for texts, langs, sources in batches:
            whole = [t or "" for t in texts]
            text = meta = None
            if ms["views"]:
                text, meta = scorer.text(whole), scorer.meta(metadata(whole, langs, sources))
            cols = []
            for t, target in enumerate(TARGETS):
                m = ms[target]
                found = (m["prior"],) * 3 if "prior" in m else log_odds(m, text[:, t], meta[:, t])
                cols += [np.broadcast_to(sigmoid(x), len(whole)) for x in found]
            yield pd.DataFrame(dict(zip((x.split()[0] for x in SCORES.split(", ")), cols, strict=True)))

    udf = F.pandas_udf(score, SCORES)
    rows = docs.select(F.struct("*").alias("__row"), udf("text", "lang", "source").alias("s")).select("__row", "s.*")
    return rows.withColumn("kept", (F.col("quality_score") >= quality) & (F.col("toxic_score") < toxic))


def op4_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    models = fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, models).select("__row.doc_id", *[x.split()[0] for x in SCORES.split(", ")], "kept")


QUERIES = {"op4_classifier": op4_classifier}
ORACLE = {}
