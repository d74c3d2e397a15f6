import collections
import math
import zlib

import numpy as np
import pytest

from seriesmill.llm import classifier, components, decontamination, jaccard_join, lm_scoring
from seriesmill.llm.common import Tables, WordHashes, word_hash

DOCS = "doc_id long, text string"
VOCAB = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return list(rng.choice(VOCAB, n))


def near_corpus(seed=3):
    """Groups of exact and near copies, unrelated texts, and edge cases."""
    rng = np.random.default_rng(seed)
    out = []
    for size, edits in ((6, 1), (12, 3), (3, 0), (40, 2)):
        base = prose(rng, 90)
        for _ in range(size):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, edits + 1)):
                w[at] = "edit" + str(rng.integers(1000))
            out.append(" ".join(w))
    out += [" ".join(prose(rng, n)) for n in (40, 80, 5, 4, 3, 1)] + ["a b c", "a  b\tc", "a b d", None, "", " ", None, " ".join(prose(rng, 4000))]
    return out


def brute_links(texts, size=5, threshold=0.8):
    h = WordHashes()
    sets = [frozenset(jaccard_join.shingles(t, size, h).tolist()) for t in texts]
    links, root = [0] * len(sets), list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [(top(i), links[i]) for i in range(len(sets))]


@pytest.mark.parametrize("block", [512, 4])
def test_near_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS + ", k string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_copies(df).collect()}
    assert got == dict(enumerate(brute_links(texts)))


def test_near_copies_edges(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, None), (None, "")]
    got = jaccard_join.near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6 and sorted(r.n_links for r in got) == [0, 0, 0, 2, 2, 2]
    assert sum(r["first"] for r in got if r.class_key is not None) == 1 and all(r["first"] for r in got if r.class_key is None)
    assert {r.class_id for r in got if r.n_links} == {7}
    assert jaccard_join.near_copies(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("block", [2, 5, 512])
def test_near_copies_in_chains(spark, monkeypatch, block):
    """Texts that overlap with the next ones only: one coarse group, many small buckets, compared bucket by bucket."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(8)
    words = prose(rng, 600)
    texts = [" ".join(words[i * 12 : i * 12 + 150]) for i in range(37)] * 2
    df = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_copies(df).collect()}
    assert got == {f"d{i:03}": (f"d{c:03}", n) for i, (c, n) in enumerate(brute_links(texts))}


def test_pruning_keeps_what_reaches_the_threshold():
    keep = jaccard_join.least_matches(0.8, 1e-7)
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        m = np.cumsum(rng.random(200) < 0.8)
        lost += any(m[n - 1] < k for n, k in keep.items())
    assert lost <= 1 and all(keep[n] < 0.8 * n for n in keep) and keep[200] > 0.5 * 200


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"), Tables(spark, "cc"), "t").collect()}
    root = {n: n for e in edges for n in e}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: top(n) for n in linked}


def test_lm_against_plain_counts(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(prose(rng, int(n))) for n in rng.integers(0, 60, 120)] + [None, "", "A a Ä ä", "dup dup dup", "dup dup dup", "z " * 5000]
    rows = list(enumerate(texts)) + [(None, "null id")]
    got = lm_scoring.score_documents(spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS + ", token string")).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = collections.Counter(w for i, t in rows if not held(i) for w in lm_scoring.tokens(t))
    n, v = sum(c.values()), len(c)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        tk, r = lm_scoring.tokens(t), by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tk), sum(w in c for w in tk), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tk))
        assert r.score < 0 and math.isfinite(r.score)
    assert by[rows[-3][0]].score / by[rows[-3][0]].n_tokens > by[0].score / by[0].n_tokens
    assert lm_scoring.score_documents(spark.createDataFrame([], DOCS)).count() == 0


def plain_scores(rows, weight=0.3):
    """The interpolated model with quantised counts, from exact ones; rows are (training?, tokens)."""
    one = collections.Counter(w for train, t in rows if train for w in t)
    two = collections.Counter(x for train, t in rows if train for x in zip([None, *t], t, strict=False))
    n, v, texts = sum(one.values()), len(one), sum(train for train, _ in rows)
    level = lambda c: 0 if not c else 1 + math.floor(math.log(c) / math.log(lm_scoring.RATIO) + 1e-9)
    least = lambda c: math.ceil(lm_scoring.RATIO ** (level(c) - 1) - 1e-9) if c else 0
    out = []
    for _, t in rows:
        total = 0.0
        for before, w in zip([None, *t], t, strict=False):
            history = texts if before is None else lm_scoring.RATIO ** level(one[before]) if one[before] else 0
            share = min(1.0, least(two[before, w]) / max(1.0, history))
            total += math.log10(weight * share + (1 - weight) * (least(one[w]) + 0.5) / (n + 0.5 * (v + 1)))
        out.append(total)
    return out


@pytest.mark.parametrize("filter_mb", [64, 0])
def test_lm_scores_against_a_plain_model(spark, monkeypatch, filter_mb):
    """Broadcast or in shards: with so many bits that nothing is found that was not put in, the scores are those of exact lookups."""
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 900)
    rng = np.random.default_rng(12)
    rows = [(f"id{i}", " ".join(prose(rng, int(n)))) for i, n in enumerate(rng.integers(0, 80, 150))] + [("x", None), ("y", ""), (None, "w1 w2 w3"), ("z", "w1 w2 " * 3000), ("z", "w1 w2 " * 3000)]
    held = lambda i: zlib.crc32(("" if i is None else i).encode()) % 5 == 1
    got = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id string, text string"), filter_mb=filter_mb, per_insert=80).collect()
    want = plain_scores([(not held(i), lm_scoring.tokens(t)) for i, t in rows])
    have = sorted((str(r.doc_id), round(r.score, 6)) for r in got)
    assert have == sorted((str(i), round(x, 6)) for (i, _), x in zip(rows, want, strict=True))


def test_lm_ten_bits_are_close(spark):
    rng = np.random.default_rng(13)
    rows = [(i, " ".join(prose(rng, 60))) for i in range(120)]
    one, other = ({r.doc_id: r.score for r in lm_scoring.score_documents(spark.createDataFrame(rows, DOCS), per_insert=n).collect()} for n in (10, 80))
    assert np.mean([abs(one[i] - other[i]) / abs(other[i]) for i in one]) < 0.01
    few = spark.createDataFrame([(0, "a"), (1, "b c d e f g h")], DOCS)  # shards without any n-gram of the training texts
    assert all(r.score < 0 for r in lm_scoring.score_documents(few, filter_mb=0).collect())


def test_lm_is_a_probability():
    """Over all next words of a history, and the unknown one, the model adds up to no more than one."""
    rng = np.random.default_rng(2)
    small = [w.encode() for w in VOCAB[:30]]
    texts = [[*rng.choice(small, 40), lm_scoring.END] for _ in range(50)]

    def part(tokens):
        words = list(dict.fromkeys(w for t in tokens for w in t))
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        number = np.array([words.index(w) for t in tokens for w in t])
        sizes = np.array([len(t) for t in tokens])
        values = (np.arange(len(tokens)).tobytes(), lm_scoring.packed(sizes, int(sizes.max())), np.ones(len(tokens), bool).tobytes(), lm_scoring.packed(number, len(words)), hashes.tobytes())
        return lm_scoring.Chunk(dict(zip(lm_scoring.PART, values, strict=True)))

    c = part(texts)
    data = lm_scoring.filled(c.keys, lm_scoring.levels(c.counts()), 10)
    f = lm_scoring.Filter(data, np.array([len(data)]))
    n, v = sum(map(len, texts)), len(set(w for t in texts for w in t))
    for before in small[:5]:
        total = 0.0
        for w in [*small, lm_scoring.END, b"unknown"]:
            two, one = part([[before, w]]), part([[before]])
            total += 10 ** float(two.scores(f.level_of(two.keys), n, v, 50, 0.3)[0] - one.scores(f.level_of(one.keys), n, v, 50, 0.3)[0])
        assert 0.3 < total <= 1.001


def test_filter_reads_back_levels_and_stops_when_full():
    rng = np.random.default_rng(1)
    keys, q = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) * np.uint64(2), rng.integers(1, 9, 3000)
    q = q[: len(keys)]
    at = np.searchsorted(lm_scoring.shard_of(keys, 4), np.arange(5))
    pieces = [lm_scoring.filled(keys[i:j], q[i:j], 12) for i, j in zip(at, at[1:], strict=False)]
    f = lm_scoring.Filter(np.concatenate(pieces), np.array([len(p) for p in pieces]))
    assert (f.level_of(keys) >= q).all() and (f.level_of(keys) == q).mean() > 0.9
    assert (f.level_of(keys + np.uint64(1)) == 0).mean() > 0.9
    full = lm_scoring.Filter(np.full(1000, 255, np.uint8), np.array([1000]))
    assert set(full.level_of(keys).tolist()) == {lm_scoring.MOST}
    assert lm_scoring.Filter(np.empty(0, np.uint8), np.zeros(3, np.int64)).level_of(keys).max() == 0


def labelled_docs(n=600, seed=4):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        w = prose(rng, int(rng.integers(20, 120)))
        quality, toxic = int(rng.random() > 0.3), int(rng.random() < 0.2)
        if not quality:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "%%%" for x in w]
        if toxic:
            for at in rng.integers(0, len(w), 4):
                w[at] = ["vile", "nasty", "awful"][at % 3]
        docs.append((i, " ".join(w), ["en", "de"][i % 2], f"s{i % 5}", "clash"))
        labels.append((i, quality, toxic))
    return docs, labels


CLS = DOCS + ", lang string, source string, quality_score string"
LAB = "doc_id long, quality int, toxic int"


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled_docs()
    d = spark.createDataFrame(docs, CLS)
    models = classifier.fit_classifier(d, spark.createDataFrame(labels[:400], LAB), exchange=20)
    got = {r["__row"].doc_id: r for r in classifier.classify(d, models).collect()}
    rest = labels[400:]
    assert np.mean([(got[i].quality_score >= 0.5) == q for i, q, _ in rest]) > 0.95
    assert np.mean([(got[i].toxic_score >= 0.5) == t for i, _, t in rest]) > 0.9
    assert np.mean([got[i].kept == (q and not t) for i, q, t in rest]) > 0.88


def test_classifier_edges(spark):
    docs, labels = labelled_docs(60)
    odd = [(None, None, None, None, None), (900, "", "xx", "new", None), (900, "", "xx", "new", None), (901, "w1 " * 30000, None, "s1", None)]
    d = spark.createDataFrame(docs + odd, CLS)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (900, None, None), *labels[:3]], LAB)
    out = classifier.classify(d, classifier.fit_classifier(d, lab)).collect()
    assert len(out) == 64 and all(0 <= r.quality_score <= 1 and r.kept is not None for r in out)
    none = spark.createDataFrame([], LAB)
    assert classifier.classify(d, classifier.fit_classifier(d, none)).count() == 64
    empty = spark.createDataFrame([], CLS)
    assert classifier.classify(empty, classifier.fit_classifier(empty, lab)).count() == 0


def test_classifier_scores_and_surest_against_single_rows(spark):
    """Whole batches score as single rows do, and the rows handed over are the surest of all, copies once."""
    docs, _ = labelled_docs(80)
    docs = [(i, t, x, s) for i, t, x, s, _ in docs]
    docs += [(100 + i, *docs[3][1:]) for i in range(30)] + [(200, None, None, None), (201, "w1 " * 5000, "en", "s1")]
    rng = np.random.default_rng(0)
    views = {"text": (rng.normal(0, 3, (1 << classifier.BITS, 2)).astype(np.float32), np.array([0.1, -0.2])), "meta": (rng.normal(0, 3, (1 << classifier.META_BITS, 2)).astype(np.float32), np.zeros(2))}
    text = [classifier.text_row(classifier.text_features(t or "")) for _, t, _, _ in docs]
    meta = [classifier.meta_row(classifier.meta_features(t or "", x, s).tobytes()) for _, t, x, s in docs]
    want = {v: np.array([values @ views[v][0][ids] + views[v][1] for ids, values in rows]) for v, rows in (("text", text), ("meta", meta))}
    scorer = classifier.Scorer(views)
    texts = [t or "" for _, t, _, _ in docs]
    assert np.allclose(scorer.text(texts), want["text"]) and np.allclose(scorer.meta(classifier.metadata(texts, *zip(*[d[2:] for d in docs], strict=True))), want["meta"], atol=1e-4)
    pool = spark.createDataFrame(docs, "place long, text string, lang string, source string").repartition(5)
    got = classifier.surest(pool, views, 4).collect()
    for t in (0, 1):
        for v, view in enumerate(classifier.VIEWS):
            for label in (0, 1):
                sure = {d[1:]: s for d, s in zip(docs, want[view][:, t] * (1 if label else -1), strict=True) if s > classifier.SURE}
                have = [r.score for r in got if (r.target, r.view, r.label) == (t, v, label)]
                assert np.allclose(have, sorted(sure.values(), reverse=True)[:4], atol=1e-3)


def fold(t):
    return (t or "").lower().translate(str.maketrans("", "", decontamination.PUNCTUATION)).split()


def brute_matches(docs, items):
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = {}
    for i, t in docs:
        w = fold(t)
        for a, x in items:
            b = grams(fold(x))
            m = len(fold(x))
            if m < 5 or len(w) < 5:
                continue
            best = 0
            for s in range(max(1, len(w) - m + 1)):
                c = grams(w[s : s + m])
                k = sum((c & b).values())
                best = max(best, k / (sum(c.values()) + sum(b.values()) - k))
            if best >= 0.8:
                out[i, a] = best
    return out


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_decontamination_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", limit)
    rng = np.random.default_rng(6)
    items = [(i, " ".join(prose(rng, int(n)))) for i, n in enumerate((15, 30, 59, 8, 5, 40))] + [(6, "too short"), (7, None), (8, "a b a b a b a b a b a b")]
    texts = []
    for i in range(60):
        w = prose(rng, int(rng.integers(0, 80)))
        if i % 3 == 0:
            x = items[i % 6][1].split()
            if i % 2:
                x[len(x) // 2] = "changed"
            if i % 4 == 0:
                x = [y.upper() + "," for y in x]
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + x + w[at:]
        texts.append(" ".join(w))
    texts += [None, "", "a b", "a b a b a b a b a b a b a b", items[2][1][: len(items[2][1]) * 9 // 10], (items[1][1] + " ") * 3]
    docs = list(enumerate(texts))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS + ", w string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_matches(docs, items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")] * 2, "item_id long, text string")
    rows = [(1, "say One two, three four five six seven eight now", 1), (1, "say One two, three four five six seven eight now", 1), (None, "clean text of some words here", 2), (2, None, 3)]
    df = spark.createDataFrame(rows, DOCS + ", key int")
    left = decontamination.clean(df, items)
    assert left.columns == df.columns and sorted(r.key for r in left.collect()) == [2, 3]
    assert decontamination.matches(df, items.limit(0)).count() == 0 and decontamination.matches(df.limit(0), items).count() == 0


def test_decontamination_finds_all_at_the_threshold(spark):
    """Items of 49 words with one changed in the middle have similarity 0.8; a SimHash radius of 15 bits loses some 2% of them."""
    rng = np.random.default_rng(21)
    items = [(i, " ".join(f"x{w}" for w in rng.integers(0, 10**9, 49))) for i in range(400)]
    docs = []
    for i, t in items:
        w = t.split()
        w[24] = f"changed{i}"
        docs.append((i, " ".join(["before", *w, "after"])))
    got = decontamination.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(400)} and all(r.similarity == pytest.approx(0.8) for r in got)


def test_decontamination_finds_what_is_moved_about(spark):
    """Halves of an item that changed places share most shingles with it, but no shared shingle tells where the window begins."""
    rng = np.random.default_rng(22)
    items = [(i, " ".join(f"y{w}" for w in rng.integers(0, 10**9, 120))) for i in range(8)]
    docs = []
    for i, t in items:
        w = t.split()
        docs += [(10 * i, " ".join(["one", "two", *w[60:], *w[:60], "three"])), (10 * i + 1, " ".join(w[:50] + ["in", "between"] + w[50:])), (10 * i + 2, " ".join(w * 2)), (10 * i + 3, " ".join(w[:90]))]
    docs.append((99, "z " * 2000 + items[0][1] + " z" * 2000))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_matches(docs, items)
    assert set(got) == set(want) and len(want) == 3 * 8 + 1 and all(got[k] == pytest.approx(want[k]) for k in got)
