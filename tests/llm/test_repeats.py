import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesmill.llm import repeats, substring_dedup, suffix_dedup
from seriesmill.llm.substring_dedup import Automaton


def plain_flags(segments, w):
    c = collections.Counter()
    for s, n in segments:
        for i in range(len(s) - w + 1):
            c[tuple(s[i : i + w])] += n
    return [[c[tuple(s[i : i + w])] > 1 for i in range(len(s) - w + 1)] for s, _ in segments]


def plain_kept(units, texts, w):
    """Per text: units left and removed runs."""
    c = collections.Counter(tuple(u[i : i + w]) for u in units for i in range(len(u) - w + 1))
    out = []
    for u in units:
        cover = np.zeros(len(u), bool)
        for i in range(len(u) - w + 1):
            if c[tuple(u[i : i + w])] > 1:
                cover[i : i + w] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()) if len(u) else 0
        out.append(([x for x, gone in zip(u, cover, strict=True) if not gone], runs))
    return out


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array(x):
    assert suffix_dedup.suffix_array(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@given(st.dictionaries(st.binary(min_size=12, max_size=40).map(lambda b: bytes(97 + v % 2 for v in b)), st.integers(1, 2), min_size=1, max_size=5), st.integers(2, 12))
@settings(max_examples=150, deadline=None)
def test_shards_decide_exactly(segments, w):
    segments = list(segments.items())
    want = plain_flags(segments, w)
    assert [f.tolist() for f in suffix_dedup.decide(segments, w)] == want
    spaced = [(b" ".join(bytes([c]) for c in s), n) for s, n in segments]
    assert [f.tolist() for f in substring_dedup.decide(spaced, w)] == want


def test_automaton_statistics():
    a = Automaton()
    a.add([1, 2, 3, 4], 1, -1)
    a.add([9, 2, 3, 8], 1, -2)
    a.finish()
    assert a.statistics([1, 2, 3, 4]) == [0, 1, 2, 0] and a.statistics([5, 2]) == [0, 1]


WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    passage, line = say(40), say(9)
    texts = [say(60) for _ in range(12)]
    texts += [f"{say(20)} {passage} {say(15)}" for _ in range(10)] + [f"{line}\n{say(50)}" for _ in range(20)]
    texts += [texts[0]] * 4 + [texts[1] + " tail"] + [None, "", "  ", "one", passage, passage + " " + passage, "na " * 90, "x" * 1500, "é" * 900, say(3000)]
    return texts


@pytest.mark.parametrize(("hot", "largest"), [(2000, 16_000_000), (3, 16_000_000), (2000, 300), (3, 10)])
def test_words(spark, monkeypatch, hot, largest):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LARGEST", largest)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {r.doc_id: r for r in substring_dedup.report(df).collect()}
    units = [(t or "").encode().split() for t in texts]
    for i, (kept, _) in enumerate(plain_kept(units, texts, 35)):
        assert (got[i].n_words, got[i].n_removed) == (len(units[i]), len(units[i]) - len(kept)), i
        assert got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize(("hot", "largest"), [(2000, 16_000_000), (3, 16_000_000), (2000, 300), (3, 10)])
def test_bytes(spark, monkeypatch, hot, largest):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LARGEST", largest)
    texts = corpus(2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.report(df, 100).collect()}
    units = [(t or "").encode() for t in texts]
    for i, (kept, runs) in enumerate(plain_kept(units, texts, 100)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(units[i]), len(units[i]) - len(kept), runs), i
        assert got[i].kept_sha256 == hashlib.sha256(bytes(kept)).hexdigest()


def test_remove_keeps_columns_and_untouched_texts(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"a  b {long}", 9, "t"), (2, f"{long}\tc", 9, None), (3, "un  touched", 11, "t"), (None, None, None, "t")]
    out = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __text string"))
    assert out.columns == ["doc_id", "text", "n_chars", "__text"]
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a b", 3), 2: ("c", 1), 3: ("un  touched", 11), None: (None, None)}


def test_suffix_array_of_many_symbols():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(1, 2**29, 500), [2**29] * 40, rng.integers(1, 5, 300) + 2**28])
    assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "é" * 250, "k", 1) for i in range(3)], "doc_id long, text string, k string, n_bytes int")
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.report(df).collect()] == [(500, 500, 1)] * 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.report(none).count() == 0 and suffix_dedup.report(none).count() == 0
