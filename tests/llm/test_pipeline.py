"""The pipeline against a plain version of its rules on a small corpus."""

import numpy as np
import pytest
from test_models_and_pairs import brute_links, brute_matches, prose
from test_repeats import plain_kept

from seriesmill.llm import quality_rules
from seriesmill.llm.common import WordHashes

pipeline = pytest.importorskip("corpus_pipeline")

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(12)
    item = " ".join(prose(rng, 30))
    passage = " ".join(prose(rng, 50))
    texts = [" ".join(prose(rng, 60)) for _ in range(30)]
    near = texts[0].split()
    near[30] = "other"
    texts += [texts[1], " ".join(near), f"{texts[2]} {passage}", f"{passage} {' '.join(prose(rng, 40))}", f"{' '.join(prose(rng, 20))} {item}", "short", None, "", "LOUD!! " * 40]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)], item


def test_stages(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {r[0]: r[1] for r in rows}

    def measured(t):
        m = dict(zip([x.split()[0] for x in quality_rules.MEASURES.split(", ")], quality_rules.measure(t, WordHashes()), strict=True))
        return m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"]

    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [x.split()[0] for x in KIND.split(", ")]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            want = {i: t for i, t in left.items() if measured(t)}
        elif name == "jaccard_join":
            ids = sorted(left)
            links = brute_links([left[i] for i in ids])
            want = {i: left[i] for place, i in enumerate(ids) if links[place][0] == place}
        elif name == "substring_dedup":
            ids = sorted(left)
            words = [left[i].encode().split() for i in ids]
            want = {i: left[i] if len(k) == len(w) else b" ".join(k).decode() for i, w, (k, _) in zip(ids, words, plain_kept(words, None, 35), strict=True)}
        else:
            bad = brute_matches(list(left.items()), [(0, item)])
            want = {i: t for i, t in left.items() if (i, 0) not in bad}
        assert got == want, name
        assert name == "substring_dedup" or len(got) < len(left)
        left = got
    final = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= set(left) and len(final) >= len(left) // 2
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, final))


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = spark.createDataFrame([(None, None, None, None, None, 1)] * 2 + [(1, "", "en", "s", 0, 1)], KIND + ", size int")
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.count()


def test_stages_with_ids_that_are_no_numbers(spark, tmp_path):
    rows, item = corpus()
    rows = [(f"doc {i}", *r) for i, *r in rows] + [(None, *rows[3][1:])]
    spark.createDataFrame([("item", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, KIND.replace("doc_id long", "doc_id string"))
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert docs.schema["doc_id"].dataType.simpleString() == "string" and docs.count() > 0, name
