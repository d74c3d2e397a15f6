"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document over the whole text; the ledger keeps
its measurements and one failure bit per rule. A policy is a versioned mask of
rules that reject; policies and ablations are bit operations on the ledger and
never read a text again.

Null text: no words (it fails ``few_words``). A text of one line, of blanks only
or of any length is measured whole. Repeated rows: each keeps its own row; the
ledger is a narrow map with no shuffle, so no order or ties matter. Empty table:
no rows. Columns of the table other than doc_id and text are carried only inside
``__row`` and can have any name.
"""

from __future__ import annotations

import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, rolled

#: Rule bits, in this order; a bit is never given another meaning, new rules are appended.
RULES = ("few_words", "repeat_words", "symbol_ratio", "duplicate_lines", "word_length", "upper_case", "exclamations", "toxic_terms", "stutter")
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: The rules of each policy version.
POLICIES = {
    "v1": ("few_words", "repeat_words", "symbol_ratio", "duplicate_lines"),
    "v2": RULES,
}

#: Insults that mark a text as toxic, in four languages, compared with lower-cased words without outer punctuation.
TOXIC = (
    "idiot", "moron", "scum", "trash", "stupid", "pathetic", "disgusting", "worthless", "clown", "loser", "idiots", "morons",
    "trottel", "dummkopf", "abschaum", "widerlich", "wertlos", "idiota", "imbécil", "basura", "escoria", "asqueroso", "imbécile", "ordure", "dégoûtant", "abruti",
)

SYMBOLS = re.compile(r"[#*$%&|<>]")
OUTER = ".,;:!?\"'()"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_exclaimed long, n_toxic long, n_stutter long"


def measure(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    repeats = 0
    if n > 5:
        grams = rolled(hashes.of(words), 5)
        _, at, counts = np.unique(grams, return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        if twice.any():
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, np.flatnonzero(twice), 1)
            np.add.at(cover, np.flatnonzero(twice) + 5, -1)
            repeats = int((np.cumsum(cover)[:n] > 0).sum())
    decoded = [w.decode() for w in words]
    return (
        n,
        sum(map(len, decoded)),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        sum(1 for w in decoded if w != w.lower() and len(w) > 1 and w == w.upper()),
        sum(1 for w in decoded if w[-1] == "!"),
        sum(1 for w in decoded if w.strip(OUTER).lower() in TOXIC_SET),
        sum(map(operator.eq, words[1:], words)),
    )


TOXIC_SET = frozenset(TOXIC)


def ledger(docs: DataFrame) -> DataFrame:
    """__row (the document as a struct), the measurements, and ``failed``, a bit per rule."""
    rows = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"))

    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, HASHES) for t in texts], columns=[x.split()[0] for x in MEASURES.split(", ")])

    m = rows.select("__row", F.pandas_udf(measured, MEASURES)("__text").alias("m")).select("__row", "m.*")
    n = F.col("n_words")
    fails = {
        "few_words": n < 10,
        "repeat_words": 100 * F.col("n_repeat_words") > 20 * n,
        "symbol_ratio": 10 * F.col("n_symbols") > n,
        "duplicate_lines": (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "upper_case": 10 * F.col("n_upper") > 3 * n,
        "exclamations": 10 * F.col("n_exclaimed") > 2 * n,
        "toxic_terms": (F.col("n_toxic") >= 2) & (400 * F.col("n_toxic") >= n),
        "stutter": 10 * F.col("n_stutter") > 2 * n,
    }
    failed = F.lit(0).cast("long")
    for name in RULES:
        failed = failed + F.when(fails[name], F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
    return m.withColumn("failed", failed)


HASHES = WordHashes()


def mask(policy: str) -> int:
    return sum(BIT[x] for x in POLICIES[policy])


def with_policy(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds base_failed and kept under a policy; a base failure rejects under every policy."""
    base = F.col("failed").bitwiseAND(F.lit(BIT["few_words"] | BIT["repeat_words"])) != 0
    return book.withColumns({"base_failed": base, "kept": ~base & (F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)})


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept if it were left out)."""
    under = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    rows = book.agg(*[F.count_if(under.bitwiseAND(F.lit(BIT[x])) != 0).alias(f"f_{x}") for x in POLICIES[policy]], *[F.count_if(under == BIT[x]).alias(f"o_{x}") for x in POLICIES[policy]])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(f"f_{x}").alias("fails"), F.col(f"o_{x}").alias("only_this")) for x in POLICIES[policy]])).alias("r")).select("r.*")


def op6_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_policy(ledger(docs)).select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def _sql() -> str:
    listed = ", ".join(f"'{x}'" for x in TOXIC)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT i, p, array_to_string(w[p:p + 4], ' ') AS gram FROM (SELECT i, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
c AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT i, count(DISTINCT p + k) AS n FROM c, (SELECT unnest(range(0, 5)) AS k) GROUP BY i),
m AS (SELECT w.i, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(w, lambda x: x <> lower(x) AND length(x) > 1 AND x = upper(x))) AS n_upper, len(list_filter(w, lambda x: ends_with(x, '!'))) AS n_exclaimed,
  len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"''()')) IN ({listed}))) AS n_toxic,
  len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS n_stutter FROM w LEFT JOIN rep ON w.i = rep.i),
f AS (SELECT *, ((n_words < 10)::INT * 1 + (100 * n_repeat_words > 20 * n_words)::INT * 2 + (10 * n_symbols > n_words)::INT * 4 + (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT * 8
  + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT * 16 + (10 * n_upper > 3 * n_words)::INT * 32 + (10 * n_exclaimed > 2 * n_words)::INT * 64
  + (n_toxic >= 2 AND 400 * n_toxic >= n_words)::INT * 128 + (10 * n_stutter > 2 * n_words)::INT * 256)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


def quality_ablations(spark, sf_dir):
    """What each rule of the policy rejects, and what only it rejects, from the ledger's bits."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _ablation_sql() -> str:
    bits = ", ".join(f"('{name}', {bit})" for name, bit in BIT.items())
    return f"WITH l AS ({_sql()}), r(rule, bit) AS (VALUES {bits}) SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS fails, count(*) FILTER (WHERE failed = bit) AS only_this FROM l, r GROUP BY rule"


QUERIES = {"op6_quality_rules": op6_quality_rules, "quality_ablations": quality_ablations}
ORACLE = {"op6_quality_rules": _sql(), "quality_ablations": _ablation_sql()}
