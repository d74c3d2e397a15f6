"""Substring deduplication with suffix automata of reference shards.

The corpus is its own reference. It is cut into shards by content (``repeats``),
small enough that one suffix automaton holds a shard; the segments of the
documents that can match a shard are streamed through its automaton. The
statistic at each word is the length of the longest suffix read so far that
occurs somewhere else; where it reaches the window, the window is removed.

An automaton is not broadcast to all workers: over a whole corpus the automata
together are as large as the corpus, so each goes to the one task whose documents
need it.

Null text: no words. Texts shorter than the window keep all words, texts of any
length are read whole. Equal texts of a window or more lose every word. Words are
compared as they are; the blanks between kept words become one space. Empty
table: no rows. Other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHashes
from .repeats import Repeats

WINDOW = 35


class Automaton:
    """Suffix automaton over integers with the number of occurrences of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], times: int, end: int) -> None:
        """Appends a sequence that occurs ``times`` times, then ``end``, a symbol used nowhere else."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = self.last if hasattr(self, "last") else 0
        for c, t in [(x, times) for x in sequence] + [(end, 0)]:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(t)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    count.append(0)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def finish(self) -> None:
        """Adds up the occurrences along suffix links, longest states first."""
        count, link = self.count, self.link
        for v in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            count[link[v]] += count[v]

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each place, the longest suffix ending there that occurs twice or more."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state, size, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(c, 0)
            size = size + 1 if state else 0
            # a suffix of what occurs twice: shorten until it does
            while state and count[state] < 2:
                state = link[state]
                size = length[state]
            out.append(size)
        return out


def decide(segments: list[tuple[bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """Flags of the windows of each (words joined by a space, occurrences) that occur twice or more among all of them."""
    names: dict[bytes, int] = {}
    sequences = [[names.setdefault(w, len(names)) for w in data.split(b" ")] for data, _ in segments]
    reference = Automaton()
    for i, (s, (_, times)) in enumerate(zip(sequences, segments, strict=True)):
        reference.add(s, times, -1 - i)
    reference.finish()
    out = []
    for s, (_, times) in zip(sequences, segments, strict=True):
        if times > 1:
            out.append(np.ones(len(s) - window + 1, bool))
        else:
            out.append(np.array(reference.statistics(s)[window - 1 :]) >= window)
    return out


def split(text: str) -> list[bytes]:
    return text.encode().split()


def words_of(window: int) -> Repeats:
    return Repeats("words", window, max(1, window // 4), split, lambda: WordHashes().of, lambda u, i, j: b" ".join(u[i:j]), lambda s: decide(s, window), 300_000)


def without(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    if not ranges:
        return words
    out, at = [], 0
    for a, b in ranges:
        out += words[at:a]
        at = b
    return out + words[at:]


def digest(words: list[bytes], ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
    kept = without(words, ranges)
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, a row per row of docs(doc_id, text)."""
    repeats, tables = words_of(window), Tables(docs.sparkSession, "substring")
    kept = repeats.cut(docs, tables, digest, "n_words long, n_removed long, kept_sha256 string")
    return repeats.joined(docs.select("doc_id", "text"), kept).select("__row.doc_id", "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The table with repeated words cut from its texts: a text that loses nothing stays as it is, n_chars (if there) is counted again."""
    repeats, tables = words_of(window), Tables(docs.sparkSession, "substring")
    kept = repeats.cut(docs, tables, lambda w, r: (b" ".join(without(w, r)).decode() if r else None, 1 if r else 0), "__text string, __cut long")
    rows, cut, row = repeats.joined(docs, kept), F.col("__cut") == 1, F.col("__row")
    new = {"text": F.when(cut, F.col("__text")).otherwise(row.getField("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(row.getField("n_chars"))
    return rows.select(*[new.get(c, row.getField(c)).alias(c) for c in docs.columns])


def op1_substring_dedup(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT i, p, array_to_string(w[p:p + 34], ' ') AS g FROM (SELECT i, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
r AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
k AS (SELECT DISTINCT i, p + j AS q FROM r, (SELECT unnest(range(0, 35)) AS j)),
x AS (SELECT i, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
t AS (SELECT x.i, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM x ANTI JOIN k ON x.i = k.i AND x.q = k.q GROUP BY x.i)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (i)
"""
}
