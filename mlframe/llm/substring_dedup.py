"""Removal of word runs that an earlier document has, by matching statistics over suffix automata of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import SPREAD, Words, map_arrow, materialize, mix64, text_slices


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state keeps the smallest document that has its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.least = [-1], [0], [None]

    def add(self, words: list, document: int) -> None:
        last = 0
        for w in words:
            last = self._step(last, w)
            if self.least[last] is None or document < self.least[last]:
                self.least[last] = document

    def _step(self, last: int, w) -> int:
        nexts, link, length = self.next, self.link, self.len
        if w in nexts[last]:
            q = nexts[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.least.append(None)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w, q: int) -> int:
        nexts, link = self.next, self.link
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        self.least.append(None)
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def finish(self) -> None:
        """Hands each state's smallest document on to the states of its suffixes."""
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up, own = self.link[state], self.least[state]
            if up > 0 and own is not None and (self.least[up] is None or own < self.least[up]):
                self.least[up] = own

    def statistics(self, words: list, least: int) -> Iterator[tuple[int, int | None]]:
        """Streams ``words``; per word the longest match that ends there, up to ``least`` words, and at that length the smallest document that has it."""
        state, matched = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.len[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while state and self.len[self.link[state]] >= least:
                state = self.link[state]
            matched = min(matched, max(least, 0)) if matched >= least else matched
            yield (matched, self.least[state]) if matched >= least else (matched, None)


def earliest(texts: list[list], documents: list[int], least: int) -> list[list[int]]:
    """Per sequence, for each of its windows of ``least`` words the smallest of ``documents`` whose sequence has it."""
    machine = SuffixAutomaton()
    for words, document in zip(texts, documents, strict=True):
        machine.add(words, document)
    machine.finish()
    return [[d for n, d in machine.statistics(words, least) if n >= least] for words in texts]


def minimizers(words: np.ndarray, least: int, gram: int) -> np.ndarray:
    """For each window of ``least`` words, the smallest hash of its runs of ``gram`` words: equal windows have equal ones."""
    n = len(words) - gram + 1
    value = words[:n].copy()
    for k in range(1, gram):
        value *= SPREAD
        value += words[k : n + k]
    value = mix64(value)
    span = least - gram + 1  # runs in a window; minima of 1, 2, 4, ... of them
    have = 1
    while have < span:
        step = min(have, span - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return value


def segments_of(texts: pa.Array, least: int, gram: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: their words, and for every run of consecutive windows of one minimizer (a segment) that minimizer, the text's number, and the numbers of the first words of its first and last window."""
    words = Words.of(texts)
    if len(words.start) < least:
        none = np.zeros(0, np.int64)
        return words, none.view(np.uint64), none, none, none
    value = minimizers(words.hashes(), least, gram)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    window = np.flatnonzero(text[: len(value)] == text[least - 1 :])  # windows do not cross texts
    value, text = value[window], text[window]
    new = np.flatnonzero((value[1:] != value[:-1]) | (text[1:] != text[:-1])) + 1
    first = np.append(0, new) if len(value) else new
    last = np.append(new, len(value))[: len(first)] - 1
    return words, value[first], text[first], window[first], window[last]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13, gram: int = 5, shard_segments: int = 4096) -> DataFrame:
    """Removes every word in a run of ``least`` words that also stands in a document of smaller id; judged on the input.

    Words are runs without ASCII white space, unchanged. Sending every shard's automaton to all documents would cost shards times documents, so documents go to the shards that can match: consecutive windows of one minimizer (the smallest hash of the ``gram``-word runs inside) make a segment, and equal windows have the same minimizer. (1) Minimizers that stand in more than one document are found by an aggregate with partial sums. (2) Only documents that have some cut segments, and only for those. (3) Equal segments (of one minimizer and one 64-bit hash) become one, with their smallest and largest document. (4) Different segments of a minimizer meet in one shard; its suffix automaton is built once, every segment is streamed through it, and the matching statistics give each window's smallest document. A segment that is alone with its minimizer needs no automaton: all its windows are its own. A minimizer of more than ``shard_segments`` different segments is cut into single windows, equal ones become one, and they are dealt by their own text, so no shard grows with it. (5) Segments with windows of a smaller document go back to the documents and the union of these windows is removed.

    The joins by minimizer and by segment have written tables on both sides, so adaptive execution splits those that very many documents share.

    Columns: doc_id, n_words, n_removed, kept (the words left, joined by one space), spans (array of struct(start, stop): the removed runs, as word numbers). One row per row of ``docs``. Null text: no words, kept empty. Rows of a null id lose nothing and count for nothing. Repeated rows of one id are one document: none is earlier than the other. An empty table gives none; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = source.where("doc_id is not null and text is not null")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            _, value, text, _, _ = segments_of(batch.column(1), least, gram)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(text))], names=["print", "doc_id"])

    marked = map_arrow(known, prints, "print long, doc_id long")
    shared = materialize(marked.groupBy("print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("print"))
    hits = marked.join(shared, "print").groupBy("doc_id").agg(F.collect_list("print").alias("prints"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            words, value, text, first, last = segments_of(batch.column(1), least, gram)
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(lists), dtype=np.uint64), lists.value_lengths().to_numpy())
            some = np.isin(value ^ mix64(text), lists.flatten().to_numpy().view(np.uint64) ^ mix64(owner))
            value, text, first, last = value[some], text[some], first[some], last[some]
            raw = words.data.tobytes()
            pieces = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.stop[last + least - 1].tolist(), strict=True)]
            # White space that is not one space between two words, counted up to each word.
            other = np.append(0, np.cumsum((words.start[1:] - words.stop[:-1] != 1) | (words.data[words.stop[:-1]] != 32)))
            for k in np.flatnonzero(other[last + least - 1] > other[first]).tolist():
                pieces[k] = b" ".join(pieces[k].split())
            columns = [pa.array(value.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(first - words.first[text]), pa.array(last - first + 1), pa.array(pieces, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["print", "doc_id", "start", "n", "words"])

    cuts = map_arrow(known.join(hits, "doc_id"), cut, "print long, doc_id long, start long, n long, words string")
    cuts = materialize(cuts.withColumn("segment", F.xxhash64("words")))
    segments = materialize(cuts.groupBy("print", "segment").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("n").cast("int").alias("n")))
    several = materialize(segments.groupBy("print").agg(F.count("*").alias("segments")).where("segments > 1"))
    alone = segments.where("low < high").join(several, "print", "left_anti").select("print", "segment", F.lit(0).cast("long").alias("shift"), F.array_repeat("low", F.col("n")).alias("first"))
    heads = segments.join(several, "print").select("print", "segment", F.col("low").alias("doc_id"), "high", (F.col("segments") > shard_segments).alias("crowded"))
    heads = cuts.select("print", "segment", "doc_id", "words").join(heads, ["print", "segment", "doc_id"])
    shards = max(1, segments.count() // shard_segments)

    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["print", "segment"])  # a segment may stand twice in its smallest document
        found = earliest([w.split(" ") for w in group["words"]], group["doc_id"].tolist(), least)
        late = np.array([min(f) < high for f, high in zip(found, group["high"], strict=True)], bool)
        return pd.DataFrame({"print": group["print"].to_numpy()[late], "segment": group["segment"].to_numpy()[late], "first": pd.Series([f for f, x in zip(found, late, strict=True) if x], dtype=object)})

    def streamed(rows: DataFrame, key: str) -> DataFrame:
        dealt = rows.select("print", "segment", "doc_id", "high", "words", F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
        return dealt.groupBy("shard").applyInPandas(match, "print long, segment long, first array<long>")

    found = alone.unionAll(streamed(heads.where("not crowded"), "print").select("print", "segment", F.lit(0).cast("long").alias("shift"), "first"))
    if not several.where(F.col("segments") > shard_segments).isEmpty():
        each = F.transform(F.sequence(F.lit(1), F.size("w") - (least - 1)), lambda k: F.struct((k - 1).cast("long").alias("shift"), F.array_join(F.slice("w", k, least), " ").alias("words")))
        single = heads.where("crowded").withColumn("w", F.split("words", " ")).select("print", F.col("segment").alias("whole"), "doc_id", "high", F.explode(each).alias("part")).select("print", "whole", "doc_id", "high", "part.*")
        single = materialize(single.withColumn("segment", F.xxhash64("words")))
        distinct = single.groupBy("print", "segment").agg(F.min("doc_id").alias("doc_id"), F.max("high").alias("high"), F.min("words").alias("words"))
        back = materialize(streamed(distinct, "segment"))
        found = found.unionAll(single.select("print", "segment", "whole", "shift").join(back, ["print", "segment"]).select("print", F.col("whole").alias("segment"), "shift", "first"))
    found = materialize(found)
    late = cuts.select("print", "segment", "doc_id", "start").join(found, ["print", "segment"])
    at = F.transform(F.filter(F.transform("first", lambda d, k: F.struct(d.alias("d"), k.alias("k"))), lambda x: x["d"] < F.col("doc_id")), lambda x: F.col("start") + F.col("shift") + x["k"])
    gone = late.select("doc_id", at.alias("at")).where(F.size("at") > 0)
    gone = gone.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text)
                spans = []
                if at.is_valid:
                    starts = np.unique(at.values.to_numpy())
                    cuts = np.flatnonzero(np.diff(starts) > least) + 1
                    spans = [(int(s[0]), int(s[-1]) + least) for s in np.split(starts, cuts)]
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                rows.append((doc, len(words), len(words) - len(kept), b" ".join(kept), [{"start": a, "stop": b} for a, b in spans]))
            columns = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()).cast(pa.string()), pa.array(columns[4], span)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return map_arrow(source.join(gone, "doc_id", "left"), strip, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,stop:long>>")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: windows of 13 words."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN f USING (s) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM u ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
