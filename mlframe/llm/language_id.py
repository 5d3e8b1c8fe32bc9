"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import map_arrow, mix64, text_slices

ORDER = 4
#: Symbols beside letters: between words, and before a text.
GAP, EDGE = 32, 1
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
#: Marks that belong to the letter before them.
_MARK = range(0x300, 0x370)
#: Characters of a text that are worked on at once.
PIECE = 4 << 20
#: Symbols that are scored at once.
CHUNK = 1 << 18


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and each text's end: lower-case letters and the marks on them, one GAP for any run of others, ORDER - 1 EDGEs first.

    Letters beyond the basic plane share 4096 symbols of the private area. A text without letters has its EDGEs only.
    """
    parts, ends, total = [], [], 0
    edge = np.full(ORDER - 1, EDGE, np.uint16)
    for text in texts:
        parts.append(edge)
        total += len(edge)
        inside = False  # whether the last character is part of a word
        own = []
        for at in range(0, len(text or ""), PIECE):
            code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            letter = _LETTER[code]
            mark = (code >= _MARK.start) & (code < _MARK.stop)
            before = np.append(inside, letter[:-1])
            while (more := mark & before & ~letter).any():  # marks after letters and after such marks
                letter = letter | more
                before = np.append(inside, letter[:-1])
            inside = bool(letter[-1])
            code = np.where(code > 0xFFFF, 0xE000 + code % 0x1000, code)
            own.append(np.where(letter, code, GAP)[letter | before].astype(np.uint16))
        parts += own
        total += sum(map(len, own))
        ends.append(total)
    return np.concatenate(parts) if parts else edge[:0], np.array(ends, np.int64)


def grams(line: np.ndarray) -> np.ndarray:
    """Per symbol, it and the three before it as one 64-bit number (zeros before the start)."""
    wide = line.astype(np.uint64)
    key = wide.copy()
    for back in range(1, ORDER):
        key[back:] |= wide[:-back] << np.uint64(16 * back)
    return key


@dataclass
class Table:
    """Sorted hashes of n-grams with one row of log-probabilities (or of back-off logs) over the languages. ``first`` has the place of the first hash for each value of the upper bits, about two for each hash: a key is a step or two from there."""

    hashes: np.ndarray  # and the largest number behind them
    rows: np.ndarray
    first: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Table:
        hashes = mix64(keys)
        order = np.argsort(hashes)
        hashes, bits = hashes[order], max(1, len(keys).bit_length())
        first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return cls(np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF)), rows[order].astype(np.float32), first, np.uint64(64 - bits))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, and whether the key is there."""
        hashes = mix64(keys)
        at = self.first[hashes >> self.shift]
        here = self.hashes[at]
        before = np.flatnonzero(here < hashes)
        while len(before):
            at[before] += 1
            here[before] = self.hashes[at[before]]
            before = before[here[before] < hashes[before]]
        inside = at < len(self.rows)
        return np.where(inside, at, 0), (here == hashes) & inside


@dataclass
class Model:
    """Interpolated Kneser-Ney models of all languages over the union of their n-grams, and the calibration of their scores."""

    languages: list[str]
    tables: list[Table]  # of orders 1 to ORDER
    backoff: list[Table | None]  # by context, for orders 2 to ORDER
    unseen: np.ndarray  # log-probability of a symbol that no language has
    centre: np.ndarray  # per language, expected cross-entropy of its own texts
    spread: np.ndarray  # per language, its standard deviation between texts
    per_symbol: np.ndarray  # per language, the part of that deviation that falls with 1 / sqrt(length)
    limit: np.ndarray  # per language, the deviation beyond which a text is rejected
    sharpness: float = 1.0  # of the posterior

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        at, there = self.tables[order - 1].find(keys)
        out = self.tables[order - 1].rows[at]
        if there.all():
            return out
        missing = np.flatnonzero(~there)
        if order == 1:
            out[missing] = self.unseen
            return out
        lost = keys[missing]
        lower = self.log_probs(lost & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        row, known = self.backoff[order - 1].find(lost >> np.uint64(16))
        lower += np.where(known[:, None], self.backoff[order - 1].rows[row], 0)
        out[missing] = lower
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language, nats per symbol (nan without letters), and per text the number of symbols."""
        line, ends = symbols(texts)
        counts = np.diff(ends, prepend=0) - (ORDER - 1)
        out = np.full((len(texts), len(self.languages)), np.nan)
        full = np.flatnonzero(counts)
        if len(full) and self.languages:
            keys = grams(line)[line != EDGE]
            first = (np.cumsum(counts) - counts)[full]
            total = np.zeros((len(full), len(self.languages)))
            for at in range(0, len(keys), CHUNK):
                logs = self.log_probs(keys[at : at + CHUNK])
                low, high = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(logs))
                total[low:high] -= np.add.reduceat(logs, np.maximum(first[low:high] - at, 0), axis=0, dtype=np.float64)
            out[full] = total / counts[full, None]
        return out, counts

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: language (und without letters), score, cross-entropy, deviations above the expected one, and whether it is rejected."""
        if not self.languages:
            none = np.full(len(texts), np.nan)
            return ["und"] * len(texts), np.zeros(len(texts)), none, none, np.ones(len(texts), bool)
        entropy, counts = self.cross_entropy(texts)
        empty = counts == 0
        entropy[empty] = 0
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        weight = np.exp(-self.sharpness * np.sqrt(np.maximum(counts, 1))[:, None] * (entropy - least[:, None]))
        score = np.where(empty, 0, 1 / weight.sum(1))
        z = (least - self.centre[best]) / np.sqrt(self.spread[best] ** 2 + self.per_symbol[best] ** 2 / np.maximum(counts, 1))
        rejected = empty | (z > self.limit[best])
        return [("und" if e else self.languages[b]) for e, b in zip(empty, best, strict=True)], score, np.where(empty, np.nan, least), np.where(empty, np.nan, z), rejected


def build(languages: list[str], keys: np.ndarray, counts: np.ndarray) -> Model:
    """From the union of ORDER-grams and their counts per language (rows: n-grams) to the interpolated models.

    Top order: raw counts. Lower orders: in how many different contexts to the left an n-gram is seen. Discount n1 / (n1 + 2 n2) per order and language; the mass taken off goes to the next lower order; order 1 mixes with the uniform distribution over the symbols of all languages.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        levels = [(keys, counts.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            key, count = levels[0]
            low = key & np.uint64((1 << 16 * order) - 1)
            unique, at = np.unique(low, return_inverse=True)
            lower = np.zeros((len(unique), len(languages)))
            np.add.at(lower, at, count > 0)
            levels.insert(0, (unique, lower))
        size = len(levels[0][0]) + 1
        tables, backoff, below = [], [], None
        unseen = None
        for order, (key, count) in enumerate(levels, 1):
            ones, twos = (count == 1).sum(0), (count == 2).sum(0)
            discount = np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
            context, of = np.unique(key >> np.uint64(16), return_inverse=True)
            total, types = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
            np.add.at(total, of, count)
            np.add.at(types, of, count > 0)
            left = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            own = np.where(total[of] > 0, np.maximum(count - discount, 0) / np.maximum(total[of], 1), 0.0)
            if order == 1:
                lower = np.full((len(key), len(languages)), 1 / size)
                unseen = np.log(left[0] / size)
            else:
                lower = np.exp(below.rows[below.find(key & np.uint64((1 << 16 * (order - 1)) - 1))[0]].astype(np.float64))
            below = Table.of(key, np.log(own + left[of] * lower))
            tables.append(below)
            backoff.append(None if order == 1 else Table.of(context, np.log(left)))
    n = len(languages)
    return Model(list(languages), tables, backoff, unseen.astype(np.float32), np.zeros(n), np.ones(n), np.ones(n), np.full(n, np.inf))


def calibrate(model: Model, entropy: np.ndarray, counts: np.ndarray, truth: np.ndarray, false_rejects: float) -> Model:
    """Sets centre, spreads, sharpness and the limit of rejection from texts that were not counted; ``truth`` has language numbers.

    The limit of a language is the deviation that a share ``false_rejects`` of its own texts exceeds: beyond the ninth decile of the sample, deviations are taken to fall off exponentially with their mean excess (one deviation at least, as samples may be small), since so small a share is beyond the sample itself. Twice the sample's largest deviation is the least that is set. A language with fewer than eight texts rejects nothing.
    """
    right = entropy[np.arange(len(truth)), truth] if len(truth) else np.zeros(0)
    for k in range(len(model.languages)):
        own, n = right[truth == k], counts[truth == k]
        if len(own) >= 8:
            long = n >= np.median(n)
            centre = np.median(own[long])
            deviation = lambda x: 1.4826 * np.median(np.abs(x - centre)) + 1e-3
            spread = deviation(own[long])
            model.centre[k], model.spread[k] = centre, max(spread, 0.05)
            model.per_symbol[k] = max(1.0, float(np.median(np.abs(own - centre) * np.sqrt(n)) * 1.4826))
            z = (own - centre) / np.sqrt(model.spread[k] ** 2 + model.per_symbol[k] ** 2 / n)
            decile = np.quantile(z, 0.9)
            model.limit[k] = max(2 * z.max(), decile + max(1.0, np.mean(z[z >= decile] - decile)) * np.log(0.1 / false_rejects))
        else:
            model.centre[k], model.spread[k], model.per_symbol[k] = 2.5, 0.3, 2.0
    best = (np.inf, 1.0)
    for sharp in 2.0 ** np.arange(-3, 6):
        if len(truth):
            weight = -sharp * np.sqrt(counts)[:, None] * (entropy - entropy.min(1, keepdims=True))
            loss = float(np.mean(np.log(np.exp(weight).sum(1)) - weight[np.arange(len(truth)), truth]))
            best = min(best, (loss, float(sharp)))
    model.sharpness = best[1]
    return model


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 3000, sample_chars: int = 100_000, calibration_docs: int = 400, max_languages: int = 200, false_rejects: float = 1e-5) -> Model:
    """Fits on a bounded sample: about ``sample_docs`` texts of each language with at most ``sample_chars`` characters each (whole texts; longer ones are not drawn), and about ``calibration_docs`` more for the calibration. Of more than ``max_languages`` languages the most frequent are learned.

    The draw is by a hash of id and text, so it does not depend on order or partitions. What reaches the driver, and what is broadcast later, is at most the distinct n-grams of that sample. Rows without text or language take no part; without any rows the model judges every text ``und``.
    """
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("draw")).where("text is not null and lang is not null")
    counted = train.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(text_col).alias("n")).where("n > 0")
    per = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not per:
        return Model([], [], [], *[np.zeros(0)] * 5)
    rows = rows.where(F.col("lang").isin(list(per)))
    languages = sorted(per)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, (sample_docs + calibration_docs) / per[k]))])
    drawn = rows.where(F.length("text") <= sample_chars).where(F.pmod("draw", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    apart = F.pmod(F.shiftright("draw", 32), F.lit(1 << 20)) < (1 << 20) * calibration_docs // (sample_docs + calibration_docs)
    number = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                line, _ = symbols(texts)
                key, n = np.unique(grams(line)[line != EDGE], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number[lang], np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = map_arrow(drawn.where(~apart).select("text", "lang"), count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    gram = counted["gram"].to_numpy().view(np.uint64)
    keys, at = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(keys), len(languages)))
    counts[at, counted["lang"].to_numpy()] = counted["n"].to_numpy()
    model = build(languages, keys, counts)
    shared = train.sparkSession.sparkContext.broadcast(model)
    n_lang = len(languages)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            entropy, n = shared.value.cross_entropy(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(entropy), pa.list_(pa.float64())), pa.array(n), pa.array([number[x] for x in batch.column(1).to_pylist()], pa.int32())], names=["entropy", "n", "lang"])

    seen = map_arrow(drawn.where(apart).select("text", "lang"), measure, "entropy array<double>, n long, lang int").where("n > 0").toArrow()
    entropy = np.array(seen["entropy"].to_pylist(), np.float64).reshape(-1, n_lang)
    return calibrate(model, entropy, seen["n"].to_numpy().astype(float), seen["lang"].to_numpy(), false_rejects)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: the lowest cross-entropy per symbol; one row per row of ``docs``, without a shuffle.

    Columns: doc_id, lang_pred, score (calibrated posterior, 0 to 1), cross_entropy (nats per symbol), deviation (in units of the calibrated spread), rejected (further above what texts of that language have than the calibrated limit, or und). Ties go to the language first in order. Null, empty and letterless texts: und, score 0, nulls, rejected. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            lang, score, entropy, z, rejected = shared.value.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(z, from_pandas=True), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "deviation", "rejected"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, lang_pred string, score double, cross_entropy double, deviation double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the models do not reject; no join, the text is judged where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            rejected = shared.value.judge(batch.column(batch.schema.get_field_index(text_col)).to_pylist())[4]
            yield batch.filter(pa.array(~rejected))

    return map_arrow(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4 (a null id does not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: learns from the documents not held out and judges all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "deviation", "rejected")
