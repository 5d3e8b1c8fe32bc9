"""Near-duplicate groups by MinHash bands, odd sketches of the samples, and exact confirmation on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlframe.llm.common import SPREAD, Words, discard, map_arrow, materialize, mix64, text_slices
from mlframe.llm.components import connected_components

#: Bits of the odd sketch of every document, and samples and bits of the sharper one that documents of unsettled buckets get.
SKETCH_BITS = 256
SHARP_SAMPLES, SHARP_BITS = 2048, 4096
_LAST = np.iinfo(np.int64).max


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words the whole sequence as one; empty without words."""
    n = len(words)
    if not n:
        return words
    take = min(n, size)
    value = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        value = (value * SPREAD) ^ mix64(words[k : n - take + 1 + k] + np.uint64(k))
    return np.unique(mix64(value))


def text_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    words = Words.of(texts, lower=True)
    hashes = words.hashes()
    return [shingle_set(hashes[a:b], size) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * samples + 1, dtype=np.uint64) * SPREAD)
    return seeds[:samples] | np.uint64(1), seeds[samples:]


def minhash(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """MinHash samples, one row per set (none of them empty)."""
    factor, shift = permutations(samples)
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), samples), np.uint64)
    for k in range(samples):
        value = flat * factor[k]
        value += shift[k]
        out[:, k] = np.minimum.reduceat(value, first)
    return out


def odd_sketch(signature: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of each row's samples: every (position, value) flips one of ``bits`` bits; bits / 64 numbers a row."""
    rows, samples = signature.shape
    bit = mix64(signature + np.arange(samples, dtype=np.uint64) * SPREAD) & np.uint64(bits - 1)
    at = np.arange(rows)[:, None] * bits + bit.astype(np.int64)
    parity = (np.bincount(at.ravel(), minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(parity, axis=1, bitorder="little").view("<u8")


def most_flips(samples: int, bits: int, threshold: float, deviations: float = 5.5) -> int:
    """Set bits of the XOR of two odd sketches that a pair of similarity ``threshold`` exceeds only ``deviations`` standard deviations out.

    A pair of similarity s is expected to differ in bits / 2 * (1 - exp(-4 samples (1 - s) / bits)) bits; the spread has the part of the MinHash samples and the part of samples that share a bit.
    """
    load = 4 * samples * (1 - threshold) / bits
    mean, slope = bits / 2 * (1 - math.exp(-load)), 2 * samples * math.exp(-load)
    variance = slope**2 * threshold * (1 - threshold) / samples + bits / 4 * (1 - math.exp(-2 * load))
    return min(bits, math.ceil(mean + deviations * math.sqrt(variance)))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: doc_id, n_shingles, high and low (digest of the set), bands (one hash each), sketch (four numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            sets = text_sets(batch.column(1), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            band, sketch = [None] * len(sets), [None] * len(sets)
            if full:
                signature = minhash([sets[k] for k in full], bands * rows)
                keys = np.zeros((len(full), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = mix64(keys * SPREAD ^ signature[:, r::rows])
                for k, b, o in zip(full, keys.view(np.int64), odd_sketch(signature, SKETCH_BITS).view(np.int64), strict=True):
                    band[k], sketch[k] = b, o
            digest = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(d[0]) for d in digest], pa.int64()), pa.array([int(d[1]) for d in digest], pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "high", "low", "bands", "sketch"],
            )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), run, "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, a digest of the set, and items (the set of shingles) of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            sets = text_sets(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "digest", "items"])

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    return map_arrow(some, run, "doc_id long, digest binary, items array<long>")


def sharp_sketches(sets: DataFrame) -> DataFrame:
    """doc_id and sharp (odd sketch of SHARP_SAMPLES samples, as bytes) from full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            sketch = odd_sketch(minhash([x.values.to_numpy().view(np.uint64) for x in batch.column(1)], SHARP_SAMPLES), SHARP_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in sketch], pa.binary())], names=["doc_id", "sharp"])

    return map_arrow(sets.select("doc_id", "items"), run, "doc_id long, sharp binary")


def flips(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, SKETCH_BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full sets have denominator * shared >= numerator * union."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(denominator * shared >= numerator * (F.size("x") + F.size("y") - shared)).select("a", "b")


def cross_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of documents of one bucket but different components whose sharp sketches differ in at most ``limit`` bits.

    ``rows``: bucket, doc_id, comp, sharp, bands, main (component of the bucket's hub), hub, n (rows of the bucket). Documents outside the main component meet all others; large buckets are cut into cells of bounded size, in which the outsiders of one part meet the documents of another, so that no task holds a bucket and no pair is written that the sketches rule out. Of the buckets that a pair shares, only the one of smallest number writes it.
    """
    tiles, parts = F.ceil(F.col("n") / 2048).cast("int"), F.ceil(F.col("n") / 16384).cast("int")
    other = F.col("comp") != F.col("main")
    mine = lambda count, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), count).cast("int")
    span = lambda count: F.sequence(F.lit(0), count - 1)
    as_target = F.transform(span(parts), lambda p: F.struct(p.alias("part"), mine(tiles, 1).alias("tile"), F.lit(False).alias("left")))
    as_left = F.transform(span(tiles), lambda t: F.struct(mine(parts, 2).alias("part"), t.alias("tile"), F.lit(True).alias("left")))
    cells = rows.where(F.col("doc_id") != F.col("hub")).withColumn("cell", F.explode(F.when(other, F.concat(as_target, as_left)).otherwise(as_target))).select("bucket", "cell.*", "doc_id", "comp", "sharp", "bands")
    cells = cells.repartition("bucket", "part", "tile").sortWithinPartitions("bucket", "part", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def meet():
            if len(held) < 2:
                return
            left, ids, comp = (np.array([h[k] for h in held]) for k in range(3))
            sketch = np.frombuffer(b"".join(h[3] for h in held), "<u8").reshape(len(held), -1)
            bands = np.stack([h[4] for h in held])
            target = np.flatnonzero(~left)
            for at in np.flatnonzero(left):
                differ = np.bitwise_count(sketch[target] ^ sketch[at]).sum(1) <= limit
                near = target[differ & (comp[target] != comp[at])]
                shared = np.where(bands[near] == bands[at], bands[near], _LAST).min(1)
                for t in near[shared == key[0]]:
                    found.append((min(ids[t], ids[at]), max(ids[t], ids[at])))

        def out():
            pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            bands = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1)
            for b, p, t, left, doc, comp, sketch, own in zip(*(c.to_pylist() for c in batch.columns[:7]), bands, strict=True):
                if (b, p, t) != key:
                    meet()
                    key, held = (b, p, t), []
                    if len(found) > 50_000:
                        yield out()
                held.append((left, doc, comp, sketch, own))
        meet()
        yield out()

    return cells.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, numerator: int = 80, denominator: int = 100, bands: int = 32, rows: int = 4) -> DataFrame:
    """Groups documents whose sets of ``shingle``-word runs have similarity numerator / denominator or more, directly or through others.

    Words are runs without ASCII white space, A-Z lower-cased. Steps: (1) per document its set's digest, MinHash bands and the odd sketch of its samples; (2) documents of equal sets become one class; (3) each band's bucket links its classes to a hub, the class that meets most others over all buckets, sketches rule out what is far below the threshold, full sets confirm the rest, and links give components; (4) in buckets that still hold several components, documents of different components meet by sharper sketches, made for these documents only, and then full sets, so no link between different texts is lost to the hub; (5) components over all links. A pair of similarity s shares no bucket with chance (1 - s**rows)**bands: 5e-8 at 0.8.

    Columns: doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id). One row per row of ``docs``. Texts that are null or without words have no shingles and are linked with nothing; with fewer words than ``shingle`` the whole sequence is one shingle. Rows of a null id are linked with nothing: component_id null, kept false. Repeated rows share their component; rows of one id with different texts are one document that is linked with whatever any of these texts is linked with. An empty table gives none; other columns are not read.
    """
    base = materialize(signatures(docs, id_col, text_col, shingle, bands, rows))
    real = base.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    heads = materialize(real.join(classes, ["high", "low"]).where("doc_id = rep").select("doc_id", "high", "low", "bands", "sketch").dropDuplicates(["doc_id", "high", "low"]).drop("high", "low"))
    banded = heads.select("doc_id", F.explode("bands").alias("bucket"))
    busy = materialize(banded.join(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"))
    company = busy.groupBy("doc_id").agg(F.sum("n").alias("company"))
    hubs = busy.join(company, "doc_id").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("minus"))).alias("m")).select("bucket", (-F.col("m.minus")).alias("hub"))
    busy = materialize(busy.join(hubs, "bucket"))
    threshold = numerator / denominator
    limit = most_flips(bands * rows, SKETCH_BITS, threshold)

    def sketched(pairs: DataFrame) -> DataFrame:
        side = lambda name: heads.select(F.col("doc_id").alias(name), F.col("sketch").alias(f"sketch_{name}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").where(flips(F.col("sketch_a"), F.col("sketch_b")) <= limit).select("a", "b")

    sets = materialize(full_sets(docs, busy.select("doc_id").distinct(), id_col, text_col, shingle).where(F.size("items") > 0).dropDuplicates(["doc_id", "digest"]))
    spokes = busy.where("doc_id <> hub").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    first = materialize(confirm(sketched(spokes), sets, numerator, denominator))
    groups = connected_components(first)
    placed = busy.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("bucket", "doc_id", "n", "hub", F.coalesce("component", "doc_id").alias("comp"))
    mixed = placed.where("n > 2").groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(F.when(F.col("doc_id") == F.col("hub"), F.col("comp"))).alias("main")).where("least <> most").select("bucket", "main")
    open_ = materialize(placed.join(mixed, "bucket"))
    sharp = sharp_sketches(sets.join(open_.select("doc_id").distinct(), "doc_id", "left_semi"))
    near = cross_pairs(open_.join(sharp, "doc_id").join(heads.select("doc_id", "bands"), "doc_id"), most_flips(SHARP_SAMPLES, SHARP_BITS, threshold))
    second = confirm(near, sets, numerator, denominator)
    groups = connected_components(first.unionAll(second))
    member = base.join(classes, ["high", "low"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    done = member.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, of the document of smallest id of every group of :func:`near_duplicates`; equal rows of one id and text once.

    Rows without an id are in no group and stay as they are. An empty table stays empty.
    """
    found = materialize(near_duplicates(docs, id_col, text_col, **how).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct())
    known = docs.where(F.col(id_col).isNotNull()).withColumn("_id", F.col(id_col).cast("long")).join(found, "_id", "left_anti")
    once = known.withColumn("_row", F.row_number().over(Window.partitionBy("_id", text_col).orderBy("_id"))).where("_row = 1")
    return once.select(*docs.columns).unionAll(docs.where(F.col(id_col).isNull()))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, numerator=85)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, b.b FROM reach r JOIN both_ways b ON b.a = r.other),
m AS (SELECT node, min(other) AS least FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, d.doc_id = coalesce(m.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""
