"""Benchmark decontamination: MinHash containment search in size partitions, then exact shingle containment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import materialize

#: What stands between words: words are runs of digits, letters and non-ASCII characters, after lower-casing (fixed value).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Cutting at what stands between words takes a ninth of the time of extracting them; only the ends can be empty."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def shingles(tokens: Column, size: Column | int, value) -> Column:
    """``value`` of each run of ``size`` words; an empty array of fewer words.

    ``tokens`` should be a plain column: an expression would be worked out anew for every run.
    """
    size = F.lit(size) if isinstance(size, int) else size
    many = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: value(F.slice(tokens, i, size)))
    return F.when(F.size(tokens) >= size, many).otherwise(F.slice(F.array(value(tokens)), 1, 0))


def sketch_items(items: DataFrame, samples: int, least_hits: int, threshold: float) -> DataFrame:
    """Bottom-``samples`` MinHash sketch of every item: item_id, size, partition, need (hits that make a candidate), limit (largest hash of the partition's sketches), print (one row per sample).

    Partition p holds the items of more than ``samples`` * 2**(p-1) and at most ``samples`` * 2**p shingles. In partition 0 a sketch is the whole set and a candidate needs the threshold itself; in the others ``samples`` hashes stand for the set.
    """
    own = items.withColumn("partition", F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / samples))).cast("int"))
    own = own.withColumn("print", F.slice(F.array_sort("hashes"), 1, samples)).withColumn("need", F.when(F.col("partition") == 0, F.ceil(F.col("size") * threshold - 1e-9)).otherwise(F.lit(least_hits)))
    limits = own.groupBy("partition").agg(F.max(F.element_at("print", -1)).alias("limit"))
    return own.join(limits, "partition").select("item_id", "partition", "need", "limit", F.explode("print").alias("print"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8, samples: int = 16, least_hits: int = 4, broadcast_rows: int = 1_000_000, broadcast_words: int = 4_000_000) -> DataFrame:
    """Pairs of a document and a test item of whose distinct ``shingle``-word runs the document has ``threshold`` or more.

    Words are runs of letters, digits and non-ASCII characters, lower-cased, so punctuation and line breaks do not hide an item. Items are partitioned by size; each has a bottom-``samples`` MinHash sketch, and a document's sketch for a partition is its shingle hashes up to that partition's largest sampled hash. A pair whose sketches share enough hashes (in partition 0 the threshold, else ``least_hits``, which a contained item misses with chance 3e-7) is a candidate; for candidates alone, the full sets of shingles as text decide.

    An item of fewer words than ``shingle`` is one run of all its words, and documents are searched for runs of that length too: it is found wherever its words stand next to each other.

    Columns: doc_id, item_id, n_item (distinct shingles of the item), n_shared, containment. Null texts and ids, and texts without words, take no part. Repeated rows give one pair (of one id with several texts, the best). Empty tables give none; other columns are not read.

    Sketches are broadcast while they have at most ``broadcast_rows`` rows, and the items' shingles while they have at most ``broadcast_words`` words (both counted first), else joined by a shuffle whose large keys adaptive execution splits; hits are counted with partial sums before the shuffle, so an item that a third of all documents hold costs a row a document.
    """
    print_of = lambda w: F.xxhash64(w)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("w")).where("item_id is not null and size(w) > 0")
    tests = tests.withColumn("length", F.least(F.size("w"), F.lit(shingle)))
    tests = tests.select("item_id", "length", F.array_distinct(shingles(F.col("w"), F.col("length"), lambda w: F.array_join(w, " "))).alias("runs"), F.array_distinct(shingles(F.col("w"), F.col("length"), print_of)).alias("hashes")).dropDuplicates(["item_id", "runs"])
    tests = materialize(tests.withColumn("size", F.size("runs")))
    sketches = materialize(sketch_items(tests, samples, least_hits, threshold))
    known = tests.agg(F.collect_set("length").alias("lengths"), F.sum(F.col("size") * F.col("length")).alias("words")).first()
    lengths = sorted(known["lengths"]) or [shingle]  # at most ``shingle`` of them
    few = sketches.count() <= broadcast_rows
    most = sketches.agg(F.max("limit")).first()[0]
    every = lambda value: F.concat(*[shingles(F.col("w"), n, value) for n in lengths])
    parts = source.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(every(print_of)).alias("print")).where(F.col("print") <= F.lit(most if most is not None else 0))
    sample = F.broadcast(sketches) if few else sketches
    hits = parts.join(sample, "print").where("print <= limit").groupBy("doc_id", "item_id", "need").agg(F.count_distinct("print").alias("hits")).where("hits >= need")
    candidates = materialize(hits.select("doc_id", "item_id").distinct())
    texts = source.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.array_distinct(every(lambda w: F.array_join(w, " "))).alias("have"))
    full = F.broadcast(tests) if (known["words"] or 0) <= broadcast_words else tests
    both = candidates.join(full.select("item_id", "runs", "size"), "item_id").join(texts, "doc_id")
    found = both.select("doc_id", "item_id", "size", F.size(F.array_intersect("have", "runs")).alias("shared")).where(F.col("shared") >= F.col("size") * threshold - 1e-9)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("containment"), F.col("size").cast("long").alias("n_item"), F.col("shared").cast("long").alias("n_shared"))).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All items of ``benchmark`` in all of ``documents``."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH t AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), l AS (SELECT item_id, w, least(len(w), 5) AS n FROM t WHERE len(w) > 0),
i AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k+n-1], ' '))) AS s FROM l
), c AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k+n-1], ' '))) AS s
  FROM d, (SELECT DISTINCT n FROM l) WHERE len(w) >= n
)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM s JOIN i USING (s) JOIN c USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING count(*) >= n_item * 0.8 - 1e-9
"""
