"""Cost-balanced packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import map_arrow, text_slices

SCHEMA = "doc_id long, start long, length long, {ids}, doc_tokens long, sequence_id long, offset long, padded_length long, cost double"


class Encoder:
    """Token ids of a text as little-endian 32-bit integers, equal to those of the tokenizers library for the same file.

    A byte-level BPE file whose ids follow its merge order runs as ranks, which is several times faster; any other file runs in the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = None
        vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges") or []
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        plain = spec["model"].get("type") == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec.get("normalizer") is None
        if plain and all(vocab.get(m) == 256 + k for k, m in enumerate(merged)) and not spec["model"].get("continuing_subword_prefix"):
            import tiktoken

            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items() if token not in special}
            self.special = set(special)
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.marks = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        else:
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        """Ids of the whole text; long texts are worked on in pieces, cut where the splitting pattern cuts anyway."""
        if self.ranks is None or len(text) <= PIECE or any(" " in mark for mark in self.special):
            return self.encode(text)
        found, at = [], 0
        while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
            found.append(self.encode(text[at : cut.start() + 1]))
            at = cut.start() + 1
        return b"".join([*found, self.encode(text[at:])])

    def encode(self, text: str) -> bytes:
        if self.ranks is None:
            ids = self.other.encode(text, add_special_tokens=False).ids
        elif self.marks.search(text):
            ids = self.ranks.encode(text, allowed_special=self.special, disallowed_special=())
        else:
            ids = self.ranks._core_bpe.encode_ordinary(text)
        return array("I", ids).tobytes()


#: The splitting pattern of byte-level BPE files without one of their own (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters of a text that are tokenised at once.
PIECE = 1 << 20
_CUT = re.compile("[A-Za-z](?= [A-Za-z])")


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others follow from code point 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


def balance(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """Deals documents of ``lengths`` (each under ``seq_len``) to sequences that hold exactly their sum.

    Longest first, each to the sequence of lowest cost (linear * n + quadratic * n**2 for a piece of n tokens) among those where it fits; where it fits nowhere, the sequence with most room takes what it can and the rest queues again. Whole sequences hold ``seq_len``; what is left over makes sequences of powers of two, which need no padding. Returns pieces (document, start, length, sequence, offset), the capacity of each sequence, and its cost.
    """
    total = sum(lengths)
    room = [seq_len] * (total // seq_len) + [1 << b for b in reversed(range(seq_len.bit_length())) if (total % seq_len) >> b & 1]
    left, cost, caps = np.array(room, np.int64), np.zeros(len(room)), room
    queue = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    pieces = []
    while queue:
        n, k, start = heapq.heappop(queue)
        n = -n
        fits = left >= n
        at = int(np.where(fits, cost, np.inf).argmin())
        if not fits[at]:
            at = int(left.argmax())
        take = min(n, int(left[at]))
        pieces.append((k, start, take, at, caps[at] - int(left[at])))
        left[at] -= take
        cost[at] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, k, start + take))
    return pieces, caps, cost.tolist()


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, end_id: int = 1, group_tokens: int = 2 << 20, linear: float = 1.0, quadratic: float = 1 / 2048, digest: bool = False) -> DataFrame:
    """Packs all documents into sequences of ``seq_len`` tokens (a power of two); one row per piece.

    A document is its token ids and then ``end_id``. Whole runs of ``seq_len`` tokens make a sequence each; the rests gather, ``group_tokens`` at a time, and are dealt out by :func:`balance`. Every token lies in one piece. There is no shuffle: a task packs the rows it reads, holds one group at most, and numbers its sequences within its partition (``sequence_id`` = partition number * 2**32 + counter), so a repeated task gives the same rows.

    Columns: the document's id as doc_id, start, length, ids array<int> (with ``digest``: ids_crc32 long of the little-endian 32-bit ids), doc_tokens, sequence_id, offset, padded_length (``seq_len`` or the power of two that the sequence fills), cost (of the sequence).

    Null or empty text: one token, ``end_id``. Repeated rows are packed each for itself. Null ids stay null. An empty table gives no rows. Other columns are not read, so their names do not matter.
    """
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    schema = SCHEMA.format(ids="ids_crc32 long" if digest else "ids array<int>")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        base, made = (context.partitionId() if context else 0) << 32, 0
        rows: list[tuple] = []
        waiting: list[tuple] = []
        gathered = 0
        most_rows = 20_000 if digest else 2_000

        def row(doc, first, start, n, ids, total, sequence, offset, padded, cost):
            own = ids[4 * start : 4 * (start + n)]
            return (doc, first + start, n, zlib.crc32(own) if digest else np.frombuffer(own, "<i4"), total, base + sequence, offset, padded, cost)

        def out():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        def deal():
            nonlocal made
            pieces, caps, costs = balance([len(tail) // 4 for _, _, tail in waiting], seq_len, linear, quadratic)
            for k, start, n, at, offset in pieces:
                doc, first, tail = waiting[k]
                rows.append(row(doc, first, start, n, tail, first + len(tail) // 4, made + at, offset, caps[at], costs[at]))
            made += len(caps)
            waiting.clear()

        for batch in text_slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                whole = total // seq_len
                for k in range(whole):
                    rows.append(row(doc, 0, k * seq_len, seq_len, ids, total, made, 0, seq_len, linear * seq_len + quadratic * seq_len * seq_len))
                    made += 1
                    if len(rows) >= most_rows:
                        yield out()
                        rows.clear()
                if total % seq_len:
                    waiting.append((doc, whole * seq_len, ids[4 * whole * seq_len :]))
                    gathered += total % seq_len
                if gathered >= group_tokens:
                    deal()
                    gathered = 0
            if len(rows) >= most_rows:
                yield out()
                rows.clear()
        deal()
        if rows:
            yield out()

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema)


def packing_report(pieces: DataFrame) -> DataFrame:
    """One row: documents' tokens, sequences, padded tokens, and the largest and mean cost of a sequence."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.max("padded_length").alias("padded"), F.max("cost").alias("cost"))
    return per.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sequences"), F.sum(F.col("padded") - F.col("tokens")).alias("padding"), F.max("cost").alias("max_cost"), F.avg("cost").alias("mean_cost"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document of ``documents``, 2048 tokens, ids of byte_bpe_50k.json and then id 1."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
