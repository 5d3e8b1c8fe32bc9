"""Licence scan: Aho-Corasick over phrases and tags, and a shunting-yard reading of licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import LOWER_ASCII, map_arrow, text_slices

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases: label and weight of evidence (fixed values).
NOTICES = {
    "apache license": ("apache", 0.8), "apache license version 2 0": ("apache-2.0", 0.95), "licensed under the apache license": ("apache", 0.95),
    "mit license": ("mit", 0.8), "permission is hereby granted free of charge": ("mit", 0.9), "the software is provided as is without warranty of any kind": ("mit", 0.6),
    "bsd license": ("bsd", 0.8), "redistribution and use in source and binary forms": ("bsd", 0.9), "isc license": ("isc", 0.8),
    "lesser general public license": ("lgpl", 0.9), "affero general public license": ("agpl", 0.9), "gnu general public license": ("gpl", 0.9), "general public license version 2": ("gpl-2.0", 0.95), "general public license version 3": ("gpl-3.0", 0.95), "general public license v2": ("gpl-2.0", 0.95), "general public license v3": ("gpl-3.0", 0.95),
    "mozilla public license": ("mpl", 0.9), "mozilla public license version 2 0": ("mpl-2.0", 0.95), "eclipse public license": ("epl", 0.9), "boost software license": ("bsl", 0.9),
    "creative commons attribution": ("cc-by", 0.9), "cc by sa": ("cc-by-sa", 0.9), "cc by nc": ("cc-by-nc", 0.9), "cc by nd": ("cc-by-nd", 0.9), "cc by nc sa": ("cc-by-nc-sa", 0.9), "cc by nc nd": ("cc-by-nc-nd", 0.9), "cc0": ("cc0", 0.7), "public domain dedication": ("public-domain", 0.8), "released into the public domain": ("public-domain", 0.8),
}
BASE_WEIGHT = {"cc-by": 0.7, "gpl": 0.8, "reserved": 0.5}
#: The tag before a licence expression, as words.
TAG = "spdx license identifier"
_TAG_TEXT = re.compile(r"spdx-license-identifier[ \t]*:?[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
#: Binding strength of operators, as the licence-expression grammar has it (fixed values).
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: First parts of identifiers by what they ask of a user (fixed values).
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "cc-by-4", "cc-by-3", "bsl", "python", "postgresql", "0bsd", "ncsa", "x11")
COPYLEFT = ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "cc-by-sa", "osl")

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, verdict string"
_NON_WORD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER_ASCII)


def looks_like_identifier(token: str) -> bool:
    """Not plain prose: a known first part, or a digit or hyphen inside."""
    return judge(token) != "unknown" or bool(re.search(r"[0-9-]", token.rstrip(".-")))


def parse_expression(text: str) -> list[str]:
    """Postfix form of the licence expression at the start of ``text`` by the shunting-yard method; prose after a whole expression ends it; [] if there is none.

    Operands and operators must alternate and brackets must close; the longest start of ``text`` for which they do is read.
    """
    tokens, at = [], 0
    best, out, stack, want = 0, [], [], True
    depth = 0
    while m := _TOKEN.match(text, at):  # the longest whole prefix
        token, at = m[1], m.end()
        tokens.append(token)
        low = token.lower()
        if want:
            if token == "(":
                depth += 1
            elif token == ")" or low in PRECEDENCE or not looks_like_identifier(low):
                break
            else:
                want = False
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif low in PRECEDENCE:
            want = True
        else:
            break
        if not want and not depth:
            best = len(tokens)
    for token in tokens[:best]:
        low = token.lower()
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
        else:
            out.append(low.rstrip("."))
    return out + stack[::-1]


def judge(identifier: str) -> str:
    if identifier.startswith(COPYLEFT):
        return "copyleft"
    return "permissive" if identifier.startswith(PERMISSIVE) else "unknown"


_RANK = {"permissive": 0, "copyleft": 1, "unknown": 2}


def evaluate(postfix: list[str]) -> str:
    """What the expression asks at least: ``or`` takes the laxer side, ``and`` the stricter; ``with`` adds an exception, which leaves the licence what it is."""
    stack: list[str] = []
    for token in postfix:
        if token == "with":
            stack.pop()
        elif token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append((min if token == "or" else max)(a, b, key=_RANK.get))
        else:
            stack.append(judge(token))
    return stack[0] if stack else "unknown"


def automaton():
    """Aho-Corasick automaton over words joined by one space, with a space at either end; UTF-8 read as Latin-1."""
    import ahocorasick

    found: dict[str, list] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label, BASE_WEIGHT[label]))
    for phrase, (label, weight) in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label, weight))
    found.setdefault(TAG, []).append(("tag", "", 0.0))
    made = ahocorasick.Automaton()
    for phrase, what in found.items():
        made.add_word(f" {phrase} ", (len(phrase) + 1, what))
    made.make_automaton()
    return made


def scan_text(text: str | None, machine) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expression, verdict) of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_NON_WORD).split()
    joined = b" " + b" ".join(words) + b" "
    base, places, labels, miss, tagged = set(), [], set(), 1.0, False
    seen = set()
    for end, (back, what) in machine.iter(joined.decode("latin-1")):
        start = end - back
        for kind, label, weight in what:
            if kind == "base":
                base.add(label)
                places.append(start)
            if kind == "tag":
                tagged = True
            else:
                labels.add(label)
                if (kind, label) not in seen:
                    seen.add((kind, label))
                    miss *= 1 - weight
    expressions, verdict = [], None
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            if postfix := parse_expression(m[1]):
                expressions.append(" ".join(postfix))
                labels.update(t for k, t in enumerate(postfix) if t not in PRECEDENCE and not (k + 1 < len(postfix) and postfix[k + 1] == "with"))
                v = evaluate(postfix)
                verdict = v if verdict is None else max(verdict, v, key=_RANK.get)
                miss *= 0.01
    order = [joined.count(b" ", 0, p) for p in ((min(places), max(places)) if places else ())]
    return (len(words), len(places), order[0] if places else None, order[1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss, "; ".join(expressions) or None, verdict)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans every whole text for licence notices and licence-expression tags; one row per row of ``docs``, without a shuffle.

    Words are runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters. Columns: doc_id; n_words; n_base, first_word, last_word and base_labels of the base phrases; labels of all phrases and of expressions' identifiers (exceptions left out); score, the chance that at least one notice is real (1 - product of 1 - weight over distinct labels; a whole expression counts 0.99); expression, the postfix forms in order; verdict, what the strictest expression asks (permissive, copyleft or unknown; null without an expression).

    Null or empty text: no words, nulls for first_word and last_word, empty labels, score 0. A tag without a readable expression adds nothing. Repeated rows give repeated rows; an empty table gives none. Other columns are not read.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()] + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in text_slices(batches):
            rows = [scan_text(t, machine) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
