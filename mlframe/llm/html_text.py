"""Main text of web pages: explicit markup decides where there is some, a suffix array over each host's pages the rest."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import Words, map_arrow, materialize, mix64, text_slices
from mlframe.llm.urls import host_and_path

# Element names and attribute words by their part in a page (fixed values).
HIDDEN = frozenset("script style noscript template title iframe object svg canvas audio video select textarea math".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog fieldset".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = frozenset("br td th img wbr input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist respond disqus discussion replies share sharing social related recommended recommendations trending toolbar pagination pager copyright disclaimer".split())
PAGE_WORDS = frozenset("header".split())  # only outside the main element, where a header is the page's

# Linear: quantifiers are possessive, a quote counts after = alone, and one that nothing closes ends the tag at the next >. The search ends at the page's last >.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
_CUT_OFF = re.compile(r"</?[a-zA-Z][^<]*+\Z")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Elements that an opening tag of the same group ends, if they are open and nothing else is in between.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}


def is_boilerplate(name: str, attributes: str, inside_main: bool) -> bool:
    """Whether markup says that an element is none of the article."""
    if name in BOILERPLATE:
        return not (inside_main and name == "header")
    if not attributes or not attributes.strip():
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "") in ROLES:
        return True
    if name in ("html", "body"):
        return False
    words = {w for key in ("class", "id") for w in _SPLIT.split(found.get(key, ""))}
    return bool(words & WORDS) or (not inside_main and bool(words & PAGE_WORDS))


def blocks_of(page: str | None) -> tuple[list[str], str]:
    """The page's blocks in order, and a mark for each: c within article or main, b where markup says boilerplate, u outside both.

    Character references are decoded, white space becomes one space, empty blocks are left out. Unclosed elements end with the element around them; comments, scripts and styles have no text; a < that starts no tag is text, a tag cut off by the end is not. Quotes matter only after =; an attribute whose quote nothing closes ends at the tag's >, so no text after it is lost.
    """
    texts, marks, piece = [], [], []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate here or above, main here or above
    mark, at, page = "u", 0, page or ""
    end = page.rfind(">") + 1  # no tag can end beyond

    def flush():
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                texts.append(text)
                marks.append(mark)

    def settle():
        nonlocal mark
        mark = ("b" if stack[-1][1] else "c" if stack[-1][2] else "u") if stack else "u"

    while m := _TAG.search(page, at, end):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        closes, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closes:
            if name in SPACE:
                piece.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[0] in BLOCK for x in stack[k:]):
                        flush()
                    del stack[k:]
                    settle()
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.IGNORECASE).search(page, at, end)
            at = close.end() if close else len(page)
            continue
        if name in SPACE:
            piece.append(" ")
        if name in BLOCK:
            flush()
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in _ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _ENDS[name]:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        above = stack[-1] if stack else ("", False, False)
        bad = above[1] or name in HIDDEN or is_boilerplate(name, attributes, above[2])
        was = mark
        mark_next = "b" if bad else "c" if above[2] or name in MAIN else "u"
        if mark_next != was:
            flush()
        stack.append((name, bad, above[2] or name in MAIN))
        mark = mark_next
    rest = page[at:]
    if cut := _CUT_OFF.search(rest):
        rest = rest[: cut.start()]
    piece.append(rest)
    flush()
    return texts, "".join(marks)


def repeated(tokens: np.ndarray, page: np.ndarray, least: int, identity: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a run of ``least`` tokens or more that stands in two different pages.

    ``tokens`` is all pages' streams in a row (equal numbers, equal tokens), ``page`` the page of each token, ``identity`` what copies of a page have in common (without it, every page is its own). The suffix array is sorted by prefix doubling until ranks cover ``least`` tokens; neighbours of one rank share that long a prefix, and the longer runs are unions of such windows. Windows do not cross pages.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < least:
        return covered
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while have < least:
        step = min(have, least - have)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        have += step
    whole = np.flatnonzero(page[: n - least + 1] == page[least - 1 :])
    if not len(whole):
        return covered
    order = whole[np.argsort(rank[whole], kind="stable")]  # the suffix array, of whole windows
    first = np.flatnonzero(np.diff(rank[order], prepend=-1))
    who = (page if identity is None else identity)[order]
    low, high = np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)
    return spans(order[np.repeat(low < high, np.diff(first, append=len(order)))], n, least)


def spans(starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of ``n`` tokens the windows of ``least`` tokens at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge[:-1]) > 0


def window_hashes(tokens: np.ndarray, least: int) -> np.ndarray:
    """64-bit hash of every window of ``least`` tokens; ``tokens`` are the words' hashes."""
    n = max(len(tokens) - least + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(least if n else 0):
        out += tokens[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    return mix64(out)


#: Bytes of a window's hash that travel.
HASH_BYTES = 6


def packed(hashes: np.ndarray) -> bytes:
    """The upper HASH_BYTES bytes of each 64-bit number."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Numbers of :func:`packed`, with zeros for the lower bytes."""
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def page_tokens(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all pages' blocks in a row, and the first token's number of each page (the last entry: the number of tokens)."""
    words = Words.of(pa.array(["\n".join(blocks).encode("utf-8", "surrogatepass") for blocks in pages], pa.binary()))
    return words.hashes(), words.first


def page_digests(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What equal token streams have in common, one number a page."""
    return np.array([xxhash.xxh3_64_intdigest(tokens[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.uint64)


def whole_windows(tokens: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, page and start of every window that lies within one page."""
    page = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = window_hashes(tokens, least)
    start = np.flatnonzero(page[: len(hashes)] == page[least - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[start], page[start], start


def shared_windows(group: pd.DataFrame) -> pd.DataFrame:
    """Window hashes of one host and part that stand on two different pages, to every shard where no two pages show it by themselves."""
    read = lambda column, kind: np.concatenate([np.frombuffer(x, kind) for x in group[column]])
    counts, hashes = read("counts", "<u4"), unpacked(b"".join(group["hashes"]))
    who, shard = np.repeat(read("digests", "<u8"), counts), np.repeat(read("shards", "<u4"), counts)
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    several = np.minimum.reduceat(who[order], first) < np.maximum.reduceat(who[order], first)
    order = order[np.repeat(several, np.diff(first, append=len(order)))]
    out = []
    if len(order):
        order = order[np.lexsort((hashes[order], shard[order]))]
        hashes, who, shard = hashes[order], who[order], shard[order]
        first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (shard[1:] != shard[:-1])))
        alone = first[np.minimum.reduceat(who, first) == np.maximum.reduceat(who, first)]
        cuts = np.flatnonzero(np.diff(shard[alone])) + 1
        out = [(int(shard[a[0]]), packed(hashes[a])) for a in np.split(alone, cuts) if len(a)]
    return pd.DataFrame({"host": [group["host"].iloc[0]] * len(out), "shard": [x[0] for x in out], "hashes": [x[1] for x in out]}, dtype=object)


def main_texts(pages: list[tuple[list[str], str]], least: int, elsewhere: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """Per page of one host's shard: its main text, its tokens, and those in runs repeated across pages; ``elsewhere`` has the hashes (:func:`unpacked`) of windows that repeat on pages of other shards."""
    tokens, first = page_tokens([texts for texts, _ in pages])
    sizes = np.diff(first)
    identity = page_digests(tokens, first)  # copies of a page count as one
    covered = repeated(tokens, np.repeat(np.arange(len(pages)), sizes), least, np.repeat(identity, sizes))
    if elsewhere is not None and len(elsewhere):
        hashes, _, start = whole_windows(tokens, first, least)
        low = np.uint64((1 << 8 * (8 - HASH_BYTES)) - 1)
        covered |= spans(start[np.isin(hashes & ~low, elsewhere)], len(tokens), least)
    out = []
    for (texts, marks), begin, stop in zip(pages, first[:-1].tolist(), first[1:].tolist(), strict=True):
        if "c" in marks:
            kept = [t for t, m in zip(texts, marks, strict=True) if m == "c"]
        else:
            kept, at = [], begin
            for text, mark in zip(texts, marks, strict=True):
                words = text.split(" ")
                here = covered[at : at + len(words)]
                at += len(words)
                if mark == "u" and not here.all():
                    kept.append(" ".join(w for w, c in zip(words, here, strict=True) if not c))
        out.append(("\n\n".join(kept), stop - begin, int(covered[begin:stop].sum())))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 8, shard_chars: int = 4_000_000, rounds: int = 2, broadcast_hosts: int = 100_000) -> DataFrame:
    """Main text of every page from its whole html; one row per row of ``pages``.

    Where a page has article or main elements, their blocks that no markup inside them marks as boilerplate are its text. Elsewhere blocks marked as boilerplate go, and of the others the runs of ``least`` or more tokens that the suffix array finds on two different pages of the host; unique runs stay. Copies of a page count as one page. The text is blocks joined by two line feeds.

    The pages of a host are dealt by a hash of the id into shards of about ``shard_chars`` characters of html, one suffix array each, so no task grows with a host. Before that the hashes of all pages' windows meet by host, in parts of four shards' size dealt by the hash, and those on two different pages go back to the shards, so a run is found wherever its pages are. Six bytes of a hash travel; as a part holds a few million windows at any size of the host, a window is taken for another with chance 1e-8. The hashes are worked through in ``rounds``, each of which reads and parses the pages again and has its shuffle freed, so they never take more disk than the texts. Only hosts of several shards are looked up, by a broadcast if they are at most ``broadcast_hosts`` (counted first), else by a shuffled join.

    Columns: page_id, url, text, n_chars (code points), n_tokens (of the whole page), n_repeated (in repeated runs). Null html: empty text. Null urls and urls without a host make one host of their own. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    host = F.coalesce(host_and_path(F.col(url_col))[0], F.lit(""))
    sizes = pages.groupBy(host.alias("host")).agg(F.sum(F.coalesce(F.length(html_col), F.lit(0))).alias("chars"))
    share = lambda n: F.ceil(F.col("chars") / F.lit(float(n))).cast("long")
    large = materialize(sizes.where(F.col("chars") > shard_chars).select("host", share(shard_chars).alias("shards"), share(4 * shard_chars).alias("parts")))
    if large.count() <= broadcast_hosts:
        large = F.broadcast(large)
    one = lambda c: F.coalesce(c, F.lit(1)).cast("long")
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("draw"), F.col(html_col).alias("html"))
    read = read.join(large, "host", "left").withColumn("shard", F.pmod("draw", one(F.col("shards")))).withColumn("parts", one(F.col("parts")))

    def windows(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, 8 << 20):
                tokens, first = page_tokens([blocks_of(x)[0] for x in batch.column(3).to_pylist()])
                digests, shards = page_digests(tokens, first), batch.column(2).to_numpy().astype("<u4")
                hashes, page, _ = whole_windows(tokens, first, least)
                mine = np.flatnonzero(hashes % np.uint64(rounds) == turn)
                hashes, page = hashes[mine], page[mine]
                host = batch.column(0).dictionary_encode()
                names, host = host.dictionary.to_pylist(), host.indices.to_numpy()[page]
                parts = batch.column(1).to_numpy().astype(np.uint64)[page]
                part = mix64(hashes) % parts
                cell = host * int(parts.max(initial=1)) + part.astype(np.int64)
                order = np.argsort(cell.astype(np.uint16) if cell.max(initial=0) < 1 << 16 else cell, kind="stable")  # pages stay in order
                hashes, page, part, host = hashes[order], page[order], part[order], host[order]
                edges = np.append(np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (host[1:] != host[:-1]))), len(hashes)).tolist() if len(hashes) else [0]
                rows = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    there, counts = np.unique(page[a:b], return_counts=True)
                    rows.append((names[host[a]], int(part[a]), digests[there].astype("<u8").tobytes(), shards[there].tobytes(), counts.astype("<u4").tobytes(), packed(hashes[a:b])))
                columns = [[r[k] for r in rows] for k in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["host", "part", "digests", "shards", "counts", "hashes"])

        return run

    shared = []
    for turn in range(rounds):
        spread = map_arrow(read.select("host", "parts", "shard", "html"), windows(turn), "host string, part long, digests binary, shards binary, counts binary, hashes binary")
        shared.append(materialize(spread.groupBy("host", "part").applyInPandas(shared_windows, "host string, shard long, hashes binary")))
    shared = reduce(DataFrame.unionAll, shared)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in text_slices(batches, 8 << 20):
            found = [blocks_of(x) for x in batch.column(4).to_pylist()]
            raw = ["\n".join(f[0]).encode("utf-8", "surrogatepass") for f in found]  # no block has a line feed
            columns = [pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["page_id", "url", "host", "shard", "size", "texts", "marks"])

    dealt = map_arrow(read.select("page_id", "url", "host", "shard", "html"), parse, "page_id long, url string, host string, shard long, size long, texts binary, marks string")

    def work(group: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        codec = pa.Codec("zstd")
        texts = [codec.decompress(x, n, asbytes=True).decode("utf-8", "surrogatepass").split("\n") if n else [] for x, n in zip(group["texts"], group["size"], strict=True)]
        out = main_texts(list(zip(texts, group["marks"], strict=True)), least, unpacked(b"".join(repeats["hashes"])))
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": [x[0] for x in out], "n_chars": [len(x[0]) for x in out], "n_tokens": [x[1] for x in out], "n_repeated": [x[2] for x in out]})

    return dealt.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard")).applyInPandas(work, "page_id long, url string, text string, n_chars long, n_tokens long, n_repeated long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
