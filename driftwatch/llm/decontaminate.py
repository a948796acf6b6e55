"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows against every window of every text."""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import small_batches, staged

#: Words of a window.
WINDOW = 10
#: Bytes that words are made of, A-Z as a-z: digits, letters and all that is beyond ASCII. The rest parts words.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def _edges(text: str) -> list[tuple[int, int]]:
    """Start and end of each word, in characters."""
    out, start = [], -1
    for i, c in enumerate(text):
        inside = ord(c) >= 0x80 or (c.isascii() and c.isalnum())
        if inside and start < 0:
            start = i
        elif not inside and start >= 0:
            out.append((start, i))
            start = -1
    return out + ([(start, len(text))] if start >= 0 else [])


class WindowSet:
    """Windows of a block of benchmark items, found by their anchor: the longest word, the first one on ties.

    Items are kept once, as words parted by spaces. A window is a stretch of that: windows of one anchor, place of the
    anchor and number of words lie side by side, sorted by hash; a hit of the hash is compared with the words.
    """

    def __init__(self, items: list[tuple[str, str | None]]):
        self.items = [item for item, _ in items]
        parts, rows, anchors, at = [], [], {}, 0
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            ends = list(accumulate(len(w) + 1 for w in words))
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                window = words[i : i + WINDOW]
                place = max(range(len(window)), key=lambda j: (len(window[j]), -j))
                anchor = anchors.setdefault(window[place], len(anchors))
                start = at + (ends[i - 1] if i else 0)
                rows.append((anchor, place, len(window), xxhash.xxh64_intdigest(b" ".join(window)), start, at + ends[i + len(window) - 1] - 1, k))
            parts.append(b" ".join(words) + b" " if words else b"")
            at += len(parts[-1])
        self.text = b"".join(parts)
        columns = list(zip(*rows)) or [()] * 7
        group = np.array(columns[0], np.int64) << 16 | np.array(columns[1], np.int64) << 8 | np.array(columns[2], np.int64)
        hashes = np.array(columns[3], np.uint64)
        order = np.lexsort((hashes, group))
        group = group[order]
        # as arrays of the language, which it reads faster one by one
        self.hashes = array("Q", hashes[order].tobytes())
        self.start, self.end, self.item = (array("q", np.array(c, np.int64)[order].tobytes()) for c in columns[4:])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        self.bounds = array("q", np.append(first, len(group)).astype(np.int64).tobytes())
        self.place, self.size = (x.astype(np.uint8).tobytes() for x in (group[first] >> 8 & 255, group[first] & 255))
        # an anchor's groups: the number of the first, and how many
        own = np.searchsorted(group[first] >> 16, np.arange(len(anchors) + 1))
        self.anchors = {w: int(own[k]) << 8 | int(own[k + 1] - own[k]) for w, k in anchors.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences as (first word, end), and the items they belong to."""
        found, items = [], set()
        if self.anchors.keys().isdisjoint(words):
            return found, items
        get = self.anchors.get
        for i, w in enumerate(words):
            if (groups := get(w)) is None:
                continue
            for g in range(groups >> 8, (groups >> 8) + (groups & 255)):
                at, n = self.place[g], self.size[g]
                if i < at or i - at + n > len(words):
                    continue
                window = b" ".join(words[i - at : i - at + n])
                h, high = xxhash.xxh64_intdigest(window), self.bounds[g + 1]
                k = bisect_left(self.hashes, h, self.bounds[g], high)
                if k == high or self.hashes[k] != h:
                    continue
                own = set()
                while k < high and self.hashes[k] == h:
                    if self.text[self.start[k] : self.end[k]] == window:
                        own.add(self.items[self.item[k]])
                    k += 1
                if own:
                    found.append((i - at, i - at + n))
                    items |= own
        return found, items


#: About what a block holds in memory: bytes a window, and bytes an item and a different anchor beside their text.
WINDOW_BYTES, ITEM_BYTES = 32, 250


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[WindowSet]:
    """The benchmark, block by block, so that what is broadcast at once is bounded whatever the benchmark's size.

    A block is full when its text, windows and anchors, each word counted as one, would hold max_bytes of memory.
    """
    items, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        items.append((item, text))
        words = words_of(text)
        held += len(text or "") + ITEM_BYTES + WINDOW_BYTES * len(words) + ITEM_BYTES * len(set(words)) // 2
        if held >= max_bytes:
            yield WindowSet(items)
            items, held = [], 0
    if items:
        yield WindowSet(items)


def _spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping occurrences as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(found):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def _over_blocks(rows: DataFrame, text_col: str, blocks: Iterator[WindowSet], finish, schema) -> DataFrame:
    """rows through mapInArrow, where finish(batch, words, spans, items) gets what all blocks have found in each row.

    A pass broadcasts one block. With more than one, a pass adds its findings to the rows and stages them for the next.
    """
    spark, names, at = rows.sparkSession, rows.columns, rows.columns.index(text_col)
    small_batches(spark)

    def findings(batch: pa.RecordBatch, block: WindowSet):
        words, spans, items = [words_of(t) for t in batch.column(at).to_pylist()], [], []
        held = zip(*(c.to_pylist() for c in batch.columns[len(names) :])) if len(batch.columns) > len(names) else [((), ())] * len(words)
        for w, (old, known) in zip(words, held):
            found, own = block.hits(w)
            pairs = list(zip(old[::2], old[1::2]))
            spans.append(_spans(found + pairs) if found else pairs)
            items.append(own | set(known))
        return words, spans, items

    def last(block):
        def run(batches):
            for batch in batches:
                words, spans, items = findings(batch, block.value)
                yield finish(pa.RecordBatch.from_arrays(batch.columns[: len(names)], names), words, spans, items)

        return run

    def carry(block):
        def run(batches):
            for batch in batches:
                _, spans, items = findings(batch, block.value)
                more = [pa.array([[x for s in row for x in s] for row in spans], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], [*names, *extra])

        return run

    extra = ["_found_spans", "_found_items"]
    while set(extra) & set(names):
        extra = [x + "_" for x in extra]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {extra[0]} array<int>, {extra[1]} array<string>"
    block = next(blocks, WindowSet([]))
    for following in blocks:
        shared = spark.sparkContext.broadcast(block)
        rows = staged(rows.mapInArrow(carry(shared), kinds), "decontamination")
        shared.unpersist()
        block = following
    return rows.mapInArrow(last(spark.sparkContext.broadcast(block)), schema)


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of docs: words, words inside an occurrence of a benchmark window, and the items that occur.

    Null text: no words, no hits. Null or word-less item text: no windows. Null item id: the empty string. Items with
    the same id count as one. Repeated rows give repeated results, a null id stays null, other columns are ignored, an
    empty benchmark leaves everything clean. Nothing is shuffled. A benchmark that would hold more than max_bytes of
    memory is broadcast and scanned for block by block; each further block stages docs anew.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def finish(batch, words, spans, items):
        hit = [sum(b - a for a, b in row) for row in spans]
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else _NO_ITEMS for x in items]
        numbers = [pa.array(x, pa.int64()) for x in ([len(w) for w in words], hit, [len(x) for x in items])]
        return pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names)

    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return _over_blocks(rows, "text", _blocks(benchmark, item_col, item_text_col, max_bytes), finish, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", action: str = "drop", max_bytes: int = 64 << 20) -> DataFrame:
    """docs without contamination: action "drop" leaves out contaminated rows, "cut" removes the words that are hit.

    All columns stay. What is cut goes from the first hit word's start to the last one's end; rows without hits are
    passed on unchanged, nulls included.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"action must be drop or cut, not {action}")
    at = docs.columns.index(text_col)

    def finish(batch, words, spans, items):
        if action == "drop":
            return batch.filter(pa.array([not row for row in spans], pa.bool_()))
        texts = batch.column(at).to_pylist()
        for k, row in enumerate(spans):
            if row:
                edges, out, place = _edges(texts[k]), [], 0
                for first, end in row:
                    out.append(texts[k][place : edges[first][0]])
                    place = edges[end - 1][1]
                texts[k] = "".join(out) + texts[k][place:]
        columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return _over_blocks(docs, text_col, _blocks(benchmark, item_col, item_text_col, max_bytes), finish, docs.schema)
