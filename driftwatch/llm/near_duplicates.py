"""SimHash near-duplicates by covering locality-sensitive hashing, and the components that their links form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import SMALL_ROWS, small_batches, staged

#: Words of a shingle; the hash is XXH64 with this seed.
SHINGLE, SEED = 3, 42
#: Differing bits at which fingerprints still link.
RADIUS = 3
#: Fingerprints of one chunk of a bucket. A bucket with more is dealt out as pairs of chunks.
CHUNK = 512


def fingerprint(text: str | None) -> int:
    """Bit by bit the majority of the shingles' hashes; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks such that any so many differing bits all lie outside one of them at least.

    Each bit gets a nonzero vector of radius + 1 bits. For each nonzero vector v, a mask keeps the bits whose vectors
    have an odd product with v. Any radius vectors have a nonzero v that is orthogonal to all of them, so its mask
    keeps none of the bits that differ.
    """
    size = 1 << (radius + 1)
    vector = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp, a signed 64-bit number, for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _forest(fp: np.ndarray, node: np.ndarray, u: list, v: list) -> None:
    """Add edges that join the fingerprints within RADIUS of each other as all their links would: one less than members, for each component."""
    rest = np.arange(len(fp))
    while len(rest) > 1:
        heap, rest = [rest[0]], rest[1:]
        while heap and len(rest):
            k = heap.pop()
            near = np.bitwise_count(fp[rest] ^ fp[k]) <= RADIUS
            if near.any():
                new = rest[near]
                u.append(np.full(len(new), node[k]))
                v.append(node[new])
                heap.extend(new)
                rest = rest[~near]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells come sorted; each is handled when its last row has come. Those of two rows, most of them, are handled at once."""
    held: list[np.ndarray] = []

    def solve(cell, fp, node):
        u, v = [], []
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        u.append(node[near])
        v.append(node[near + 1])
        for a, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            _forest(fp[a : a + n], node[a : a + n], u, v)
        a, b = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    for batch in batches:
        cell, fp, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        fp = fp.view(np.uint64)
        if held:
            cell, fp, node = (np.concatenate(x) for x in zip(held, (cell, fp, node)))
        if not len(cell):
            continue
        cut = int(np.flatnonzero(cell == cell[-1])[0]) if cell[0] != cell[-1] else 0
        if cut:
            yield solve(cell[:cut], fp[:cut], node[:cut])
        held = [cell[cut:], fp[cut:], node[cut:]]
    if held:
        yield solve(*held)


def links(nodes: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp, node): edges (u, v), u < v, whose components are those of all links.

    In each table, fingerprints that agree on its mask share a bucket. A bucket yields a spanning forest of its links,
    not all pairs. One of more than CHUNK fingerprints is dealt out by chunks, each pair of chunks a cell of its own: n
    different fingerprints of one bucket make about n * n / CHUNK rows, so beyond some 100,000 that agree on a mask of 32
    bits or so the rows outgrow the table. Copies don't count, as fingerprints are different ones.
    """
    spark = nodes.sparkSession
    masks = covering_masks()
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("t", "key")
    spread = nodes.select("fp", "node", keys)
    sizes = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), chunks).cast("int")
    cells = spread.join(sizes, ["t", "key"]).select("fp", "node", "t", "key", chunks.alias("c"), mine.alias("a"))
    cells = cells.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cell = F.xxhash64("t", "key", F.least("a", "b"), F.greatest("a", "b"))
    cells = cells.select(cell.alias("cell"), "fp", "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_linked, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, to (node, component), the smallest node reachable, for all nodes with an edge.

    Alternates two steps until edges no longer change: each node links its larger neighbours, then its smaller ones
    and itself, to the smallest node it sees. Rounds grow with the logarithm of the longest path; every one is staged in
    the shared folder.
    """
    edges = staged(edges, "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = staged(large, "links")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), F.col("v")).union(joined.select(F.col("m"), F.col("u"))).where("u < v").distinct()
        edges = staged(small, "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its fingerprint, and as component the smallest id reachable over links of RADIUS bits or less.

    Ids are integers. A null text is empty; texts without words have fingerprint zero and link like any other. Repeated
    rows share their component. A row with a null id is linked to nothing: its component is null. Other columns are
    ignored. An empty table gives an empty result. Exact copies meet by their fingerprint before any search.
    """
    prints = staged(fingerprints(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col), "fingerprints")
    nodes = staged(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    named = nodes.join(components(links(nodes)), "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = prints.join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that with the smallest id. All columns stay.

    Rows that repeat the kept id are one document and stay once: the row whose values' hash is least, so that the
    choice is the same in every run. Rows with a null id are linked to nothing and all stay. An empty table stays empty.
    """
    gone = staged(near_duplicates(docs, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    # few ids are broadcast, so that texts stay where they are
    few = gone.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("bigint") == F.col("_gone"), "left_anti")
    repeated = staged(docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col].alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated")
    if repeated.isEmpty():  # else rows would be shuffled twice more for nothing
        return kept
    same = kept[id_col] == F.col("_id")
    again = kept.join(repeated, same, "left_semi").select(F.struct("*").alias("_row"), F.xxhash64("*").alias("_h"))
    one = again.groupBy(F.col("_row")[id_col]).agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
    return kept.join(repeated, same, "left_anti").unionByName(one)
