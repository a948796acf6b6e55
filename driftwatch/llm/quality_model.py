"""Quality classifier: random-indexing word vectors pooled by document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import beside_texts, held_out, joined_by_id, small_batches, staged

#: Numbers of a word vector, words beside a word that count as its context, how many numbers of an index vector aren't zero.
DIMENSIONS, CONTEXT, NONZERO = 32, 2, 6
#: A word has a context vector of its own if it stands so often in all texts together; its parts alone describe a rarer one.
MIN_COUNT = 5
#: Context vectors, of 40 bytes, that are broadcast; more are looked up for each chunk of the texts.
BROADCAST_VECTORS = 2_000_000
#: Labelled rows that the network is fitted to, and parts into which that sample is dealt.
SAMPLE_ROWS, SAMPLE_PARTS = 20_000, 16
#: Share of the sample kept from the network to calibrate its probabilities: one in so many.
CALIBRATE_PART = 5
#: Hidden units, passes over the sample, rows of a step, rate of learning, weight decay.
HIDDEN, EPOCHS, STEP, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
#: Words whose vectors a worker keeps; words of the texts pooled together; words whose vectors are laid out at a time;
#: context vectors that a task gathers before it hands them on.
CACHE, GROUP, BLOCK, GATHERED_VECTORS = 400_000, 1 << 18, 1 << 15, 500_000
#: Index vectors from which each word and each part of a word draws one by its hash.
POOL = 1 << 14
#: The seed of the network's start and of the order of its sample.
SEED = 17
#: Numbers that describe a text, see pooled.
FEATURES = 3 * DIMENSIONS + 4

_KINDS = np.zeros(0x110000, np.uint64)  # by code point; 0: not met yet


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """Texts in groups of some GROUP words: the first text's place, the different words, each word by its number among
    these, and words by text. White space parts words; a null text has none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # not what is before the first and after the last
    before = np.r_[0, np.cumsum(full)]
    bounds = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    words = words.filter(pa.array(full))
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GROUP, "right")) - 1)
        coded = words.slice(bounds[first], bounds[last] - bounds[first]).dictionary_encode()
        yield first, coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(bounds[first : last + 1])
        first = last


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ordered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values."""
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    return _mixed(np.add.reduceat(_mixed(values + (at.astype(np.uint64) << np.uint64(32))), starts))


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between marks, where each word starts, and its length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    cp = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    return cp, np.cumsum(lengths) - lengths, lengths


def hashes_of(words: list[str]) -> np.ndarray:
    return _ordered(*_marked(words)) if words else np.zeros(0, np.uint64)


def _kinds(cp: np.ndarray) -> np.ndarray:
    """Kinds of characters: 1 upper case, 2 other letters, 3 digits; others are each their own."""
    for c in np.unique(cp[_KINDS[cp] == 0]).tolist():
        x = chr(c)
        _KINDS[c] = 1 if x.isupper() else 2 if x.isalpha() else 3 if x.isdigit() else c + 4
    return _KINDS[cp]


@lru_cache(maxsize=1)
def _pool() -> np.ndarray:
    """Sparse vectors: NONZERO places, drawn at random, hold plus and minus one in turn."""
    rng, out = np.random.default_rng(SEED), np.zeros((POOL, DIMENSIONS), np.int8)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(POOL), rng.integers(0, DIMENSIONS, POOL)), -1 if k % 2 else 1)
    return out


def _drawn(hashes: np.ndarray) -> np.ndarray:
    """Which index vector each hash draws."""
    return (hashes >> np.uint64(20)).astype(np.int64) % POOL


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


def part_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its hash, and the sum of the index vectors of its parts, at unit length: its characters in threes, its
    shape (runs of kinds of characters), itself."""
    cp, starts, lengths = _marked(words)
    n = len(words)
    own = _ordered(cp, starts, lengths)
    owner = np.repeat(np.arange(n), lengths)
    last = np.ones(len(cp), bool)
    last[starts + lengths - 1] = last[starts + lengths - 2] = False
    at = np.flatnonzero(last)
    threes = _mixed(cp[at] | cp[at + 1] << np.uint64(21) | cp[at + 2] << np.uint64(42))
    kinds = _kinds(cp)
    runs = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])])
    sizes = np.bincount(owner[runs], minlength=n)
    shapes = _ordered(kinds[runs] | np.uint64(1 << 40), np.cumsum(sizes) - sizes, sizes)
    pool, drawn, out = _pool(), _drawn(threes), np.empty((n, DIMENSIONS), np.float32)
    ends = np.cumsum(lengths - 2)  # each word has as many threes as characters
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        first = ends[a] - lengths[a] + 2
        out[a:b] = np.add.reduceat(pool[drawn[first : ends[b - 1]]], ends[a:b] - lengths[a:b] + 2 - first, axis=0, dtype=np.int32)
    return own, _unit(out + pool[_drawn(shapes)] + pool[_drawn(own)])


@dataclass
class Contexts:
    """Context vectors by word: sorted 64-bit hashes, and vectors of unit length as multiples of 1/127."""

    keys: np.ndarray
    vectors: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hashes), DIMENSIONS), np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            found = self.keys[at] == hashes
            out[found] = self.vectors[at[found]].astype(np.float32) / 127
        return out


class Vectors:
    """Word vectors: what a word's parts say, and its context vector if it has one. A worker keeps CACHE of them."""

    def __init__(self, contexts: Contexts):
        self.contexts = contexts
        self.slots: dict[str, int] = {}
        self.rows = np.zeros((0, DIMENSIONS), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.slots]
        if len(self.slots) + len(new) > CACHE:
            self.slots, self.rows, new = {}, self.rows[:0], words
        if new:
            hashes, v = part_vectors(new)
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
            self.rows = np.concatenate([self.rows[: len(self.slots) - len(new)], _unit(v + self.contexts.of(hashes))])
        return self.rows[np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))]


def pooled(texts: pa.Array, vectors: Vectors) -> np.ndarray:
    """A text's numbers: mean and spread of its word vectors, mean product with the next word's vector, share of different
    words, likeness of neighbours, log of the length, share of repeated lines."""
    out = np.zeros((len(texts), FEATURES))
    for first, words, codes, lengths in grouped(texts):
        if not len(codes):
            continue
        own, n = vectors.of(words), len(lengths)
        doc = np.repeat(np.arange(n), lengths)
        total, square, product = (np.zeros((n, DIMENSIONS)) for _ in range(3))
        ends = np.cumsum(lengths).tolist()
        for k, end in enumerate(ends):
            start = ends[k - 1] if k else 0
            for a in range(start, end, BLOCK):
                v = own[codes[max(a - 1, start) : min(a + BLOCK, end)]]  # with the word before the block
                product[k] += np.einsum("ij,ij->j", v[1:], v[:-1])
                v = v[int(a > start) :]
                total[k] += v.sum(0)
                square[k] += np.einsum("ij,ij->j", v, v)
        size = np.maximum(lengths, 1)[:, None]
        kinds = np.bincount(np.unique(doc * len(words) + codes) // len(words), minlength=n)
        mean = total / size
        rest = np.column_stack([kinds / size[:, 0], product.sum(1) / size[:, 0], np.log1p(lengths) / 8, np.zeros(n)])
        numbers = np.concatenate([mean, np.sqrt(np.maximum(square / size - mean * mean, 0)), product / size, rest], axis=1)
        for k in np.flatnonzero(lengths):
            lines = [x for x in texts[first + k].as_py().split("\n") if x.strip()]
            numbers[k, -1] = 1 - len(set(lines)) / len(lines)
        out[first : first + n] = numbers
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    #: The calibrated probability is the sigmoid of the network's number over the temperature.
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Classifier:
    """The network on most rows, by Adam; its temperature on one row in CALIBRATE_PART. With one class alone, its share decides."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-4)
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    model = Classifier(mean, scale, layers)
    if not 0 < y.sum() < len(y):
        model.layers[2], model.layers[3] = np.zeros(HIDDEN), np.array(5.0 if y.sum() else -5.0)
        return model
    apart = np.arange(len(y)) % CALIBRATE_PART == 0 if len(y) >= 20 * CALIBRATE_PART else np.zeros(len(y), bool)
    z, t = np.clip((x[~apart] - mean) / scale, -8, 8), y[~apart]
    first, second, steps = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(t))
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(t), STEP):
            rows = order[a : a + STEP]
            w1, b1, w2, b2 = model.layers
            pre = z[rows] @ w1 + b1
            hidden = np.maximum(pre, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - t[rows]) / len(rows)
            back = np.outer(error, w2) * (pre > 0)
            steps += 1
            for k, g in enumerate((z[rows].T @ back + DECAY * w1, back.sum(0), hidden.T @ error + DECAY * w2, error.sum())):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.layers[k] = model.layers[k] - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    if apart.any():
        logit, t = model.logits(x[apart]), y[apart]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logit / c) - t * logit / c) for c in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their values."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(np.concatenate(values)[order], starts, axis=0) if len(key) else np.concatenate(values)


def _around(codes: np.ndarray, doc: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Of each word the sum of the index vectors up to CONTEXT words beside it, in the same text; and how often it stands."""
    pool, out = _pool(), np.zeros((len(drawn), DIMENSIONS + 1), np.int32)
    for a in range(0, len(codes), BLOCK):
        at = a + np.argsort(codes[a : a + BLOCK], kind="stable")
        v = np.zeros((len(at), DIMENSIONS), np.int8)
        for d in (*range(-CONTEXT, 0), *range(1, CONTEXT + 1)):
            beside = np.clip(at + d, 0, len(codes) - 1)
            v += pool[drawn[codes[beside]]] * ((doc[beside] == doc[at]) & (beside == at + d))[:, None]
        word = codes[at]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[starts], :-1] += np.add.reduceat(v, starts, axis=0, dtype=np.int32)
        out[word[starts], -1] += np.diff(np.r_[starts, len(word)]).astype(np.int32)
    return out


def _packed(key: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, vector) of sums whose last column is n; a vector takes half a byte a number, one, two or four, as it
    needs: most words are met a few times by a task, and their numbers are small."""
    most = np.abs(v[:, :-1]).max(1, initial=0)
    for low, high, kind in ((-1, 7, ""), (7, 127, "<i1"), (127, 32767, "<i2"), (32767, 2**31, "<i4")):
        at = np.flatnonzero((most > low) & (most <= high))
        if len(at):
            own = v[at, :-1]
            packed = _as_bytes(own, kind) if kind else _as_bytes((own[:, ::2] + 8) << 4 | own[:, 1::2] + 8, "<u1")
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(v[at, -1].astype(np.int64)), packed], ["key", "n", "vector"])


def _unpacked(column: pa.Array) -> np.ndarray:
    out, sizes = np.empty((len(column), DIMENSIONS), np.int64), pc.binary_length(column).to_numpy()
    at = np.flatnonzero(sizes == DIMENSIONS // 2)
    if len(at):
        pairs = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
        out[at, ::2], out[at, 1::2] = (pairs >> 4).astype(np.int64) - 8, (pairs & 15).astype(np.int64) - 8
    for width in (1, 2, 4):
        at = np.flatnonzero(sizes == width * DIMENSIONS)
        if len(at):
            out[at] = _from_bytes(column.take(pa.array(at)), f"<i{width}")
    return out


def context_vectors(texts: DataFrame, min_count: int) -> DataFrame:
    """From (text) to (key, vector): for each word that stands min_count times or more in all texts together the sum of the
    index vectors of the words up to CONTEXT places beside it; as DIMENSIONS whole numbers in bytes, little-endian.

    The texts are read once. Each task hands on the sums of all words that it meets, since none can tell which are
    frequent; those that turn out rare are left out when the sums meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, words, codes, lengths in grouped(batch.column(0)):
                own = hashes_of(words)
                keys.append(own)
                values.append(_around(codes, np.repeat(np.arange(len(lengths)), lengths), _drawn(own)))
                held += len(own)
                if held > GATHERED_VECTORS:
                    key, v = _summed(keys, values)
                    keys, values, held = [key], [v], len(key)
                    if held > GATHERED_VECTORS // 2:
                        yield from _packed(key, v)
                        keys, values, held = [], [], 0
        if keys:
            yield from _packed(*_summed(keys, values))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by key of rows that come sorted by it."""
        rest: tuple[np.ndarray, np.ndarray] | None = None

        def frequent(key: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            often = v[:, -1] >= min_count
            return pa.RecordBatch.from_arrays([pa.array(key[often]), _as_bytes(v[often, :-1])], ["key", "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, v = batch.column(0).to_numpy(), np.column_stack([_unpacked(batch.column(2)), batch.column(1).to_numpy()])
            if rest is not None:
                key, v = np.concatenate([rest[0], key]), np.concatenate([rest[1], v])
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, v = key[starts], np.add.reduceat(v, starts, axis=0)
            yield frequent(key[:-1], v[:-1])
            rest = key[-1:], v[-1:]
        if rest is not None:
            yield frequent(*rest)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInArrow(run, "key bigint, n bigint, vector binary").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(add, "key bigint, vector binary")


def _as_bytes(v: np.ndarray, kind: str = "<i8") -> pa.Array:
    """Rows of whole numbers as binary values."""
    width = v.shape[1] * int(kind[-1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((np.arange(len(v) + 1) * width).astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(v, kind).tobytes())])


def _from_bytes(column: pa.Array, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, DIMENSIONS)


def contexts_of(texts: DataFrame, min_count: int | None = None) -> Broadcast | DataFrame:
    """The Contexts of a (text) table's frequent words, less their mean; every row of it counts. As a table (key, vector)
    where they are too many to broadcast."""
    sums = staged(context_vectors(texts, min_count or MIN_COUNT), "contexts")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = 0, np.zeros(DIMENSIONS)
        for batch in batches:
            n += batch.num_rows
            v += _from_bytes(batch.column(1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v.tobytes()], pa.binary())], ["n", "v"])

    parts = sums.mapInArrow(total, "n bigint, v binary").toArrow()  # one short row a task
    mean = sum((np.frombuffer(v) for v in parts.column("v").to_pylist()), np.zeros(DIMENSIONS)) / max(1, sum(parts.column("n").to_pylist()))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.rint(_unit(_from_bytes(batch.column(1)) - mean) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["key", "vector"])

    units = sums.mapInArrow(unit, "key bigint, vector binary")
    if sum(parts.column("n").to_pylist()) > BROADCAST_VECTORS:
        return staged(units, "unit-contexts")
    got = units.toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    vectors = np.frombuffer(b"".join(got.column("vector").to_pylist()), np.int8).reshape(-1, DIMENSIONS)
    return texts.sparkSession.sparkContext.broadcast(Contexts(keys[order], vectors[order]))


def _numbered(docs: DataFrame, contexts: Broadcast | DataFrame, id_col: str, text_col: str, finish: Callable[[np.ndarray], list[pa.Array]], added: str) -> DataFrame:
    """docs with the columns that finish makes of their texts' numbers."""
    if isinstance(contexts, DataFrame):
        keys_of = lambda texts: (k for _, words, _, _ in grouped(pa.array(texts, pa.string())) for k in hashes_of(words).view(np.int64).tolist())

        def prepare(known: dict[int, bytes]) -> Vectors:
            keys = np.fromiter(known, np.int64, len(known)).view(np.uint64)
            order = np.argsort(keys)
            return Vectors(Contexts(keys[order], np.frombuffer(b"".join(known.values()), np.int8).reshape(-1, DIMENSIONS)[order]))

        return beside_texts(docs, id_col, text_col, keys_of, "bigint", lambda by_chunk: by_chunk.join(contexts, "key"), "vector", "binary", prepare, lambda texts, vectors: finish(pooled(pa.array(texts, pa.string()), vectors)), added)
    at, names = docs.columns.index(text_col), docs.columns
    made = [part.split()[0] for part in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(contexts.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *finish(pooled(batch.column(at), vectors))], [*names, *made])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added]))


@dataclass
class Model:
    contexts: Broadcast | DataFrame
    classifier: Classifier


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Word vectors from all of docs, and a network from about sample_rows labelled rows, chosen by hash from those that
    are not held out; all of them if fewer.

    A null label is none; of conflicting labels of one id the largest counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    contexts = contexts_of(rows.select("text"))
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col, 4, 2)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = staged(joined_by_id(rows, chosen, "_id").select("_id", "y", "text"), "quality-sample").repartition(SAMPLE_PARTS)
    as_bytes = lambda x: [pa.array([row.astype(np.float32).tobytes() for row in x], pa.binary())]
    got = _numbered(sample, contexts, "_id", "text", as_bytes, "x binary").select("y", "x").toArrow()
    y = got.column("y").to_numpy().astype(float)
    x = np.array([np.frombuffer(b, np.float32) for b in got.column("x").to_pylist()], float).reshape(-1, FEATURES)
    if not len(y):
        empty = [np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(())]
        return Model(contexts, Classifier(np.zeros(FEATURES), np.ones(FEATURES), empty))
    order = np.lexsort((*np.round(x.T[:3], 4), y))  # whatever the order in which tasks end
    mixed = np.random.default_rng(SEED).permutation(len(order))
    return Model(contexts, train(x[order][mixed], y[order][mixed]))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Each row is scored by its text and the word vectors of docs: repeated rows get the same score, a null text is empty,
    a null id stays null and is not held out, other columns are ignored. An empty table gives an empty result; without
    labels all scores are 0.5.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.classifier)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _numbered(rows, model.contexts, "doc_id", "text", lambda x: [pa.array(shared.value.score(x))], "score double")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
