"""Toxicity: one Kneser-Ney character model of words for each class, and their length-normalised log-likelihoods compared."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import beside_texts, held_out, joined_by_id, small_batches, staged

#: Characters of the longest n-grams; orders above SHARED are counted by class, those up to it for both classes together.
ORDER, SHARED = 5, 2
#: Rows of all tables of counts that may be broadcast, some 280 MB; longer ones are joined.
SMALL_COUNTS = 6_000_000
#: What each order takes off a count and gives to the shorter n-grams.
DISCOUNT = 0.75
#: Words of the windows whose likelihoods are compared beside the whole text's, and most words kept by a worker's cache.
WINDOW, CACHE = 20, 200_000
#: Numbers that describe a text, see features_of.
FEATURES = 6
#: Rows kept from the counts to fit the scale of the score: one labelled row in CALIBRATE_PART, CALIBRATE_ROWS or so at most.
CALIBRATE_PART, CALIBRATE_ROWS = 4, 20_000

_START, _END = 2, 3
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each after ORDER - 1 start marks and before an end mark; and where characters are predicted."""
    lead = chr(_START) * (ORDER - 1)
    cp = np.frombuffer("".join(f"{lead}{w}{chr(_END)}" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    return cp, np.flatnonzero(cp != _START)


def _hashes(cp: np.ndarray, at: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """A 64-bit hash of the n characters that end at each place, or skip places before it."""
    h = np.full(len(at), 0x9E3779B97F4A7C15 + n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            h = (h ^ cp[at - (k + skip)]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def count_grams(rows: DataFrame) -> DataFrame:
    """From (cls, text) to one row per class and n-gram of ORDER characters: hashes of all its endings, of what precedes
    their last character, and its count. Words are counted before n-grams, batch by batch."""
    names = [f"h{n}" for n in range(ORDER, 0, -1)] + [f"c{n}" for n in range(ORDER, 1, -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_class: dict[int, Counter] = {}
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_class.setdefault(cls, Counter()).update(words_of(text))
            for cls, words in by_class.items():
                if not words:
                    continue
                cp, at = _points(list(words))
                times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 1 for w in words])
                top, first, inverse = np.unique(_hashes(cp, at, ORDER), return_index=True, return_inverse=True)
                at = at[first]
                columns = [top] + [_hashes(cp, at, n) for n in range(ORDER - 1, 0, -1)] + [_hashes(cp, at, n - 1, 1) for n in range(ORDER, 1, -1)]
                n = np.bincount(inverse, times).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), cls, np.int32))] + [pa.array(c.view(np.int64)) for c in columns] + [pa.array(n)], ["cls", *names, "n"])

    raw = rows.mapInArrow(run, "cls int, " + ", ".join(f"{c} bigint" for c in names) + ", n bigint")
    return raw.groupBy("cls", *names).agg(F.sum("n").alias("n"))


class Lookup:
    """Exact counts by 64-bit hash in memory: sorted hashes, the place where each leading part of a hash starts, and columns of counts."""

    def __init__(self, rows: pa.Table):
        keys = rows.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, bits = keys[order], max(4, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        # the last row is that of hashes not found
        self.counts = {c: np.append(rows.column(c).to_numpy()[order], 0).astype(np.float64) for c in rows.column_names[1:]}

    def find(self, h: np.ndarray) -> np.ndarray:
        part = (h >> self.shift).astype(np.int64)
        at, end = self.starts[part], self.starts[part + 1]
        out = np.full(len(h), len(self.keys))
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class Tables:
    """The counts of Models in memory."""

    grams: dict[int, Lookup]
    contexts: dict[int, Lookup]
    total: float

    def ratios(self, words: list[str]) -> np.ndarray:
        """As Models.ratios."""
        if not words:
            return np.zeros(0)
        cp, all_at = _points(words)
        _, first, inverse = np.unique(_hashes(cp, all_at, ORDER), return_index=True, return_inverse=True)
        at = all_at[first]
        below = [(self.grams[1].counts["a1_0"][self.grams[1].find(_hashes(cp, at, 1))] + 0.5) / (self.total + 0.5 * 65536)] * 2
        for n in range(2, ORDER + 1):
            gram, context = self.grams[n].find(_hashes(cp, at, n)), self.contexts[n].find(_hashes(cp, at, n - 1, 1))
            out = []
            for c in (0, 1) if n > SHARED else (0,):
                a = self.grams[n].counts[f"a{n}_{c}"][gram]
                t, f = (self.contexts[n].counts[f"{kind}{n}_{c}"][context] for kind in "tf")
                rest = np.where(t > 0, np.minimum(DISCOUNT * f / np.maximum(t, 1.0), 1.0), 1.0)
                out.append(np.maximum(a - DISCOUNT, 0.0) / np.maximum(t, 1.0) + rest * below[c])
            below = out if n > SHARED else out * 2
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
        return np.add.reduceat((np.log(below[1]) - np.log(below[0]))[inverse], starts)

    def features(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """As features_of, whose ratios are looked up for words not met before."""
        words = {w for text in texts for w in words_of(text)}
        new = list(words - cache.keys())
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            cache.update(zip(part, self.ratios(part).tolist()))
        return features_of(texts, cache)


@dataclass
class Models:
    """Exact counts as tables keyed by the hash of an n-gram or of a context: by order n, the columns a{n}_{class} count n-grams,
    t{n}_{class} sum them by context, f{n}_{class} count a context's different followers."""

    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    #: Sum of the counts of single characters.
    total: float
    weights: np.ndarray | None = None
    #: The same counts broadcast, if they are few.
    shared: Broadcast | None = None

    def ratios(self, words: DataFrame) -> DataFrame:
        """From different words to (word, ratio): the log of its likelihood as toxic over that as ordinary."""
        longest = words.mapInArrow(_grams_of, ", ".join(f"{c} bigint" for c in _KEYS)).groupBy(f"h{ORDER}").agg(*(F.first(c).alias(c) for c in _KEYS[1:]))
        x = longest.join(self.grams[1], "h1", "left")
        p = (F.coalesce("a1_0", F.lit(0)) + 0.5) / F.lit(self.total + 0.5 * 65536)
        below = [p, p]
        for n in range(2, ORDER + 1):
            x = x.join(self.grams[n], f"h{n}", "left").join(self.contexts[n], f"c{n}", "left")
            below = [_level(n, c, below[c]) for c in (0, 1)] if n > SHARED else [_level(n, 0, below[0])] * 2
            # named, as an expression of all orders would grow with their product
            x = x.withColumn(f"p{n}_0", below[0]).withColumn(f"p{n}_1", below[1])
            below = [F.col(f"p{n}_0"), F.col(f"p{n}_1")]
        by_gram = x.select(f"h{ORDER}", (F.log(below[1]) - F.log(below[0])).alias("r"))
        places = words.mapInArrow(_places_of, f"word string, h{ORDER} bigint")
        return places.join(by_gram, f"h{ORDER}").groupBy("word").agg(F.sum("r").alias("ratio"))


_KEYS = [f"h{n}" for n in range(ORDER, 0, -1)] + [f"c{n}" for n in range(ORDER, 1, -1)]


def _level(n: int, cls: int, below: Column) -> Column:
    """The discounted share of an n-gram among its context's, and what the discount leaves to the shorter one."""
    a, t, f = (F.coalesce(f"{kind}{n}_{cls}", F.lit(0)) for kind in "atf")
    seen = F.greatest(a - F.lit(DISCOUNT), F.lit(0.0)) / F.greatest(t, F.lit(1))
    return seen + F.when(t > 0, F.least(F.lit(DISCOUNT) * f / F.greatest(t, F.lit(1)), F.lit(1.0))).otherwise(1.0) * below


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of ORDER characters in a batch of words: hashes of all their endings and of what precedes their last characters."""
    for batch in batches:
        if batch.num_rows:
            cp, at = _points(batch.column(0).to_pylist())
            top, first = np.unique(_hashes(cp, at, ORDER), return_index=True)
            at = at[first]
            columns = [top] + [_hashes(cp, at, n) for n in range(ORDER - 1, 0, -1)] + [_hashes(cp, at, n - 1, 1) for n in range(ORDER, 1, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], _KEYS)


def _places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with the hash of each n-gram of ORDER characters in it, as often as it occurs."""
    for batch in batches:
        if batch.num_rows:
            words = batch.column(0).to_pylist()
            cp, at = _points(words)
            which = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(_hashes(cp, at, ORDER).view(np.int64))], ["word", f"h{ORDER}"])


def features_of(texts: list[str | None], ratios: dict[str, float]) -> np.ndarray:
    """Of each text: the log ratio by word over the whole text, its most toxic window and its 2, 4 and 8 most toxic words; the log of its length."""
    out = np.zeros((len(texts), FEATURES))
    for k, text in enumerate(texts):
        words = words_of(text)
        if words:
            r = np.fromiter(map(ratios.__getitem__, words), float, len(words))
            sums = np.concatenate([[0.0], np.cumsum(r)])
            w = min(WINDOW, len(r))
            best = np.sort(np.partition(r, len(r) - 8)[-8:] if len(r) > 8 else r)[::-1]
            out[k] = r.mean(), (sums[w:] - sums[:-w]).max() / WINDOW, best[:2].mean(), best[:4].mean(), best.mean(), np.log(len(r))
    return out


def score_of(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.clip(features, -20, 20), np.ones(len(features))])
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def count_tables(grams: DataFrame) -> Models:
    """The counts of all orders. Above the top order's, a count is of the different characters that stand before an
    n-gram; up to SHARED the classes are put together."""
    level, by_gram, by_context = grams, {}, {}
    for n in range(ORDER, 0, -1):
        kept = [f"h{m}" for m in range(n, 0, -1)] + [f"c{m}" for m in range(n, 1, -1)]
        cls = ["cls"] if n > SHARED else []
        if n < ORDER:
            source = level.select(f"h{n + 1}", *kept).distinct() if n == SHARED else level
            level = source.groupBy(*cls, *kept).agg(F.count("*").alias("n"))
        classes = [(c, F.col("cls") == c) for c in (0, 1)] if cls else [(0, F.lit(True))]
        by_gram[n] = staged(level.groupBy(f"h{n}").agg(*(F.sum(F.when(own, F.col("n"))).alias(f"a{n}_{c}") for c, own in classes)), f"toxicity-grams{n}")
        if n > 1:
            sums = [x for c, own in classes for x in (F.sum(F.when(own, F.col("n"))).alias(f"t{n}_{c}"), F.count(F.when(own, 1)).alias(f"f{n}_{c}"))]
            by_context[n] = staged(level.groupBy(f"c{n}").agg(*sums), f"toxicity-contexts{n}")
    models = Models(by_gram, by_context, float(by_gram[1].agg(F.sum("a1_0")).first()[0] or 0))
    if sum(x.count() for x in (*by_gram.values(), *by_context.values())) <= SMALL_COUNTS:
        held = [{n: Lookup(x.na.fill(0).toArrow()) for n, x in tables.items()} for tables in (by_gram, by_context)]
        models.shared = grams.sparkSession.sparkContext.broadcast(Tables(*held, models.total))
    return models


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, slightly held towards zero."""
    x = np.column_stack([np.clip(x, -20, 20), np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _described(docs: DataFrame, models: Models, id_col: str, text_col: str, finish: Callable[[np.ndarray], list[np.ndarray]], added: list[str]) -> DataFrame:
    """docs with the numbers added that finish makes of their features.

    Few counts are broadcast. Otherwise the texts' words are given their ratios by a join, see beside_texts. Both ways
    give the same numbers.
    """
    small_batches(docs.sparkSession)
    names, at, shared = docs.columns, docs.columns.index(text_col), models.shared
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` double" for n in added)])
    if shared is not None:

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, float] = {}
            for batch in batches:
                numbers = finish(shared.value.features(batch.column(at).to_pylist(), cache))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, numbers)], [*names, *added])

        return docs.mapInArrow(look_up, schema)
    keys = lambda texts: {w for t in texts for w in words_of(t)}
    look_up = lambda by_chunk: by_chunk.join(models.ratios(by_chunk.select(F.col("key").alias("word")).distinct()).withColumnRenamed("word", "key"), "key")
    numbers = lambda texts, known: [pa.array(x) for x in finish(features_of(texts, known))]
    return beside_texts(docs, id_col, text_col, keys, "string", look_up, "ratio", "double", lambda known: known, numbers, ", ".join(f"`{n}` double" for n in added))


def set_apart(id_col: str, rows: int) -> Column:
    """Whether an id's row, of so many labelled ones, fits the scale of the score; chosen by hash. All others are counted."""
    share = min(1.0, CALIBRATE_ROWS * CALIBRATE_PART / max(1, rows))
    return (F.pmod(F.xxhash64(id_col), F.lit(CALIBRATE_PART)) == 0) & (F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Models:
    """Models from all labelled rows that are not held out; a null label is none, of conflicting labels the largest counts.

    The counts leave out the sample that fits the score's scale alone, see set_apart. Without rows of both classes
    there, the score is that of the log ratio by word in the most toxic window.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col, 3, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("cls"))
    known = staged(known, "labels")
    rows = joined_by_id(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")), known, "_id")
    apart = set_apart("_id", known.count())
    models = count_tables(staged(count_grams(rows.where(~apart).select("cls", "text")), "toxicity-counts"))
    sample = rows.where(apart).select("_id", "cls", "text")
    got = _described(sample, models, "_id", "text", lambda f: list(f.T), [f"f{k}" for k in range(FEATURES)]).drop("_id", "text").toArrow()
    y = got.column("cls").to_numpy().astype(float)
    x = np.column_stack([got.column(f"f{k}").to_numpy() for k in range(FEATURES)])
    models.weights = _logistic(x, y) if 0 < y.sum() < len(y) else np.array([0.0, 1.0] + [0.0] * (FEATURES - 2) + [-1.0])
    return models


def scored(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score added, 0 to 1. A null text is empty; texts without words score as their features of zero do."""
    weights = models.weights
    return _described(docs, models, id_col, text_col, lambda f: [score_of(f, weights)], [score_col])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Each row is scored by its text alone: repeated rows get the same score, a null id stays null and is not held out,
    other columns are ignored. An empty table gives an empty result; without labels all scores are by the same scale.
    """
    models = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = scored(rows, models)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", _above(threshold).alias("predicted"))


def _above(threshold: float) -> Column:
    return F.when(F.col("score") >= threshold, 1).otherwise(0)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold. All columns stay."""
    models = fit(docs, labels, id_col, text_col, label_col)
    score = "_score"
    while score in docs.columns:
        score += "_"
    return scored(docs, models, id_col, text_col, score).where(F.col(score) < threshold).drop(score)
