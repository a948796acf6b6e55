"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: what the base kinds match, and the least length of a match or of its last group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: In the order in which kinds at the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")

# The entropy method's parameters: characters of a window, and the least bits that it needs, by character class.
WINDOW = 20
CLASSES = {"hex": 3.0, "base64": 3.9}
#: A candidate is a run of these characters. Its class is hex if it is of hex digits alone; base64 takes in all.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: A candidate must have characters of each of these sets; plain words, numbers and slugs don't.
NEEDS = {"hex": ("^[0-9a-fA-F]+$", "[0-9]", "[a-fA-F]"), "base64": ("[0-9]", "[A-Z]", "[a-z]")}
#: The allow list: identifiers, examples, ordered runs, and six times the same character. A window that overlaps one of
#: these isn't reported; what a candidate has before and after it is judged on its own.
ALLOWED = "(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|dummy|placeholder|abcdefgh|01234567|" + "|".join(
    ("[+]" if c == "+" else c) + "{6,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
)

_NONE = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
_PART = "struct<start:bigint,end:bigint,value:string>"
#: Items of an array that are gone through at a time; the scale of weights, which are whole numbers so that nothing
#: drifts over a long candidate.
_BLOCK, _SCALE = 256, 1 << 32


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))


def _none(kind: str = _NONE) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """For each item in order what step gives: (state, item) to the next state and an output of the SQL type kind.

    Outputs are gathered by blocks: adding one to an array copies the array.
    """

    def one(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["outs"], F.array(out)).alias("outs"))

    def block(a: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(a["state"].alias("state"), _none(f"array<{kind}>").alias("outs")), one)
        return _let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(a["outs"], F.array(r["outs"])).alias("outs")))

    def over(own: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(own) - 1, F.lit(0)) / _BLOCK)), lambda k: F.slice(own, (k * _BLOCK + 1).cast("int"), F.lit(_BLOCK)))
        return F.aggregate(parts, F.struct(zero.alias("state"), _none(f"array<array<{kind}>>").alias("outs")), block, lambda a: F.flatten(a["outs"]))

    return _let(items, over)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order: start, end and the group's value. Spark has no positions; the pieces between matches have them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("size"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found).alias("value"),
    )

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + x["size"], F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))

    return _scan(F.filter(parts, lambda x: x["size"].isNotNull()), F.lit(0).cast("long"), add, _PART)


def _base(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(_matches(text, pattern, group), lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), F.transform(kept, lambda x: _span(x["start"], kind, x["end"]))).otherwise(_none())


def _dense(value: Column, bits: float) -> Column:
    """First and last place where a window of the value has so many bits: struct(first, last), last -1 if none.

    The count of the character that enters grows by one at each step, that of the one that leaves shrinks, and with them
    the sum of c * log2(c) over the window; the entropy of a full window of w characters is log2(w) less that sum over w.
    """
    weight = [round(c * math.log2(c) * _SCALE) if c else 0 for c in range(WINDOW + 2)]
    adds = F.array(*(F.lit(b - a).cast("long") for a, b in zip(weight, weight[1:])))  # by the count before a character enters
    most = math.floor((WINDOW * (math.log2(WINDOW) - bits) + 1e-9) * _SCALE)
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("tail"), F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    count = lambda tail, c: F.octet_length(tail) - F.octet_length(F.replace(tail, c, F.lit("")))

    def step(a: Column, new: Column) -> Column:
        full, tail, old = a["n"] >= WINDOW, a["tail"], F.substring(a["tail"], 1, 1)
        less = F.when(full, F.get(adds, count(tail, old) - 1)).otherwise(F.lit(0).cast("long"))
        s = a["s"] - less + F.get(adds, count(tail, new) - F.when(full & (old == new), 1).otherwise(0))
        n = a["n"] + 1
        hit = (n >= WINDOW) & (s <= most)
        return F.struct(
            n.alias("n"), F.concat(F.when(full, F.substring(tail, 2, WINDOW - 1)).otherwise(tail), new).alias("tail"), s.alias("s"),
            F.when(hit & (a["first"] < 0), n - WINDOW).otherwise(a["first"]).alias("first"), F.when(hit, n).otherwise(a["last"]).alias("last"),
        )

    return F.aggregate(F.split(value, ""), zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _parts(text: Column) -> Column:
    """Candidates without what the allow list suppresses in them."""

    def apart(run: Column) -> Column:
        gaps = F.arrays_zip(F.split(run["value"], ALLOWED, -1).alias("gap"), F.transform(F.regexp_extract_all(run["value"], F.lit(ALLOWED), F.lit(0)), lambda x: F.length(x)).alias("size"))

        def add(at: Column, x: Column) -> tuple[Column, Column]:
            end = at + F.length(x["gap"])
            return end + F.coalesce(x["size"], F.lit(0)), F.struct(at.alias("start"), end.alias("end"), x["gap"].alias("value"))

        return F.when(run["value"].rlike(ALLOWED), _scan(gaps, run["start"], add, _PART)).otherwise(F.array(run))

    return F.filter(F.flatten(F.transform(_matches(text, CANDIDATE), apart)), lambda x: F.length(x["value"]) >= WINDOW)


def _without(parts: Column, base: Column) -> Column:
    """The parts that overlap no base span: none that starts before them ends in them, and none starts in them."""
    none, last = F.lit(None).cast("string"), (1 << 62)
    both = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("part"), b["end"].alias("end"), none.alias("value"))),
        F.transform(parts, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("part"), x["end"].alias("end"), x["value"].alias("value"))),
    ))
    kind = "struct<start:bigint,part:int,end:bigint,value:string,free:boolean>"

    def mark(x: Column, free: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("start", "part", "end", "value")), free.alias("free"))

    def forth(end: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["part"] == 0, F.greatest(end, x["end"])).otherwise(end), mark(x, end <= x["start"])

    def back(start: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["part"] == 0, x["start"]).otherwise(start), mark(x, x["free"] & (start >= x["end"]))

    seen = _scan(F.reverse(_scan(both, F.lit(0).cast("long"), forth, kind)), F.lit(last).cast("long"), back, kind)
    kept = F.transform(F.filter(seen, lambda x: (x["part"] == 1) & x["free"]), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "value"))))
    return F.when(F.size(base) > 0, kept).otherwise(parts)


def _entropy(text: Column, base: Column) -> Column:
    def of_class(x: Column, kind: str) -> Column:
        fits = F.array_min(F.array(*(x["value"].rlike(p) for p in NEEDS[kind])))
        span = _let(_dense(x["value"], CLASSES[kind]), lambda d: F.when(d["last"] >= 0, _span(x["start"] + d["first"], "entropy", x["start"] + d["last"])))
        return F.when(fits, span)

    found = F.transform(_without(_parts(text), base), lambda x: F.array_distinct(F.filter(F.array(*(of_class(x, k) for k in CLASSES)), lambda y: y.isNotNull())))
    # a run that has a digit and a letter
    ahead = "(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])"
    return F.when(text.rlike(r"(?<![A-Za-z0-9+/_=-])" + ahead + CANDIDATE), F.flatten(found)).otherwise(_none())


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns base_spans and secret_spans added: arrays of (start, rank, kind, end) in order.

    Starts and ends are in code points, ends exclusive. Base spans are the leftmost matches of each kind that don't
    overlap another of their kind; entropy spans overlap no base span and nothing on the allow list. A null or empty
    text has no spans; repeated rows have equal ones; an empty table stays empty. Columns of those two names in docs
    are an error.
    """
    if clash := {"base_spans", "secret_spans"} & set(docs.columns):
        raise ValueError(f"docs already have {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_base(text, "assign", ASSIGN, 2, ASSIGN_LENGTH), _base(text, "access", ACCESS, 0, 16), _base(text, "hex", HEX, 0, 32))
    first = docs.withColumn("base_spans", F.array_sort(base))
    return first.withColumn("secret_spans", F.array_sort(F.concat("base_spans", _entropy(text, F.col("base_spans")))))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: how many base spans of each kind, a digest of them, and all spans as text.

    Each row is judged alone: nothing is shuffled, repeated rows give repeated results, other columns are ignored.
    Null or empty text: zeros, the digest of the empty string and no spans. Null id: stays null.
    """
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("secret_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span, and every run of overlapping spans, replaced by mark. Other columns stay as they are.

    A null or empty text stays as it is; repeated rows stay repeated; an empty table stays empty.
    """
    names = [c for c in docs.columns if c != text_col]
    rows = with_spans(docs.select(F.struct(*(names or [F.lit(1)])).alias("_row"), F.col(text_col).alias("text")))

    def clean(chars: Column) -> Column:
        def add(at: Column, x: Column) -> tuple[Column, Column]:
            gap = F.array_join(F.slice(chars, (at + 1).cast("int"), F.greatest(x["start"] - at, F.lit(0)).cast("int")), "")
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, gap)

        gaps = F.filter(_scan(F.col("secret_spans"), F.lit(0).cast("long"), add, "string"), lambda x: x.isNotNull())
        end = F.array_max(F.transform("secret_spans", lambda x: x["end"])).cast("int")
        return F.array_join(F.concat(gaps, F.array(F.array_join(F.slice(chars, end + 1, F.size(chars)), ""))), mark)

    text = F.when(F.size("secret_spans") > 0, _let(F.split("text", ""), clean)).otherwise(F.col("text"))
    return rows.select(*(F.col("_row")[c].alias(c) for c in names), text.alias(text_col)).select(*docs.columns)
