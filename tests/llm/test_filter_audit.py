import itertools
import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from tests.llm.test_operators import frame, odd  # noqa: F401
from tests.test_queries import rows

from driftwatch.llm import filter_audit, oracle


def brute(docs, labels):
    """Every order applied to every document, one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    failing = []
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else "")
        fails += ("D" if re.search(r"[#$%&*|]", text) else "") + ("E" if i is not None and i > least[text] else "")
        failing.append((part or "", fails, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {p for p, *_ in failing}:
        own = [x for x in failing if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = [x for x in own if not set(x[1]) & set(order[:k])]
                gone = [x for x in before if f in x[1]]
                shapley[part, f] += len(gone)
                out[part, order, k + 1] = [
                    len(before) - len(gone), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
    return sorted((p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items())


@pytest.fixture(scope="module")
def cases(odd):  # noqa: F811
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)] + ["Big", "HUGE", "x#y", "50%", "ÄÖ", "😀"]
    texts = [" ".join(rng.choices(words[: rng.choice([60, 399, 406])], k=rng.choice([1, 199, 200, 201, 450]))) for _ in range(60)]
    exact = [" ".join(f"w{k % 100}" for k in range(200)), " ".join(f"w{k % 99}" for k in range(200)), "AB" + "x" * 98, "ABC" + "x" * 97]  # at the limits and one beyond
    docs = [*odd, *((rng.randrange(90), rng.choice(texts + exact), rng.choice([None, "", "a", "b", "hot", "hot"])) for _ in range(300))]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def labelled(spark, labels):
    return spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, part string")


def test_all_orders_equal_filters_applied_one_by_one(spark, cases):
    docs, labels = cases
    got = filter_audit.filter_audit(frame(spark, docs), labelled(spark, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    wanted = brute(docs, labels)
    assert sorted(map(tuple, got.collect())) == wanted
    assert {o for _, o, *_ in wanted} == {"".join(x) for x in itertools.permutations("ABCDE")} and sum(r[8] for r in wanted) > 0 < sum(r[7] for r in wanted)


def test_sql(spark, cases):
    docs, labels = cases
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs]), "source": pa.array([d[2] for d in docs])}))
    c.register("labels", pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels]), "toxic": pa.array([x[2] for x in labels])}))
    found = c.execute(oracle.OP13)
    columns = [x[0] for x in found.description]
    got = filter_audit.filter_audit(frame(spark, docs), labelled(spark, labels))
    assert rows(got.columns, got.collect()) == rows(columns, found.fetchall())


def test_empty_tables_and_one_text_in_all_rows(spark):
    none = labelled(spark, [])
    assert filter_audit.filter_audit(frame(spark, []), none).count() == 0
    copies = [(k, "one text", f"s{k % 3}") for k in range(500)] + [(7, "one text", "s1")] * 3
    assert sorted(map(tuple, filter_audit.filter_audit(frame(spark, copies), none).collect())) == brute(copies, [])
    cells = {(r.part, r["mask"]): r.docs for r in filter_audit.mask_cells(frame(spark, copies), none).collect()}
    assert cells["s0", 1] == 1 and cells["s0", 17] == 166


def test_native(spark, cases):
    plan = filter_audit.filter_audit(frame(spark, cases[0]), labelled(spark, cases[1]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
