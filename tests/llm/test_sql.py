"""The registered SQL against the operators, over rows that the test tables don't hold."""

import random

import duckdb
import pyarrow as pa
import pytest
from tests.llm.test_operators import frame, odd  # noqa: F401
from tests.test_queries import rows

from driftwatch.llm import decontaminate, oracle, quality_rules, secrets, warc


def duck(**tables):
    c = duckdb.connect()
    for name, (columns, values) in tables.items():
        c.register(name, pa.Table.from_pylist([dict(zip(columns.names, v)) for v in values], columns))
    return c


def documents_of(values):
    return pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]), values


def check(df, connection, sql):
    wanted = connection.execute(sql)
    columns = [c[0] for c in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    values = wanted.fetchall()
    assert rows(df.columns, df.collect()) == rows(columns, values)
    return columns, values


@pytest.mark.parametrize("n", [0, None])
def test_quality_rules(spark, odd, n):  # noqa: F811
    check(quality_rules.quality_rules(frame(spark, odd[:n])), duck(documents=documents_of(odd[:n])), oracle.OP1)


def test_decontamination(spark, odd):  # noqa: F811
    items = [(1, odd[10][1]), (1, "two words"), (2, None), (3, ""), (None, "A, b; c"), (7, odd[11][1])]
    for held in (items, []):
        bench = spark.createDataFrame(held, "item_id bigint, text string")
        c = duck(documents=documents_of(odd), benchmark=(pa.schema([("item_id", pa.int64()), ("text", pa.string())]), held))
        check(decontaminate.decontamination(frame(spark, odd), bench), c, oracle.OP5)


def test_secrets(spark, odd):  # noqa: F811
    rng = random.Random(11)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    values = list(odd)
    for k in range(150):
        parts = [pick(mixed, rng.choice([19, 20, 21, 45])), pick("0123456789abcdefABCDEF", rng.choice([20, 31, 40])), pick("0123456789abcdef", rng.choice([31, 32, 40]))]
        parts += ["a" * 12 + pick(mixed, 30), "example" + pick(mixed, 25), "AKIA" + pick("ABCDEFGHIJ0123456789", rng.choice([11, 12, 16])), pick("abAB01", 40)]
        parts += [f'{rng.choice(["Password", "api_key", "APIKEY", "token", "passwd"])}{rng.choice([":", " = ", chr(34) + ": " + chr(34)])}{pick(mixed, rng.choice([7, 8, 30]))}', "x123e4567-e89b-12d3-a456-426614174000", "😀é"]
        rng.shuffle(parts)
        values.append((1000 + k, rng.choice([" ", "\n", ", ", "é"]).join(parts[: rng.randrange(1, 11)]), None))
    columns, found = check(secrets.secret_scan(frame(spark, values)), duck(documents=documents_of(values)), oracle.OP7)
    assert sum("entropy" in r[columns.index("spans")] for r in found) > 50 and sum(r[columns.index("n_access")] for r in found) > 20


def test_archives(spark):
    long = "<p>" + "wörd\r\n\r\nWARC/1.1 😀 " * 4000
    pages = [(5, "u5", long), (3, "u3", "a"), (1, "u1", "a"), (1, "u1", "a"), (9, None, None), (8, "u8", ""), (6, "u6", long)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    c = duck(pages=(pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]), pages))
    columns, found = check(warc.round_trip(df), c, oracle.OP4)
    assert sum(r[columns.index("record_type")] == "revisit" for r in found) == 3
