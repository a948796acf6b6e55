import json

import corpus_pipeline
import public_tokenizers
from tests.llm import brute
from tokenizers import Tokenizer

from driftwatch.llm import decontaminate
from driftwatch.llm.common import table

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.collect()
    toxic, unique, clean, redacted = (f for _, f in corpus_pipeline.STAGES[:4])
    a = toxic(spark, docs, SF).collect()
    assert {r.doc_id for r in a} <= {r.doc_id for r in before} and len(a) > 0.8 * len(before)
    df = spark.createDataFrame(a, docs.schema)
    b = unique(spark, df, SF).collect()
    assert {r.doc_id for r in b} == {c for *_, c in brute.components([(r.doc_id, r.text) for r in a])}
    df = spark.createDataFrame(b, docs.schema)
    c = clean(spark, df, SF)
    assert c.columns == columns
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert {r.doc_id for r in c.collect()} == {i for i, *_, bad in brute.leaks([(r.doc_id, r.text) for r in b], items) if not bad}
    d = redacted(spark, c, SF)
    assert d.columns == columns and d.count() == c.count()
    assert all(sum(brute.secrets(r.text)[:3]) == 0 for r in d.collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = corpus_pipeline.STAGES[4][1](spark, d, SF)
    wanted = brute.pieces([(r.doc_id, r.text) for r in d.collect()], lambda x: t.encode(x, add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in e.collect()) == sorted(wanted)


def test_run_equals_its_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted(json.dumps([r.doc_id, r.piece, r.start, r.length, r.ids_crc32]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 3), (2, "", None, None, 0)], table(spark, SF, "documents").schema)
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        df.collect()
    assert decontaminate.clean(docs, table(spark, SF, "benchmark")).count() == 3
