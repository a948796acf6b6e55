"""Folders in which operators stage are their run's own."""

import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import corpus_pipeline

from driftwatch.llm.common import delete, shared_folder, staged, staging

SF = "/root/testdata/sf0.001"


def there(folder: str) -> bool:
    return os.path.exists(folder.removeprefix("file://"))


def test_runs_side_by_side_keep_their_folders(spark):
    turn = Barrier(2, timeout=60)

    def run(k: int) -> tuple[list[str], int]:
        with staging() as own:
            first = staged(spark.range(10 + k), f"side-{k}")
            turn.wait()  # both have staged
            if k == 0:
                delete(spark, own)
            turn.wait()  # one has deleted
            return own, first.count() if k else 0

    with ThreadPoolExecutor(2) as pool:
        (a, _), (b, n) = pool.map(run, range(2))
    assert len(a) == len(b) == 1 and not set(a) & set(b)
    assert n == 11 and there(b[0]) and not there(a[0])
    delete(spark, b)
    assert not there(b[0])


def test_inner_staging_and_none(spark):
    with staging() as outer:
        staged(spark.range(1), "outer")
        with staging() as inner:
            staged(spark.range(1), "inner")
    assert [len(outer), len(inner)] == [1, 1] and outer != inner
    assert staged(spark.range(3), "nobody").count() == 3  # outside of any it stays
    delete(spark, outer + inner)


def test_a_pipeline_leaves_what_its_result_reads(spark):
    root = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with staging() as own:
        out = corpus_pipeline.run(spark, SF)
        n = out.count()
        left = {x for x in set(os.listdir(root)) - before if not x.startswith("rdd-")}
        assert left == {os.path.basename(f) for f in own if there(f)} and n >= 1
        assert not any(x.startswith(("pipeline-0", "pipeline-1", "pipeline-2", "toxicity")) for x in left)
        assert any(x.startswith("pipeline-3") for x in left)
    delete(spark, own)
    assert not any(map(there, own))
