"""Plan assertions over every registered query."""

import re

import pytest

from conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E
    return {k: plan_of(fn(spark, SF_SMALL)) for k, fn in E.queries().items()}


def test_no_cross_or_nested_loop_join(plans):
    for key, p in plans.items():
        assert "CartesianProduct" not in p, key
        assert "BroadcastNestedLoopJoin" not in p, key


def test_no_unpartitioned_window(plans):
    for key, p in plans.items():
        for line in p.splitlines():
            if re.search(r"\bWindow \[", line):
                assert not re.search(r"\], \[\], \[", line), (key, line)


def test_samples_are_top_n_not_global_sorts(plans):
    for key in ["sel_sample_n", "sel_first_n"]:
        assert "TakeOrderedAndProject" in plans[key], key


def test_topk_merge_is_group_limited(plans):
    # the merge window keeps k rows per question as it streams; when a shuffle
    # precedes it, a partial limit runs map-side (see test_similarity)
    for key in ["txt_sparse_topk", "vec_topk", "sim_code_masked", "sim_threshold_rank"]:
        assert "WindowGroupLimit" in plans[key], key


def test_streaming_progress_counts(spark):
    import json
    import os

    from tessera.session import scratch_path
    from tessera.streaming.progress import current, start_progress

    base = scratch_path(spark, "stream-test")
    local = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(local + "/log")
    lines = [
        [{"run": 1, "seq": 1, "answer": "a", "prediction": "a"},
         {"run": 1, "seq": 2, "answer": "a", "prediction": "Traceback x"}],
        [{"run": 2, "seq": 3, "answer": "b", "prediction": "c"},
         {"run": 1, "seq": 4, "answer": "b", "prediction": "b"}],
    ]
    for i, part in enumerate(lines):
        with open(f"{local}/log/part-{i}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in part))
    q = start_progress(spark, base + "/log", base + "/out", base + "/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    got = {r.run: (r.n_items, r.c1, r.c0, r.cerr) for r in current(spark, base + "/out").collect()}
    assert got == {1: (3, 2, 0, 1), 2: (1, 0, 1, 0)}
