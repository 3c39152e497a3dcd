"""The pipeline stage by stage on a small table, and the registered queries."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_queries import compare, connect
from ledgerloom.llm import queries as corpus
from ledgerloom.llm import shared
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.test_operators import WORDS


def text(r, n):
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def test_stages_keep_clean_texts_and_drop_the_rest(spark, tmp_path):
    r = random.Random(1)
    clean = [text(r, 120) for _ in range(60)]
    item, passage, near = text(r, 30), text(r, 60), text(r, 150)
    rows = list(enumerate(clean))
    rows += [(100, near), (101, near + " tail end"), (102, near), (103, text(r, 40) + " " + passage), (104, text(r, 60) + " " + passage),
             (105, text(r, 60) + " " + item), (106, "too short"), (107, None), (108, "spam spam spam " * 40), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "clash") for i, t in rows],
                                  "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, row_key STRING")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, str(tmp_path)), "test-stage")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {k: {x["doc_id"] for x in v.collect()} for k, v in seen.items()}
    assert {106, 107, 108, None}.isdisjoint(ids["quality_rules"]) and len(ids["quality_rules"] & set(range(60))) >= 58
    assert ids["quality_rules"] - ids["near_duplicates"] == {101, 102}
    cut = {x["doc_id"]: x for x in seen["repeated_passages"].collect()}
    before = [(x["doc_id"], x["text"]) for x in seen["near_duplicates"].collect()]
    expected = {d: s for d, _, _, s in brute.without_repeats(before)}
    assert {d: brute.sha(" ".join(brute.spaced(x["text"]))) for d, x in cut.items()} == expected
    assert passage not in cut[104]["text"] and cut[104]["n_chars"] == len(cut[104]["text"]) and passage in cut[103]["text"]
    assert ids["repeated_passages"] - ids["benchmark_decontamination"] == {105}
    assert ids["packing"] == ids["benchmark_decontamination"]


def test_stages_of_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, frame, str(tmp_path))
        assert result.count() == 0


@pytest.mark.parametrize("key", sorted(corpus.ORACLES))
def test_query_equals_sql(spark, key):
    assert compare(spark, connect(SMALL), key, queries()[key], oracle_sql()[key], SMALL) is None


def test_all_operators_are_registered():
    numbers = {int(k[2:].split("_")[0]) for k in corpus.QUERIES}
    assert numbers == set(range(1, 14)) and "pipeline" in queries()
