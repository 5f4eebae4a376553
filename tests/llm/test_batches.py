"""Rows that go to Python at once, and the form of grams on disk."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from wirelens.llm import op2_lm, op6_language, op8_repeats
from wirelens.llm.common import BATCH_ROWS, batches, cut


def test_a_cut_bounds_the_rows_of_its_jobs_batches(spark):
    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    before = [spark.conf.get(k, None) for k in BATCH_ROWS]
    got = cut(spark.range(0, 1000, 1, 1).mapInPandas(sizes, "n long"), "sizes", 300)
    assert sorted(r.n for r in got.collect()) == [100, 300, 300, 300]
    assert [spark.conf.get(k, None) for k in BATCH_ROWS] == before


@pytest.mark.parametrize("module", [op2_lm, op8_repeats])
def test_whole_texts_go_to_python_in_small_batches(spark, module, monkeypatch):
    bounds = {}

    def noted(df, name, batch=None):
        bounds[name] = batch
        return cut(df, name, batch)

    monkeypatch.setattr(module, "cut", noted)
    module.query(frame(spark, [(i, f"text {i} " * 30, None, None) for i in range(5)])).collect()
    wanted = {"parts", "answers"} if module is op2_lm else {"packed", "segments"}
    assert {k: bounds[k] for k in wanted} == dict.fromkeys(wanted, module.ROWS)


@pytest.mark.parametrize("dtype", op2_lm.KEYS)
def test_grams_are_kept_in_order_and_small(dtype):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3000):
        keys = np.unique(rng.integers(0, np.iinfo(dtype).max, n, dtype=dtype, endpoint=True))
        times = rng.integers(0, 2, len(keys)).astype("<u4")
        times[-1] = 2 ** 32 - 1
        data = op2_lm._squeezed(keys, times)
        back = op2_lm._spread(data, dtype)
        assert back[0].tolist() == keys.tolist() and back[1].tolist() == times.tolist()
    assert len(data) < 0.85 * keys.nbytes + times.nbytes / 4


def test_language_and_tokens_take_texts_in_small_batches(spark, monkeypatch):
    import corpus_pipeline

    bounds, at_fit = {}, []

    def noted(df, name, batch=None):
        bounds[name] = batch
        return cut(df, name, batch)

    def noted_batches(spark, rows):
        at_fit.append(rows)
        return batches(spark, rows)

    monkeypatch.setattr(op6_language, "cut", noted)
    monkeypatch.setattr(op6_language, "batches", noted_batches)
    monkeypatch.setattr(corpus_pipeline, "cut", noted)
    docs = frame(spark, [(i, f"text {i} " * 30, "en", "src") for i in range(5)])
    op6_language.query(docs).collect()
    got = corpus_pipeline.tokenise(spark, docs, "").collect()
    assert bounds["language-scores"] == op6_language.ROWS and at_fit == [op6_language.ROWS]
    assert bounds["pipeline-tokens"] == corpus_pipeline.ROWS
    assert len(got) == 5 and all(r.round_trip and 4 * r.n_tokens == len(r.ids) > 0 for r in got)
