"""Registered queries against their SQL on the smallest tables, and plans without cross joins or single-task sorts."""

import os
import shutil
import subprocess
import sys

import pytest
from harness import DATA, ROOT, compare, database

import tidemark.plans.queries as registered
from tidemark.operators import correlation
from tidemark.plans.series import Tables

FOLDER = f"{DATA}/{os.environ.get('SF', 'sf0.001')}"
QUICK = ["acf", "pacf", "ar_fit", "ar_forecast", "fill_linear", "basic_stats", "outliers_iqr", "resample", "matmul",
         "cross_correlation", "kpss_test", "adf_test", "arma_residuals", "predict_from_params", "evaluate_forecast",
         "ljung_box", "wf_backtest", "qq_points", "aicc_heatmap", "correlation_matrix_spearman"]


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(registered.REGISTRY) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query(spark, con, name):
    query, sql = registered.REGISTRY[name]
    ok, text = compare(spark, con, FOLDER, name, query, sql)
    assert ok, text


def test_acf_moves_the_series_once(spark):
    plan = correlation.acf(Tables(spark, FOLDER).ev_user(), 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_names():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 60


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_corpus_part(tmp_path, left_out):
    """The engine's queries are registered where the corpus folders are not there, with or without the pipeline's file."""
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        if name not in left_out:
            copy(f"{ROOT}/{name}", tmp_path / name, **({"ignore": shutil.ignore_patterns(*left_out)} if copy is shutil.copytree else {}))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                          env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(registered.queries())), str(len(registered.oracle_sql())), "[]"]
