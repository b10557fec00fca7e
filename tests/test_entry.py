"""Driver contract: flagship query, registry coherence."""

from __spark_entry__ import entry, oracle_sql, queries


def test_entry_runs(spark, smoke_dir):
    df = entry(spark)
    assert df.count() > 0 and "SK_ID_CURR" in df.columns


def test_every_oracle_has_a_query():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


# fits and the streaming scorer, whose values come from an iterative solver
NO_ORACLE = {"oof_predictions", "baseline_models", "boosted_model", "learning_curve", "param_search", "halving_search",
             "feature_importance", "permutation_importance", "score_batch", "stream_score"}


def test_every_key_has_an_oracle_or_a_reason():
    from ledgerlens.plans.registry import ORACLES, QUERIES
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE and set(ORACLES) <= set(QUERIES)


def test_entry_without_the_optional_subpackage():
    """The queries load where the training-data subpackage and its pipeline are missing."""
    import subprocess
    import sys
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('ledgerlens.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert len(e.queries()) >= 140 and not [k for k in e.queries() if k.startswith('op')]")
    done = subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
