"""The driver contract in __spark_entry__.py."""

import importlib.util
import os
import subprocess
import sys

from splitlens.plans import QUERIES
from tests.conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_returns_flagship(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.columns == ["variant", "units", "converted", "orders", "revenue", "cvr",
                          "orders_per_unit", "revenue_per_unit"]
    rows = {r["variant"]: r for r in df.collect()}
    assert (rows["A"]["units"], rows["B"]["units"]) == (79, 71)


def test_queries_and_oracles_line_up(spark):
    m = _entry_module()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in set(q) - set(o) if k in QUERIES}
    assert own == {"churn_model", "churn_evaluation", "price_model"}
    df = q["ab_cvr"](spark, SF001)
    assert df.count() == 2


def _keys_without(module: str) -> set[str]:
    """Registered keys of a fresh interpreter in which ``module`` cannot be imported."""
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; print(' '.join(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return set(out.stdout.split())


def test_queries_without_the_corpus_operators():
    for missing in ("splitlens.llm", "zstandard"):
        keys = _keys_without(missing)
        assert set(QUERIES) <= keys and not any(k.startswith("op9_") or k == "pipeline" for k in keys)
