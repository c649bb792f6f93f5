"""The command line runner."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(*args, timeout=600):
    return subprocess.run([sys.executable, "-m", "splitlens", *args], cwd=ROOT, capture_output=True,
                          text=True, timeout=timeout)


def test_list_shows_every_key():
    out = _run("list")
    assert out.returncode == 0
    keys = {line.split()[0] for line in out.stdout.splitlines() if line.strip()}
    assert {"ab_result_total", "mt_hommel", "funnel", "churn_model"} <= keys
    assert len(keys) == 68


def test_run_writes_output(tmp_path):
    dest = tmp_path / "out"
    out = _run("run", "ab_cvr", "--data", "/root/testdata/sf0.001", "--master", "local[2]",
               "--show", "0", "--out", str(dest), "--format", "csv")
    assert out.returncode == 0, out.stderr[-2000:]
    parts = [p for p in os.listdir(dest) if p.endswith(".csv")]
    lines = sum(len(open(dest / p).read().splitlines()) for p in parts)
    assert lines == 2 + len(parts)        # two variants plus one header per part file
