import json
import os
import subprocess
import sys

from conftest import ROOT


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_QUERIES="nation_revenue")
    out = subprocess.run(
        [sys.executable, str(ROOT / "bench.py")], env=env, capture_output=True, text=True, check=True
    ).stdout
    assert out.count("\n") == 1
    report = json.loads(out)
    assert set(report) == {"metric", "value", "unit", "queries", "sf"}
    assert set(report["queries"]) == {"nation_revenue"}
    assert report["unit"] == "sec" and report["sf"] == "0.001" and report["value"] > 0
