"""Workers get the package whatever folder the driver was started in."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from storepulse.session import build_session
from storepulse.llm.negatives import hard_negatives
spark = build_session("local[1]", shuffle_partitions=1, extra={{"spark.checkpoint.dir": {folder!r}}})
rows = [(k, [float(k % 7), 1.0], k % 2) for k in range(101)]
print("ROWS", hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).count() > 0)
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, folder=str(tmp_path / "ck"))], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=180)
    assert "ROWS True" in out.stdout, out.stderr[-1500:]
