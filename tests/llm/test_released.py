"""Workers give back what a task has freed."""

import os
import subprocess
import sys

CODE = """
import re
import pyarrow as pa
from strata.llm.common import released

few = []

def run(batches):
    for b in batches:
        held = [bytes(2000) for _ in range(50_000)]  # 100 MB in small pieces, freed but for a few
        few.append(held[::1000])
        held = None
        yield b.slice(0, 50)

def anonymous():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

batch = pa.record_batch([list(range(100))], names=["x"])
before = anonymous()
rows = [b.num_rows for b in released(run)([batch] * 3)]
assert rows == [50] * 3, rows
assert anonymous() - before < 30, (before, anonymous())
"""


def test_worker_memory_is_given_back():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", CODE], cwd=root, check=True, env={**os.environ, "PYTHONPATH": root}, timeout=60)
