"""What a Python worker holds while it counts words, and once it has."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import random, re
import pyarrow as pa
from crosswalk.llm import importance

def held(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024

draw = random.Random(1)
words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(200000)]
texts = [" ".join(draw.choices(words, k=250)) for _ in range(8000)]
batch = pa.record_batch([pa.array(range(8000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
del texts, words
list(importance.counted(iter([batch.slice(0, 10)])))
at = held("VmRSS")
n = sum(sum(b.column("n_words").to_pylist()) for b in importance.counted(iter([batch])))
print(n, held("VmHWM") - at, held("VmRSS") - at)
"""


def test_a_worker_holds_one_small_block():
    got = subprocess.run([sys.executable, "-c", SCRIPT], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=300)
    n, most, after = map(float, got.stdout.split())
    assert n == 2_000_000
    # MB over what was held before; 16 MB of text are counted (blocks of 4 MB took 106)
    assert most < 80 and after < 30
