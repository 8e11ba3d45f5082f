"""What a Python worker holds while it starts."""

import subprocess
import sys
from pathlib import Path

LOAD = """
import re
import numpy, pandas, pyarrow, tokenizers
from tessera.llm import bpe
most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
before = most()
bpe.loaded(bpe.default_tokenizer())
print(most() - before)
"""


def test_a_tokenizer_is_loaded_in_little_memory():
    root = Path(__file__).parents[2]
    took = subprocess.run([sys.executable, "-c", LOAD], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(took) < 120  # MB


VERIFY = """
import re
import numpy, pandas, pyarrow
from tessera.llm import minhash
most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
rng = numpy.random.default_rng(3)
texts = [" ".join("w%d" % x for x in rng.integers(0, 3000, 1600)) for _ in range(400)]  # 8 MB of pairs
node = pyarrow.array([b"n"] * len(texts))
batch = pyarrow.RecordBatch.from_arrays([node, node, pyarrow.array(texts), pyarrow.array(texts)], names=["a", "b", "text_a", "text_b"])
run = minhash._verify(minhash.Weights(numpy.zeros(0, numpy.uint64), numpy.zeros(0), 400), 0.8)
before = most()
assert sum(x.num_rows for x in run([batch])) == len(texts)
print(most() - before)
"""


def test_pairs_are_verified_in_little_memory():
    root = Path(__file__).parents[2]
    took = subprocess.run([sys.executable, "-c", VERIFY], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(took) < 80  # MB
