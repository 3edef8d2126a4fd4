"""What workers keep after a task, and which workers a query starts."""

import subprocess
import sys

import pytest

from embermill.llm import quality_rules

HELD = '''
import re
import numpy as np, pyarrow as pa
from embermill.llm import near_duplicates, quality_rules, shared

def held():
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

words = np.array([f"word{i}" for i in range(5000)])
text = [" ".join(words[np.random.default_rng(k).integers(0, 5000, 300)]) for k in range(8000)]
n = pa.array(range(8000), pa.int64())
batch = pa.record_batch([n, pa.array(text), n], ["doc_id", "text", "print"])
del text
before = held()
for _ in getattr(shared, "lean", lambda f: f)(WORK)(iter([batch])):
    pass
print(held() - before)
'''


@pytest.mark.parametrize("work", ["quality_rules._measured", "near_duplicates._sketch(5, False)", "near_duplicates._sketch(5, True)"])
def test_a_worker_gives_memory_back(work):
    out = subprocess.run([sys.executable, "-c", HELD.replace("WORK", work)], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 40  # MB; 16 MB of text


def test_the_threshold_is_found_without_python_workers(spark, monkeypatch):
    scores = spark.sql("select id / 100D score, id % 3 good, (id + 1) % 2 bad from range(100)")
    started = []
    monkeypatch.setattr("pyspark.core.rdd.RDD._to_java_object_rdd", lambda self: started.append(self))
    assert 0 <= quality_rules.parted(scores) < 1
    assert not started
