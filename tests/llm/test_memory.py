"""What Python tasks hold at once, and what they keep when they are done."""

import subprocess
import sys

import pandas as pd
from pyspark.sql import functions as F

from obsweave.llm import packing, queries
from obsweave.llm.common import kept

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stored_frames_reach_python_in_small_batches(spark):
    def count(batches):
        for batch in batches:
            yield pd.DataFrame({"rows": [len(batch)]})

    before = spark.conf.get(LIMIT, None)
    rows = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("text"))
    sizes = [r["rows"] for r in kept(rows.mapInPandas(count, "rows bigint"), "sizes").collect()]
    assert sum(sizes) == 60 and max(sizes) <= 10
    assert spark.conf.get(LIMIT, None) == before


def test_workers_give_freed_memory_back():
    code = """
from obsweave.llm.common import release_arrow_memory
import pyarrow
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
parts = [b"x" * (100_000 + i % 2) for i in range(2_000)]
parts[::2] = [b""] * 1_000  # the others keep the allocator from shrinking by itself
full = held()
release_arrow_memory()
print(full - held())
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 50


def test_tokenizer_settings_without_its_vocabulary():
    encoder = packing.Encoder(queries.tokenizer_path())
    assert encoder.by_word
    assert len(encoder.tokenizer.pre_tokenizer.__getstate__()) < 1_000 and packing._settings(None) == {}
