"""What the pipeline's stages hold beside the heap: bytes sent to Python at once, and memory that workers give back."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paralogic.llm import common, token_output

REPO = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"


def batch_sizes(df):
    def run(batches):  # nested, so that workers need not import the tests
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return [r.n for r in df.mapInArrow(run, "n long").collect()]


@pytest.mark.parametrize("name", ["quality_classifier", "benchmark_decontamination", "token_output", "simhash_near_dedup"])
def test_stages_send_texts_in_bounded_batches(spark, name):
    before = spark.conf.get(common.BATCH_SETTING)
    try:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        found = dict(corpus_pipeline.STAGES)[name](spark, docs, DATA)
        assert found.count()
        # what is run now is sent as the stage's lazy table is
        wide = spark.range(0, 5000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
        sizes = batch_sizes(wide)
        assert sum(sizes) == 5000 and max(sizes) * 4000 <= 1.1 * common.BATCH_BYTES
        assert batch_sizes(spark.range(0, 20_000, 1, 1)) == [10_000, 10_000]  # short rows are not cut finer
    finally:
        spark.conf.set(common.BATCH_SETTING, before)


def test_a_lower_bound_stays_and_the_pipeline_restores_its_session(spark):
    before = spark.conf.get(common.BATCH_SETTING)
    try:
        spark.conf.set(common.BATCH_SETTING, "64KB")
        common.bound_batches(spark)
        assert spark.conf.get(common.BATCH_SETTING) == "64KB"
    finally:
        spark.conf.set(common.BATCH_SETTING, before)
    corpus_pipeline.run(spark, DATA)
    assert spark.conf.get(common.BATCH_SETTING) == before


def test_a_worker_gives_back_what_token_files_took():
    script = """
import re
from paralogic.llm import common, token_output
def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
words = token_output.tokens_of(token_output.tokenizer_path())
common.give_back()
empty = held()
for at in range(0, 300_000, 1000):
    words.encode([b" ".join(b"w%dx" % (k * 7919) for k in range(at, at + 1000))], 1)
del words
full = held()
for _ in common.tidy(lambda batches: iter([token_output.forget()]))([]):
    pass
print(empty, full, held())
"""
    out = subprocess.run([sys.executable, "-c", script.replace("\\\\", "\\")], capture_output=True, text=True, cwd=REPO, check=True).stdout
    empty, full, after = map(float, out.split())
    assert full - empty > 30 and after <= empty + 5


def test_token_files_are_the_same_in_small_batches(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = spark.conf.get(common.BATCH_SETTING)
    expected = sorted(map(tuple, token_output.encode_and_read(docs).collect()))
    try:
        spark.conf.set(common.BATCH_SETTING, "4KB")
        assert sorted(map(tuple, token_output.encode_and_read(docs).collect())) == expected
    finally:
        spark.conf.set(common.BATCH_SETTING, before)


def test_near_duplicate_stage_gives_the_drivers_memory_back(spark, monkeypatch):
    from paralogic.llm import simhash_dedup

    told = []
    trim = common.trim_jvm
    monkeypatch.setattr(common, "trim_jvm", lambda s: told.append(trim(s)))
    docs = spark.createDataFrame([(k, f"one two three four five six seven {k // 2}") for k in range(8)], "doc_id long, text string")
    assert simhash_dedup.keep_one(spark, docs, "").count() == 4
    assert len(told) >= 6 and all(told)
