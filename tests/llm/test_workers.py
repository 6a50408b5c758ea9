"""What a Python worker keeps from one stage of a job to the next."""

import gc
import os
import weakref

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hammerprice.llm import packing, toxicity
from hammerprice.llm.queries import table
from hammerprice.llm.tokens import encoder

MODEL = toxicity.Model(b"some ordinary words " * 9, b"some toxic words " * 9, [0.0] * (toxicity.TOP + 1))


def test_a_stage_drops_what_the_one_before_has_opened():
    path = public_tokenizers.path("byte_bpe_50k.json")
    opened = weakref.ref(encoder(path))
    assert encoder(path) is opened()
    scorer = toxicity._scorer(MODEL)
    gc.collect()
    assert opened() is None
    assert toxicity._scorer(MODEL) is scorer
    del scorer


@pytest.mark.parametrize("name", ["ARROW_DEFAULT_MEMORY_POOL", "MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_"])
def test_workers_give_memory_back(spark, tmp_path, name):
    spark.range(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    told = F.udf(lambda _: os.environ.get(name), "string")
    assert {r[0] for r in docs.select(told("id")).collect()} == {spark.sparkContext.environment[name]}


def test_pieces_of_many_small_batches_have_names_of_their_own(spark):
    texts = ["word " * 300_000, None, "", "x " * 1_200_000, *["a few words"] * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048).select("id", "doc_id", "piece", "start", "length").collect()
    assert len({r["id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} == set(range(len(texts)))
    ends = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == ends.get(r["doc_id"], 0)
        ends[r["doc_id"]] = r["start"] + r["length"]
