import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulse.llm import bpe, decontaminate, pii, quality
from pulse.session import shared_dir
from tests.llm.conftest import table_texts
from tests.llm.test_minhash import brute as near_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_are_named_and_typed(spark, odd, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert stage(spark, documents([]), FOLDER).count() == 0


def test_rows_equal_brute_force(spark):
    packer = quality.zstandard.ZstdCompressor(level=3, write_content_size=False)

    def good(text):
        words = (text or "").encode().split()
        enough = len(words) >= 50 and 100 * quality.repeated_words(words) <= 50 * len(words)
        return enough and quality.compression((text or "").encode(), quality.Bands(), packer)[0] == "good"

    rows = [(r["doc_id"], r["text"]) for r in table_texts() if good(r["text"])]
    first = {i for i, _, _, kept in near_groups(rows, 5) if kept}
    rows = [(i, t) for i, t in rows if i in first]
    items = [decontaminate.normal_words(r["text"]) for r in table_texts("benchmark")]

    def leaks(text):
        words = decontaminate.normal_words(text)
        grams = {tuple(words[k : k + 4]) for k in range(len(words) - 3)}
        for item in items:
            if any(tuple(item[k : k + 4]) in grams for k in range(len(item) - 3)):
                hashed = [decontaminate.word_hashes(item)], [decontaminate.word_hashes(words)]
                if decontaminate.align(*hashed)[0][0] >= 0.5 * decontaminate.MATCH * len(item):
                    return True
        return False

    rows = [(i, t) for i, t in rows if not leaks(t)]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        codec = bpe.Codec(file.read(), public_tokenizers.PATTERN)
    want = {i: codec.encode(pii.masked(t, pii.base_spans(t))) for i, t in rows}
    found = corpus_pipeline.run(spark, FOLDER).collect()
    # The tables are too small for trained thresholds, so only base spans are masked.
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found} == want and len(found) == len(want) > 20


def test_a_broken_run_goes_on_after_its_last_stage(spark, monkeypatch):
    folder, calls = shared_dir(spark, "pipeline"), []

    def stage(name, fails=False):
        def work(spark, docs, sf_dir):
            calls.append(name)
            if fails:
                raise RuntimeError(name)
            return docs.withColumn(name, F.lit(len(calls)))

        return name, work

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", fails=True)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, FOLDER, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    rows = corpus_pipeline.run(spark, FOLDER, folder)
    assert calls == ["a", "b", "c", "c"]
    assert [tuple(r) for r in rows.select("a", "b", "c").distinct().collect()] == [(1, 2, 4)]
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
