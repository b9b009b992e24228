"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from weftwork.llm.token_cache import default_path

SF = "/root/testdata/sf0.001"


def test_stages_and_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "mixture", "packing"]


def test_each_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(5000, None, "en", "src1", 0), (5001, "12 34", "en", "src1", 5)], docs.schema)
    docs.union(extra).union(docs.where("doc_id = 7").selectExpr("6000L as doc_id", "text", "lang", "source", "n_chars")).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id: r.text for r in now.collect()}
    steps = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append({r.doc_id for r in now.collect()})
    assert steps[0] == set(before) - {5000, 5001}
    assert 6000 not in steps[1] and steps[1] < steps[0] and steps[2] < steps[1]
    words = lambda ids: sum(len((before[i] or "").split()) for i in ids)
    assert 0.6 * words(steps[1]) < words(steps[2]) <= 0.8 * words(steps[1])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == steps[2]
    whole = Tokenizer.from_file(default_path())
    for r in got:
        ids = [*whole.encode(before[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert sum(r.length for r in got) == sum(len(whole.encode(before[i], add_special_tokens=False).ids) + 1 for i in steps[2])


def test_near_copies_go_and_less_similar_texts_stay(spark):
    r = np.random.default_rng(5)
    docs, keep = [], set()
    for k, n in enumerate([40, 60, 90, 150, 300, 700, 1500] * 6):
        words = [f"w{x}" for x in r.integers(0, 10**6, n)]
        near, far = list(words), list(words)
        for at in range(n // 50):  # five shingles each: similarity just over 0.8
            near[at * 50 + 10] = "changed"
        near[0] = "changed" if n < 50 else near[0]
        far[2::15] = ["other"] * len(far[2::15])  # a third of the shingles: similarity 0.5
        docs += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(near).upper()), (10 * k + 2, " ".join(far))]
        keep |= {10 * k, 10 * k + 2}
    sets = lambda x: {tuple(w[i : i + 5]) for w in [x.lower().split()] for i in range(len(w) - 4)}
    for (_, a), (_, b), (_, c) in zip(docs[::3], docs[1::3], docs[2::3], strict=True):
        assert len(sets(a) & sets(b)) >= 0.8 * len(sets(a) | sets(b)) and len(sets(a) & sets(c)) < 0.8 * len(sets(a) | sets(c))
    table = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, table, "").collect()} == keep
