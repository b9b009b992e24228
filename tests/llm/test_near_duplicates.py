"""Near-duplicates by the Hamming trees' candidates and an exact check on the shingles."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from weftwork.llm import hamming_tree, shingle_groups
from weftwork.llm.hamming_tree import WORDS, Wide

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], TEXTS)


def kept(rows):
    """By comparing all pairs."""
    sets = [set(shingle_groups.shingles(t, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label)}


def test_the_stage_goes_through_the_hamming_trees(spark, monkeypatch):
    seen, own = [], hamming_tree.candidates
    monkeypatch.setattr(shingle_groups, "candidates", lambda *a: seen.append(1) or own(*a))
    rows = [(1, " ".join(f"a{k}" for k in range(60))), (2, " ".join(f"a{k}" for k in range(57))), (3, " ".join(f"b{k}" for k in range(60)))]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()} == {1, 3} and seen


def test_pairs_at_the_least_similarity_meet_in_a_shard(spark):
    r, sets = np.random.default_rng(7), []
    for n in [4, 5, 8, 9, 20, 45, 90, 180, 450] * 60:
        common = r.integers(0, 1 << 63, n, np.uint64)
        # n of 5 in both, or n of 1.25 n: similarity 0.8 of one in the other where n divides by 4
        other = np.concatenate([common, r.integers(0, 1 << 63, n // 4, np.uint64)])
        sets += [common, other]
    p = Wide(shard_rows=64)
    assert hamming_tree.shards_of(len(sets), p)[2] >= 4
    rows = [(k, len(x), *hamming_tree.wide(x).view(np.int64).tolist()) for k, x in enumerate(sets)]
    found = hamming_tree.candidates(spark.createDataFrame(rows, "key long, size long, " + ", ".join(f"{w} long" for w in WORDS)), len(rows), p)
    root = {x.node: x.root for x in found.collect()}
    # whole sets apart, since only those of four and five shingles could link by chance
    assert all(root.get(k + 1) == root.get(k, k) for k in range(0, len(rows), 2))
    large = [k for k, x in enumerate(sets) if len(x) >= 45]
    assert all(root.get(k, k) in (k, k - 1) for k in large)


def test_a_component_in_many_blocks(spark):
    r = np.random.default_rng(3)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(60):  # near copies of one text, of which some are too far from each other
        words = list(base)
        for at in r.integers(0, 200, int(r.integers(0, 5))):
            words[int(at)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"y{k}x{i}" for i in range(50))) for k in range(20)]
    got = shingle_groups.one_of_each(table(spark, rows), shingle_groups.Params(block=8, bucket_rows=16))
    assert {x.doc_id for x in got.collect()} == kept(rows)
