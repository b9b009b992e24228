"""Nearest neighbours and near-duplicate vectors against brute force."""

from __future__ import annotations

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from weftwork.llm import collision_search, rotated_codes

KIND = "vec_id long, embedding array<float>, label int, shard string, n_links int"


def rows(n=400, d=24, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * r.standard_normal((n - n // 2, d))
    x[5] = x[6] = x[7]  # ties
    return [(i, x[i].astype(np.float32).tolist(), i % 3 if i % 11 else None, "s", 1) for i in range(n)]


BAD = [(1000, None, 0, "s", 1), (1001, [0.0] * 24, 0, "s", 1), (1002, [math.nan] + [1.0] * 23, 0, "s", 1), (1003, [math.inf] + [1.0] * 23, 1, "s", 1), (1004, [None] + [1.0] * 23, 1, "s", 1)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows() + BAD, KIND)


def test_search_finds_the_nearest(spark, vectors):
    found = collision_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=5).collect()
    x = np.asarray([r[1] for r in rows()], np.float32).astype(np.float64)
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append(r)
    assert sorted(by) == list(range(0, 400, 20))
    hit = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(r.score == dist[r.vec_id] and r.vec_id != q for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        dist[q] = np.inf
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(len(x)), dist))[:5].tolist()))
    assert hit >= 0.9 * 5 * len(by)


def test_search_with_few_candidates_and_none(spark, vectors):
    few = vectors.where("vec_id in (0, 5, 6, 7, 1000)")
    found = collision_search.nearest(few, few.where("vec_id = 5"), k=10).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in found][:2] == [(1, 6), (2, 7)] and len(found) == 3
    assert collision_search.nearest(few.limit(0), few, k=3).count() == 0
    assert collision_search.nearest(few, few.limit(0), k=3).count() == 0
    assert collision_search.nearest(few, vectors.where("vec_id >= 1000"), k=3).count() == 0


def brute(data, threshold):
    links, up = defaultdict(int), {r[0]: r[0] for r in data}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    able = [(r[0], np.asarray(r[1], np.float64), r[2]) for r in data if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None]
    for k, (a, x, la) in enumerate(able):
        for b, y, lb in able[k + 1 :]:
            if la == lb and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {r[0]: (links[r[0]], find(r[0])) for r in data}


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_near_duplicates_match_brute_force(spark, vectors, block_rows):
    got = rotated_codes.near_duplicates(vectors, 0.93, rotated_codes.Params(block_rows=block_rows)).collect()
    want = brute(rows() + BAD, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(want)


def test_near_duplicates_of_empty_and_tiny_vectors(spark, vectors):
    assert rotated_codes.near_duplicates(vectors.limit(0)).count() == 0
    tiny = spark.createDataFrame([(1, [1e-30, 0.0], 1), (2, [1e-30, 1e-33], 1), (3, [1.0], None)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in rotated_codes.near_duplicates(tiny).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_in_sql(spark, vectors):
    embeddings = vectors.select("vec_id", "embedding", "label").toArrow()
    want = duckdb.sql(rotated_codes.oracle_sql(0.93)).fetchall()
    got = rotated_codes.near_duplicates(vectors, 0.93).select("vec_id", "n_links", "component_id", "kept").collect()
    assert len(embeddings) == len(got) and sorted(map(tuple, got)) == sorted(want)


def test_the_bound_holds_and_the_estimate_is_unbiased():
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 64))
    codes = rotated_codes.Codes(np.arange(600), x, rotated_codes.Params())
    estimate = (codes.code @ codes.turned.T) / np.sqrt(64) / codes.factor[:, None]
    exact = codes.unit @ codes.unit.T
    off = ~np.eye(600, dtype=bool)
    assert abs((estimate - exact)[off].mean()) < 0.002
    across = np.sqrt(np.maximum(0, 1 - exact**2))
    assert (np.abs(estimate - exact) <= 7 * codes.spread[:, None] * across + 1e-4).all()


def test_odd_ids_and_lengths(spark):
    kind = "vec_id int, embedding array<double>, label int"
    table = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0, 0.0], 0), (4, [1.0, 0.0, 0.01], 0), (None, [1.0, 0.0], 0), (5, [1.0, 0.0], None)], kind)
    got = {(r.query_id, r.vec_id) for r in collision_search.nearest(table, table, k=3).collect()}
    assert got == {(a, b) for own in ((1, 2, 5), (3, 4)) for a in own for b in own if a != b}
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rotated_codes.near_duplicates(table).collect()}
    assert found == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), None: (0, None, True)}


def test_huge_components(spark):
    table = spark.createDataFrame([(k, [x, 1.0, x / 3]) for k, x in enumerate((1e308, 0.9e308, -1.7e308, 1.0, 2.0))], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in collision_search.nearest(table, table.where("vec_id in (0, 3)"), k=4).collect()}
    assert [got[0, k][0] for k in (1, 2, 3, 4)] == [1, 3, 4, 2] and got[0, 4][1] == math.inf
    assert got[3, 1][0] == 4 and len(got) == 8
