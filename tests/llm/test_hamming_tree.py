"""SimHash near-duplicates against a plain version."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from weftwork.llm import hamming_tree
from weftwork.llm.common import Forest, components


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "A b C d e", "É à b c\x0bd e\x1cf g", "a " * 70_000, "x" * 200_000])
def test_fingerprint(text):
    assert hamming_tree.fingerprint(text) == plain(text)


def roots(fp, reach=3):
    forest = Forest(len(fp))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= reach):
            forest.join(i, i + 1 + int(j))
    return [forest.find(i) for i in range(len(fp))]


def clouds(n, seed):
    """Distinct fingerprints: loose ones, chains of near ones and a dense ball."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    for x in list(out)[: n // 4]:
        for _ in range(4):
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            out.add(x)
    centre = r.getrandbits(64)
    out |= {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(20)) for _ in range(n // 2)}
    return np.asarray(sorted(out), np.uint64)


@pytest.mark.parametrize("leaf", [8, 64, 384])
def test_tree_links_what_brute_force_links(leaf):
    fp = clouds(600, leaf)
    forest = hamming_tree.link(fp, 3, leaf, np.random.default_rng(0))
    assert [forest.find(i) for i in range(len(fp))] == roots(fp)


def test_dense_sets():
    fp = clouds(200, 9)
    forest = Forest(len(fp))
    hamming_tree.link_dense(fp, np.arange(len(fp)), forest, 3)
    assert [forest.find(i) for i in range(len(fp))] == roots(fp)


def texts():
    r = random.Random(4)
    words = ["w%d" % k for k in range(300)]
    out = []
    for k in range(160):
        own = [r.choice(words) for _ in range(r.randrange(30, 120))]
        out.append(" ".join(own))
        if k % 4 == 0:
            out.append(" ".join(own).upper())
            near = " ".join(own + [r.choice(words)])
            out += [near, near]
    return [(i, t, "x", "y") for i, t in enumerate(out)] + [(900, None, "x", "y"), (901, "", "x", "y"), (902, " \n", "x", "y"), (5, out[5], "x", "y")]


@pytest.mark.parametrize("shards", [1, 8])
def test_documents(spark, shards):
    data = texts()
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string, rep string")
    got = hamming_tree.near_duplicates(docs, hamming_tree.Params(least_shards=shards, leaf=16)).collect()
    assert len(got) == len(data)
    fp = np.asarray([plain(t) for _, t, *_ in data], np.uint64)
    root = roots(fp)
    least = {}
    for r, (i, *_) in zip(root, data, strict=True):
        least[r] = min(i, least.get(r, i))
    want = sorted((i, f"{int(f):016x}", least[r]) for (i, *_), f, r in zip(data, fp, root, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = hamming_tree.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values())) and kept[0].asDict().keys() == {"doc_id", "text", "fp", "rep"}


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "zz yy xx ww")], "doc_id long, text string")
    assert hamming_tree.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.component_id or -1 for r in hamming_tree.near_duplicates(docs).collect()) == [-1, 3, 3]
    assert hamming_tree.one_of_each(docs).count() == 3


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
