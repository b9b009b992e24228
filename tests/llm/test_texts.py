"""Language ID, licence scans, language-model scores, sharding and mixing."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import best_fit_shards, budget_mix, context_mixing, language_id, license_rules

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def some(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], KIND)


# -- language ID


def test_languages_of_held_out_documents(spark, docs):
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.learn(docs.where(fold != 2))
    got = language_id.predicted(docs.where(fold == 2), model).collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.lang_score <= 1 for r in got)


def test_language_edges(spark, docs):
    model = language_id.learn(docs)
    odd = some(spark, [(1, None), (2, ""), (3, " 12 ?! \n"), (4, "the and of that " * 60_000), (4, "the and of that"), (None, "É")])
    got = {(r.doc_id, len(r.text) if r.text is not None else None): (r.lang_pred, r.lang_score) for r in language_id.predicted(odd, model).collect()}
    assert [got[k][0] for k in ((1, None), (2, 0), (3, 8))] == ["und"] * 3 and got[1, None][1] == 0
    assert got[4, 960_000][0] == got[4, 15][0] == "en" and got[None, 1][0] != "und"
    kept = language_id.accepted(odd.withColumnRenamed("lang", "lang_pred"), model)
    assert kept.columns == ["doc_id", "text", "lang_pred", "source"] and kept.count() == 3
    assert language_id.predicted(odd.limit(0), model).count() == 0
    nothing = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.predicted(odd, nothing).collect()} == {"und"}
    one = language_id.learn(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.predicted(odd, one).collect()} == {"und", "fr"}


def test_null_and_repeated_ids_teach(spark):
    english, french = "the and of that with this from", "le la les des pour avec dans"
    rows = [(None, f"{english} {k}", "en") for k in range(30)] + [(1, f"{french} x{k}", "fr") for k in range(30)] + [(2, "é ü", "fr")] * 50
    model = language_id.learn(some(spark, rows), language_id.Params(sample=20))
    table = some(spark, [(1, english), (2, french)]).withColumn("lang_pred", F.lit(3)).withColumn("lang_score", F.lit("x"))
    assert {r.doc_id: r.lang_pred for r in language_id.predicted(table, model).collect()} == {1: "en", 2: "fr"}


def test_every_language_is_learned(spark):
    names = [a + b + c for a in "qwxyz" for b in "abcde" for c in "abcdefghijk"]  # 275, above any earlier bound
    rows = [(k, f"{n * 3} {n}{n[::-1]} " * 3, n) for k, n in enumerate(names) for _ in (0, 1)]
    model = language_id.learn(some(spark, rows), language_id.Params(rounds=30))
    assert len({x for own in model.languages.values() for x in own}) == len(names)


def test_slices_of_a_long_text_add_up():
    text = "".join(chr(97 + k % 26) + (" " if k % 7 == 0 else "") for k in range(200_000))
    whole = np.bincount(language_id.features(np.frombuffer((" " + text + "  ").encode(), np.uint8)).ravel(), minlength=2 * language_id.SIZE)
    try:
        keep, language_id.SLICE = language_id.SLICE, 1000
        parts = sum(np.bincount(language_id.features(x).ravel(), minlength=2 * language_id.SIZE) for x in language_id.framed(text))
    finally:
        language_id.SLICE = keep
    assert (whole == parts).all()


# -- licences

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
"""
GRANT = license_rules.SENTENCES["mit-grant"][0].capitalize()
BSD = ["bsd-head", "bsd-source", "bsd-binary", "bsd-names"]


def said(*names):
    return "\n".join(license_rules.SENTENCES[n][0].upper() + "." for n in names)


LICENCES = [
    (1, "Hello. Released under the MIT License.", "MIT"),
    (2, "x\n\n" + said("mit-grant", "mit-notice", "as-is"), "MIT"),
    (3, said("mit-grant", "as-is", "mit-notice"), ""),
    (4, said(*BSD), "BSD-3-Clause"),
    (5, said(*BSD[:3]), "BSD-2-Clause"),
    (6, said(*BSD[:2]), ""),
    (7, "// SPDX-License-Identifier: Apache-2.0\n// more", "SPDX:Apache-2.0"),
    (12, "The MIT License\n\n" + said("mit-named"), "MIT"),
    (13, " * " + said("mit-grant").replace(" ", "\n * ") + "\n *\n" + said("mit-notice", "as-is"), "MIT"),
    (8, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0!", "Apache-2.0,CC-BY-NC-4.0"),
    (9, None, ""), (10, "", ""), (11, "no licence here. " * 20_000, ""),
    (8, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0!", "Apache-2.0,CC-BY-NC-4.0"),
]


def test_licences(spark):
    got = license_rules.scanned(some(spark, [(i, t) for i, t, _ in LICENCES])).collect()
    assert sorted((r.doc_id, r.licenses) for r in got) == sorted((i, x) for i, _, x in LICENCES)
    assert {r.n_sentences for r in got if r.doc_id in (9, 10)} == {0}
    assert license_rules.scanned(some(spark, [(1, "x")]).limit(0)).count() == 0


def test_licences_in_sql(spark, docs):
    both = docs.select("doc_id", "text").union(some(spark, [(i + 10_000, t) for i, t, _ in LICENCES]).select("doc_id", "text"))
    documents = both.toPandas()
    assert len(documents)
    want = duckdb.sql(license_rules.oracle_sql()).fetchall()
    got = [tuple(r) for r in license_rules.scanned(both).collect()]
    assert sorted(got) == sorted(want)


def test_licence_lines_after_lines_without_an_end_mark(spark):
    grant = said("mit-grant").replace("ANY PERSON", "ANY\nPERSON") + "\n" + said("mit-notice", "as-is")
    texts = [
        (1, "thonhare.***\nReleased under the MIT License\nfrom from from", "MIT", "mit-named"),
        (2, "| a | b |\r\nThis work is licensed under CC BY 4.0.\r\nmore", "CC-BY-4.0", "cc-by4-named"),
        (3, "Copyright (c) 2020 Someone\n" + grant, "MIT", "mit-grant,mit-notice,as-is"),
        (4, "This project is\nlicensed under the MIT License", "MIT", "mit-named"),
        (5, "from\nMIT License\nLicensed under the Apache License,\nVersion 2.0\nfrom", "Apache-2.0,MIT", "mit-named,apache2-named"),
        (6, "it is not released under the MIT License\nfrom", "", ""),
    ]
    got = license_rules.scanned(some(spark, [(i, t) for i, t, *_ in texts])).collect()
    assert sorted((r.doc_id, r.licenses, r.sentence_ids) for r in got) == [(i, x, ids) for i, _, x, ids in texts]


def test_the_scan_is_native(spark, docs):
    plan = license_rules.scanned(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- language model


@pytest.fixture(scope="module")
def scores(spark, docs):
    odd = some(spark, [(7000, None), (7001, ""), (7002, "Brand-new \x01 wörds " * 3), (7003, "the " * 50_000), (7003, "the " * 50_000)])
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return both.collect(), context_mixing.scored(both, held).collect()


def test_base_scores_and_counts(scores):
    rows, got = scores
    words = {}
    for r in rows:
        words.setdefault(r.doc_id, []).append((r.text or "").encode().lower().split())
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, x in words.items() if not held[i] for own in x for w in own)
    ends = sum(len(x) for i, x in words.items() if not held[i])
    n, v = sum(counts.values()) + ends, len(counts) + 1
    low = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    assert len(got) == len(rows)
    for r in got:
        own = words[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n)
        assert r.base_score == pytest.approx(sum(map(low, map(counts.get, own, [0] * len(own)))) + low(ends), rel=1e-9)


def test_the_model_beats_the_base_on_held_out_texts(scores):
    _, got = scores
    held = [r for r in got if r.held_out]
    assert held and all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len({r.score for r in got if r.doc_id == 7003}) == 1


def test_held_out_texts_teach_nothing(spark):
    rows = [(i, f"alpha beta {'gamma' * (i % 3)} delta w{i}") for i in range(40)]
    held = F.col("doc_id") % 4 == 0
    one = {r.doc_id: r for r in context_mixing.scored(some(spark, rows), held).collect()}
    other = [(i, t if i % 4 or i == 8 else "entirely other words zzz " * 5) for i, t in rows]
    two = {r.doc_id: r for r in context_mixing.scored(some(spark, other), held).collect()}
    same = [i for i, _ in rows if i % 4 or i == 8]
    assert all(one[i].score == pytest.approx(two[i].score, rel=1e-6) and one[i].base_score == two[i].base_score for i in same)


def test_no_training_rows(spark):
    rows = some(spark, [(1, "a b"), (2, None)])
    got = context_mixing.scored(rows, F.lit(True)).collect()
    assert {(r.doc_id, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
    assert context_mixing.scored(rows.limit(0), F.lit(False)).count() == 0


# -- sharding


def test_tree_keeps_its_order_and_balance():
    r = np.random.default_rng(2)
    tree, kept = best_fit_shards.Tree(), []
    for k in range(3000):
        if kept and r.random() < 0.45:
            size = int(r.integers(0, 1100))
            want = min((x for x in kept if x[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                kept.remove(want)
        else:
            x = (int(r.integers(0, 1000)), k)
            tree.insert(x)
            kept.append(x)
    assert tree._high(tree.root) <= 1.45 * math.log2(len(kept) + 2)


def plain_best_fit(sizes, capacity):
    """What each bin holds, item by item: the fullest bin in which one still fits, by number."""
    rooms, bins = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= size]
        b = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(max(capacity, size))
            bins.append([])
        rooms[b] -= size
        bins[b].append(size)
    return bins


def counted(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def spread(bins):
    return [[size for size, n in own for _ in range(n)] for own in bins]


def test_best_fit_decreasing():
    r = np.random.default_rng(3)
    for most in (5, 60, 200):
        sizes = r.integers(1, most, 400).tolist()
        assert spread(best_fit_shards.best_fit(counted(sizes), 100)) == plain_best_fit(sizes, 100)
    assert best_fit_shards.best_fit([(500, 1), (3, 1)], 100) == [[(500, 1)], [(3, 1)]]


def test_shards_are_those_of_best_fit_over_all_groups(spark):
    """At a size with many small groups: no group is packed by anything else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = Counter()
    for r in docs.select("text").collect():
        groups[r.text] += (len(r.text.encode()) if r.text is not None else 0) + 1
    sizes, got = list(groups.values()), defaultdict(int)
    for r in best_fit_shards.sharded(docs, 16).collect():
        got[r.shard] += r["size"]
    capacity = -(-sum(sizes) // 16)
    step = capacity // 10_000
    while len(want := plain_best_fit(sizes, capacity)) > 16:
        capacity += step
        step += step // 2
    assert max(sizes) <= capacity and [got[k] for k in range(16)] == [sum(x) for x in want]


def test_a_group_above_the_mean_leaves_no_shard_empty(spark):
    words = np.random.default_rng(4).integers(10**8, 10**9, 2000).tolist()
    rows = some(spark, [(k, "hot" * 333) for k in range(100)] + [(1000 + k, f"{w} " * 10) for k, w in enumerate(words)])
    sizes = defaultdict(int)
    for r in best_fit_shards.sharded(rows, 16).collect():
        sizes[r.shard] += r["size"]
    hot, *others = sorted(sizes.values(), reverse=True)
    assert hot == 100_000 and sorted(sizes) == list(range(16)) and max(others) <= 1.02 * sum(others) / 15
    bins = best_fit_shards.fixed_bins([(500, 1), (60, 1), (1, 5)], 6)
    assert bins[:2] == [[(500, 1)], [(60, 1)]] and sorted(sum(n for _, n in x) for x in bins[2:]) == [1, 1, 1, 2]
    assert sorted(sum(n for _, n in x) for x in best_fit_shards.fixed_bins([(1, 17)], 16)) == [1] * 15 + [2]
    assert best_fit_shards.fixed_bins([(9, 2)], 4) == [[(9, 1)], [(9, 1)]] and best_fit_shards.fixed_bins([(5, 2)], 1) == [[(5, 2)]]


@pytest.mark.parametrize("capacity", [None, 60_000])
def test_shards(spark, docs, capacity):
    rows = docs.select("doc_id", "text").union(some(spark, [(900, None), (901, None), (902, ""), (903, "Ünï"), (903, "Ünï"), (None, "no id"), (None, "no id")]).select("doc_id", "text"))
    rows = rows.withColumn("shard", F.lit("x")).withColumn("size", F.lit(1))
    got = best_fit_shards.sharded(rows, 4, capacity).collect()
    texts = defaultdict(set)
    for r in rows.collect():
        texts[r.doc_id].add(r.text)
    assert len(got) == rows.count() and all(r.law == "bytes" and r.grown_shard is None for r in got)
    shards, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        (text,) = texts[r.doc_id]
        data = (text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        shards[r.shard].append(r)
        by_text[text].add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    sizes = {k: sum(r["size"] for r in x) for k, x in shards.items()}
    if capacity is None:
        assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) <= 1.02 * sum(sizes.values()) / 4
    else:
        assert max(sizes.values()) <= capacity and len(sizes) <= math.ceil(1.05 * sum(sizes.values()) / capacity)
    assert best_fit_shards.sharded(rows.limit(0), 4).count() == 0


# -- mixing


def plain_budgets(leaves, amount, epochs, weights):
    """The tokens of each leaf, from the root down, one by one in memory."""
    out = {}

    def down(paths, depth, share):
        names = sorted({x[: depth + 1] for x in paths})
        own = [[x for x in paths if x[: depth + 1] == name] for name in names]
        given, open_ = [0] * len(names), {k for k, name in enumerate(names) if weights.get(name, 1.0) > 0}
        room = [epochs * sum(leaves[x] for x in o) for o in own]
        share = min(share, sum(room[k] for k in open_))
        while open_ and share:
            total = sum(weights.get(names[k], 1.0) for k in sorted(open_))
            full = [k for k in sorted(open_) if room[k] - given[k] <= share * weights.get(names[k], 1.0) / total]
            if not full:
                parts = {k: int(share * weights.get(names[k], 1.0) / total) for k in sorted(open_)}
                spare = share - sum(parts.values())
                for n, k in enumerate(sorted(open_)):
                    given[k] += parts[k] + (n < spare)
                break
            for k in full:
                share -= room[k] - given[k]
                given[k] = room[k]
                open_.remove(k)
        for name, o, x in zip(names, own, given, strict=True):
            if o == [name]:
                out[name] = x
            else:
                down(o, depth + 1, x)

    down(sorted(leaves), 0, amount)
    return out


@pytest.mark.parametrize(
    "leaves,amount,epochs,weights",
    [
        ({("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}, 120, 1, {}),
        ({("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}, 300, 1, {}),
        ({("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}, 300, 2, {("b",): 0.0}),
        ({(f"d{k % 3}", f"l{k % 5}", f"s{k}"): k * k for k in range(300)}, 1_000_003, 2, {("d1",): 3.0, ("d0", "l2"): 0.5}),
    ],
)
def test_shortages_go_to_siblings_first(spark, leaves, amount, epochs, weights):
    table = spark.createDataFrame([("\x01".join(k), n) for k, n in leaves.items()], "path string, n long")
    got = {tuple(r.path.split("\x01")): r.budget for r in budget_mix.budgets(table, len(next(iter(leaves))), amount, epochs, weights).collect()}
    assert got == plain_budgets(leaves, amount, epochs, weights)


def test_budgets_by_hand():
    assert plain_budgets({("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 1000}, 300, 1, {}) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 190}
    assert sum(budget_mix.poured(7, [10, 10, 10], [1, 1, 1])) == 7
    assert budget_mix.poured(5, [1, 1], [1, 1]) == [1, 1] and budget_mix.poured(0, [], []) == []


LEVELS = {"lang": lambda: F.col("lang"), "source": lambda: F.col("source")}


def levels():
    return {k: f() for k, f in LEVELS.items()}


@pytest.mark.parametrize("budget,epochs", [(0.5, 1), (1.0, 2), (3000, 3), (0, 2)])
def test_mixed_documents_are_prefixes(spark, docs, budget, epochs):
    p = budget_mix.Params(budget=budget, epochs=epochs, weights={("en",): 3.0, ("fr", "src1"): 2.0})
    extra = some(spark, [(800, None, None, "src0"), (801, "", "en", None), (802, "a b c", "en", "src0"), (802, "a b c", "en", "src0")])
    rows = docs.select("doc_id", "text", "lang", "source").union(extra).withColumn("leaf", F.lit(1)).withColumn("epoch", F.lit("e"))
    got = budget_mix.mixed(rows, levels(), p).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = {}
    for e in range(epochs + 1):
        for r in rows.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), F.lit(e).cast("long"), "doc_id"), 1).alias("k")).collect():
            key[e, r.doc_id] = r.k
    leaves = defaultdict(list)
    for r in rows.collect():
        leaves[r.lang or "", r.source or ""].append((r.doc_id, words(r.text)))
    have = {k: sum(n for _, n in x) for k, x in leaves.items()}
    amount = int(budget * sum(have.values())) if isinstance(budget, float) else budget
    want = Counter()
    for leaf, share in plain_budgets(have, amount, epochs, p.weights).items():
        whole, rest = divmod(share, have[leaf]) if have[leaf] else (0, 0)
        for i, _ in leaves[leaf]:
            for e in range(min(whole, epochs)):
                want[i, e] += 1
        if whole < epochs:
            total, last = 0, None
            groups = defaultdict(int)
            for i, n in leaves[leaf]:
                groups[key[whole, i], i] += n
            for (_, i), n in sorted(groups.items()):
                total += n
                if total > rest:
                    break
                want[i, whole] += sum(1 for x, _ in leaves[leaf] if x == i)
    assert Counter((r.doc_id, r.epoch) for r in got) == want
    kept = budget_mix.mixed(rows, levels(), p, keep=True)
    assert kept.columns == rows.columns and kept.count() == len(got)


def test_mixing_nothing(spark, docs):
    assert budget_mix.mixed(docs.limit(0), levels()).count() == 0
