"""Files, sinks and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftwork.functions import folding
from weftwork.operators import browsers, rows
from weftwork.plans import stylesheets
from weftwork.sources import texts
from weftwork.streaming import sheets as streaming


def test_files_to_sheets_and_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.css").write_text("color:red;&:hover{color:blue}")
    (tmp_path / "in/b.css").write_text("a{")
    done = stylesheets.transform_css(texts.css_files(spark, str(tmp_path / "in")))
    got = {r.path.rsplit("/", 1)[1]: r for r in done.collect()}
    assert got["a.css"].error is None and len(got["a.css"].sheets) == 2
    assert got["b.css"].sheets is None and "Unclosed" in got["b.css"].error
    out = done.where("error is null").select(F.lit("m").alias("module"), F.explode("sheets").alias("sheet"))
    texts.write_sheets(out, str(tmp_path / "out"), ["module"])
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_null_and_empty_styles(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "/* only */")], "doc_id int, css string")
    got = {r.doc_id: r for r in stylesheets.transform_css(df).collect()}
    assert got[1].sheets is None and got[1].error is None and got[2].sheets == [] == got[3].sheets
    assert stylesheets.nodes_of(df).count() == 1 and stylesheets.declarations_of(df).count() == 0
    assert stylesheets.transform_css(df.limit(0)).count() == 0


def test_unknown_at_rules_raise(spark):
    df = spark.createDataFrame([("media",), ("font-face",)], "name string")
    assert [r.g for r in df.select(rows.gate(F.col("name")).alias("g")).collect()] == [True, False]
    try:
        spark.createDataFrame([("import",)], "name string").select(rows.gate(F.col("name"))).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "cannot be used in CSS rules" in str(e)


def test_short_classes_merge(spark):
    df = spark.createDataFrame([(1, 0, "_aaaa_k"), (1, 1, "x"), (1, 2, "_aaaabbbb"), (2, 0, "_cccc_m")], "id int, ord int, c string")
    got = {r.id: r.classes for r in rows.merge_classes(df, ["id"], "ord", "c", short=True).collect()}
    assert got == {1: "_aaaabbbb x", 2: "m"}


def test_features_by_name(spark):
    support = spark.createDataFrame([("css-grid", "x", "1", "y"), ("css-grid-2", "x", "1", "y"), ("flex", "x", "1", "y")], "feature string, browser string, version string, flags string")
    assert [r.feature for r in browsers.find_features(support, "css-grid").collect()] == ["css-grid"]
    assert sorted(r.feature for r in browsers.find_features(support, "grid").collect()) == ["css-grid", "css-grid-2"]
    features = spark.createDataFrame([("flex",), ("none",)], "feature string")
    nobody = spark.createDataFrame([], "browser string, version string")
    assert {r.feature: r.supported for r in browsers.is_supported(support, features, nobody).collect()} == {"flex": True, "none": False}


def test_usage_queries(spark):
    agents = spark.createDataFrame([("x", "1", 0, 1), ("x", "2", 1, 1)], "browser string, version string, pos int, released int")
    usage = spark.createDataFrame([("x", "1", 0.2), ("x", "2", 5.0)], "browser string, version string, share double")
    assert [(r.browser, r.version) for r in browsers.selected(spark, agents, "> 1%", usage).collect()] == [("x", "2")]


def test_stream_inserts_each_sheet_once(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.txt").write_text("._aaaabbbb{color:red}\n._aaaabbbb{color:red}\n@media x{}\n")
    (tmp_path / "s/2.txt").write_text("@media x{}\n._aaaabbbb:hover{top:0}\n")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "s")).withColumnRenamed("value", "sheet")
    out = streaming.inserted_once(stream)
    q = out.writeStream.format("memory").queryName("weftwork_sheets").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r.sheet, r.bucket) for r in spark.table("weftwork_sheets").collect()) == [("._aaaabbbb:hover{top:0}", "h"), ("._aaaabbbb{color:red}", ""), ("@media x{}", "m")]


def test_late_sheets_within_the_watermark(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.json").write_text('{"sheet": "a", "at": "2024-01-01T00:00:00"}\n{"sheet": "a", "at": "2024-01-01T00:10:00"}\n')
    stream = spark.readStream.schema("sheet string, at timestamp").json(str(tmp_path / "s"))
    q = streaming.inserted_once(stream, time="at").writeStream.format("memory").queryName("weftwork_late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("weftwork_late").count() == 1


def test_dead_browsers(spark):
    agents = spark.createDataFrame([("x", "1", 0, 1), ("x", "2", 1, 1), ("ie", "8", 0, 1)], "browser string, version string, pos int, released int")
    dead = spark.createDataFrame([("ie", "8")], "browser string, version string")
    assert sorted((r.browser, r.version) for r in browsers.selected(spark, agents, "last 2 versions, not dead", dead=dead).collect()) == [("x", "1"), ("x", "2")]
    usage = spark.createDataFrame([("x", "1", 0.2), ("x", "2", 5.0)], "browser string, version string, share double")
    assert sorted((r.browser, r.version) for r in browsers.selected(spark, agents, "defaults", usage, dead).collect()) == [("x", "1"), ("x", "2")]
    for query in ("not dead", "> 1%"):
        with pytest.raises(ValueError, match="needs a table"):
            browsers.selected(spark, agents, query)


def test_first_match_keeps_every_row(spark, monkeypatch):
    left = spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "c"), (2, None)], "id int, t string")
    rules = spark.createDataFrame([(2, "a"), (1, "ab")], "rule int, prefix string")
    want = [(1, "ab", 1), (1, "ab", 1), (1, "c", None), (2, None, None)]
    for few in (1000, 1):
        monkeypatch.setattr(rows, "FEW_RULES", few)
        got = rows.first_match(left, rules, lambda r: F.col("t").startswith(r.prefix), "rule").collect()
        assert sorted(((r.id, r.t, r.rule) for r in got), key=str) == want
    assert rows.first_match(left, rules.limit(0), lambda r: F.col("t").startswith(r.prefix), "rule").count() == 4


def test_rounding_of_large_numbers(spark):
    x = spark.createDataFrame([(1e20,), (-2.0**60,), (2.5,), (-2.5,), (float("inf"),)], "x double")
    got = x.select(*(folding.MATH[f](F.col("x")).alias(f) for f in ("ceil", "floor", "round", "trunc"))).collect()
    assert [tuple(r) for r in got] == [(1e20,) * 4, (-(2.0**60),) * 4, (3, 2, 3, 2), (-2, -3, -2, -2), (float("inf"),) * 4]


def test_deep_nesting_is_an_error(spark):
    deep = "a{" * 5000 + "top:0" + "}" * 5000
    got = stylesheets.transform_css(spark.createDataFrame([(1, deep), (2, "a{top:0}")], "id int, css string")).collect()
    assert [r.error is None for r in sorted(got, key=lambda r: r.id)] == [False, True]
