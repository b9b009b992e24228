"""Items, modules, edits, prefixes and support data over literals, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits, items, modules, prefixes
from ..sources import support_data, texts
from ..streaming import sheets as streaming
from .styles import SHEETS, literal, text_udf

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


# -- items

ENTRIES = [(1, 0, "backgroundColor", None, "red"), (1, 1, "marginTop", 4.0, "4"), (1, 2, "lineHeight", 2.0, "2"), (1, 3, "content", None, "hi"), (2, 0, "--x", 1.0, "1"), (2, 1, "content", None, "none")]
OBJECTS = [(1, 'background-color:red;margin-top:4px;line-height:2;content:"hi";'), (2, "--x:1;content:none;")]


@query(f"SELECT id, css FROM {literal('id, css', OBJECTS)}")
def object_styles(spark, sf_dir):
    return items.object_css(spark.createDataFrame(ENTRIES, "id int, ord int, name string, number double, text string"), ["id"], "ord")


ITEMS = [(1, 0, "logical", "l"), (1, 1, "unconditional", "a"), (1, 2, "unconditional", "b"), (1, 3, "sheet", "s"), (1, 4, "unconditional", "c"), (1, 5, "logical", "m"), (1, 6, "unconditional", "d")]
MERGED = [(1, "sheet", "s", 0), (1, "logical", "l", 1), (1, "unconditional", "abc", 2), (1, "logical", "m", 3), (1, "unconditional", "d", 4)]


@query(f"SELECT id, type, css, place FROM {literal('id, type, css, place', MERGED)}")
def merged_style_items(spark, sf_dir):
    from pyspark.sql import Window

    out = items.merged_items(spark.createDataFrame(ITEMS, "id int, ord int, type string, css string"), ["id"])
    return out.select("id", "type", "css", (F.row_number().over(Window.partitionBy("id").orderBy("place")) - 1).alias("place"))


USED = [(1, 0, "--_a", "x"), (1, 1, "--_b", "y"), (1, 2, "--_a", "z"), (2, 0, "--_a", "w")]


@query(f"SELECT id, ord, name, expression FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY ord) AS k FROM {literal('id, ord, name, expression', USED)}) WHERE k = 1")
def unique_variables(spark, sf_dir):
    return items.variables(spark.createDataFrame(USED, "id int, ord int, name string, expression string"), ["id"])


CALLS = [("m", "css", 1), ("m", "styled", 2), ("m", "other", 3), ("n", "css", 4)]
IMPORTS = [("m", "css", "css", "lib"), ("m", "styled", "styled", "lib/x"), ("m", "other", "other", "elsewhere"), ("n", "css", "keyframes", "lib")]


@query(f"""SELECT c.module, c.local, call, imported AS api FROM {literal('module, local, call', CALLS).replace('t(', 'c(')}
JOIN {literal('module, local, imported, source', IMPORTS).replace('t(', 'i(')} ON i.module = c.module AND i.local = c.local WHERE i.source IN ('lib', 'lib/x')""")
def recognised_calls(spark, sf_dir):
    calls = spark.createDataFrame(CALLS, "module string, local string, call int")
    imports = spark.createDataFrame(IMPORTS, "module string, local string, imported string, source string")
    return items.from_imports(calls, imports, spark.createDataFrame([("lib",), ("lib/x",)], "source string"))


@query(f"SELECT css, named FROM {literal('css, named', [('color:red', True)])}")
def keyframe_names(spark, sf_dir):
    found = items.keyframes(spark.createDataFrame([("color:red",)], "css string"))
    return found.select("css", (F.col("name").startswith("k") & F.col("sheet").startswith(F.concat(F.lit("@keyframes "), "name"))).alias("named"))


# -- modules

SCOPES = [("root", None), ("f", "root"), ("g", "f"), ("h", "root")]
BOUND = [("root", "a"), ("f", "a"), ("f", "b"), ("h", "c")]
USES = [(1, "g", "a"), (2, "h", "a"), (3, "g", "c"), (4, "g", "b"), (5, "root", "a"), (6, "deep129", "c"), (7, "deep129", "missing")]
SCOPES += [("deep0", "h")] + [(f"deep{k}", f"deep{k - 1}") for k in range(1, 130)]


@query(f"""WITH RECURSIVE up AS (SELECT use, name, scope, 0 AS depth FROM {literal('use, scope, name', USES)}
  UNION ALL SELECT use, name, s.parent, depth + 1 FROM up JOIN {literal('scope, parent', SCOPES).replace('t(', 's(')} ON s.scope = up.scope WHERE s.parent IS NOT NULL)
SELECT use, up.name, arg_min(b.scope, depth) FILTER (b.scope IS NOT NULL) AS scope FROM up LEFT JOIN {literal('scope, name', BOUND).replace('t(', 'b(')} ON b.scope = up.scope AND b.name = up.name GROUP BY use, up.name""")
def nearest_bindings(spark, sf_dir):
    return modules.bindings(spark.createDataFrame(SCOPES, "scope string, parent string"), spark.createDataFrame(BOUND, "scope string, name string"), spark.createDataFrame(USES, "use int, scope string, name string"))


EDGES = [("a", "x", "b", "y"), ("b", "*", "c", None), ("c", "y", None, None), ("a", "z", None, None), ("d", "*", "a", None)]
EDGES += [(f"h{k}", f"v{k}", f"h{k + 1}", f"v{k + 1}") for k in range(40)] + [("h40", "v40", None, None), ("p", "*", "q", None), ("q", "*", "p", None)]


@query(f"SELECT module, name, home, home_name FROM {literal('module, name, home, home_name', [('a', 'x', 'c', 'y'), ('d', 'x', 'c', 'y'), ('d', 'z', 'a', 'z'), ('h0', 'v0', 'h40', 'v40')])}")
def resolved_exports(spark, sf_dir):
    wanted = spark.createDataFrame([("a", "x"), ("d", "x"), ("d", "z"), ("a", "missing"), ("h0", "v0"), ("p", "x")], "module string, name string")
    return modules.exports(spark.createDataFrame(EDGES, "module string, name string, source string, source_name string"), wanted)


HOPS = [("m", "b.js"), ("m", "a.js"), ("m", "b.js"), ("n", "c.js")]


@query(f"SELECT module, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM {literal('module, path', HOPS)} GROUP BY module")
def included_files(spark, sf_dir):
    return modules.included_files(spark.createDataFrame(HOPS, "module string, path string")).select("module", F.array_join("files", ",").alias("files"))


FILES = [("a.js", "A"), ("b.js", "B")]


@query(f"SELECT module, h.path, code FROM {literal('module, path', HOPS).replace('t(', 'h(')} LEFT JOIN {literal('path, code', FILES).replace('t(', 'f(')} ON f.path = h.path")
def imported_files(spark, sf_dir):
    hops = spark.createDataFrame(HOPS, "module string, path string")
    return texts.joined_modules(hops, spark.createDataFrame(FILES, "path string, code string")).select("module", "path", "code")


REQUESTS = [("@ui/button",), ("@ui/core/x",), ("./local",)]
PREFIXES = [(1, "@ui/core/", "core/"), (2, "@ui/", "packages/ui/")]


@query("SELECT request, path FROM " + literal("request, path", [("@ui/button", "packages/ui/button"), ("@ui/core/x", "core/x"), ("./local", "./local")]))
def resolved_requests(spark, sf_dir):
    return modules.resolved(spark.createDataFrame(REQUESTS, "request string"), spark.createDataFrame(PREFIXES, "rule int, prefix string, target string"))


STEPS = [{"op": "renameKey", "from": "old-exports", "to": "exports", "ifTargetMissing": True}, {"op": "ensureObject", "key": "exports"}, {"op": "setDefault", "in": "exports", "entries": {".": "./index.js"}}, {"op": "renameMapEntry", "in": "exports", "from": "./old", "to": "./new", "deleteSource": True}, {"op": "deleteKey", "key": "main"}]
PACKAGES = [('{"name": "a", "main": "x.js"}', '{"name": "a", "exports": {".": "./index.js"}}'), ('{"old-exports": {"./old": "o.js", ".": "i.js"}}', '{"old-exports": {"./old": "o.js", ".": "i.js"}, "exports": {".": "i.js", "./new": "o.js"}}'), ("[1]", "[1]")]


@query(f"SELECT before, after FROM {literal('before, after', PACKAGES)}")
def rewritten_packages(spark, sf_dir):
    df = spark.createDataFrame([(b, b) for b, _ in PACKAGES], "before string, after string")
    return modules.rewritten_packages(df, "after", STEPS)


STYLE_MAPS = [("styles", [".a{}", ".b{}"]), ("other", [".c{}"])]
STYLE_USES = [("x", 0, "other"), ("x", 1, "styles"), ("y", 0, "unknown"), ("x", 2, "other")]


@query("SELECT key, sheets FROM " + literal("key, sheets", [("x", ".c{}.a{}.b{}")]))
def used_style_maps(spark, sf_dir):
    uses = spark.createDataFrame(STYLE_USES, "key string, ord int, identifier string")
    found = modules.used_variants(uses, spark.createDataFrame(STYLE_MAPS, "identifier string, sheets array<string>"))
    return found.select("key", F.array_join("sheets", "").alias("sheets"))


CLASSES = [(k, f"_{k:08d}") for k in range(70)] + [(70, "plain"), (71, "_00000003"), (72, "_short")]


@query("""WITH f AS (SELECT k, chr(k::INTEGER) AS c FROM range(97, 123) r(k) UNION ALL SELECT k + 26, chr((k - 32)::INTEGER) FROM range(97, 123) r(k) UNION ALL SELECT 200, '_'),
l AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place FROM f),
n AS (SELECT c AS short, place FROM l UNION ALL SELECT c || 'a', 53 + place FROM l),
free AS (SELECT short, row_number() OVER (ORDER BY place) - 1 AS place FROM n),
names AS (SELECT lpad(k::VARCHAR, 8, '0') AS name, CASE WHEN k > 7 THEN k - 1 ELSE k END AS place, k FROM range(70) r(k))
SELECT name, CASE WHEN k = 7 THEN 'zz' ELSE short END AS short FROM names JOIN free USING (place)""")
def compressed_class_map(spark, sf_dir):
    old = spark.createDataFrame([("00000007", "zz")], "name string, short string")
    return modules.compression_map(spark.createDataFrame(CLASSES, "ord int, name string"), old)


# -- edits

NODES = [("d", 0, None, 0, "rule", None, []), ("d", 1, 0, 0, "decl", "color", ["a"]), ("d", 2, 0, 1, "decl", "top", ["a"]), ("d", 3, None, 1, "rule", None, []), ("d", 4, None, 2, "atrule", "media", []), ("d", 5, 4, 0, "decl", "left", ["@mediaprint"])]
NODE_KIND = "doc string, node_id int, parent_id int, ord int, kind string, name string, ancestors array<string>"
NODE_SQL = literal("doc, node_id, parent_id, ord, kind, name, ancestors", [(*r[:6], r[6] or None) for r in NODES])


@query(f"WITH n AS (SELECT * FROM {NODE_SQL}) SELECT node_id, kind FROM n x WHERE kind <> 'rule' OR EXISTS (SELECT 1 FROM n c WHERE c.parent_id = x.node_id)")
def rules_with_children(spark, sf_dir):
    return edits.without_childless(spark.createDataFrame(NODES, NODE_KIND), "doc").select("node_id", "kind")


@query(f"SELECT node_id FROM {NODE_SQL} WHERE kind = 'decl' AND len(list_filter(ancestors, lambda a: starts_with(a, '@media'))) > 0")
def declarations_in_media(spark, sf_dir):
    nodes = edits.of_kind(spark.createDataFrame(NODES, NODE_KIND), "decl")
    return nodes.where(edits.under_some(lambda a: a.startswith("@media"))).select("node_id")


@query("SELECT node_id, ord FROM " + literal("node_id, ord", [(1, 0), (9, 1), (2, 2), (10, 3)]))
def edited_siblings(spark, sf_dir):
    nodes = spark.createDataFrame(NODES, NODE_KIND).where("parent_id = 0")
    new = lambda i, at: spark.createDataFrame([("d", i, 0, at, "decl", "new", ["a"])], NODE_KIND)
    out = edits.inserted(nodes, new(9, 0), ["doc", "parent_id"])
    return edits.appended(out, new(10, 0), ["doc", "parent_id"]).select("node_id", "ord")


@query(f"SELECT node_id, (row_number() OVER (PARTITION BY parent_id ORDER BY ord) - 1)::INTEGER AS ord FROM {NODE_SQL} WHERE parent_id IS NOT NULL AND name <> 'color'")
def removed_siblings(spark, sf_dir):
    nodes = spark.createDataFrame(NODES, NODE_KIND).where("parent_id is not null")
    return edits.removed(nodes, F.col("name") == "color", ["doc", "parent_id"]).select("node_id", "ord")


# -- prefixes

MARKS = {"transform": ["-webkit-", "-ms-"], "user-select": ["-moz-"]}
TRANSITIONS = [("transform 1s, color 2s", "-webkit-transform 1s,-ms-transform 1s,transform 1s,color 2s"), ("all 1s", "all 1s")]


@query(f"SELECT value, variants FROM {literal('value, variants', TRANSITIONS)}")
def transition_variants(spark, sf_dir):
    show = text_udf(lambda v: prefixes.transition_variants(v, MARKS))
    return spark.createDataFrame([(v,) for v, _ in TRANSITIONS], "value string").select("value", show("value").alias("variants"))


CONDITIONS = [("(user-select:none) and (color:red)", "((-moz-user-select:none) or (user-select:none)) and (color:red)"), ("not (display:grid)", "not (display:grid)")]


@query(f"SELECT params, variants FROM {literal('params, variants', CONDITIONS)}")
def supports_variants(spark, sf_dir):
    show = text_udf(lambda v: prefixes.supports_variants(v, MARKS))
    return spark.createDataFrame([(v,) for v, _ in CONDITIONS], "params string").select("params", show("params").alias("variants"))


SIZES = [(1, "width", "fit-content"), (2, "width", "10px"), (3, "width", "calc(1px + fit-content)"), (4, "width", "my-fit-content")]


@query("SELECT id, clone, value FROM " + literal("id, clone, value", [(1, 0, "-moz-fit-content"), (1, 1, "fit-content"), (2, 1, "10px"), (3, 0, "calc(1px + -moz-fit-content)"), (3, 1, "calc(1px + fit-content)"), (4, 1, "my-fit-content")]))
def value_variants(spark, sf_dir):
    table = spark.createDataFrame([("fit-content", "-moz-")], "word string, mark string")
    return prefixes.value_variants(spark.createDataFrame(SIZES, "id int, prop string, value string"), table).select("id", "clone", "value")


CONTROLS = [("b", 0, "decl", "x"), ("b", 1, "comment", "autoprefixer: off"), ("b", 2, "decl", "y"), ("b", 3, "comment", "autoprefixer: on"), ("b", 4, "comment", "autoprefixer: ignore next"), ("b", 5, "decl", "z"), ("b", 6, "decl", "w")]


@query("SELECT ord, \"on\" FROM " + literal("ord, \"on\"", [(0, True), (2, False), (5, False), (6, True)]))
def prefix_control(spark, sf_dir):
    nodes = prefixes.controlled(spark.createDataFrame(CONTROLS, "block string, ord int, kind string, value string"), ["block"])
    return nodes.where("kind = 'decl'").select("ord", "on")


RUN = [(0, "-webkit-transform"), (1, "transform"), (2, "color"), (3, "-ms-transform"), (4, "transform")]


@query(f"""WITH b AS (SELECT ord, prop, regexp_replace(prop, '^-\\w+-', '') AS bare FROM {literal('ord, prop', RUN)}), l AS (SELECT *, lag(bare) OVER (ORDER BY ord) AS before FROM b)
SELECT ord, prop, sum(CASE WHEN bare = before THEN 0 ELSE 1 END) OVER (ORDER BY ord) AS run FROM l""")
def prefix_runs(spark, sf_dir):
    return prefixes.prefix_runs(spark.createDataFrame([("b", *r) for r in RUN], "block string, ord int, prop string"), ["block"]).select("ord", "prop", "run")


HEADS = [(1, ["@-webkit-keyframesx", "a"], "-webkit-"), (2, ["@media print", "b::-moz-placeholder"], "-moz-"), (3, ["a"], None)]


@query("SELECT id, mark FROM " + literal("id, heads, mark", HEADS))
def parent_prefixes(spark, sf_dir):
    return spark.createDataFrame([r[:2] for r in HEADS], "id int, heads array<string>").select("id", prefixes.parent_prefix(F.col("heads")).alias("mark"))


# -- support data

DATA = """{"agents": {"chrome": {"prefix": "webkit", "version_list": [{"version": "99", "global_usage": 1.5, "release_date": 10}, {"version": "100", "global_usage": 2.5, "release_date": null}]}},
"data": {"grid": {"title": "Grid", "stats": {"chrome": {"99": "y", "100": "y #1"}}}}}"""


@query("SELECT browser, prefix, version, pos, share, released FROM " + literal("browser, prefix, version, pos, share, released", [("chrome", "-webkit-", "99", 0, 1.5, 10), ("chrome", "-webkit-", "100", 1, 2.5, None)]))
def support_agents(spark, sf_dir):
    return support_data.agents(spark.createDataFrame([(DATA,)], "json string"))


@query("SELECT feature, browser, version, flags FROM " + literal("feature, browser, version, flags", [("grid", "chrome", "99", "y"), ("grid", "chrome", "100", "y #1")]))
def support_entries(spark, sf_dir):
    return support_data.support(spark.createDataFrame([(DATA,)], "json string"))


# -- streams and metadata

STREAM = [(s,) for s, _ in SHEETS] + [(SHEETS[0][0],), (SHEETS[3][0],)]


@query("SELECT DISTINCT sheet, bucket FROM " + literal("sheet, bucket", SHEETS))
def inserted_sheets(spark, sf_dir):
    return streaming.inserted_once(spark.createDataFrame(STREAM, "sheet string"))


@query("SELECT module, style_rules FROM " + literal("module, style_rules", [("m", "._b{}|._a{}"), ("n", "._c{}")]))
def style_metadata(spark, sf_dir):
    df = spark.createDataFrame([("m", 1, "._a{}"), ("m", 0, "._b{}"), ("n", 0, "._c{}")], "module string, ord int, rule string")
    return texts.metadata(df, ["module"], "ord", "rule").select("module", F.array_join("style_rules", "|").alias("style_rules"))
