"""Stylesheet operators over literal inputs and over the pages table.

The literal rows go into Spark and, as VALUES, into the checking SQL. Where SQL can
compute the operator it does; for parsing and hashing it holds the expected values.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, folding, rewrites, selectors, values
from ..functions.text import js_number, parse_unit, short_names, space_list
from ..operators import browsers, expand, prefixes, rows
from ..plans import stylesheets
from ..sources import texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def quoted(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x) if isinstance(x, int) else f"{x!r}::DOUBLE"
    if isinstance(x, list):
        return "[" + ", ".join(map(quoted, x)) + "]" + ("::VARCHAR[]" if not x else "")
    return "'" + str(x).replace("'", "''") + "'"


def literal(names: str, data: list[tuple]) -> str:
    """(VALUES ...) t(names), for a FROM clause."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in data) + f") t({names})"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def text_udf(f):
    """A function of strings over string columns, in Arrow batches."""

    @F.arrow_udf("string")
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*(x.as_py() for x in row)) for row in zip(*columns, strict=True)], pa.string())

    return run


# -- pages: the whole way

# The classes of p{margin:0}.
PAGE_RULES = [("_clfdidpf", "._clfdidpf p{margin-top:0}"), ("_11pqidpf", "._11pqidpf p{margin-right:0}"), ("_q0a5idpf", "._q0a5idpf p{margin-bottom:0}"), ("_c3k8idpf", "._c3k8idpf p{margin-left:0}")]
STYLE_SQL = "(SELECT page_id, regexp_extract(html, '(?is)<style[^>]*>(.*?)</style>', 1) AS css FROM pages WHERE html LIKE '%<style%')"


def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.style_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id", "css")


@query(f"SELECT page_id, class_name, sheet FROM {STYLE_SQL} p JOIN {literal('class_name, sheet', PAGE_RULES)} ON p.css = 'p{{margin:0}}'")
def page_atomic_rules(spark, sf_dir):
    """Style blocks of pages as atomic rules: page_id, class name and sheet of each. A block that
    many pages share is transformed once."""
    blocks = page_styles(spark, sf_dir)
    done = stylesheets.transform_css(blocks.select("css").distinct())
    out = done.select("css", F.explode(F.arrays_zip("class_names", "sheets")).alias("x"))
    return blocks.join(out, "css").select("page_id", F.col("x.class_names").alias("class_name"), F.col("x.sheets").alias("sheet"))


@query(f"SELECT page_id, 0::BIGINT AS ord, 'p' AS selector, 'margin' AS prop, '0' AS value, false AS important FROM {STYLE_SQL} WHERE css = 'p{{margin:0}}'")
def page_declarations(spark, sf_dir):
    found = stylesheets.declarations_of(page_styles(spark, sf_dir), "page_id")
    return found.select("page_id", "ord", F.array_join("selectors", ", ").alias("selector"), "prop", "value", "important")


@query(f"""SELECT page_id, k AS node_id, kind, name, depth FROM {STYLE_SQL} p
JOIN (VALUES (0, 'rule', NULL, 0), (1, 'decl', 'margin', 1)) n(k, kind, name, depth) ON p.css = 'p{{margin:0}}'""")
def page_nodes(spark, sf_dir):
    return stylesheets.nodes_of(page_styles(spark, sf_dir), "page_id").select("page_id", "node_id", "kind", "name", "depth")


# -- class names

NAMES = [
    (None, "&", "color", "red", False, "_syaz5scu"), (None, "&", "font-size", "15px", False, "_1wybo7ao"), (None, "&", "background-color", "pink", False, "_bfhk32ev"),
    (None, "&", "border", "3px solid pink", False, "_19ith012"), (None, "& div span", "color", "blue", False, "_8gsp13q2"), (None, "&&", "display", "block", False, "_if291ule"),
    ("media(min-width: 30rem)", "&", "user-select", "none", False, "_ufx4glyw"), ("media(min-width: 30rem)", "& div", "user-select", "none", False, "_195xglyw"),
    ("media(min-width: 30rem)media(min-width: 20rem)", "&", "user-select", "none", False, "_uf5eglyw"),
]


@query(f"SELECT prop, value, class_name FROM {literal('at_rules, selector, prop, value, important, class_name', NAMES)}")
def atomic_class_names(spark, sf_dir):
    df = spark.createDataFrame([r[:5] for r in NAMES], "at_rules string, selector string, prop string, value string, important boolean")
    return df.select("prop", "value", columns.class_name(F.col("at_rules"), F.col("selector"), F.col("prop"), F.col("value"), F.col("important")).alias("class_name"))


SHORT = ["a", "b", "c", "Z", "_", "aa", "ba", "ea", "ga"]


@query(f"SELECT name, place FROM {literal('name, place', [(n, k) for n, k in zip(SHORT, (0, 1, 2, 51, 52, 53, 54, 57, 59), strict=True)])}")
def short_class_names(spark, sf_dir):
    names = short_names()
    every = [next(names) for _ in range(60)]
    return spark.createDataFrame([(n, every.index(n)) for n in SHORT], "name string, place int")


# -- native columns

KEBAB = [("backgroundColor",), ("WebkitLineClamp",), ("ÀéÎ",), ("margin",), ("fontSizeÖ",)]


@query(f"SELECT x, lower(regexp_replace(x, '([A-ZÀ-ÖØ-Þ])', '-\\1', 'g')) AS y FROM {literal('x', KEBAB)}")
def kebab_cased(spark, sf_dir):
    return spark.createDataFrame(KEBAB, "x string").select("x", columns.kebab_case(F.col("x")).alias("y"))


VENDOR = [("-webkit-user-select",), ("user-select",), ("-moz-appearance",), ("--custom",)]


@query(f"SELECT x, regexp_replace(x, '^-\\w+-', '') AS bare, regexp_extract(x, '^(-\\w+-)', 1) AS mark FROM {literal('x', VENDOR)}")
def vendor_marks(spark, sf_dir):
    return spark.createDataFrame(VENDOR, "x string").select("x", columns.unprefixed(F.col("x")).alias("bare"), columns.vendor_prefix(F.col("x")).alias("mark"))


COLORS = [("currentcolor",), ("CURRENT-COLOR",), ("red",), ("currentColor",)]


@query(f"SELECT x, CASE WHEN lower(x) IN ('currentcolor', 'current-color') THEN 'currentColor' ELSE x END AS y FROM {literal('x', COLORS)}")
def current_colors(spark, sf_dir):
    return spark.createDataFrame(COLORS, "x string").select("x", columns.current_color(F.col("x")).alias("y"))


EMPTY = [(1, "red"), (2, ""), (3, "  \t"), (4, "undefined"), (5, "null"), (6, "nullish")]


@query(f"SELECT id, value FROM {literal('id, value', EMPTY)} WHERE value NOT IN ('undefined', 'null') AND NOT regexp_full_match(value, '\\s*')")
def declarations_with_values(spark, sf_dir):
    return rows.without_empty(spark.createDataFrame(EMPTY, "id int, value string"))


AT_RULES = [(n,) for n in ("media", "supports", "font-face", "keyframes", "import", "charset", "layer", "tailwind", "page", "container")]


@query(f"""SELECT name, CASE WHEN name IN ('container','-moz-document','else','layer','media','starting-style','supports','when') THEN 'atomic'
  WHEN name IN ('color-profile','counter-style','font-face','font-palette-values','keyframes','page','property') THEN 'whole'
  WHEN name IN ('charset','import','namespace') THEN 'forbidden' ELSE 'unknown' END AS kind FROM {literal('name', AT_RULES)}""")
def at_rule_gate(spark, sf_dir):
    return spark.createDataFrame(AT_RULES, "name string").select("name", rows.gate_kind(F.col("name")).alias("kind"))


UNITED = [("width", 10.0, "10"), ("lineHeight", 2.0, "2"), ("width", 0.0, "0"), ("--x", 3.0, "3"), ("color", None, " red "), ("zIndex", 5.0, "5"), ("top", None, None)]


@query(f"""SELECT prop, CASE WHEN txt IS NULL THEN '' WHEN num IS NOT NULL AND num <> 0 AND prop NOT IN ('lineHeight', 'zIndex') AND NOT starts_with(prop, '--')
  THEN txt || 'px' ELSE trim(txt) END AS value FROM {literal('prop, num, txt', UNITED)}""")
def values_with_units(spark, sf_dir):
    df = spark.createDataFrame(UNITED, "prop string, num double, txt string")
    return df.select("prop", columns.with_unit(F.col("prop"), F.col("num"), F.col("txt")).alias("value"))


AFFIX = [("a: -", "px;"), ('a: "', '"'), ("a: ", "em solid"), ("a: ", "")]


@query(f"SELECT pre, regexp_extract(pre, '([\"''-])$', 1) AS prefix, CASE post WHEN 'px;' THEN 'px' WHEN '\"' THEN '\"' WHEN 'em solid' THEN 'em' ELSE '' END AS suffix FROM {literal('pre, post', AFFIX)}")
def interpolation_affixes(spark, sf_dir):
    df = spark.createDataFrame(AFFIX, "pre string, post string")
    return df.select("pre", columns.variable_prefix(F.col("pre")).alias("prefix"), columns.variable_suffix(F.col("post")).alias("suffix"))


CONTENT = [("hello",), ("'x'",), ("url(a.png)",), ("open-quote",), ("none",), ("",), ("attr(x) y",), ("no-open-quote",)]


@query(f"""SELECT x, CASE WHEN x = '' THEN '""' WHEN contains(x, '"') OR contains(x, '''') OR regexp_matches(x, '^([A-Za-z\\-]+\\(.*|.*-quote|inherit|initial|none|normal|revert|unset)(\\s|$)', 's')
  THEN x ELSE '"' || x || '"' END AS y FROM {literal('x', CONTENT)}""")
def content_values(spark, sf_dir):
    return spark.createDataFrame(CONTENT, "x string").select("x", columns.content_value(F.col("x")).alias("y"))


VARIABLES = [(1, "10", "px", None), (2, "10", "px", "-"), (3, "10", None, "-"), (4, None, "px", None)]


@query(f"SELECT id, CASE WHEN v IS NULL THEN 'var(--c-, )' WHEN s IS NOT NULL AND s <> '' THEN coalesce(p, '') || v || s ELSE v END AS value FROM {literal('id, v, s, p', VARIABLES)}")
def variable_values(spark, sf_dir):
    df = spark.createDataFrame(VARIABLES, "id int, v string, s string, p string")
    return df.select("id", columns.variable_value(F.col("v"), F.col("s"), F.col("p")).alias("value"))


MARGINS = [(1, "1px"), (2, "1px 2px"), (3, "1px 2px 3px"), (4, "1px 2px 3px 4px"), (5, " auto  0 ")]


@query(f"""WITH s AS (SELECT id, regexp_split_to_array(trim(v), '\\s+') AS p FROM {literal('id, v', MARGINS)}),
w AS (SELECT id, p[1] AS a, coalesce(p[2], p[1]) AS b, coalesce(p[3], p[1]) AS c, coalesce(p[4], p[2], p[1]) AS d FROM s)
SELECT id, 'margin-top' AS prop, a AS value FROM w UNION ALL SELECT id, 'margin-right', b FROM w
UNION ALL SELECT id, 'margin-bottom', c FROM w UNION ALL SELECT id, 'margin-left', d FROM w""")
def margin_longhands(spark, sf_dir):
    df = spark.createDataFrame(MARGINS, "id int, v string")
    props = F.array(*(F.lit(f"margin-{s}") for s in expand.SIDES))
    return df.select("id", F.explode(F.arrays_zip(props.alias("prop"), columns.box_sides(F.col("v")).alias("value"))).alias("x")).select("id", "x.prop", "x.value")


MEDIA = [("(min-width: 30rem)",), ("screen and (max-width: 400px) and (min-width: 10em)",), ("(width >= 500px)",), ("print",)]


@query(f"""SELECT q, array_to_string(regexp_extract_all(q, '((?:min|max)-width):\\s*(-?\\d*\\.?\\d+)(ch|em|ex|px|rem)', 0), '|') AS sizes FROM {literal('q', MEDIA)}""")
def media_sizes(spark, sf_dir):
    found = F.regexp_extract_all("q", F.lit(r"((?:min|max)-width):\s*(-?\d*\.?\d+)(ch|em|ex|px|rem)"), F.lit(0))
    return spark.createDataFrame(MEDIA, "q string").select("q", F.array_join(found, "|").alias("sizes"))


PSEUDO = [("a:hover",), ("a:focus-within ",), ("a",), ("b:active",), ("a:link",), ("a:focus-visible",), ("x:focus",), ("y:visited",)]


@query(f"""SELECT s, CASE WHEN trim(s) LIKE '%:link' THEN 1 WHEN trim(s) LIKE '%:visited' THEN 2 WHEN trim(s) LIKE '%:focus-within' THEN 3 WHEN trim(s) LIKE '%:focus' THEN 4
  WHEN trim(s) LIKE '%:focus-visible' THEN 5 WHEN trim(s) LIKE '%:hover' THEN 6 WHEN trim(s) LIKE '%:active' THEN 7 ELSE 0 END AS place FROM {literal('s', PSEUDO)}""")
def pseudo_places(spark, sf_dir):
    return spark.createDataFrame(PSEUDO, "s string").select("s", columns.pseudo_rank(F.col("s")).alias("place"))


SHEETS = [("._aaaabbbb{color:red}", ""), ("@media print{._aaaabbbb{color:red}}", "m"), ("._aaaabbbb:hover{color:red}", "h"), ("._aaaabbbb:focus-visible{color:red}", "i"), ("._aaaabbbb{margin:0}", "s-1"), ("._aaaabbbb{border-top:0}", "s-4"), ("._aaaabbbb{all:unset}", "s-0")]


@query(f"SELECT sheet, bucket FROM {literal('sheet, bucket', SHEETS)}")
def style_buckets(spark, sf_dir):
    return spark.createDataFrame([(s,) for s, _ in SHEETS], "sheet string").select("sheet", columns.bucket(F.col("sheet")).alias("bucket"))


COMPRESS = [("_aaaabbbb", "a"), ("_aaaacccc", None), ("plain", None)]


@query(f"SELECT name, coalesce(substr(name, 1, 5) || '_' || short, name) AS shown FROM {literal('name, short', COMPRESS)}")
def compressed_names(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n, _ in COMPRESS], "name string")
    short = spark.createDataFrame([(n[1:], s) for n, s in COMPRESS if s], "bare string, short string")
    joined = names.join(F.broadcast(short), F.substr("name", F.lit(2)) == F.col("bare"), "left")
    return joined.select("name", columns.compressed(F.col("name"), F.col("short")).alias("shown"))


CLASSES = [(1, 0, "_aaaabbbb"), (1, 1, "x"), (1, 2, "_ccccdddd"), (1, 3, "_aaaaeeee"), (2, 0, "y"), (2, 1, "y"), (3, 0, "_aaaa_k")]


@query(f"""WITH g AS (SELECT id, CASE WHEN c LIKE '\\_%' ESCAPE '\\' THEN substr(c, 1, 5) ELSE c END AS k, min(ord) AS pos, arg_max(c, ord) AS c FROM {literal('id, ord, c', CLASSES)} GROUP BY 1, 2)
SELECT id, string_agg(c, ' ' ORDER BY pos) AS classes FROM g GROUP BY id""")
def merged_classes(spark, sf_dir):
    return rows.merge_classes(spark.createDataFrame(CLASSES, "id int, ord int, c string"), ["id"], "ord", "c")


AT_CHILDREN = [(1, 0, "media", "print", ".a{}"), (1, 1, "media", "print", ".b{}"), (1, 2, "media", "print", ".a{}"), (1, 3, "media", "all", ".a{}"), (2, 0, "layer", "x", ".c{}")]


@query(f"""WITH o AS (SELECT id, name, params, child, min(ord) AS pos FROM {literal('id, ord, name, params, child', AT_CHILDREN)} GROUP BY ALL)
SELECT id, name, params, min(pos) AS ord, string_agg(child, '' ORDER BY pos) AS children FROM o GROUP BY id, name, params""")
def merged_at_rules(spark, sf_dir):
    df = spark.createDataFrame(AT_CHILDREN, "id int, ord int, name string, params string, child string")
    return rows.merge_at_rules(df, ["id"], "ord").select("id", "name", "params", "ord", F.array_join("children", "").alias("children"))


RENDERED = [(1, k, s) for k, (s, _) in enumerate(SHEETS)] + [(1, 20, SHEETS[0][0]), (2, 0, SHEETS[2][0]), (2, 1, "._ccccdddd:hover{top:0}")]
RENDERED_OUT = [(1, b, s) for s, b in SHEETS] + [(2, "h", SHEETS[2][0] + "._ccccdddd:hover{top:0}")]


@query(f"SELECT id, bucket, css FROM {literal('id, bucket, css', RENDERED_OUT)}")
def rendered_buckets(spark, sf_dir):
    return rows.bucketed(spark.createDataFrame(RENDERED, "id int, ord int, sheet string"), ["id"], "ord", "sheet").select("id", "bucket", "css")


RULES_OF = [("a.js", "._b{}"), ("a.js", "._a{color:red}"), ("b.js", "@media x{}")]


@query(f"SELECT module, string_agg(rule, chr(10) ORDER BY rule) AS css FROM {literal('module, rule', RULES_OF)} GROUP BY module")
def extracted_sheets(spark, sf_dir):
    return texts.extracted(spark.createDataFrame(RULES_OF, "module string, rule string"), ["module"], "rule")


@query(f"SELECT module, 'require(\"compiled.css?style=' || url_encode(rule) || '\")' AS request FROM {literal('module, rule', RULES_OF)}")
def require_requests(spark, sf_dir):
    return texts.require_queries(spark.createDataFrame(RULES_OF, "module string, rule string"), "rule").select("module", "request")


# -- folding

NUMBERS = [(1, 7.0, 2.0), (2, -7.5, 2.0), (3, 4294967297.0, 3.0), (4, 0.0, 5.0), (5, 2.5, -3.0)]


@query(f"""SELECT id, a + b AS plus, a - b AS minus, a * b AS times, a / b AS over, a - b * trunc(a / b) AS rest, pow(a, b) AS power,
  floor(a + 0.5) AS rounded, trunc(a) AS cut, a < b AS below, CASE WHEN a <> 0 THEN a ELSE b END AS either, CASE WHEN a <> 0 THEN b ELSE a END AS both
FROM {literal('id, a, b', NUMBERS)}""")
def folded_numbers(spark, sf_dir):
    df = spark.createDataFrame(NUMBERS, "id int, a double, b double")
    a, b = F.col("a"), F.col("b")
    op = folding.ARITHMETIC
    names = zip(["plus", "minus", "times", "over", "rest", "power"], ["+", "-", "*", "/", "%", "**"], strict=True)
    more = [folding.MATH["round"](a).alias("rounded"), folding.MATH["trunc"](a).alias("cut"), folding.COMPARISON["<"](a, b).alias("below"), folding.LOGICAL["||"](a, b).alias("either"), folding.LOGICAL["&&"](a, b).alias("both")]
    return df.select("id", *(op[o](a, b).alias(n) for n, o in names), *more)


BITS = [(1, 5.0, 3.0, 7, 1, 6, 40, 0, 0), (2, -1.0, 1.0, -1, 1, -2, -2, -1, 2147483647), (3, 4294967297.0, 2.0, 3, 0, 3, 4, 0, 0)]


@query(f"SELECT id, o, n, x, l, r, u::BIGINT AS u FROM {literal('id, a, b, o, n, x, l, r, u', BITS)}")
def folded_bits(spark, sf_dir):
    df = spark.createDataFrame([r[:3] for r in BITS], "id int, a double, b double")
    return df.select("id", *(f(F.col("a"), F.col("b")).alias(n) for n, f in zip("onxlru", folding.BITWISE.values(), strict=True)))


PARSED = [("12px",), (" 3.5e2x",), ("-.5",), ("0",), ("1e3",)]


@query(f"SELECT x, regexp_extract(x, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1)::DOUBLE AS y, CASE WHEN x = '-.5' THEN NULL ELSE regexp_extract(x, '^\\s*([+-]?\\d+)', 1)::DOUBLE END AS z FROM {literal('x', PARSED)}")
def parsed_numbers(spark, sf_dir):
    df = spark.createDataFrame(PARSED, "x string")
    whole = folding.parse_int(F.col("x"))
    return df.select("x", folding.parse_float(F.col("x")).alias("y"), F.when(~F.isnan(whole), whole).alias("z"))


PRINTED = [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (123456789.5, "123456789.5"), (-0.000001, "-0.000001"), (1e20, "100000000000000000000")]


@query(f"SELECT x, y FROM {literal('x, y', PRINTED)}")
def printed_numbers(spark, sf_dir):
    @F.arrow_udf("string")
    def show(x: pa.Array) -> pa.Array:
        return pa.array([js_number(v) for v in x.to_pylist()], pa.string())

    return spark.createDataFrame([(x,) for x, _ in PRINTED], "x double").select("x", show("x").alias("y"))


# -- browsers

CONFIG = [("a", "last 2 versions # recent\n> 1%, not dead"), ("b", "# none\nie 11\n[modern]\nchrome 100, firefox 99\n")]
CONFIG_OUT = [("a", "defaults", "last 2 versions"), ("a", "defaults", "> 1%"), ("a", "defaults", "not dead"), ("b", "defaults", "ie 11"), ("b", "modern", "chrome 100"), ("b", "modern", "firefox 99")]


@query(f"SELECT id, section, query FROM {literal('id, section, query', CONFIG_OUT)}")
def config_queries(spark, sf_dir):
    df = spark.createDataFrame(CONFIG, "id string, txt string")
    return df.select("id", F.explode(texts.config_queries(F.col("txt"))).alias("x")).select("id", "x.section", "x.query")


PACKAGES = [(1, '{"browserslist": ["ie 11", "chrome 50"]}', "ie 11|chrome 50"), (2, '{"browserslist": {"production": ["> 1%"]}}', "> 1%"), (3, '{"browserslist": "last 1 version"}', "last 1 version"), (4, '{"name": "x"}', "")]


@query(f"SELECT id, queries FROM {literal('id, txt, queries', PACKAGES)}")
def package_queries(spark, sf_dir):
    df = spark.createDataFrame([(i, t) for i, t, _ in PACKAGES], "id int, txt string")
    return df.select("id", F.coalesce(F.array_join(texts.package_queries(F.col("txt")), "|"), F.lit("")).alias("queries"))


AGENTS = [("chrome", "99", 0, 1), ("chrome", "100", 1, 2), ("chrome", "101", 2, None), ("ios_saf", "12.0-12.1", 0, 1), ("ios_saf", "12.2-12.5", 1, 2), ("firefox", "115", 0, 1), ("firefox", "128", 1, 2), ("firefox", "129", 2, 3)]
AGENT_KIND = "browser string, version string, pos int, released int"
AGENT_SQL = literal("browser, version, pos, released", AGENTS)


@query(f"SELECT browser, version FROM (SELECT *, row_number() OVER (PARTITION BY browser ORDER BY pos DESC) AS k FROM {AGENT_SQL} WHERE released IS NOT NULL) WHERE k <= 2")
def last_two_versions(spark, sf_dir):
    return browsers.last_versions(spark.createDataFrame(AGENTS, AGENT_KIND), 2)


WANTED = [("ios_saf", "12.3"), ("ios_saf", "12.1"), ("chrome", "100"), ("chrome", "5")]


@query(f"""SELECT w.browser, want, min_by(version, pos) AS version FROM {AGENT_SQL.replace('t(', 'a(')} JOIN {literal('browser, want', WANTED).replace('t(', 'w(')} ON a.browser = w.browser AND
  (version = want OR want::DOUBLE BETWEEN split_part(version, '-', 1)::DOUBLE AND string_split(version, '-')[-1]::DOUBLE) GROUP BY w.browser, want""")
def version_ranges(spark, sf_dir):
    return browsers.version_lookup(spark.createDataFrame(AGENTS, AGENT_KIND), spark.createDataFrame(WANTED, "browser string, want string"))


@query(f"SELECT browser, version FROM {literal('browser, version', [('chrome', '100'), ('firefox', '129'), ('firefox', '128'), ('firefox', '115'), ('ios_saf', '12.2-12.5')])}")
def browser_query(spark, sf_dir):
    return browsers.selected(spark, spark.createDataFrame(AGENTS, AGENT_KIND), "last 2 versions, firefox esr, not ios 12.0, not chrome 99").select("browser", "version")


SUPPORT = [("grid", "chrome", "57", "y"), ("grid", "chrome", "29", "n d #1"), ("grid", "chrome", "100", "y"), ("grid", "ie", "10-11", "a x #2"), ("flex", "chrome", "100", "y"), ("flex", "firefox", "128", "y"), ("has", "chrome", "100", "n"), ("has", "firefox", "128", "y")]
SUPPORT_SQL = literal("feature, browser, version, flags", SUPPORT)


@query(f"""WITH r AS (SELECT feature, browser, regexp_extract(split_part(version, '-', 1), '^(\\d*\\.?\\d+)', 1)::DOUBLE AS v, unnest(string_split(flags, ' ')) AS flag FROM {SUPPORT_SQL})
SELECT feature, browser, regexp_replace(flag, '^#', '') AS flag, CASE WHEN regexp_replace(flag, '^#', '') = 'y' THEN min(v) ELSE max(v) END AS version FROM r WHERE flag <> 'd' GROUP BY 1, 2, 3""")
def support_by_flag(spark, sf_dir):
    return browsers.support_by_flag(spark.createDataFrame(SUPPORT, "feature string, browser string, version string, flags string"))


SELECTED = [("chrome", "100"), ("firefox", "128")]


@query(f"""SELECT f.feature, f.feature IN (SELECT feature FROM {SUPPORT_SQL}) AND bool_and(coalesce(starts_with(s.flags, 'y'), false)) AS supported
FROM {literal('feature', [('grid',), ('flex',), ('has',), ('nothing',)]).replace('t(', 'f(')} CROSS JOIN {literal('browser, version', SELECTED).replace('t(', 'b(')}
LEFT JOIN {SUPPORT_SQL.replace('t(', 's(')} ON s.feature = f.feature AND s.browser = b.browser AND s.version = b.version GROUP BY f.feature""")
def supported_features(spark, sf_dir):
    support = spark.createDataFrame(SUPPORT, "feature string, browser string, version string, flags string")
    features = spark.createDataFrame([("grid",), ("flex",), ("has",), ("nothing",)], "feature string")
    return browsers.is_supported(support, features, spark.createDataFrame(SELECTED, "browser string, version string"))


# -- prefixes

ENTRIES = [("user-select", "chrome", "50", "-webkit-", None), ("user-select", "firefox", "60", "-moz-", None), ("user-select", "ie", "11", "-ms-", None), ("appearance", "ie", "11", "-ms-", None), ("flex", "chrome", "50", "-webkit-", "2009"), ("flex", "firefox", "60", "-webkit-", None)]
CHOSEN = [("chrome", "50"), ("firefox", "60")]
PLAN = [("user-select", "-webkit-|-moz-", "-ms-"), ("appearance", "", "-ms-"), ("flex", "-webkit- 2009|-webkit-", "")]


def prefix_plan(spark: SparkSession) -> DataFrame:
    entries = spark.createDataFrame(ENTRIES, "name string, browser string, version string, prefix string, note string")
    return prefixes.plan(entries, spark.createDataFrame(CHOSEN, "browser string, version string"))


@query(f"SELECT name, added, removed FROM {literal('name, added, removed', PLAN)}")
def prefix_tables(spark, sf_dir):
    return prefix_plan(spark).select("name", F.array_join("add", "|").alias("added"), F.array_join("remove", "|").alias("removed"))


DECLS = [("d", 0, [], ["a"], "user-select", "none"), ("d", 1, [], ["a"], "-moz-user-select", "text"), ("d", 2, [], ["b"], "-ms-appearance", "none"), ("d", 3, [], ["b"], "color", "red")]
DECL_KIND = "doc_id string, ord int, at_rules array<string>, selectors array<string>, prop string, value string"
PREFIXED = [(0, 0, "-webkit-user-select"), (0, 2, "user-select"), (1, 0, "-moz-user-select"), (2, 0, "-ms-appearance"), (3, 0, "color")]


@query(f"SELECT ord, clone, prop FROM {literal('ord, clone, prop', PREFIXED)}")
def prefixed_declarations(spark, sf_dir):
    return prefixes.add_prefixes(spark.createDataFrame(DECLS, DECL_KIND), prefix_plan(spark)).select("ord", "clone", "prop")


@query(f"SELECT ord, prop FROM {literal('ord, prop', [(d[1], d[4]) for d in DECLS if d[4] != '-ms-appearance'])}")
def cleaned_declarations(spark, sf_dir):
    return prefixes.remove_prefixes(spark.createDataFrame(DECLS, DECL_KIND), prefix_plan(spark)).select("ord", "prop")


QUERY_2X = "(-webkit-min-device-pixel-ratio: 1.5)|(min--moz-device-pixel-ratio: 1.5)|(-o-min-device-pixel-ratio: 3/2)|(min-resolution: 144dpi)"


@query(f"SELECT q, variants FROM {literal('q, variants', [('(min-resolution: 144dpi)', QUERY_2X), ('(color)', '(color)')])}")
def resolution_variants(spark, sf_dir):
    show = text_udf(lambda q: "|".join(prefixes.resolution_variants(q)))
    return spark.createDataFrame([("(min-resolution: 144dpi)",), ("(color)",)], "q string").select("q", show("q").alias("variants"))


# -- parsing and rewriting, against expected values

SHORTHANDS = [
    ("margin", "0 auto", "margin-top:0;margin-right:auto;margin-bottom:0;margin-left:auto"), ("padding", "var(--x)", "padding:var(--x)"), ("overflow", "hidden", "overflow-x:hidden;overflow-y:hidden"),
    ("place-content", "left", ""), ("place-content", "center", "align-content:center;justify-content:center"), ("flex", "1", "flex-grow:1;flex-shrink:1;flex-basis:0%"), ("flex", "none", "flex-grow:0;flex-shrink:0;flex-basis:auto"),
    ("flex", "2 2 0", "flex-grow:2;flex-shrink:2;flex-basis:0%"), ("flex", "auto 1", ""), ("flex", "10em", "flex-grow:1;flex-shrink:1;flex-basis:10em"), ("flex-flow", "row wrap", "flex-direction:row;flex-wrap:wrap"),
    ("flex-flow", "wrap-reverse", ""), ("outline", "2px solid red", "outline-color:red;outline-style:solid;outline-width:2px"), ("outline", "solid dotted", ""),
    ("text-decoration", "underline overline red", "text-decoration-color:red;text-decoration-line:overline underline;text-decoration-style:solid"), ("text-decoration", "underline underline", ""),
    ("background", "red", "background-color:red"), ("background", "url(x.png) red", "background:url(x.png) red"), ("place-items", "start end", "align-items:start;justify-items:end"), ("color", "red", "color:red"),
]


@query(f"SELECT prop, value, longhands FROM {literal('prop, value, longhands', SHORTHANDS)}")
def expanded_shorthands(spark, sf_dir):
    show = text_udf(lambda p, v: ";".join(f"{a}:{b}" for a, b in expand.expanded(p, v)))
    return spark.createDataFrame([r[:2] for r in SHORTHANDS], "prop string, value string").select("prop", "value", show("prop", "value").alias("longhands"))


REWRITTEN = [
    ("discard-comments", "a", "/* x */red/*! keep */", "red/*! keep */"), ("minify-gradients", "background", "linear-gradient(to top, red, blue)", "linear-gradient(0deg,red,blue)"),
    ("reduce-initial", "min-width", "initial", "auto"), ("reduce-initial", "writing-mode", "initial", "initial"), ("colormin", "color", "#ff0000", "red"), ("colormin", "color", "rgb(0, 0, 0)", "#000"), ("colormin", "color", "hsl(0, 100%, 50%)", "red"), ("colormin", "color", "transparent", "#0000"),
    ("timing-functions", "transition", "all 1s cubic-bezier(0.42, 0, 1, 1)", "all 1s ease-in"), ("timing-functions", "animation-timing-function", "steps(1, start)", "step-start"), ("timing-functions", "animation-timing-function", "steps(4, end)", "steps(4)"),
    ("calc", "width", "calc(1px + 2px)", "3px"), ("calc", "width", "calc(100% - (10px + 5px))", "calc(100% - 15px)"), ("calc", "width", "calc(2 * 3em / 4)", "1.5em"), ("convert-values", "margin", "0.5px 0px 10.00em", ".5px 0 10em"), ("convert-values", "transition", "all 500ms", "all .5s"),
    ("convert-values", "width", "96px", "1in"), ("convert-values", "opacity", "1.5", "1"), ("convert-values", "flex", "0px", "0px"), ("convert-values", "width", "calc(0px + 1em)", "calc(0px + 1em)"), ("ordered-values", "border", "red solid 1px", "1px solid red"), ("ordered-values", "flex-flow", "wrap row", "row wrap"),
    ("ordered-values", "transition", "opacity ease 1s", "opacity 1s ease"), ("ordered-values", "border", "var(--x) solid", "var(--x) solid"), ("normalize-string", "content", "'a'", '"a"'), ("normalize-string", "content", "'\"'", "'\"'"), ("normalize-unicode", "unicode-range", "U+0025-00FF, u+4??", "u+0025-00ff,u+4??"), ("normalize-unicode", "unicode-range", "U+0400-04FF", "u+4??"),
    ("normalize-url", "background", "url('./a/../b.png')", "url(b.png)"), ("normalize-url", "background", "url(http://EXAMPLE.com:80/a/./b)", "url(http://example.com/a/b)"), ("normalize-url", "background", "url(data:image/png;base64,AA)", "url(data:image/png;base64,AA)"), ("normalize-positions", "background-position", "left top", "0 0"), ("normalize-positions", "background-position", "center", "50%"), ("normalize-positions", "object-position", "bottom right", "100% 100%"),
]


@query(f"SELECT step, prop, value, rewritten FROM {literal('step, prop, value, rewritten', REWRITTEN)}")
def rewritten_values(spark, sf_dir):
    steps = dict(rewrites.MINIFY)
    show = text_udf(lambda s, p, v: steps[s](p, v))
    return spark.createDataFrame([r[:3] for r in REWRITTEN], "step string, prop string, value string").select("*", show("step", "prop", "value").alias("rewritten"))


MINIFIED = [("a > b , b", "a>b,b"), ("b, a, a", "a,b"), ("p::before", "p:before"), ("li:nth-child(1)", "li:first-child"), ("a[href = \"x\"]", "a[href=x]"), ("*.a", ".a"), (":is(a , b) c", ":is(a,b) c")]


@query(f"SELECT s, minified FROM {literal('s, minified', MINIFIED)}")
def minified_selectors(spark, sf_dir):
    from ..functions.text import comma_list

    show = text_udf(lambda s: ",".join(selectors.minify_selectors(comma_list(s))))
    return spark.createDataFrame([(s,) for s, _ in MINIFIED], "s string").select("s", show("s").alias("minified"))


PARAMS = [("media", "screen  and ( min-width : 10px ) , print", "print,screen and (min-width:10px)"), ("media", "all and (color)", "(color)"), ("media", "(min-aspect-ratio: 16 / 8)", "(min-aspect-ratio:2/1)"), ("layer", "a,  b", "a,  b"), ("supports", "( display : grid )", "(display:grid)")]


@query(f"SELECT name, params, minified FROM {literal('name, params, minified', PARAMS)}")
def minified_params(spark, sf_dir):
    show = text_udf(selectors.minify_params)
    return spark.createDataFrame([r[:2] for r in PARAMS], "name string, params string").select("*", show("name", "params").alias("minified"))


SELECTORS = [(":hover", "&:hover"), (":hover:focus", "&:hover&:focus"), ("a:hover", "a:hover")]


@query(f"SELECT s, y FROM {literal('s, y', SELECTORS)}")
def parented_pseudos(spark, sf_dir):
    show = text_udf(selectors.with_parents)
    return spark.createDataFrame([(s,) for s, _ in SELECTORS], "s string").select("s", show("s").alias("y"))


SPECIFIC = [("._aaaabbbb", "._aaaabbbb:not(#\\#)"), ("._aaaabbbb:hover .x", "._aaaabbbb:not(#\\#):hover .x:not(#\\#)"), (".x", ".x")]


@query(f"SELECT s, y FROM {literal('s, y', SPECIFIC)}")
def raised_specificity(spark, sf_dir):
    show = text_udf(selectors.more_specific)
    return spark.createDataFrame([(s,) for s, _ in SPECIFIC], "s string").select("s", show("s").alias("y"))


NESTED = [
    ("a{color:red;b{top:0}}", "a|color|;a b|top|"), ("a,b{&:hover,c{top:0}}", "a:hover,a c,b:hover,b c|top|"), ("a{@media print{top:0;b{left:0}}}", "a|top|mediaprint;a b|left|mediaprint"),
    ("a{x:1;b{y:2}z:3}", "a|x|;a b|y|;a|z|"),
]


@query(f"SELECT css, decls FROM {literal('css, decls', NESTED)}")
def flattened_rules(spark, sf_dir):
    found = stylesheets.declarations_of(spark.createDataFrame([(c, c) for c, _ in NESTED], "doc string, css string"), "doc")
    line = F.concat_ws("|", F.array_join("selectors", ","), "prop", F.array_join(F.transform("at_rules", lambda a: F.concat(a["name"], a.params)), ""))
    own = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x.t)
    return found.groupBy(F.col("doc").alias("css")).agg(F.array_join(own, ";").alias("decls"))


SORTED = [
    ("@media (max-width:300px){.a{top:0}} .b:hover{top:0} .b{top:0}", ".b{top:0}.b:hover{top:0}@media (max-width:300px){.a{top:0}}"),
    (".a{margin-top:0} .b{margin:0}", ".b{margin:0}.a{margin-top:0}"),
    ("@media (min-width:500px){.a{top:0}} @media (min-width:300px){.a{top:0}}", "@media (min-width:300px){.a{top:0}}@media (min-width:500px){.a{top:0}}"),
    ("@media print{.a{top:0}} @media print{.b{top:0}} @media print{.a{top:0}}", "@media print{.b{top:0}.a{top:0}}"),
    (".a:active{top:0} .a:link{top:0} .a:hover{top:0}", ".a:link{top:0}.a:hover{top:0}.a:active{top:0}"),
]


@query(f"SELECT css, sorted FROM {literal('css, sorted', SORTED)}")
def sorted_sheets(spark, sf_dir):
    return stylesheets.sort_css(spark.createDataFrame([(c,) for c, _ in SORTED], "css string"))


UNITS = [("12px", "12", "px"), ("-1.5e3em", "-1.5e3", "em"), (".5", ".5", ""), ("px", None, None)]


@query(f"SELECT x, number, unit FROM {literal('x, number, unit', UNITS)}")
def parsed_units(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x, *_ in UNITS], "x string")
    number = text_udf(lambda x: (parse_unit(x) or (None, None))[0])
    unit = text_udf(lambda x: (parse_unit(x) or (None, None))[1])
    return df.select("x", number("x").alias("number"), unit("x").alias("unit"))


VALUES = [("a(b, c) d", "function:a word:b div:, word:c space:  word:d"), ("1px/2px", "word:1px div:/ word:2px"), ("\"x\" url(a.png)", "string:x space:  function:url word:a.png")]


@query(f"SELECT x, parts FROM {literal('x, parts', VALUES)}")
def value_parts(spark, sf_dir):
    show = text_udf(lambda x: " ".join(f"{kind}:{value}" for _, _, kind, value in values.rows(x)))
    return spark.createDataFrame([(x,) for x, _ in VALUES], "x string").select("x", show("x").alias("parts"))


LISTS = [("a (b c) 'd e' f", "a|(b c)|'d e'|f"), ("x", "x")]


@query(f"SELECT x, parts FROM {literal('x, parts', LISTS)}")
def split_lists(spark, sf_dir):
    show = text_udf(lambda x: "|".join(space_list(x)))
    return spark.createDataFrame([(x,) for x, _ in LISTS], "x string").select("x", show("x").alias("parts"))


FORBIDDEN = [("@import 'x';", "At-rule '@import' cannot be used in CSS rules."), ("@foo{a{top:0}}", "Unknown at-rule '@foo'."), ("a{top:0", "Unclosed block at 0")]


@query(f"SELECT css, error FROM {literal('css, error', FORBIDDEN)}")
def rejected_styles(spark, sf_dir):
    return stylesheets.transform_css(spark.createDataFrame([(c,) for c, _ in FORBIDDEN], "css string")).select("css", "error")


