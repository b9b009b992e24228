"""Where stylesheets and their configuration come from, and where they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STYLE = r"(?is)<style[^>]*>(.*?)</style>"


def css_files(spark: SparkSession, path: str) -> DataFrame:
    """path, css: one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("css"))


def style_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `block` (from 0) and `css` for each style element."""
    return pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(STYLE))).alias("block", "css"))


def config_queries(text: Column) -> Column:
    """section and query of each line of a browser configuration, as an array: sections are in
    brackets, comments after `#`, queries between commas; lines before a section are `defaults`."""
    lines = F.filter(F.transform(F.split(text, r"\n|,"), lambda x: F.btrim(F.regexp_replace(x, "#.*", ""))), lambda x: x != "")
    start = F.struct(F.lit("defaults").alias("section"), F.array().cast("array<struct<section:string,query:string>>").alias("rows"))

    def add(state: Column, line: Column) -> Column:
        head = F.regexp_extract(line, r"^\[(.*)\]$", 1)
        row = F.array(F.struct(state.section.alias("section"), line.alias("query")))
        return F.when(head != "", F.struct(F.btrim(head).alias("section"), state.rows.alias("rows"))).otherwise(F.struct(state.section.alias("section"), F.concat(state.rows, row).alias("rows")))

    return F.aggregate(lines, start, add, lambda state: state.rows)


def package_queries(text: Column) -> Column:
    """The `browserslist` of a package.json: a list of queries, or those of its production section."""
    whole = F.from_json(text, "browserslist array<string>").browserslist
    named = F.from_json(text, "browserslist struct<production:array<string>,defaults:array<string>>").browserslist
    single = F.array(F.get_json_object(text, "$.browserslist"))
    text_like = ~F.get_json_object(text, "$.browserslist").rlike(r"^[\[{]")
    return F.when(text_like, single).otherwise(F.coalesce(named.production, named.defaults, whole))


def joined_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(path, ...) with the text of the file at its resolved path."""
    return imports.join(files, "path", "left")


def write_sheets(sheets: DataFrame, path: str, by: list[str] = [], sheet: str = "sheet") -> None:  # noqa: B006
    """Sheets as text files, in folders by the columns `by`."""
    sheets.select(F.col(sheet).alias("value"), *by).write.partitionBy(*by).text(path)


def extracted(rules: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """keys and css: a module's rules in order of code points, one to a line."""
    return rules.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(rule)), "\n").alias("css"))


def require_queries(rules: DataFrame, rule: str, sheet: str = "compiled.css") -> DataFrame:
    """rules with the module request that carries each rule."""
    coded = F.replace(F.url_encode(rule), F.lit("+"), F.lit("%20"))
    return rules.withColumn("request", F.concat(F.lit(f'require("{sheet}?style='), coded, F.lit('")')))


def metadata(rules: DataFrame, keys: list[str], ord: str, rule: str) -> DataFrame:
    """keys and style_rules: a module's rules as an array, in order."""
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord), F.col(rule).alias("r")))), lambda x: x.r)
    return rules.groupBy(*keys).agg(own.alias("style_rules"))
