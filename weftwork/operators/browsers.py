"""Browser queries and feature support over tables of the user's data.

agents(browser, version, pos, released): versions in order, released null if it is none;
support(feature, browser, version, flags): flags as `y`, `n d`, `a #2`...
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Other names of browsers, the default query, and the long-term releases.
ALIASES = {"fx": "firefox", "ff": "firefox", "ios": "ios_saf", "explorer": "ie", "blackberry": "bb", "explorermobile": "ie_mob", "operamini": "op_mini", "operamobile": "op_mob", "chromeandroid": "and_chr", "firefoxandroid": "and_ff", "ucandroid": "and_uc", "qqandroid": "and_qq"}
DEFAULT = ["> 0.5%", "last 2 versions", "Firefox ESR", "not dead"]
ESR = ["115", "128"]


def last_versions(agents: DataFrame, n: int, browser: str | None = None) -> DataFrame:
    """The n newest released versions of each browser."""
    own = agents.where("version is not null and released is not null")
    if browser:
        own = own.where(F.col("browser") == ALIASES.get(browser.lower(), browser.lower()))
    rank = F.row_number().over(Window.partitionBy("browser").orderBy(F.desc("pos")))
    return own.withColumn("_rank", rank).where(F.col("_rank") <= n).select("browser", "version")


def version_lookup(agents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(browser, want) with the agent's version: equal, or a range `lo-hi` that holds it;
    of several the first by pos."""
    ends = F.split("version", "-")
    low, high = F.element_at(ends, 1).try_cast("double"), F.element_at(ends, -1).try_cast("double")
    at = F.col("want").try_cast("double")
    own = agents.select("browser", "version", "pos", low.alias("low"), high.alias("high"))
    hit = own.join(wanted, "browser").where((F.col("version") == F.col("want")) | at.between(F.col("low"), F.col("high")))
    rank = F.row_number().over(Window.partitionBy("browser", "want").orderBy("pos"))
    return hit.withColumn("_rank", rank).where("_rank = 1").select("browser", "want", "version")


def selected(spark: SparkSession, agents: DataFrame, query: str, usage: DataFrame | None = None, dead: DataFrame | None = None) -> DataFrame:
    """browser, version of a query: atoms joined by comma, each `last N [browser] versions`,
    `<browser> <version>`, `firefox esr`, `> N%` (of usage(browser, version, share)), `dead`
    (of dead(browser, version)), `defaults`, and `not <atom>`, taken away from what came before.
    Each once, by name and then newest first. An atom whose table is not given is an error."""
    out = agents.select("browser", "version").limit(0)
    atoms = re.split(r"\s*,\s*|\s+or\s+", query.strip())
    for atom in (x for a in atoms for x in (DEFAULT if a.lower() == "defaults" else [a])):
        gone = re.match(r"not\s+(.*)", atom, re.I)
        got = _atom(spark, agents, gone[1] if gone else atom, usage, dead)
        out = out.join(got, ["browser", "version"], "left_anti") if gone else out.union(got).distinct()
    low = F.split(F.element_at(F.split("version", "-"), 1), r"\.")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("browser").orderBy(F.desc(F.transform(low, lambda x: x.try_cast("int"))))))


def _atom(spark: SparkSession, agents: DataFrame, atom: str, usage: DataFrame | None, dead: DataFrame | None) -> DataFrame:
    atom = atom.strip()
    if m := re.fullmatch(r"last\s+(\d+)\s+(?:(\w+)\s+)?versions?", atom, re.I):
        return last_versions(agents, int(m[1]), m[2])
    if re.fullmatch(r"(firefox|ff|fx)\s+esr", atom, re.I):
        return agents.where((F.col("browser") == "firefox") & F.col("version").isin(*ESR)).select("browser", "version")
    if m := re.fullmatch(r"(>=?)\s*([\d.]+)%", atom):
        if usage is None:
            raise ValueError(f"{atom} needs a table of usage")
        share = F.col("share")
        return usage.where(share > float(m[2]) if m[1] == ">" else share >= float(m[2])).select("browser", "version")
    if atom.lower() == "dead":
        if dead is None:
            raise ValueError("dead needs a table of dead browsers")
        return dead.select("browser", "version")
    if m := re.fullmatch(r"(\w+)\s+([\d.]+(?:-[\d.]+)?)", atom):
        name = ALIASES.get(m[1].lower(), m[1].lower())
        wanted = spark.createDataFrame([(name, m[2])], "browser string, want string")
        return version_lookup(agents, wanted).select("browser", "version")
    raise ValueError(f"Unknown browser query: {atom}")


def version_number(version: Column) -> Column:
    """The number that the version's text before a dash begins with."""
    return F.regexp_extract(F.element_at(F.split(version, "-"), 1), r"^(\d*\.?\d+)", 1).try_cast("double")


def support_by_flag(support: DataFrame) -> DataFrame:
    """feature, browser, flag, version: the least version for `y`, the greatest for any other
    flag. `d` is no flag, and `#n` counts as flag n without its first sign."""
    flags = F.filter(F.split("flags", " "), lambda x: (x != "d") & (x != ""))
    rows = support.select("feature", "browser", version_number(F.col("version")).alias("v"), F.explode(flags).alias("flag"))
    rows = rows.withColumn("flag", F.regexp_replace("flag", "^#", "")).where("v is not null")
    return rows.groupBy("feature", "browser", "flag").agg(F.when(F.col("flag") == "y", F.min("v")).otherwise(F.max("v")).alias("version"))


def is_supported(support: DataFrame, features: DataFrame, browsers: DataFrame) -> DataFrame:
    """feature, supported: whether all the browsers have flags beginning with `y`. No browsers:
    true; a browser without an entry, and an unknown feature: false."""
    asked = browsers.select("browser", "version").distinct()
    known = support.select("feature").distinct().withColumn("known", F.lit(True))
    have = support.select("feature", "browser", "version", F.col("flags").startswith("y").alias("ok")).join(asked, ["browser", "version"])
    per = have.groupBy("feature").agg((F.every(F.coalesce("ok", F.lit(False))) & (F.count_distinct("browser", "version") == asked.count())).alias("ok"))
    out = features.select("feature").distinct().join(known, "feature", "left").join(per, "feature", "left")
    none = F.lit(asked.isEmpty())
    return out.select("feature", (F.coalesce("known", F.lit(False)) & F.coalesce("ok", none)).alias("supported"))


def find_features(support: DataFrame, text: str) -> DataFrame:
    """The feature of that name, or else all whose names hold it."""
    names = support.select("feature").distinct()
    exact = names.where(F.col("feature") == text)
    return exact.union(names.where(F.col("feature").contains(text)).join(F.broadcast(exact.select(F.lit(1).alias("x")).limit(1)), F.lit(True), "left_anti"))
