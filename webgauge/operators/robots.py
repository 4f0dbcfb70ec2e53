"""robots.txt as tables: groups and rules by expressions, verdicts by a join of rules with paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webgauge.constants import AI_CRAWLERS


def robots_lines(robots: DataFrame) -> DataFrame:
    """(origin, pos, field, value) of robots (origin, text): comments dropped, field in lower case."""
    lines = robots.select("origin", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("origin", "pos", line.alias("line")).where(F.contains("line", F.lit(":")))
    return lines.select("origin", "pos", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, grp, kind, value, pos): kind agent, allow, disallow or crawl-delay; groups count from 1.

    Agents in a row share a group; an agent after a rule begins one; rules before any agent are dropped; sitemap lines
    neither end nor begin a group.
    """
    kept = robots_lines(robots).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("origin").orderBy("pos")
    begins = (F.col("field") == "user-agent") & F.coalesce(F.lag("field").over(w) != "user-agent", F.lit(True))
    numbered = kept.withColumn("grp", F.sum(begins.cast("int")).over(w)).where("grp > 0")
    kind = F.when(F.col("field") == "user-agent", "agent").otherwise(F.col("field"))
    return numbered.select("origin", "grp", kind.alias("kind"), F.when(kind == "agent", F.lower("value")).otherwise(F.col("value")).alias("value"), "pos")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(origin, pos, url) of sitemap lines."""
    return robots_lines(robots).where("field = 'sitemap' and value <> ''").select("origin", "pos", F.col("value").alias("url"))


def path_pattern(value: Column) -> Column:
    """A rule's path as a regular expression: * is anything, a $ at the end anchors, otherwise a prefix."""
    anchored = F.endswith(value, F.lit("$"))
    body = F.when(anchored, F.regexp_replace(value, r"\$$", "")).otherwise(value)
    escaped = F.regexp_replace(body, r"([\\.+?^$(){}\[\]|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def access(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """Verdicts for requests (origin, path, agent): adds allowed, rule, specific, crawl_delay.

    The group of the longest agent name that is a prefix of the agent or has it as prefix is obeyed (the first of
    equals), else the first group of *; the longest matching rule decides (stars don't count), allow before disallow.
    """
    # an agent's group doesn't depend on the path, nor the rule that decides on the agent beyond its group
    agents = rules.where("kind = 'agent'").select("origin", "grp", F.col("value").alias("name"))
    asking = requests.select("origin", "agent").distinct().withColumn("ua", F.lower("agent"))
    named = (F.col("name") != "*") & (F.col("name") != "") & (F.startswith("ua", F.col("name")) | F.startswith("name", F.col("ua")))
    best = Window.partitionBy("origin", "agent").orderBy(F.col("name") == "*", F.desc(F.length("name")), "grp")
    group = asking.join(agents, "origin").where(named | (F.col("name") == "*")).withColumn("r", F.row_number().over(best)).where("r = 1")
    delay = rules.where("kind = 'crawl-delay'").groupBy("origin", "grp").agg(F.min_by("value", "pos").alias("crawl_delay"))
    group = group.select("origin", "agent", "grp", (F.col("name") != "*").alias("specific")).join(delay, ["origin", "grp"], "left")

    grouped = requests.join(group, ["origin", "agent"], "left")
    paths = rules.where("kind in ('allow', 'disallow') and value <> ''").select("origin", "grp", F.col("kind").alias("kind"), F.col("value").alias("rule"), "pos", path_pattern(F.col("value")).alias("pattern"))
    hits = grouped.where("grp is not null").select("origin", "grp", "path").distinct().join(paths, ["origin", "grp"]).where(F.rlike(F.col("path"), F.col("pattern")))
    strength = F.struct(F.length(F.replace(F.col("rule"), F.lit("*"), F.lit(""))), F.col("kind") == "allow", -F.col("pos"))
    verdict = hits.groupBy("origin", "grp", "path").agg(F.max_by(F.struct("kind", "rule"), strength).alias("v")).select("origin", "grp", "path", "v.*")
    return (
        grouped.join(verdict, ["origin", "grp", "path"], "left")
        .withColumns({"allowed": F.coalesce(F.col("kind") == "allow", F.lit(True)), "specific": F.coalesce("specific", F.lit(False)), "crawl_delay": F.expr("try_cast(crawl_delay as double)")})
        .select(*requests.columns, "rule", "specific", "crawl_delay", "allowed")
    )


def search_blocked(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """(origin, path, blocking_rule): null unless googlebot or * is kept out."""
    both = paths.select("origin", "path").distinct().withColumn("agent", F.explode(F.array(F.lit("googlebot"), F.lit("*"))))
    verdicts = access(rules, both).where("not allowed")
    rule = verdicts.groupBy("origin", "path").agg(F.min_by("rule", F.col("agent") != "googlebot").alias("blocking_rule"))
    return paths.join(rule, ["origin", "path"], "left")


def crawler_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(AI_CRAWLERS)], "bot_pos int, agent string, vendor string, surface string, role string")


def crawler_access(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """Every AI crawler's verdict for paths (origin, path); the registry is a constant of 16 rows."""
    bots = crawler_registry(paths.sparkSession)
    return access(rules, paths.crossJoin(F.broadcast(bots)))


def blocks_all(text: Column) -> Column:
    """A bare Disallow: / anywhere after User-agent: * (in whatever group)."""
    return F.regexp_like(text, F.lit(r"(?im)user-agent:\s*\*[\s\S]*?disallow:\s*/\s*$"))
