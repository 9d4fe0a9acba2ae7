"""Site files and probes: crawl rules, well-known files, access of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity of a block by the agents' tier.
TIER_SEVERITY = {"ai_search": "critical", "on_demand": "high", "training": "medium"}
# Reading agents by tier.
AGENTS = {
    "training": ("GPTBot", "ClaudeBot", "Google-Extended", "CCBot", "Applebot-Extended", "meta-externalagent", "Bytespider"),
    "ai_search": ("OAI-SearchBot", "PerplexityBot", "Claude-SearchBot", "DuckAssistBot"),
    "on_demand": ("ChatGPT-User", "Claude-User", "Perplexity-User", "Meta-ExternalFetcher"),
}
# Marks of challenge pages.
CHALLENGES = (
    "checking your browser", "just a moment", "cf-browser-verification", "attention required! | cloudflare",
    "please verify you are a human", "captcha-delivery.com", "distil_r_captcha", "perimeterx", "access denied",
    "request blocked", "you have been blocked", "vercel security checkpoint",
)
BLOCKING_STATUS = (403, 429)


def severity(tier: Column) -> Column:
    out = F.lit("low")
    for k, v in TIER_SEVERITY.items():
        out = F.when(tier == k, v).otherwise(out)
    return out


def degraded(c: Column) -> Column:
    """One notch towards low."""
    return F.when(c == "critical", "high").when(c == "high", "medium").otherwise("low")


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.left(F.regexp_replace(text, "^[ \t\r\n﻿]+", ""), F.lit(400)))
    return head.startswith("<!doctype html") | head.startswith("<html") | head.contains("<head") | head.contains("<body")


def robots_lines(robots: DataFrame) -> DataFrame:
    """``site, line_no, field, value, grp``: directives with the number of their group.

    A group starts with a user-agent line after a rule line; other fields end no
    run of user-agent lines but are no rules.
    """
    lines = robots.where("status = 'present'").select(
        "site", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line_no", "line")
    )
    clean = F.trim(F.regexp_replace(F.regexp_replace("line", "^﻿", ""), "#.*$", ""))
    parts = lines.select(
        "site", "line_no",
        F.lower(F.trim(F.regexp_extract(clean, "^([^:]*):", 1))).alias("field"),
        F.trim(F.regexp_extract(clean, "^[^:]*:(.*)$", 1)).alias("value"), clean.alias("line"),
    ).where(F.col("line").contains(":"))
    order = Window.partitionBy("site").orderBy("line_no")
    before = F.lag("field").over(order)
    starts = (F.col("field") == "user-agent") & (before.isNull() | (before != "user-agent"))
    # a run of user-agent lines opens a group only if rules came since the last one began
    marked = parts.withColumn("starts", starts.cast("int"))
    return marked.withColumn("grp", F.sum("starts").over(order)).where("grp > 0").select("site", "line_no", "field", "value", "grp")


def robots_groups(robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``site, grp, agent``, ``site, grp, line_no, kind, path`` of allow and disallow rules)."""
    lines = robots_lines(robots)
    agents = lines.where("field = 'user-agent'").select("site", "grp", F.lower("value").alias("agent")).distinct()
    rules = lines.where("field in ('allow', 'disallow')").select("site", "grp", "line_no", F.col("field").alias("kind"), F.col("value").alias("path"))
    return agents, rules


def rule_pattern(path: Column) -> Column:
    """Anchored pattern of a rule's path: ``*`` stands for any signs, a last ``$`` for the end."""
    ends = path.endswith("$")
    plain = F.regexp_replace(F.when(ends, F.substring(path, 1, F.length(path) - 1)).otherwise(path), r"([\\.+?^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(plain, F.lit("*"), F.lit(".*")), F.when(ends, "$").otherwise(""))


def sql_rule_pattern(path: str) -> str:
    plain = f"regexp_replace(CASE WHEN ends_with({path}, '$') THEN left({path}, len({path}) - 1) ELSE {path} END, '([\\\\.+?^$(){{}}|\\[\\]])', '\\\\\\1', 'g')"
    return f"'^' || replace({plain}, '*', '.*') || CASE WHEN ends_with({path}, '$') THEN '$' ELSE '' END"


def allowed(robots: DataFrame, agents: list[str], paths: DataFrame) -> DataFrame:
    """``site, agent, path, allowed`` for each of ``agents`` (a fixed short list)
    and each ``site, path``: the groups that name the agent,
    else those of ``*``, else allowed; the longest matching rule wins, allow on ties."""
    groups, rules = robots_groups(robots)
    sites = robots.where("status = 'present'").select("site").distinct()
    matrix = sites.withColumn("agent", F.explode(F.array(*map(F.lit, agents)))).withColumn("a", F.lower("agent"))
    named = matrix.join(groups, (matrix.site == groups.site) & (matrix.a == groups.agent)).select(matrix.site, matrix.agent, "grp")
    rest = matrix.join(named.select("site", "agent").distinct(), ["site", "agent"], "left_anti")
    star = rest.join(groups.where("agent = '*'").select("site", "grp"), "site").select("site", "agent", "grp")
    own = named.unionByName(star).join(rules.where("path <> ''"), ["site", "grp"])
    asked = matrix.select("site", "agent").join(paths, "site")
    own = own.withColumn("pattern", rule_pattern(F.col("path")))
    # most rules are plain beginnings
    meets = F.when(F.col("r.path").rlike(r"[*$]"), F.rlike("q.path", "r.pattern")).otherwise(F.startswith("q.path", "r.path"))
    hit = asked.alias("q").join(own.alias("r"), (F.col("q.site") == F.col("r.site")) & (F.col("q.agent") == F.col("r.agent")) & meets, "left")
    best = hit.groupBy(F.col("q.site").alias("site"), F.col("q.agent").alias("agent"), F.col("q.path").alias("path")).agg(
        F.max_by(F.col("r.kind"), F.struct(F.length("r.path"), (F.col("r.kind") == "allow").cast("int"))).alias("kind")
    )
    return best.select("site", "agent", "path", (F.coalesce("kind", F.lit("allow")) == "allow").alias("allowed"))


def response_class(status: Column, body: Column) -> Column:
    """challenge, blocked, ok or ambiguous."""
    low = F.lower(F.coalesce(body, F.lit("")))
    challenge = F.lit(False)
    for m in CHALLENGES:
        challenge = challenge | low.contains(m)
    return (
        F.when(challenge, "challenge")
        .when(status.isin(*BLOCKING_STATUS), "blocked")
        .when(status.between(200, 299), "ok")
        .otherwise("ambiguous")
    )


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``site, ord, url`` of present sitemaps; other texts give none."""
    urls = F.regexp_extract_all("text", F.lit(r"(?i)<loc>[ \t\r\n]*([^< \t\r\n][^<]*)</loc>"), F.lit(1))
    return sitemaps.where("status = 'present'").select("site", F.posexplode(urls).alias("ord", "u")).select("site", "ord", F.trim("u").alias("url"))


def circuit_open(probes: DataFrame, key: str, order: list[str], failed: Column, limit: int = 2) -> DataFrame:
    """``probes`` with ``run``: failures in a row up to here; a host's circuit is open from ``limit`` on."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(w)
    marked = probes.withColumn("island", F.coalesce(island, F.lit(0)))
    run = F.sum(failed.cast("int")).over(Window.partitionBy(key, "island").orderBy(*order))
    return marked.withColumn("run", run).withColumn("open", F.col("run") >= limit).drop("island")
