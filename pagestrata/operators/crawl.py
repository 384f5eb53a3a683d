"""Crawl permission and admission: URL rules, robots rules, and rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

AGENT = "pagestratabot"
WINDOW_MS = 60_000


def url_path(url: Column | str) -> Column:
    """Path of a URL, / for a bare host; what isn't a URL is all path; '' for null."""
    u = F.col(url) if isinstance(url, str) else url
    host, path = F.try_parse_url(u, F.lit("HOST")), F.try_parse_url(u, F.lit("PATH"))
    return F.when(u.isNull() | (u == ""), F.lit("")).when(host.isNull(), u).when(path == "", F.lit("/")).otherwise(path)


def url_host(url: Column | str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")))


def admitted(url: Column | str) -> Column:
    """Whether a URL may be fetched at all: http or https, and no local name or bare address."""
    u = F.col(url) if isinstance(url, str) else url
    host = url_host(u)
    local = host.isin("", "localhost") | host.rlike(r"\.(local|internal)$") | host.rlike(r"^[0-9.]+$") | host.contains(":") | host.startswith("[")
    return F.coalesce(u.rlike("(?i)^https?://") & ~local, F.lit(False))


def robots_rules(texts: DataFrame, agent: str = AGENT, host_col: str = "host", text_col: str = "robots") -> DataFrame:
    """(host, allow, pattern): the rules of each robots.txt for the agent.

    Of the groups the one named exactly, else the first whose name is part of the
    agent's, else the one for all.  Line order decides, by a running count of the
    agent lines that begin a group.
    """
    lines = texts.select(F.col(host_col).alias("host"), F.posexplode(F.split(text_col, r"\r?\n")).alias("no", "raw")).withColumn("line", T.collapse(F.regexp_replace("raw", "#.*$", ""))).where(F.instr("line", ":") > 0)
    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    kv = lines.select("host", "no", field.alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    w = Window.partitionBy("host").orderBy("no")
    agent_line = F.col("field") == "user-agent"
    begins = (agent_line & ~F.coalesce(F.lag(agent_line).over(w), F.lit(False))).cast("int")
    kv = kv.withColumn("group", F.sum(begins).over(w))
    agents = kv.where(agent_line).groupBy("host", F.lower("value").alias("name"), "group").agg(F.min("no").alias("no"))
    fit = F.when(F.col("name") == agent, 0).when((F.col("name") != "*") & F.lit(agent).contains(F.col("name")), 1).when(F.col("name") == "*", 2)
    named = agents.withColumn("fit", fit).where("fit is not null")
    best = named.withColumn("first", F.min(F.struct("fit", F.when(F.col("fit") == 1, F.col("no")).otherwise(0).alias("no"), "name")).over(Window.partitionBy("host"))).where("name = first.name").select("host", "group").distinct()
    rules = kv.where(F.col("field").isin("allow", "disallow") & ~((F.col("field") == "disallow") & (F.col("value") == "")))
    return rules.join(best, ["host", "group"]).select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as an anchored regular expression: * for anything, a final $ for the end."""
    end = pattern.endswith("$")
    body = F.when(end, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(end, F.lit("$")).otherwise(F.lit("")))


def allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url", host_col: str = "host") -> DataFrame:
    """urls with ``allowed``: the longest rule of its host that matches the path decides, allow among equals; without one it is allowed."""
    u = urls.withColumn("path", url_path(url_col))
    keyed = rules.withColumn("rx", pattern_regex(F.col("pattern")))
    hit = u.join(keyed, host_col).where(F.expr("path rlike rx"))
    best = hit.groupBy(host_col, url_col).agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("__allow"))
    return u.join(best, [host_col, url_col], "left").select(*u.columns, "__allow").withColumn("allowed", F.coalesce("__allow", F.lit(True))).drop("__allow")


def admit_hits(times: list[int], most: int, window_ms: int = WINDOW_MS, before: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Which of ascending times a sliding window admits, only admitted ones counting, and the admitted times still in it."""
    live, out, at = list(before or []), [], 0
    for t in times:
        while at < len(live) and live[at] <= t - window_ms:
            at += 1
        ok = len(live) - at < most
        if ok:
            live.append(t)
        out.append(ok)
    return out, live[at:]


def rate_limited(hits: DataFrame, most: int, key: str = "key", at: str = "ts_ms", order: str | None = None, window_ms: int = WINDOW_MS) -> DataFrame:
    """(key, at, [order,] admitted): a fold over each key's hits in time order; ties go by ``order`` if given."""
    by = [at, *([order] if order else [])]
    kinds = dict(hits.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *by]) + ", admitted boolean"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by, kind="stable").reset_index(drop=True)
        rows["admitted"] = admit_hits(rows[at].tolist(), most, window_ms)[0]
        return rows

    return hits.select(key, *by).groupBy(key).applyInPandas(fold, schema)
