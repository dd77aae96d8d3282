"""robots.txt: grouping of rules, choice of agent, longest-prefix decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import trim_space
from .lookup import attach

# The message, and this engine's agent name, a parameter everywhere.
USER_AGENT = "weftlink-bot/1.0"
BLOCKED = "blocked by robots.txt"


def _rule(value: Column) -> Column:
    bare = F.replace(value, F.lit("*"), F.lit(""))
    return F.when(value == "", value).when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def robots_rules(robots_txt: DataFrame) -> DataFrame:
    """``(host, agent, kind, rule)`` of every usable robots.txt; one row per host.

    A host's window holds the lines of its body, which is one value of the
    input; ``sources.tables.cap_bodies`` cuts bodies where that is wanted.
    """
    usable = robots_txt.filter(F.col("status") < 400)
    lines = usable.select(
        F.lower("host").alias("host"),
        F.posexplode(F.split(F.col("body"), "\n", -1)).alias("line", "raw"),
    ).withColumn("text", trim_space(F.substring_index("raw", "#", 1)))
    colon = F.instr("text", ":")
    value = trim_space(F.substr(F.col("text"), colon + 1))
    field = F.when(colon > 0, F.lower(trim_space(F.left(F.col("text"), colon - 1)))).otherwise(F.lit(""))
    rule = _rule(value)
    kind = (
        F.when(F.col("text") == "", F.lit("blank"))
        .when(field == "user-agent", F.lit("agent"))
        .when(field == "allow", F.lit("allow"))
        .when((field == "disallow") & (rule != ""), F.lit("disallow"))
    )
    events = lines.select(
        "host",
        "line",
        kind.alias("kind"),
        F.when(field == "user-agent", F.lower(value)).otherwise(rule).alias("value"),
    ).filter(F.col("kind").isNotNull())
    # Agents that follow each other share the rules after them; a blank line or
    # an agent after a rule opens a new group.
    in_file = Window.partitionBy("host").orderBy("line")
    opens = (F.col("kind") == "blank") | (
        (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(in_file), F.lit("blank")) != "agent")
    )
    grouped = events.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(in_file))
    agents = grouped.filter(F.col("kind") == "agent").select("host", "group", F.col("value").alias("agent")).distinct()
    rules = grouped.filter(F.col("kind").isin("allow", "disallow")).select(
        "host", "group", "kind", F.col("value").alias("rule")
    )
    return agents.join(rules, ["host", "group"]).select("host", "agent", "kind", "rule")


def _priority(agent: Column, user_agent: str) -> Column:
    names = (user_agent.split("/")[0].lower(), user_agent, "*")
    out = F.lit(None).cast("int")
    for i in reversed(range(len(names))):
        out = F.when(agent == names[i], F.lit(i)).otherwise(out)
    return out


def agent_rules(rules: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """The rules that bind ``user_agent``: own name, name with version, or ``*``."""
    ranked = rules.withColumn("rank", _priority(F.col("agent"), user_agent)).filter(F.col("rank").isNotNull())
    best = F.min("rank").over(Window.partitionBy("host"))
    return ranked.withColumn("best", best).filter(F.col("rank") == F.col("best")).drop("rank", "best")


def rule_lists(rules: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """One row per host: ``(robots_host, allows, disallows)``, bounded by the body limit."""
    usable = agent_rules(rules, user_agent).filter(F.col("rule") != "")

    def collected(kind: str) -> Column:
        return F.collect_set(F.when(F.col("kind") == kind, F.col("rule"))).alias(f"{kind}s")

    return usable.groupBy(F.col("host").alias("robots_host")).agg(collected("allow"), collected("disallow"))


def _longest(rules: Column, path: Column) -> Column:
    hits = F.filter(rules, lambda r: path.startswith(r))
    return F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0))


def with_verdict(hosted: DataFrame, url: str = "url") -> DataFrame:
    """Turn a URL's joined rule lists into ``allowed``; no lists allow all."""
    path = U.escaped_path_of(F.col(url))
    disallow, allow = _longest(F.col("disallows"), path), _longest(F.col("allows"), path)
    allowed = F.col("disallows").isNull() | (disallow == 0) | (allow >= disallow)
    return hosted.withColumn("allowed", allowed).drop("robots_host", "allows", "disallows")


def with_robots(urls: DataFrame, rules: DataFrame, url: str = "url", user_agent: str = USER_AGENT) -> DataFrame:
    """Add ``allowed``. Each URL meets one row per host, never one per rule."""
    facts = urls.withColumn("robots_host", U.host_of(F.col(url)))
    return with_verdict(attach(facts, rule_lists(rules, user_agent), "robots_host", spread=url), url)
