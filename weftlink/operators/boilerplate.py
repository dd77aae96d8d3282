"""Repeated headers and footers of a host: find them in page order, strip them.

A page's header block becomes the host's candidate; three pages in a row that
start with it confirm it; a page that does not replaces it and the count starts
anew. Read in order this is a small automaton per host, whose state is the age
of the candidate: 0, 1 or 2 matches so far, or confirmed. Each page is a map
from state to state, and maps compose associatively. So runs of pages are
composed in parallel, then the runs of runs, and a host of any size never sits
in one task. Only block lines travel, never page bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.text import let, trim_space
from ..session import stash
from .lookup import attach
from .numbering import number_rows

# Pages in a row that confirm a candidate. The state maps below
# have one entry per number of matches so far.
CONFIRM_COUNT = 3

RUN = 1 << 14
_LEVELS = 2  # runs of runs folded before a host's own fold: RUN**3 pages fit
_SIDES = ("header", "footer")


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(host, ord, header, footer)`` of every page with text."""
    return pages.filter(F.col("text") != "").select(
        "host", "ord", L.header_block(F.col("text")).alias("header"), L.footer_block(F.col("text")).alias("footer")
    )


def _matches(side: str, candidate: Column) -> Column:
    block = F.col(side)
    hit = L.starts_with_block(block, candidate) if side == "header" else L.ends_with_block(block, candidate)
    return F.coalesce(hit, F.lit(False))


def _map_columns(side: str) -> list[str]:
    return [f"{side}_{state}" for state in range(CONFIRM_COUNT)]


_MAPS = [c for side in _SIDES for c in _map_columns(side)]


def page_maps(blocks: DataFrame, run: int = RUN) -> DataFrame:
    """One row per page with its state maps.

    Entry ``s`` says where a candidate with ``s`` matches goes: to ``s + 1``, to
    0 (this page is the new candidate), or to ``-rn``, confirmed at this page.
    The candidate with ``s`` matches is the page ``s + 1`` places before, so the
    last pages of a run are repeated, as context, at the start of the next.
    """
    position = F.col("rn") - 1
    own = F.floor(position / F.lit(run))
    copies = F.when(position % run >= run - CONFIRM_COUNT, F.array(own, own + 1)).otherwise(F.array(own))
    runs = blocks.withColumn("own_run", own).withColumn("run", F.explode(copies))
    in_run = Window.partitionBy("host", "run").orderBy("rn")
    maps = []
    for side in _SIDES:
        for state, name in enumerate(_map_columns(side)):
            candidate = F.lag(side, state + 1).over(in_run)
            reached = -F.col("rn") if state + 1 == CONFIRM_COUNT else F.lit(state + 1).cast("bigint")
            maps.append(F.when(_matches(side, candidate), reached).otherwise(F.lit(0).cast("bigint")).alias(name))
    is_context = F.col("run") != F.col("own_run")
    if "context" in blocks.columns:
        is_context = is_context | F.col("context")
    mapped = runs.select("host", "run", "rn", is_context.alias("is_context"), *maps)
    return mapped.filter(~F.col("is_context")).drop("is_context")


def _follow(state: Column, step: Column, side: str) -> Column:
    to = [step[c] for c in _map_columns(side)]
    return F.when(state < 0, state).when(state == 0, to[0]).when(state == 1, to[1]).otherwise(to[2])


def _compose(steps: Column) -> Column:
    identity = F.struct(*[F.lit(s).cast("bigint").alias(c) for side in _SIDES for s, c in enumerate(_map_columns(side))])

    def then(acc: Column, step: Column) -> Column:
        return F.struct(*[_follow(acc[c], step, side).alias(c) for side in _SIDES for c in _map_columns(side)])

    return F.aggregate(steps, identity, then)


def _fold(maps: DataFrame, keys: list[str]) -> DataFrame:
    steps = F.sort_array(F.collect_list(F.struct("rn", *_MAPS)))
    folded = maps.groupBy(*keys).agg(F.min("rn").alias("rn"), steps.alias("steps"))
    return folded.select(*keys, "rn", _compose(F.col("steps")).alias("m")).select(
        *keys, "rn", *[F.col("m")[c].alias(c) for c in _MAPS]
    )


def host_maps(maps: DataFrame, run: int = RUN) -> DataFrame:
    """The composed state maps of all of a host's pages."""
    folded = _fold(maps, ["host", "run"])
    for _ in range(_LEVELS - 1):
        folded = _fold(folded.withColumn("run", F.floor(F.col("run") / F.lit(run))), ["host", "run"])
    return _fold(folded, ["host"]).drop("rn")


def states_after(maps: DataFrame) -> DataFrame:
    """``(host, header_state, footer_state)`` after each host's last page.

    A ``{side}_before`` column, if there is one, is the state to start from; a
    host's very first page sends every state to 0, so 0 does otherwise.
    """
    out = []
    for side in _SIDES:
        before = F.col(f"{side}_before") if f"{side}_before" in maps.columns else F.lit(0)
        steps = F.struct(*[F.col(c).alias(c) for c in _map_columns(side)])
        out.append(_follow(before, steps, side).alias(f"{side}_state"))
    return maps.select("host", *out)


def rules_of(states: DataFrame, blocks: DataFrame) -> DataFrame:
    """Confirmed blocks: ``(host, header, header_at, footer, footer_at)``.

    ``blocks`` are numbered. A block confirmed at row ``n`` is that of row
    ``n - CONFIRM_COUNT``; ``_at`` is the ``ord`` of the confirming page.
    """
    wanted = []
    for side in _SIDES:
        at = -F.col(f"{side}_state")
        for role, rn in (("at", at), ("block", at - CONFIRM_COUNT)):
            wanted.append(F.when(at > 0, F.struct(F.lit(f"{side}_{role}").alias("role"), rn.alias("rn"))))
    roles = (
        states.select("host", F.explode(F.array(*wanted)).alias("w"))
        .filter(F.col("w").isNotNull())
        .select("host", F.col("w.rn").alias("rn"), F.col("w.role").alias("role"))
    )
    found = blocks.join(roles, ["host", "rn"])

    def pick(role: str, value: str, name: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(value))).alias(name)

    return found.groupBy("host").agg(
        pick("header_block", "header", "header"),
        pick("header_at", "ord", "header_at"),
        pick("footer_block", "footer", "footer"),
        pick("footer_at", "ord", "footer_at"),
    )


def boilerplate_rules(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Confirmed header and footer of each host, from ``(host, ord, text)``.

    A side that was never confirmed is NULL.
    """
    blocks = stash(number_rows(page_blocks(pages), "host", "ord"), "blocks")
    return rules_of(states_after(host_maps(page_maps(blocks, run), run)), blocks)


def _strip(text: Column, header: Column, footer: Column) -> Column:
    def cut_footer(rest: Column) -> Column:
        ends = footer.isNotNull() & L.ends_with_block(L.footer_block(rest), footer)
        return F.when(ends & (rest != ""), L.drop_last_lines(rest, L.line_count(footer).cast("int"))).otherwise(
            trim_space(rest)
        )

    starts = header.isNotNull() & L.starts_with_block(L.header_block(text), header)
    headless = F.when(starts, L.drop_first_lines(text, L.line_count(header).cast("int"))).otherwise(text)
    return let(let(headless, cut_footer), lambda out: F.when(out == "", text).otherwise(out))


def strip_boilerplate(pages: DataFrame, rules: DataFrame, out: str = "stripped") -> DataFrame:
    """Add ``out``: the text without its host's confirmed header and footer.

    Pages before the confirming one stay as they are, and so does a text that
    would become empty. Bodies meet one rule row per host; if the rules are too
    many to broadcast, hot hosts are salted.
    """
    joined = attach(pages, rules, "host", spread="ord")
    header = F.when(F.col("ord") >= F.col("header_at"), F.col("header"))
    footer = F.when(F.col("ord") >= F.col("footer_at"), F.col("footer"))
    bound = joined.withColumn("_header", header).withColumn("_footer", footer)
    unbound = F.col("_header").isNull() & F.col("_footer").isNull()
    stripped = F.when(unbound, F.col("text")).otherwise(_strip(F.col("text"), F.col("_header"), F.col("_footer")))
    return bound.withColumn(out, stripped).drop("header", "header_at", "footer", "footer_at", "_header", "_footer")
