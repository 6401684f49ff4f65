"""Answers as people and programs read them: verdict lines, explanations, JSON, exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The sentences that people and programs read, and the exit codes of a run.
AFFECTED, NOT_AFFECTED, NO_ANSWER = 0, 1, 2


def json_rows(answers: DataFrame, granularity: str) -> DataFrame:
    """(anchor, json): one object for each anchor; what there is not is left out."""
    granular = F.lit(granularity).alias("granularity")
    return answers.select("anchor", F.to_json(F.struct("anchor", "affected", "direction", "changed", "path", granular, "unresolved")).alias("json"))


def render_json(answers: DataFrame, anchors: list[str], granularity: str) -> str:
    """All anchors in the order they were given, as one document."""
    rows = {r["anchor"]: r["json"] for r in json_rows(answers, granularity).collect()}
    return '{"anchors":[' + ",".join(rows[a] for a in anchors) + "]}"


def verdict_lines(answers: DataFrame, granularity: str, explain: bool = False) -> DataFrame:
    """(anchor, n, line): the verdict and, if asked for, the witness, node by node."""
    head = F.when(F.col("affected"), F.concat(F.lit('Impact detected on target anchor via: "'), "changed", F.lit('"'))).otherwise("No reachability impact detected")
    lines = F.array(head)
    if explain:
        title = F.concat(F.lit("Path ("), "direction", F.lit(f", {granularity} granularity):"))
        lines = F.when(F.col("affected"), F.concat(lines, F.array(title), F.transform("path", lambda p: F.concat(F.lit("  "), p)))).otherwise(lines)
    return answers.select("anchor", F.posexplode(lines).alias("n", "line"))


def unresolved_lines(answers: DataFrame) -> list[str]:
    """What could not be placed and by whom, over all anchors, with totals."""
    rows = answers.select(F.explode("unresolved").alias("u")).select("u.specifier", F.explode("u.from").alias("path")).distinct()
    by = [(r["specifier"], r["from"]) for r in rows.groupBy("specifier").agg(F.sort_array(F.collect_set("path")).alias("from")).orderBy("specifier").collect()]
    if not by:
        return ["Every specifier this run reached resolved to a file."]
    out = [f"Resolved to nothing: {len(by)} specifier(s), written in {sum(len(f) for _, f in by)} file(s)."]
    for specifier, paths in by:
        out += [f"  {specifier}", *[f"    {p}" for p in paths]]
    return out


def verdict_of_set(answers: DataFrame) -> tuple[bool, str | None]:
    """A set of anchors is affected if one is; the first of them in order."""
    w = Window.orderBy("anchor")
    first = answers.where("affected").withColumn("r", F.row_number().over(w)).where("r = 1").collect()
    return bool(first), first[0]["anchor"] if first else None


def exit_code(answers: DataFrame | None) -> int:
    if answers is None:
        return NO_ANSWER
    return AFFECTED if not answers.where("affected").isEmpty() else NOT_AFFECTED
