"""Sinks; each writes in parallel, but for reports of a checked, small number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

REPORT_ROWS = 1000


def csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in the Parquet at ``path`` yet; all where nothing is there."""
    from pyspark.errors import AnalysisException

    try:
        done = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return df
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def append(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append what ``missing`` finds, so a stopped run goes on where it ended."""
    missing(df, path, keys).write.mode("append").parquet(path)


def review_queue(items: DataFrame, path: str) -> None:
    """Items that need a review, as JSON lines."""
    items.filter("needs_review").write.json(path)


def graph_corpus(entries: DataFrame, path: str) -> None:
    """Column ``entry`` with a blank line after each."""
    entries.select("entry").write.option("lineSep", "\n\n").text(path)


def vocabulary(counts: DataFrame, path: str) -> None:
    """(token, n) as tab-separated lines by falling count, then token; files in order of their names."""
    counts.orderBy(F.desc("n"), "token").select(F.concat_ws("\t", "token", "n").alias("value")).write.text(path)


def line_files(df: DataFrame, paths: dict[str, str], order: str) -> None:
    """Columns as parallel files of lines: row k of one belongs to row k of the others.

    The ordered rows are stored once, so all files agree."""
    ordered = cut(df.orderBy(order, *paths).select(*paths))
    for column, path in paths.items():
        ordered.select(F.coalesce(F.regexp_replace(column, "\n", " "), F.lit("")).alias("value")).write.text(path)


def markdown(df: DataFrame, limit: int = REPORT_ROWS) -> str:
    """An aggregate as a Markdown table; more rows than ``limit`` are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has {limit} rows at most")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *(line(r) for r in rows)])
