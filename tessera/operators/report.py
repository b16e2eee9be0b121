"""Small tables as files and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a small table as Markdown."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = [f"| {' | '.join(df.columns)} |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + [f"| {' | '.join(map(cell, r))} |" for r in df.limit(rows).collect()])


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Every table below ``folder`` as ``parquet``, ``csv`` (one file with a header) or ``both``."""
    for name, df in tables.items():
        if kind in ("parquet", "both"):
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if kind in ("csv", "both"):
            df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")


def report(title: str, sections: dict[str, DataFrame | str], rows: int = 50) -> str:
    """A Markdown report of small tables and paragraphs; empty tables are said to be empty."""
    out = [f"# {title}"]
    for name, x in sections.items():
        body = x if isinstance(x, str) else markdown(x, rows) if not x.isEmpty() else "No rows."
        out += ["", f"## {name}", "", body]
    return "\n".join(out) + "\n"


def checklist(steps: dict[str, tuple[str, str]]) -> str:
    """Which step is done alike for both classes: a table of step, for one class, for the other, and whether they agree."""
    lines = ["| step | generated | real | alike |", "|-|-|-|-|"]
    return "\n".join(lines + [f"| {k} | {a} | {b} | {'yes' if a == b else 'NO'} |" for k, (a, b) in steps.items()]) + "\n"
