"""Sinks: one CSV file for small results, Parquet, JSON caches, Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """One file with a header; for results of report size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, partitions: int | None = None) -> None:
    (df if partitions is None else df.repartition(partitions)).write.mode("overwrite").parquet(path)


def cache(df: DataFrame, path: str) -> None:
    """(name, smiles) as JSON objects of one entry, a line each, so no row holds them all; of a name's values the greatest holds, a null is kept as a known miss."""
    one = df.groupBy("name").agg(F.max(F.coalesce("smiles", F.lit(""))).alias("smiles"))
    one.select(F.to_json(F.create_map("name", "smiles")).alias("value")).write.mode("overwrite").text(path)


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """A report of small frames as tables; the text, for the caller to put where it belongs."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in df.collect()]
        out.append("")
    return "\n".join(out)


def console(title: str, df: DataFrame) -> None:
    """A small frame on the console, as a table under its title."""
    print(markdown(title, {"": df}))
