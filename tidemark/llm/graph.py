"""Connected components of links, on tables that are deleted once they are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import contracted
from .common import forget, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: for every node of a link to another node one node of its component."""
    spark = links.sparkSession
    return contracted(links.select(F.col(a).alias("a"), F.col(b).alias("b")), lambda df: written(df, "components"), lambda df: forget(spark, df))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links: those become pairs of labels first, each once, so that a group that
    has grown together costs nothing more.  The table of labels is replaced."""
    spark = links.sparkSession
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    pairs = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    more = components(pairs.where("a != b").distinct())
    new = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = written(new.union(more.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
    forget(spark, labels)
    forget(spark, more)
    return new
