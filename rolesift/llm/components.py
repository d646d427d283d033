"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component), the component named by its least node.

    Every round takes the least label among the neighbours and then the label of that label, so
    chains shrink by more than half; each round is a written table. Nodes without a
    link do not occur. An empty link table gives an empty result.
    """
    edges = written(
        links.select(F.col("a").alias("node"), F.col("b").alias("near"))
        .union(links.select("b", "a")).distinct(),
        "component-edges",
    )
    labels = written(
        edges.groupBy("node").agg(F.min("near").alias("near"))
        .select("node", F.least("node", "near").alias("label")),
        "component-labels",
    )
    while True:
        seen = (
            edges.join(labels.select(F.col("node").alias("near"), F.col("label").alias("theirs")), "near")
            .groupBy("node").agg(F.min("theirs").alias("theirs"))
        )
        least = labels.join(seen, "node").select("node", "label", F.least("label", "theirs").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        new = written(
            least.join(jump, "low", "left")
            .select("node", F.coalesce("root", "low").alias("label"), (F.coalesce("root", "low") != F.col("label")).alias("moved")),
            "component-labels",
        )
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
