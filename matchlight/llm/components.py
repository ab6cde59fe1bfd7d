"""Connected components of a link table by label propagation with pointer jumps.

Labels only fall; each round a node takes the least label of its neighbours and then
its label's label. Rounds end when no label changes. Everything stays distributed;
each round's labels are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): root is the least node of the component. Nodes without links are absent."""
    both = cut(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = cut(lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        if labels.where("old <> root").limit(1).count() == 0:
            return labels.select("node", "root")
        labels = labels.select("node", "root")
