"""Reports on searches and graphs: recall, latency percentiles, degrees and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def recall(found: DataFrame, truth: DataFrame, k: int, query: str = "qid", key: str = "rowid") -> DataFrame:
    """Mean, least and greatest share of the true k neighbours that were found, over all queries of ``truth``."""
    hits = truth.select(query, key).join(found.select(query, key).withColumn("hit", F.lit(1)), [query, key], "left")
    each = hits.groupBy(query).agg((F.count("hit") / F.lit(k)).alias("r"))
    return each.agg(F.avg("r").alias("recall_mean"), F.min("r").alias("recall_min"), F.max("r").alias("recall_max"))


def latency(samples: DataFrame, column: str) -> DataFrame:
    """Least, median, 95th, 99th percentile and greatest value, interpolated."""
    p = F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.5, 0.95, 0.99, 1.0)]))
    return samples.agg(p.alias("p")).select(*[F.col("p")[i].alias(n) for i, n in enumerate(("min_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms"))])


def degrees(graph: DataFrame) -> DataFrame:
    """Greatest and mean out-degree per layer."""
    each = graph.groupBy("layer", "node_id").agg(F.count("*").alias("degree"))
    return each.groupBy("layer").agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"))


def integrity(data: DataFrame, graph: DataFrame, layers: DataFrame, m: int, key: str = "rowid") -> DataFrame:
    """One row: edges with an end that isn't in the data, self-edges, negative distances, nodes over their degree, rows without a layer."""
    ids = data.select(F.col(key).alias("id"))
    ends = graph.select(F.explode(F.array("node_id", "neighbor_id")).alias("id"))
    orphan = ends.join(ids, "id", "left_anti").agg(F.count("*").alias("orphan_ends"))
    inner = graph.agg(F.count_if(F.col("node_id") == F.col("neighbor_id")).alias("self_edges"), F.count_if(F.col("distance") < 0).alias("negative"))
    over = graph.groupBy("layer", "node_id").count().where(F.col("count") > F.when(F.col("layer") == 0, 2 * m).otherwise(m)).agg(F.count("*").alias("over_degree"))
    bare = ids.join(layers.select(F.col("node_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("without_layer"))
    return orphan.join(inner).join(over).join(bare)


def entry_point(layers: DataFrame) -> DataFrame:
    """The node with the highest layer; the smallest id among equals."""
    return layers.agg(F.max_by("node_id", F.struct("max_layer", -F.col("node_id"))).alias("entry_point"), F.max("max_layer").alias("max_layer"))
