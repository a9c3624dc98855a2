"""Connected components of an edge table by contraction, and joins that spread hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import i64, parts_for, settle

def small(df: DataFrame, rows: int = 50_000, tasks: int | None = None) -> DataFrame:
    """:func:`settle` from at most ``tasks`` tasks, then as few as hold ``rows`` rows each: a small table leaves no crowd of small files in the shuffles that follow."""
    df = settle(df if tasks is None else df.coalesce(tasks))
    return df.coalesce(max(1, -(-df.count() // rows)))


_FOREST_DDL = "node long, root long"


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) of the edges a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)  # the larger root hangs below the smaller
        np.minimum.at(label, label[v], least)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return nodes, nodes[label]


def _forest(most: int):
    """Edges of at most ``most`` rows at a time as (node, root), every node of theirs once."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out():
            node, root = least_labels(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
            return pa.record_batch([i64(node), i64(root)], schema=schema)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return work


def connected(edges: DataFrame, a: str = "a", b: str = "b", most: int = 1 << 20, tasks: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Each task turns ``most`` edges at a time into a forest of stars. A node that stands in several
    stars joins their roots; the graph of these roots is smaller and goes the same way, until one
    task's edges are all there are. A node of n edges is in as many rows as there are tasks, never
    in n. No edges give an empty result.
    """
    graph = small(edges.select(F.col(a).alias("node"), F.col(b).alias("root")).where("node <> root"), tasks=tasks)
    levels: list[DataFrame] = []
    while True:
        parts = -(-graph.count() // most)
        forest = graph.coalesce(max(1, parts)).mapInArrow(_forest(most), _FOREST_DDL)
        if parts <= 1:
            break
        forest = settle(forest)
        least = settle(forest.groupBy("node").agg(F.min("root").alias("root")))
        levels.append(least)
        # the roots of one node's stars belong together
        ties = forest.join(least.withColumnRenamed("root", "least"), "node").where("root <> least")
        graph = settle(ties.select(F.col("root").alias("node"), F.col("least").alias("root")).distinct())
    labels = small(forest)
    for least in reversed(levels):
        top = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        hot = hot_keys(least, "root")
        labels = settle(spread_join(salted(least, "root", "node", hot), top, "root", hot, "left").select("node", F.coalesce("top", "root").alias("root")))
    return labels.select("node", F.col("root").alias("component"))


def hot_keys(rows: DataFrame, key: str, least: int = 100) -> DataFrame | None:
    """(key, copies) of keys that hold more rows than a task should; None if there are none.

    At most four keys a task can be that large, so this table can be sent to every task.
    """
    limit = max(least, rows.count() // (4 * parts_for(rows)))
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    found = sizes.select(key, F.ceil(F.col("rows") / limit).cast("int").alias("_copies")).collect()  # at most 4 * partitions
    return rows.sparkSession.createDataFrame(found, f"{key} long, _copies int") if found else None


def salted(rows: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` with the column that :func:`spread_join` needs: rows of ``hot`` keys are dealt by a hash of ``by``."""
    name = f"_salt_{key}"
    if hot is None:
        return rows.withColumn(name, F.lit(0))
    return rows.join(F.broadcast(hot), key, "left").withColumn(name, F.pmod(F.xxhash64(by), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``salted`` rows joined with ``table``, whose ``key`` is unique and whose rows of ``hot`` keys are repeated for each salt."""
    name = f"_salt_{key}"
    if hot is None:
        return rows.join(table, key, how)
    more = table.join(F.broadcast(hot.where("_copies > 1")), key).withColumn(name, F.explode(F.sequence(F.lit(1), F.col("_copies") - 1))).drop("_copies")
    return rows.join(table.withColumn(name, F.lit(0)).unionByName(more), [key, name], how)
