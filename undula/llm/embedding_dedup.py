"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one class from the start.  Unit centroids come from k-means under the
cosine distance, fitted on a bounded sample; every class is assigned to its nearest centroid's cell.
Two unit vectors of cosine >= c are at most r = sqrt(2 - 2c) apart, so when a cell border runs
between them, one of them is within r / 2 of it: classes that near a border are copied into the
neighbouring cell as well, and no pair is lost to the cells.  Only vectors of one label are compared,
so the largest label decides the number of cells: two at least, one for PER_CELL of its classes, and
their square root where that is less (assigning and comparing then both grow with n to the power 1.5).
Cells are split into blocks by hash, and each pair of blocks is one bounded matrix product, taken in
strips.  A block pair returns one row per class with its links, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing; vectors of different lengths aren't compared; further columns
are ignored; an empty table gives an empty table.  Vectors of any length and magnitude are compared.  vec_id
must be unique (rows that share one are vectors of their own with that id); rows without one are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .components import components
from .shared import kept, scratch

#: k-means sees at most about so many classes, whatever the input.
SAMPLE = 50_000
#: Classes of one label aimed at in a cell, classes in a block, rows of a strip.
PER_CELL, BLOCK, STRIP = 2048, 4096, 512
#: Vectors times centres that a task compares at once.
NEAR = 1 << 22


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cell_count(n: int) -> int:
    """Cells for n classes of the largest label."""
    return max(2, min(-(-n // PER_CELL), isqrt(n)))


def centroids(classes: DataFrame, n: int, k: int, seed: int) -> np.ndarray:
    """k unit centroids of n classes, or one for each class if they are fewer."""
    sample = classes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max(SAMPLE, 4 * k) / max(1, n))) + 1)
    scaled = F.expr("transform(vector, x -> cast(x as double) / array_max(transform(vector, y -> abs(cast(y as double)))))")
    model = KMeans(k=k, distanceMeasure="cosine", maxIter=10, seed=seed, featuresCol="v", initSteps=2).fit(sample.select(array_to_vector(scaled).alias("v")))
    return _unit(np.array(model.clusterCenters()))


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's group, once the links (a, b) join groups."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        up = np.arange(len(root))
        np.minimum.at(up, high[apart], low[apart])
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, seed: int = 7) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of all vectors."""
    with scratch(spark):
        return kept(spark, _near_duplicates(spark, vectors, cosine, seed), "vectors", stays=True)


def _near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float, seed: int) -> DataFrame:
    rows = vectors.where("vec_id is not null").select("vec_id", "label", F.col("embedding").alias("vector"))
    finite = F.expr("label is not null and vector is not null and size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vector, v -> v <> 0)")
    rows = rows.withColumn("usable", F.coalesce(finite, F.lit(False)))
    good = rows.where("usable")
    # -0.0 is 0.0 here, as in grouping
    classes = kept(spark, good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")), "vectors")
    by_label = classes.groupBy(F.size("vector").alias("dim"), "label").count()
    longest = by_label.groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy("dim").collect()
    parts = []
    for dim, n, most in longest:  # one round for each vector length in the table, in practice one
        own = classes.where(F.size("vector") == dim)
        parts.append(_linked(spark, own, centroids(own, n, cell_count(most), seed), cosine))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = kept(spark, found, "linked")
    label = components(spark, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "id", "left").join(label, "id", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of_class = kept(spark, of_class, "classes")
    both = rows.select("vec_id", F.when(F.col("usable"), F.col("label")).alias("label"), "vector").join(of_class, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _linked(spark: SparkSession, classes: DataFrame, centre: np.ndarray, cosine: float) -> DataFrame:
    """Rows (id, links, root): how many vectors a class links with in one block pair, and a class of
    the same component there."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-9
    shared = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        strip = max(16, NEAR // len(c))
        for whole in batches:
            for lo in range(0, len(whole), strip):
                batch = whole.slice(lo, strip)
                near = _unit(_matrix(batch.column(1))) @ c.T
                own = near.argmax(1)
                # how far the other cells' centres are from each vector's own one
                gap = np.sqrt(np.maximum(0, 2 - 2 * (c[own] @ c.T)))
                inside = near[np.arange(len(own)), own][:, None] - near <= reach * gap
                inside[np.arange(len(own)), own] = True
                row, cell = np.nonzero(inside)
                cells = np.split(cell.astype(np.int32), np.cumsum(np.bincount(row, minlength=len(own)))[:-1])
                out = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(own[row], pa.int32()), pa.array([cells[r] for r in row], pa.list_(pa.int32()))], names=["id", "vector", "size", "label", "cell", "own", "cells"])

    kind = classes.schema["vector"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    dealt = kept(spark, classes.select("id", "vector", "size", "label").mapInArrow(textops.tidied(assign), f"id long, vector {kind}, size long, label {label}, cell int, own int, cells array<int>"), "cells")
    blocks = kept(spark, dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = dealt.join(blocks, ["label", "cell"]).withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        x = _unit(_matrix(table["vector"].combine_chunks()))
        size, own, side = (table[n].to_numpy() for n in ("size", "own", "block"))
        cell, low, high = (table[n][0].as_py() for n in ("cell", "low", "high"))
        cells = table["cells"].combine_chunks()
        many = cells.value_lengths().to_numpy()
        copied = np.full((len(ids), int(many.max())), -1, np.int32)
        copied[np.repeat(np.arange(len(ids)), many), textops.spans(np.zeros(len(ids), np.int64), many)] = cells.flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        best, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for lo in range(0, len(ids), STRIP):
            close = x[lo : lo + STRIP] @ x.T >= cosine
            close[np.arange(len(close)), lo + np.arange(len(close))] = False
            if low != high:
                close &= side[lo : lo + STRIP, None] != side[None, :]
            a, b = np.nonzero(close)
            a += lo
            # a pair counts in the cell that one of them belongs to; if each was copied to the other's, in the lower
            home_a, home_b = own[a] == cell, own[b] == cell
            home, guest = np.where(home_a, a, b), np.where(home_a, b, a)
            once = (copied[home] != own[guest][:, None]).all(1) | (cell < own[guest])
            count = (home_a & home_b) | ((home_a != home_b) & once)
            links += np.bincount(a[count], size[b[count]], len(ids)).astype(np.int64)
            best = merge(best, rank[a], rank[b])
        best = best[rank]
        touched = np.flatnonzero((links > 0) | (best != rank))
        return pa.table({"id": ids[touched], "links": links[touched], "root": ids[order[best[touched]]]})

    return placed.groupBy("label", "cell", "low", "high").applyInArrow(compare, "id long, links long, root long")
