"""A map of documents from their vectors (G8): two axes, territories, terrain, gaps between territories, and what lies around a point.

Axes are the first two principal components (their covariance is summed on the executors and is as large as the dimensions squared).
Territories are clusters of positions by KMeans. The terrain counts documents by cell of a square grid: one shuffle of cells, so
its tables have at most cells * cells rows and gaps are found on them alone. Documents are never gathered; a territory's size
does not matter, since all of it is sums.

Defined cases: rows without a vector, or with one of another length than most, have no position; without rows all
tables are empty; where all positions are equal, all lie in one cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.vector_index import _usable
from granary.session import durable

CELLS, TERRITORIES, SEED = 20, 8, 42
#: Cells around an empty one in which two territories make it a gap.
REACH = 2


@dataclass(frozen=True)
class Landscape:
    """positions (id, x, y, territory, cx, cy), terrain (cx, cy, n, height, territory), territories (territory, n, x, y), gaps (cx, cy, territories, near)."""

    positions: DataFrame
    terrain: DataFrame
    territories: DataFrame
    gaps: DataFrame


def positions(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, y): places on the first two principal axes, each turned so that its largest component is positive, to six digits."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _usable(vectors, id_col, vector_col, None)
    usual = rows.groupBy(F.size("v").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").first()
    if usual is None or usual["k"] < 2:
        return rows.where("false").select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    rows = rows.where(F.size("v") == usual["k"]).select("id", array_to_vector("v").alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    axes = np.array(model.pc.toArray())
    turn = [1.0 if axes[np.abs(axes[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    placed = model.transform(rows).select("id", vector_to_array("p").alias("p"))
    return placed.select("id", F.round(F.col("p")[0] * turn[0], 6).alias("x"), F.round(F.col("p")[1] * turn[1], 6).alias("y"))


def landscape(vectors: DataFrame, id_col: str, vector_col: str, territories: int = TERRITORIES, cells: int = CELLS, seed: int = SEED) -> Landscape:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    at = durable(positions(vectors, id_col, vector_col))
    low_x, high_x, low_y, high_y, n = at.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not n:
        placed = at.select("*", F.lit(0).alias("territory"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    else:
        whole = VectorAssembler(inputCols=["x", "y"], outputCol="_v").transform(at)
        model = KMeans(k=max(2, territories), seed=seed, featuresCol="_v", predictionCol="_t").fit(whole)
        order = sorted(range(len(model.clusterCenters())), key=lambda k: tuple(model.clusterCenters()[k]))  # numbered from left to right
        number = F.element_at(F.array(*(F.lit(order.index(k)) for k in range(len(order)))), F.col("_t") + 1)

        def cell(c: str, low: float, high: float) -> F.Column:
            return F.least(F.lit(cells - 1), F.floor((F.col(c) - low) * cells / (high - low or 1.0))).cast("int")

        placed = model.transform(whole).select("id", "x", "y", number.alias("territory"), cell("x", low_x, high_x).alias("cx"), cell("y", low_y, high_y).alias("cy"))
    placed = durable(placed)
    counts = durable(placed.groupBy("cx", "cy", "territory").agg(F.count(F.lit(1)).alias("n")))  # at most cells squared times territories
    most = F.max_by("territory", F.struct("n", -F.col("territory")))
    terrain = counts.groupBy("cx", "cy").agg(F.sum("n").alias("n"), most.alias("territory"))
    top = counts.groupBy("cx", "cy").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 1
    terrain = durable(terrain.select("cx", "cy", "n", F.round(F.col("n") / top, 6).alias("height"), "territory"))
    sizes = placed.groupBy("territory").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    return Landscape(placed, terrain, sizes, gaps(terrain, cells))


def gaps(terrain: DataFrame, cells: int = CELLS, reach: int = REACH) -> DataFrame:
    """(cx, cy, territories, near): empty cells with cells of two territories or more within `reach`, and how many documents lie there."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = terrain.select("territory", "n", "cy", F.explode(F.transform(steps, lambda s: F.col("cx") + s)).alias("gx")).select("territory", "n", "gx", F.explode(F.transform(steps, lambda s: F.col("cy") + s)).alias("gy"))
    around = around.where(F.col("gx").between(0, cells - 1) & F.col("gy").between(0, cells - 1))
    found = around.groupBy(F.col("gx").alias("cx"), F.col("gy").alias("cy")).agg(F.array_sort(F.collect_set("territory")).alias("territories"), F.sum("n").alias("near"))
    return found.join(terrain.select("cx", "cy"), ["cx", "cy"], "left_anti").where(F.size("territories") > 1)


def around(scape: Landscape, x: float, y: float, radius: float = 1.0, size: int = 10) -> DataFrame:
    """The `size` nearest documents within `radius` of a point: id, distance, territory, rank."""
    away = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    rows = scape.positions.select("id", F.round(away, 6).alias("distance"), "territory").where(F.col("distance") <= radius)
    best = rows.orderBy("distance", "id").limit(size)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))  # at most size rows
