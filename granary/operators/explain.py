"""What a forest's prediction is made of (L8, Z37): along a row's path each split moves the probability, and the moves add up by feature.

The forest becomes a table of nodes, read from the model's own saved form; it is as large as the model (trees times 2^depth at most) and
is broadcast. A row's probability is the mean over the trees of its leaves' shares; base is the mean of the roots' shares;
base plus all contributions is the probability.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import shared_folder

TOP = 7


def node_table(model, spark) -> DataFrame:
    """(tree, node, feature, threshold, left, right, share) of a fitted RandomForestClassificationModel of two classes and number features.

    feature, left and right are -1 in a leaf; share is that of class 1 among the training weight in the node.
    """
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    leaf = F.col("leftChild") < 0
    return n.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(leaf, -1).otherwise(F.col("split.featureIndex")).cast("int").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), (stats[1] / (stats[0] + stats[1])).alias("share"),
    )


def _walker(shared, names: Sequence[str], hidden: str | None, top: int):
    shown = np.array([i for i, name in enumerate(names) if not (hidden and name.startswith(hidden))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            rows = np.arange(len(x))
            moved, base, probability = np.zeros_like(x), np.zeros(len(x)), np.zeros(len(x))
            for feature, threshold, left, right, share in trees:
                at = np.zeros(len(x), np.int64)
                base += share[0]
                while (inside := rows[feature[at] >= 0]).size:
                    here = at[inside]
                    f = feature[here]
                    down = np.where(x[inside, f] <= threshold[here], left[here], right[here])
                    np.add.at(moved, (inside, f), share[down] - share[here])
                    at[inside] = down
                probability += share[at]
            moved, base, probability = moved / len(trees), base / len(trees), probability / len(trees)
            rest = base + moved.sum(axis=1)
            order = shown[np.argsort(-np.abs(moved[:, shown]), axis=1, kind="stable")[:, :top]]
            factors = [[{"feature": names[f], "value": float(x[r, f]), "contribution": float(moved[r, f])} for f in order[r].tolist()] for r in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability), pa.array(base), pa.array(rest), pa.array(factors, pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64()), ("contribution", pa.float64())])))], ["key", "probability", "base", "total", "factors"])

    return run


def contributions(rows: DataFrame, key: str, inputs: DataFrame | str, names: Sequence[str], nodes: DataFrame, top: int = TOP, hidden: str | None = "tfidf_") -> DataFrame:
    """key, probability, base, total (base and all contributions) and factors: the `top` largest (feature, value, contribution).

    `inputs` is the column with the features' array, `names` their names in order; those that begin with `hidden` move
    the total, but are not listed.
    """
    trees: dict[int, list] = {}
    for r in nodes.orderBy("tree", "node").toLocalIterator():  # the model, no larger than its parameters allow
        trees.setdefault(r["tree"], []).append(r)
    arrays = [tuple(np.array([r[c] if r[c] is not None else 0 for r in t], kind) for c, kind in (("feature", np.int64), ("threshold", np.float64), ("left", np.int64), ("right", np.int64), ("share", np.float64))) for t in trees.values()]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(arrays)
    source = rows.select(F.col(key).alias("key"), F.col(inputs).cast("array<double>").alias("x"))
    factor = T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("contribution", T.DoubleType())]))
    schema = T.StructType([source.schema["key"]]).add("probability", "double").add("base", "double").add("total", "double").add("factors", factor)
    return source.mapInArrow(_walker(shared, list(names), hidden, top), schema).withColumnRenamed("key", key)


def default_categories(confidence, ladder: Sequence[tuple[float, Sequence[str]]]):
    """The categories of the first step of the ladder that the confidence is above, best first; none below all."""
    out = F.array().cast("array<string>")
    for least, names in reversed(list(ladder)):
        out = F.when(confidence > least, F.array(*map(F.lit, names))).otherwise(out)
    return out
