"""Nested buckets and the vector index against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import bucket_tree, vector_index


def test_nested_buckets_by_plain_python(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}", rng.choice(["a", "b", None]), rng.randint(0, 400), rng.randint(1, 5)) for _ in range(4000)] + [(None, "a", 1, 1)]
    tree = bucket_tree.bucket_tree(spark.createDataFrame(rows, "x string, y string, z long, v long"), ["x", "y", "z"], [5, 2, 3], ["v"])

    def best(some, level, top):
        n = Counter(r[level] for r in some if r[level] is not None)
        out = []
        for key, count in sorted(n.items(), key=lambda kv: (-kv[1], kv[0]))[:top]:
            mine = [r for r in some if r[level] == key]
            out.append((key, count, sum(r[3] for r in mine), *([best(mine, level + 1, (5, 2, 3)[level + 1])] if level < 2 else [])))
        return out

    def plain(b, level):
        return (b["key"], b["n"], b["v"], *([[plain(x, level + 1) for x in b["buckets"]]] if level < 2 else []))

    assert [plain(b, 0) for b in tree.collect()] == best([r for r in rows if r[0] is not None], 0, 5)
    flat = bucket_tree.flattened(tree, 3, ["v"]).collect()
    assert len(flat) == 5 + 10 + 30 and all(r.path.count(" > ") == r.level - 1 for r in flat)


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[0 if i % 3 == 0 else i % 12] + 0.6 * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [20_000, 90])
def test_recall_of_the_index(spark, tmp_path, block):
    rows = clustered(1500, 16, 3)
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0] * 3), (None, [1.0] * 16), (5004, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    index = vector_index.write_index(df, "id", "v", str(tmp_path / "index"), lists=16, block=block)
    assert index.rows.count() == 1501 and (block > 1000 or max(index.blocks) > 1)
    got = vector_index.search(index, df.where("id % 20 = 0"), "id", "v", 10, probes=6).collect()
    x = np.array([v for _, v in rows] + [rows[0][1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([*range(1500), 5004])
    exact = set()
    for q in range(0, 1500, 20):
        near = np.round(x @ x[q], 9)
        near[ids == q] = -9
        exact |= {(q, int(ids[k])) for k in np.lexsort((ids, -near))[:10]}
    found = {(r.query, r.id) for r in got}
    assert len(found & exact) / len(exact) >= 0.9
    assert (0, 5004) in found and all(r.query != r.id for r in got)
    every = vector_index.search(index, df.where("id % 100 = 0"), "id", "v", 10, probes=16)
    assert {(r.query, r.id) for r in every.where("query < 1500").collect()} == {(q, i) for q, i in exact if q % 100 == 0}


def test_recall_on_the_test_vectors(spark):
    from granary.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["indexed_neighbours"](spark, sf)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    exact = []
    for q in np.flatnonzero(ids % 20 == 0):
        near = x @ x[q]
        near[q] = -9
        exact += [(int(ids[q]), int(ids[k])) for k in np.argsort(-near)[:10]]
    assert vector_index.recall(got, spark.createDataFrame(exact, "query long, id long")) >= 0.9


def test_relations_of_all_kinds(spark):
    one = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.7), (3, 3, 1.0), (None, 2, 1.0)], "src long, dst long, weight double")
    out = vector_index.relations({"a": one, "b": one.limit(0)}).collect()
    assert [tuple(r) for r in out] == [("1", "2", "a", 0.7)]
    assert vector_index.recall(one.select(F.col("src").alias("query"), F.col("dst").alias("id")), one.select(F.col("src").alias("query"), F.col("dst").alias("id")).where("query = 9")) == 1.0


def test_document_relations_of_every_row(spark, tmp_path):
    from granary.plans.catalog import QUERIES

    rows = clustered(120, 8, 9)
    texts = [(1, "See PMID: 77 and more."), (2, "As 10.1234/ab.c and PMID 77 say, the quick brown fox ran"), (3, "Also pmid:77, 10.1234/ab.c"), (4, "PMID 78"), (5, None)]
    for name, df in (("embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>")), ("documents", spark.createDataFrame(texts, "doc_id long, text string")), ("benchmark", spark.createDataFrame([(9, "The quick brown fox. Then")], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    edges = QUERIES["document_relations"](spark, str(tmp_path)).collect()
    found = Counter(e.src for e in edges if e.kind == "similar")
    assert set(found) == {f"v{i}" for i in range(120)} and max(found.values()) == 5  # before: v0, v20, v40 and so on alone
    assert sorted((e.src, e.dst) for e in edges if e.kind == "names") == [("d2", "b9")]
    assert sorted((e.src, e.dst) for e in edges if e.kind == "identifier") == [("d2", "d1"), ("d3", "d1"), ("d3", "d2")]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T - 9 * np.eye(120)
    exact = {(f"v{i}", f"v{j}") for i in range(120) for j in np.argsort(-near[i])[:5]}
    assert len(exact & {(e.src, e.dst) for e in edges if e.kind == "similar"}) >= 0.9 * len(exact)


def test_landscape_is_the_same_on_two_runs(spark):
    from granary.operators import landscape

    rows = clustered(600, 8, 5)
    df = spark.createDataFrame([*rows, (9000, None), (9001, [1.0])], "id long, v array<double>")
    one, two = (landscape.landscape(df.repartition(k), "id", "v", territories=5, cells=12) for k in (3, 5))
    where = {r.id: (r.x, r.y, r.territory, r.cx, r.cy) for r in one.positions.collect()}
    assert len(where) == 600
    terrain = {(r.cx, r.cy): r for r in one.terrain.collect()}
    assert {k: r.n for k, r in terrain.items()} == Counter((cx, cy) for *_, cx, cy in where.values()) == {(r.cx, r.cy): r.n for r in two.terrain.collect()}
    assert max(r.height for r in terrain.values()) == 1.0 and all(0 <= c < 12 for k in terrain for c in k)
    assert {r.territory: r.n for r in one.territories.collect()} == Counter(t for _, _, t, _, _ in where.values())
    want = {}
    for cx in range(12):
        for cy in range(12):
            near = [terrain[x, y] for x in range(cx - 2, cx + 3) for y in range(cy - 2, cy + 3) if (x, y) in terrain]
            if (cx, cy) not in terrain and len({r.territory for r in near}) > 1:
                want[cx, cy] = (sorted({r.territory for r in near}), sum(r.n for r in near))
    assert {(r.cx, r.cy): (list(r.territories), r.near) for r in one.gaps.collect()} == want and want
    x, y, *_ = where[0]
    best = landscape.around(one, x, y, 1.0, 5).orderBy("rank").collect()
    plain = sorted((round(((a - x) ** 2 + (b - y) ** 2) ** 0.5, 6), i) for i, (a, b, *_) in where.items())[:5]
    assert [(r.distance, r.id) for r in best] == [p for p in plain if p[0] <= 1.0] and best[0].id == 0
    assert landscape.landscape(df.limit(0), "id", "v").gaps.count() == 0
