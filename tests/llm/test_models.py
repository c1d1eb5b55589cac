"""The trained operators: gradients, chunks, held-out accuracy on the test tables, odd texts; and the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import byte_cnn, toxicity

SF = "/root/testdata/sf0.01"


def test_chunks_overlap_and_cover():
    for n in (0, 1, 5, 448, 511, 512, 513, 960, 961, 5000):
        bounds = byte_cnn.chunk_bounds(n)
        covered = {k for a, b in bounds for k in range(a, b)}
        assert covered == set(range(max(1, n))) and all(b - a <= byte_cnn.CHUNK for a, b in bounds)


def test_symbols_flag_repeats():
    data = np.frombuffer(b"abcdefgh xyz xyz xyz" + bytes(byte_cnn.GAP), np.uint8)
    flags = byte_cnn.symbols(data) >> 8
    assert not flags[:12].any() and flags[13:17].all() and not flags[20:].any()


def plain_logit(net, text):
    """One text, chunk by chunk and filter by filter."""
    symbol = byte_cnn.symbols(np.frombuffer(text + bytes(byte_cnn.GAP), np.uint8))
    tops = []
    for a, b in byte_cnn.chunk_bounds(len(text)):
        values = [net.bias + sum(net.embed[symbol[t + k]] @ net.filters[k] for k in range(byte_cnn.WIDTH)) for t in range(a, b)]
        tops.append(np.maximum(np.max(values, axis=0), 0))
    return np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)]) @ net.weights + net.offset


def test_batched_scores_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(0)
    net = byte_cnn.Network.start(rng)
    texts = [b"", b"a", b"short text", bytes(rng.integers(32, 120, 700, dtype=np.uint8)), "Äé ".encode() * 200, b"again " * 300]
    assert np.allclose(byte_cnn.logits(net, texts), [plain_logit(net, t) for t in texts], atol=1e-4)
    texts.append(b"words said again and words said once more " * 90)
    want = [plain_logit(net, t) for t in texts]
    for chunks, slab in ((1, 1), (3, 1500)):  # long texts in pieces
        monkeypatch.setattr(byte_cnn, "PIECE_CHUNKS", chunks)
        monkeypatch.setattr(byte_cnn, "SLAB", slab)
        assert np.allclose(byte_cnn.logits(net, texts), want, atol=1e-4)


def test_quality_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = byte_cnn.fit(docs, labels)
    rows = byte_cnn.score(docs, net, F.col("doc_id").alias("row")).join(labels, F.col("row") == F.col("doc_id")).collect()
    out = [r for r in rows if zlib.crc32(str(r.row).encode()) % 4 == 2]
    good = [r.score >= byte_cnn.THRESHOLD for r in out if r.quality == 1]
    bad = [r.score < byte_cnn.THRESHOLD for r in out if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) > 0.6
    again = byte_cnn.fit(docs, labels)
    assert np.array_equal(net.weights, again.weights)


def test_one_text_of_many_megabytes_and_clashing_columns(spark):
    """Scores don't depend on what else is in the table, on its columns, or on how long another text is."""
    rng = np.random.default_rng(5)
    net = byte_cnn.Network.start(rng)
    docs = spark.createDataFrame([(1, "some words of prose", 0.5, "r"), (3, "row", 0.1, "s")], "doc_id long, text string, score double, row string")
    long_ = spark.range(1).select(F.lit(2).cast("long").alias("doc_id"), F.repeat(F.lit("many words again, "), F.lit(300_000)).alias("text"), F.lit(0.0).alias("score"), F.lit("x").alias("row"))
    rows = {r.row.doc_id: r.score for r in byte_cnn.score(docs.unionByName(long_), net, F.struct("doc_id", "score", "row").alias("row")).collect()}
    alone = byte_cnn._sigmoid(byte_cnn.logits(net, [b"some words of prose", b"many words again, " * 300_000, b"row"]))
    assert np.allclose([rows[k] for k in (1, 2, 3)], alone, atol=1e-5)
    model = toxicity.Severity({toxicity.zlib.crc32(b"again") % toxicity.DIMS: 1.0}, (2.0, 5.0, 9.0))
    graded = {r.row.doc_id: r for r in toxicity.grade(docs.unionByName(long_), model, F.struct("doc_id", "score", "row").alias("row")).collect()}
    assert graded[1].grade == 0 and graded[2].grade == 3 and abs(graded[2].severity - sum(1 / (1 + np.exp(t - 1 - np.log(300_000))) for t in (2, 5, 9))) < 1e-9


def test_scores_of_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "x" * 50_000, 0.5), (2, "x" * 50_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = byte_cnn.score(docs, byte_cnn.fit(docs, labels), F.struct("doc_id", "score").alias("row")).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    held = {r.doc_id: r.h for r in docs.select("doc_id", byte_cnn.held_out().alias("h")).collect()}
    assert held == {1: zlib.crc32(b"1") % 4 == 2, 2: zlib.crc32(b"2") % 4 == 2, None: False}
    model = toxicity.fit(docs, labels)
    assert [r.grade for r in toxicity.grade(docs, model, F.col("doc_id")).collect()] == [0] * 4
    assert byte_cnn.score(docs.limit(0), byte_cnn.fit(docs, labels), F.col("doc_id").alias("row")).count() == 0


def planted(rng, n, toxic_every=4):
    plain = [f"word{k}" for k in range(300)]
    marked = ["vile", "nasty", "awful"]
    texts, y = [], []
    for k in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 400))
        hits = rng.randrange(1, 9) if k % toxic_every == 0 else 0
        for _ in range(hits):
            words.insert(rng.randrange(len(words)), rng.choice(marked).title() + "!")
        texts.append(" ".join(words))
        y.append(hits)
    return texts, y


def test_severity_follows_the_marked_words():
    rng = random.Random(1)
    texts, hits = planted(rng, 600)
    model = toxicity.train(texts, [int(h > 0) for h in hits])
    assert list(model.thresholds) == sorted(model.thresholds) and all(w > 0 for w in model.weights.values())
    test, n = planted(rng, 400)
    got = [model.expected(t) for t in test]
    wrong = sum((g > 0) != (h > 0) for (_, g), h in zip(got, n, strict=True))
    assert wrong <= 8
    mean = lambda lo, hi: np.mean([s for (s, _), h in zip(got, n, strict=True) if lo <= h <= hi])
    assert mean(0, 0) < mean(1, 2) < mean(3, 5) < mean(6, 9)


def test_a_documents_words_do_not_decide_its_own_grade():
    """A word that only one toxic document repeats is marked by nothing else; words of many are."""
    rng = random.Random(3)
    texts, hits = planted(rng, 400)
    toxic = np.array([int(h > 0) for h in hits])
    own = int(np.flatnonzero(toxic)[0])
    texts[own] += " uncommon" * 500
    graded = toxicity.grades([toxicity.features(t) for t in texts], toxic)
    assert set(graded[toxic == 0]) == {0} and set(graded[toxic == 1]) == {1, 2, 3}
    low, high = ([h for h, g in zip(hits, graded.tolist(), strict=True) if g == k] for k in (1, 3))
    assert np.mean(low) + 2 < np.mean(high) and abs(graded[own] - graded[[i for i, h in enumerate(hits) if h == hits[own] and i != own]].mean()) < 1.5


def plain_loss(theta, w, x, over, weight):
    """The mean log loss of the cumulative links, written out."""
    score = x @ w
    p = 1 / (1 + np.exp(-(score[:, None] - theta)))
    return -(np.where(over, np.log(p), np.log(1 - p)) * weight * toxicity.FIRST).sum()


def test_the_fit_is_near_the_least_loss():
    """From the fitted weights and thresholds no small step lowers the loss by much: gradients by differences."""
    rng = random.Random(2)
    texts, hits = planted(rng, 300)
    y = np.array([int(h > 0) for h in hits])
    model = toxicity.train(texts, y.tolist())
    rows = [toxicity.features(t) for t in texts]
    x = np.array([[1 + np.log(r[i]) if i in r else 0.0 for i in model.weights] for r in rows])
    w, theta = np.array(list(model.weights.values())), np.array(model.thresholds)
    over = toxicity.grades(rows, y)[:, None] > np.arange(toxicity.GRADES)[None]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))[:, None] / len(y)
    loss = plain_loss(theta, w, x, over, weight)
    start = plain_loss(np.arange(toxicity.GRADES) + 0.0, 0 * w, x, over, weight)
    assert loss < 0.3 * start
    for k in range(len(w)):
        for step in (-0.05, 0.05):
            other = w.copy()
            other[k] += step
            assert plain_loss(theta, other, x, over, weight) > loss - 0.02 * start


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.grade(docs, model, F.col("doc_id")).join(labels, F.col("row") == F.col("doc_id")).collect()
    out = [r for r in rows if zlib.crc32(str(r.row).encode()) % 4 == 2]
    assert np.mean([r.grade > 0 for r in out if r.toxic == 1]) > 0.75  # some labels stand at texts without any sign of it
    assert np.mean([r.grade > 0 for r in out if r.toxic == 0]) < 0.02


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_toxicity_with_few_labels(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.grade(docs, toxicity.fit(docs, labels), F.col("doc_id")).join(labels, F.col("row") == F.col("doc_id")).collect()
    out = [r for r in rows if zlib.crc32(str(r.row).encode()) % 4 == 2]
    assert sum(r.grade > 0 for r in out if r.toxic == 1) >= 0.5 * sum(r.toxic for r in out)
    assert np.mean([r.grade > 0 for r in out if r.toxic == 0]) < 0.05


def test_toxicity_without_any_sign():
    """Where no word tells the classes apart nothing is marked, nor is a text without words."""
    model = toxicity.train(["same words here"] * 40, [1, 0] * 20)
    assert not model.weights and model.expected("same words here")[1] == 0
    model = toxicity.train(["vile words here"] * 10 + ["kind words here"] * 30, [1] * 10 + [0] * 30)
    assert model.expected("vile")[1] > 0 and model.expected("kind")[1] == model.expected(None)[1] == model.expected("")[1] == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output on a small table, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_000, "", None, "src0", 0), (3, "Repeated id.", "en", None, 12)], docs.schema)
    docs, out = docs.unionByName(odd), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out[name] = (docs, new)
        docs = new
    return out


def test_stages_keep_the_columns(stages):
    names = list(stages)
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "packing"]
    for name in names[:-1]:
        assert stages[name][0].columns == stages[name][1].columns


def test_stage_effects(stages):
    before, after = stages["quality_classifier"]
    assert 0.75 * before.count() < after.count() < before.count()
    assert after.exceptAll(before).count() == 0
    before, after = stages["line_dedup"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").count() == 0
    before, after = stages["simhash_near_dedup"]
    assert after.exceptAll(before).count() == 0
    texts = [t for (t,) in after.select(F.lower(F.trim("text"))).collect() if t]
    assert len(texts) == len(set(texts))
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    owner, near = {}, 0
    for i, s in enumerate(shingles):
        shared = [owner[x] for x in s if x in owner]
        near += any(len(s & shingles[j]) >= 0.9 * len(s | shingles[j]) for j in set(shared))
        owner |= dict.fromkeys(s, i)
    assert near <= 3
    before, after = stages["source_mixing"]
    assert after.dropDuplicates().exceptAll(before).count() == 0
    before, after = stages["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_the_pipeline_on_no_documents_and_on_odd_ones(spark, tmp_path):
    """Empty tables give empty ones; several rows without an id, equal ids and columns of clashing names pass through."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for name, some in (("documents", docs.limit(0)), ("labels", labels)):
        some.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    more = docs.limit(40).withColumn("uid", F.lit("u")).withColumn("root", F.lit(1)).withColumn("epoch", F.lit(2)).withColumn("row", F.lit("r"))
    odd = more.limit(3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("Something else entirely number "), F.col("n_chars").cast("string"), F.lit(" and yet another thing to be said.")))
    docs = more.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(7).cast("long")).withColumn("text", F.reverse("text")))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name == "simhash_near_dedup":
            assert out.where("doc_id is null").count() == 3 and out.where("doc_id = 7 and text like '.dias eb%'").count() == 3
        docs = out
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() > 0
