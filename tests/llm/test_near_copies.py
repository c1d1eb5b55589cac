"""The pipeline's near-duplicate stage against the similarity that it states."""

import random

import numpy as np
import pytest

from granary.llm import near_copies, simhash


def pair(rng, shared, union):
    """Two texts whose sets of five-word shingles share so many of so many."""
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    n = (shared + union) // 2
    base = [word() for _ in range(n + 4)]
    return " ".join(base), " ".join(base[: shared + 4] + [word() for _ in range(n - shared)])


def roots(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    return dict(near_copies.near_copies(frame).collect())


#: Documents for which the search's code is fitted: the test's own number, and 10**9.
@pytest.mark.parametrize("size", [None, 10**9])
def test_planted_pairs_of_the_similarity_are_found(spark, size):
    """All pairs, by brute force over how they were made: 300 each of similarity 0.80, 0.82 and 0.85."""
    rng = random.Random(5)
    levels = ((160, 200), (82, 100), (170, 200))
    texts = [t for shared, union in levels for _ in range(300) for t in pair(rng, shared, union)]
    frame = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    found = dict(near_copies.near_copies(frame, code=size and simhash.covering_for(size)).collect())
    assert all(found[k] in (k, k // 2 * 2) for k in range(len(texts)))  # and nothing else is linked
    for level in range(3):
        caught = np.mean([found[k] == k - 1 for k in range(600 * level + 1, 600 * (level + 1), 2)])
        assert caught >= 0.97, (size, levels[level], caught)


def test_coded_bits_share_an_anchor_as_often_as_the_code_is_made_for():
    rng, code = np.random.default_rng(1), simhash.Covering(1, 1, 4, 0, 0)
    x = rng.integers(0, 1 << 15, 20_000)
    flips = (rng.random((20_000, 15)) < simhash.FLIP) @ (1 << np.arange(15))
    one, other = simhash.anchors(x, code), simhash.anchors(x ^ flips, code)
    met = np.mean([len(np.intersect1d(a[m], b[k])) > 0 for a, m, b, k in zip(*one, *other, strict=True)])
    assert abs(met - simhash.MEET) < 0.01 and abs(one[1].sum() / len(x) - simhash.ANCHORS) < 0.1


def test_a_crowded_family_is_compared_in_blocks(spark):
    """A family of near copies around one text and a few chains; blocks of a handful of documents change nothing."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    families = spark.createDataFrame([(k, 0, len(t)) for k, t in enumerate(texts)], "node long, family long, chars long")
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    want = brute(texts)
    for crowd, bulk in ((1000, 1 << 30), (8, 1 << 30), (1000, 9000)):
        got = dict(near_copies.components(near_copies.true_links(families, nodes, 5, crowd, bulk)).collect())
        assert [got.get(k, k) for k in range(len(texts))] == want


def brute(texts):
    """The smallest text that each reaches over pairs of similarity 0.8 and more, by comparing all pairs."""
    sets = [set(near_copies.shingles(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for k in range(len(texts)):
        for j in range(k):
            if sets[k] == sets[j] or (sets[k] & sets[j] and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])):
                low, high = sorted((label[k], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_pairs_and_families_below_the_similarity_stay(spark):
    rng = random.Random(6)
    texts = [t for shared, union in ((158, 200), (150, 200), (140, 200)) for _ in range(40) for t in pair(rng, shared, union)]
    base = pair(rng, 1, 1)[0].split() + [f"common{k}" for k in range(149)]  # a template: 145 shingles in common of 195 in all
    texts += [" ".join(base + [f"own{c}x{k}" for k in range(25)]) for c in range(40)]
    assert all(k == root for k, root in roots(spark, texts).items())


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3)] + [f"v{k}" for k in range(3000)]
    texts = ["", None, "one", "One", "w0 w0 w0", "a b c d e e e e e e e e e", "b c d e e e e e e e e e"]
    for _ in range(12):
        copy = rng.sample(words, rng.randrange(6, 90))
        for _ in range(14):  # each differs from the one before, so that they chain
            copy = list(copy)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    found, label = roots(spark, texts), brute(texts)
    assert [found[k] for k in range(len(texts))] == label


def test_rows_without_an_id_or_with_a_repeated_one_count_by_their_texts(spark):
    rng = random.Random(8)
    (copy, near), (a, b), (c, d), (e, _) = (pair(rng, shared, 200) for shared in (190, 0, 0, 0))
    rows = [(None, a), (None, b), (5, c), (5, d), (1, copy), (5, near), (None, e), (None, e), (3, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {(r.doc_id, r.text) for r in near_copies.one_of_each(docs).collect()}
    assert kept == {(None, a), (None, b), (5, c), (5, d), (1, copy), (3, e)}


def test_open_documents_meet_all_others_once_in_tasks_of_two_blocks(spark):
    """The rows that a task of the second pass receives don't grow with the family; each pair with an open document meets once."""
    for n, closed in ((600, 0), (1200, 0), (600, 450), (40, 0)):
        members = spark.createDataFrame([(k, 0, 1000, k >= closed) for k in range(n)], "node long, family long, chars long, open boolean")
        tasks = {}
        for r in near_copies.open_pairs(members, 100, 1 << 30).collect():
            for b in r.blocks:
                tasks.setdefault(b.block, []).append((r.node, r.open, b.side))
        assert max(map(len, tasks.values())) <= 2 * 150
        met = {}
        for rows in tasks.values():
            for i, (a, free_a, side_a) in enumerate(rows):
                for b, free_b, side_b in rows[:i]:
                    if (free_a or free_b) and (side_a == 0 or side_a != side_b):
                        met[max(a, b), min(a, b)] = met.get((max(a, b), min(a, b)), 0) + 1
        assert set(met.values()) == {1} and len(met) == n * (n - 1) // 2 - closed * (closed - 1) // 2
    members = spark.createDataFrame([(k, 0, 1000, k > 3) for k in range(40)], "node long, family long, chars long, open boolean")
    assert near_copies.open_pairs(members.where("not open"), 10, 1 << 30).count() == 0
    sizes = [len(r.blocks) for r in near_copies.open_pairs(members, 1000, 9000).collect()]
    assert max(sizes) == 5  # 36 open documents of 1000 characters are four blocks, the others one
