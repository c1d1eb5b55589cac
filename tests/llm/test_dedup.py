"""Exact, line and near deduplication against brute force, on small tables with nulls, ties and repeats."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from granary.llm import exact_dedup, line_dedup, near_copies, simhash
from granary.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row int, uid string, block string, anchor int, key string"


def frame(spark, rows, schema=SCHEMA):
    """Documents with further columns that have the names of the operators' own."""
    return spark.createDataFrame([(i, t, 1, "u", "b", 2, "k") for i, t in rows], schema)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["Äpfel", "tree", "Tree", "x", "ok,", "\x0b", "ÉTÉ", "été"]
    some = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(12)]
    some += ["A" * 5000, "a" * 5000, "a" * 4999 + "b", "ab" * 9000, "", None, "a" * 4096, "a" * 8192]
    return [(rng.choice([None, *range(40)]), rng.choice(some)) for _ in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_matches_brute_force(spark, block):
    rows = texts(1)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = exact_dedup.exact_duplicates(frame(spark, rows), block_bytes=block).collect()
    rank = lambda i: -1 if i is None else i
    want = sorted((rank(i), rank(max(groups[k], key=rank)), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [(t or "").translate(LOWER)])
    assert sorted((rank(r.doc_id), rank(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def brute_lines(rows, min_chars, min_docs):
    at = defaultdict(list)
    keyed = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in lines]
        keyed.append((i, lines, keys))
        for k in set(keys):
            if len(k) >= min_chars:
                at[k].append(-1 if i is None else i)
    out = []
    for i, lines, keys in keyed:
        me = -1 if i is None else i
        kept = [x for x, k in zip(lines, keys, strict=True) if not (len(at.get(k, [])) >= min_docs and max(at[k]) != me)]
        out.append((me, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("most", "keys"), [(line_dedup.MAX_FILTER_BYTES, line_dedup.MAX_KEY_BYTES), (1, 0)])
def test_lines_match_brute_force(spark, most, keys):
    """With the smallest filter and without a broadcast of keys, too."""
    rng = random.Random(2)
    lines = [f"line {k} of some length ÄÖÜ" for k in range(14)] + ["short", "", "  ", "\tLINE 3 of some length ÄÖÜ\x0c"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", *["\n".join(rng.choices(lines, k=rng.randrange(1, 7))) for _ in range(4)]])) for _ in range(80)]
    got = line_dedup.drop_repeated_lines(frame(spark, rows), min_chars=20, min_docs=3, max_filter_bytes=most, max_key_bytes=keys)
    found = sorted((-1 if r.row.doc_id is None else r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect())
    assert found == brute_lines(rows, 20, 3)
    assert any(r[2] for r in found)


def test_the_filters_hold_every_repeated_line_and_few_others(spark):
    """Many lines over several ranges of hashes; a full filter never loses a repeat."""
    docs = [f"a line of its own, number {k:07}, and more\na line of several texts, number {k // 4:07}" for k in range(6_000)]
    table = spark.createDataFrame([(t,) for t in docs], "text string").repartition(5)
    for filter_lines in (line_dedup.FILTER_LINES, 1000):
        bloom = line_dedup.twice_seen(table, 20, filter_lines=filter_lines)
        own, shared = ([next(iter(line_dedup._keys(t.split("\n")[i], 20).values())) for t in docs] for i in (0, 1))
        hit = lambda h: line_dedup._has(bloom, line_dedup._bits(np.array(h, np.uint64), 8 * len(bloom)))
        assert hit(shared).all() and hit(own).mean() < 0.02


def test_string_ids(spark):
    rows = [("b", "the same long line in both"), ("a", "the same long line in both"), (None, "the same long line in both")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = line_dedup.drop_repeated_lines(docs, min_chars=20, min_docs=3).collect()
    assert sorted((r.row.doc_id or "", r.n_dropped) for r in got) == [("", 1), ("a", 1), ("b", 0)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert near_copies.one_of_each(none).columns == none.columns


def print_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_odd_texts():
    for text in ("", None, " \n", "one", "Two WORDS", "ÉTÉ a\x0bb c d É", "w " * 20_000, "a b c d e f g h"):
        assert simhash.fingerprint(text, 3)[0] & (2**64 - 1) == print_of(text, 3)


def test_every_link_of_three_bits_is_found(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints | {0, 1, 7, 2**64 - 1})
    signed = [(k, x - 2**64 if x >= 2**63 else x) for k, x in enumerate(prints)]
    table = np.array(prints, np.uint64)
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(table ^ table[k]) <= 3).tolist():
            a, b = root(k), root(j)
            parent[max(a, b)] = min(a, b)
    for crowd in (simhash.CROWD, 3):  # also with every anchor dealt out in blocks
        links = simhash.links(spark.createDataFrame(signed, "node long, f0 long"), simhash.TIGHT, crowd)
        got = dict(components(links).collect())
        assert [got.get(k, k) for k in range(len(prints))] == [root(k) for k in range(len(prints))]


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(5, k) for k in range(200, 400)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 100 for k in range(100, 181)) and all(got[k] == 5 for k in range(200, 400)) and 7 not in got


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, groups = [], []
    for g in range(20):
        base = [word() for _ in range(200)]
        ids = []
        for c in range(3):
            copy = list(base)
            if c:
                copy[rng.randrange(5, 195)] = word()
            ids.append(len(rows))
            rows.append((len(rows), " ".join(copy).title() if c == 2 else " ".join(copy)))
        groups.append(ids)
    clean = [(len(rows) + k, " ".join(word() for _ in range(150))) for k in range(30)]
    rows += [*clean, (900, None), (901, ""), (902, " "), (None, "another text"), (clean[0][0], clean[0][1])]
    kept = sorted((r.doc_id is not None, r.doc_id) for r in near_copies.one_of_each(frame(spark, rows)).collect())
    ids = [i for there, i in kept if there]
    assert [g[0] for g in groups] == [i for i in ids if i < 60]
    assert [i for i in ids if 60 <= i < 900] == [i for i, _ in clean]
    assert [i for i in ids if i >= 900] == [900] and kept[0] == (False, None)


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    from granary.llm.common import BATCH_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    small_batches(spark.range(1))
    assert spark.conf.get(key) in (str(BATCH_BYTES), f"{BATCH_BYTES}b")
    spark.conf.set(key, "1234567")
    small_batches(spark.range(1))
    assert spark.conf.get(key).startswith("1234567")
    spark.conf.unset(key)
