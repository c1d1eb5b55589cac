"""Resampling, collocations and fewest sequences against brute force and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import collocations as C
from granary.llm import dominance_packing as D
from granary.llm import queries, resampling
from granary.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, uid string, score string, row string, n_words string, bucket string"


def frame(spark, rows):
    """Rows (id, text, lang), with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "u", "s", "r", "n", "b") for r in rows], FIELDS)


@pytest.mark.parametrize("name", ["op11_resampling", "op12_collocations"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, SF)
    assert ours.columns == columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, ours.collect()), key=key) == sorted(theirs.fetchall(), key=key)


# resampling


def plain_resample(docs, target, percent=25, least=20):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(b for d in docs for b in buckets(d[1])), Counter(b for x in target for b in buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, text, *_ in docs:
        b = buckets(text)
        weight = sum(map(gain, b)) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(may):
        r.append(k + 1 if k < percent * len(may) // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=str)


def random_rows(rng, n):
    words = ["Alpha", "beta2", "Ünï", "gamma", "ΣΑΣ", "x", "delta's", "e-f", "it’s", "\x00"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", None])) for i in range(n)]


def test_resampling_by_brute_force(spark):
    rng = random.Random(1)
    rows = [*random_rows(rng, 150), (500, None, "en"), (501, "", "en"), (502, " .,;\n", "en"), (None, "beta2 gamma " * 30, "en"), (7, "twice " * 25, "en"), (7, "twice " * 25, "en"), (503, "long word " * 20_000, "en")]
    target = ["beta2 gamma delta", None, "", "gamma beta2"]
    got = resampling.resample(frame(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target)


def test_resampling_ranks_over_many_partitions(spark):
    """Places in partitions and what comes before them make one gapless rank."""
    rng = random.Random(2)
    rows = [(i, "same text here " * 8, "en") for i in range(3000)] + random_rows(rng, 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = resampling.resample(frame(spark, rows).repartition(9), spark.createDataFrame([("beta2",)], "text string"), percent=50).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    drawn = sorted((r["rank"], r.score, r.doc_id) for r in out if r["rank"] is not None)
    assert [r for r, *_ in drawn] == list(range(1, len(drawn) + 1)) and len(drawn) == sum(r.n_words >= 20 for r in out) // 2
    assert [(-s, i) for _, s, i in drawn] == sorted((-s, i) for _, s, i in drawn)


def test_resampling_of_empty_tables_and_drawn_rows(spark):
    docs, none = frame(spark, random_rows(random.Random(3), 40)), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert resampling.resample(docs, none).count() == 40
    ranks = {r.doc_id: (r.score, r["rank"]) for r in resampling.resample(docs, none).collect() if r["rank"]}
    taken = resampling.drawn_documents(docs, none)
    assert {r.row.doc_id: (r.score, r["rank"]) for r in taken.collect()} == ranks and taken.select("row.*").columns == docs.columns


# collocations


def plain_collocations(rows, least, top=2000, longest=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        found = []
        for p, a in many.items():
            if any(len(q) > len(p) and many[q] * 100 >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in many):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, lft, rgt, n[lang], score) for i, (score, a, p, lft, rgt) in enumerate(found[:top])]
    return sorted(out)


def phrase_rows(rng, n):
    words = ["the", "New", "york", "times", "of\tthe", "é", "ß", "end.", "so,", "a\nb", "x\x1cy", "\x00"]
    out = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]
    return [*out, (900, None, "en"), (901, "", None), (902, "...", "fr"), (903, "in the New york times today " * 3, "en"), (903, "in the New york times today " * 3, "en")]


@pytest.mark.parametrize(("least", "buckets"), [(3, 1 << 16), (8, 1 << 16), (300, 1 << 17)])
def test_collocations_by_brute_force(spark, least, buckets):
    rows = phrase_rows(random.Random(4), 260)
    got = C.collocations(frame(spark, rows).repartition(3), least=least, top=40, buckets=buckets)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, 40)


def test_small_slabs_parts_and_full_buckets_change_nothing(spark, monkeypatch):
    """Slabs end inside pieces and texts, the words' memory is emptied, and every bucket is full: the counts stay exact."""
    rows = phrase_rows(random.Random(5), 120)
    docs = frame(spark, rows)
    texts = docs.selectExpr("coalesce(lang, 'und') lang", "text")
    monkeypatch.setattr(C, "SLAB", 37)
    monkeypatch.setattr(C, "PART", 20)
    monkeypatch.setattr(C, "WORDS", 6)
    for k in (1, 2, 3):
        sums = Counter()
        import pyarrow as pa

        batches = [pa.RecordBatch.from_pylist([r.asDict() for r in texts.collect()])]
        for b in C._grams(k, 5, 2, 1 << 16, None, None)(iter(batches)):
            for r in b.to_pylist():
                if r["phrase"] is not None:
                    sums[r["lang"], r["phrase"]] += r["n"]
        want = Counter()
        for _, text, lang in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
                w = re.findall(r"[^\x20\x09]+", piece)
                want.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
        assert sums == want


def test_bucket_counts_stop_and_add():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 12, 50_000, dtype=np.uint64)
    one, parts = C.Buckets(1 << 10, 100), [C.Buckets(1 << 10, 100) for _ in range(3)]
    one.add(hashes)
    for part, some in zip(parts, np.array_split(hashes, 3), strict=True):
        part.add(some)
    true = np.bincount((hashes & np.uint64(1023)).astype(int), minlength=1024)
    assert (one.counts == np.minimum(true, 100)).all()
    assert ((sum(p.counts.astype(int) for p in parts) >= 100) == (true >= 100)).all()


def test_collocations_without_rows(spark):
    docs = frame(spark, phrase_rows(random.Random(6), 5))
    assert C.collocations(docs.limit(0)).count() == 0
    assert C.collocations(docs).count() == 0
    assert C.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# fewest sequences


def fewest(items, limit):
    """The least number of bins, by trying all sets beside the longest item."""

    @cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        out = len(left)
        for k in range(len(rest) + 1):
            for some in combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in some) <= limit:
                    out = min(out, 1 + best(tuple(x for i, x in enumerate(rest) if i not in some)))
        return out

    return best(tuple(sorted(items, reverse=True)))


def counted(items, limit):
    return [Counter(items)[w] for w in range(limit + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_the_reduction_keeps_a_best_packing(items):
    left = counted(items, 20)
    fixed = D.reduce_by_dominance(left, 20)
    rest = [w for w, n in enumerate(left) for _ in range(n)]
    assert sum(p.times for p in fixed) + fewest(rest, 20) == fewest(items, 20)
    assert all(p.room == 20 - sum(w * n for w, n in p.runs) >= 0 for p in fixed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=200))
def test_equal_pieces_at_once_are_as_one_by_one(items):
    from granary.llm.token_output import best_fit_decreasing

    got = D.best_fit_decreasing(counted(items, 30), 30)
    one_by_one = best_fit_decreasing(items, 30)
    assert sum(p.times for p in got) == len(one_by_one)
    held = Counter()
    for p in got:
        assert sum(w * n for w, n in p.runs) == 30 - p.room <= 30
        for w, n in p.runs:
            held[w] += n * p.times
    assert held == Counter(items)


def test_reduction_by_hand():
    assert D._partners(counted([9], 10), 10, 10) == ()
    assert D._partners(counted([4, 1, 1, 1], 10), 6, 10) == (4,)  # fills it
    assert D._partners(counted([3, 2], 10), 6, 10) == (3,)  # one fits
    assert D._partners(counted([4, 2, 1], 10), 5, 10) == (4,) or D._partners(counted([4, 2, 1], 10), 5, 10) == (4, 1)
    assert D._partners(counted([1, 1, 1, 2], 10), 5, 10) is None


@pytest.mark.parametrize("limit", [16, 2048])
def test_every_id_lies_in_one_place(spark, limit):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["word", "Ünï", "3.5!!", "antidisestablishment"], k=rng.randint(0, 40))), None) for i in range(400)]
    rows += [(None, "no id", "en"), (800, "again", "en"), (800, "again", "en"), (700, None, "en"), (701, "", "en"), (702, "long " * 9000, "en")]
    model = Tokenizer.from_file(default_tokenizer())
    want = sorted((str(i), model.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows)
    out = D.pack_fewest(frame(spark, rows).repartition(4), limit=limit).collect()
    assert out[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    docs, pieces, bins = [], {}, defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.start == r.piece * limit
        bins[r.sequence_id].append((r.offset, r.length))
        pieces.setdefault(str(r.doc_id), []).append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
    for i, found in pieces.items():
        if i == "800":  # two rows of one piece each
            docs += [(i, x) for _, x in found]
        else:
            docs.append((i, [x for _, ids in sorted(found) for x in ids]))
    assert sorted(docs) == want
    total = 0
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= limit
        total += at
    assert len(bins) <= math.ceil(total / limit) * 1.02 + 1


def test_ids_of_other_types_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "name string, body string")
    out = D.pack_fewest(docs, "name", "body", with_ids=False)
    assert out.columns == ["name", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and {r.name for r in out.collect()} == {"a", None}
    assert D.pack_fewest(docs.limit(0), "name", "body").count() == 0
