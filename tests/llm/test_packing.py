"""Tokens, windows and matrices: every id in one piece, costs no greater than brute force, exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import packing, token_output
from granary.llm.tokens import WordTokens, default_tokenizer

TEXTS = [None, "", " \n", "One. Two! Three?", "x" * 3000, "Ünï Cödé » “quoted”, don't 3.5!!", "a\x1cb é́ <|endoftext|> tail", "word " * 9000, "ΣΑΣ ſ İ"]


@pytest.fixture(scope="module")
def model():
    return WordTokens(default_tokenizer())


def ids_of(text):
    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(model):
    assert [np.frombuffer(x, "<u2").tolist() for x in model.batch(TEXTS)] == [ids_of(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(model, text):
    assert np.frombuffer(model.batch([text])[0], "<u2").tolist() == model.model.encode(text, add_special_tokens=False).ids


def test_the_memory_of_words_is_bounded(monkeypatch):
    from granary.llm import tokens

    monkeypatch.setattr(tokens, "WORDS", 50)
    monkeypatch.setattr(tokens, "LATER", 20)
    small = WordTokens(default_tokenizer())
    rng = random.Random(0)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdefg", k=5)) + rng.choice(["", ".", ","]) for _ in range(40))
        assert np.frombuffer(small.batch([text])[0], "<u2").tolist() == small.model.encode(text, add_special_tokens=False).ids


def best_cost(places, penalties, window, short):
    """Cost of the best cuts, by trying all windows."""
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = places[j] - places[i]
            if size <= window:
                pad = 0 if size >= 1 << packing.SHORTEST and not size & (size - 1) else window - size
                extra = short if size < window and (j < len(places) - 1 or pad == 0) else 0
                best[j] = min(best[j], best[i] + pad + extra + penalties[j])
    return best[-1]


def test_cuts_cost_no_more_than_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        window = rng.choice([600, 1024, 4096])
        places = [0]
        for _ in range(rng.randrange(1, 40)):
            places.append(places[-1] + rng.randrange(1, window // 3))
        penalties = [rng.choice([0.0, 4.0, 256.0]) for _ in places]
        cuts = packing.choose_cuts(places, penalties, window, 16.0)
        assert cuts[0] == 0 and cuts[-1] == places[-1] and set(cuts) <= set(places)
        cost = 0.0
        for a, b in zip(cuts, cuts[1:], strict=False):
            size = b - a
            assert 0 < size <= window
            free = size >= 1 << packing.SHORTEST and not size & (size - 1)
            cost += (0 if free else window - size) + (16.0 if size < window and (b < places[-1] or free) else 0) + penalties[places.index(b)]
        assert cost <= best_cost(places, penalties, window, 16.0) + 1e-6


def test_every_id_is_in_one_piece(spark):
    rows = [(k if k % 5 else None, t, "s", 1) for k, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    got = packing.pack_documents(docs, chunk=1 << 14).collect()
    want = sorted((-1 if i is None else i, *ids_of(t), packing.END_ID) for i, t, _, _ in rows)
    pieces = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(r.ids) and r.length <= packing.WINDOW
        pieces[r.sequence_id].append((r.offset, r.length))
    for spans in pieces.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    by_doc = defaultdict(list)
    for r in got:
        by_doc[-1 if r.doc_id is None else r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, doc in ((d[0], d[1:]) for d in want):
        if i >= 0:
            assert [x for _, part in sorted(by_doc[i]) for x in part] == list(doc)
    assert sum(r.length for r in got) == sum(len(d) - 1 for d in want)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_best_fit_matches_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        limit = rng.choice([8, 100, 4096])
        lengths = [rng.randrange(1, limit + 1) for _ in range(rng.randrange(1, 80))]
        rooms, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [r for r in rooms if r >= lengths[i]]
            room = min(fits) if fits else limit
            if fits:
                rooms.remove(room)
            rooms.append(room - lengths[i])
            want[i] = room
        bins = token_output.best_fit_decreasing(lengths, limit)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(limit - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


def test_matrices_round_trip(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    matrix = token_output.write_matrix(token_output.token_matrix(docs, length=256, chunk=4000), str(tmp_path / "matrix"))
    found = defaultdict(list)
    for r in matrix.collect():
        ids, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            found[doc].append((start, ids[a:b].tolist()))
    for k, t in rows:
        assert [x for _, part in sorted(found[k]) for x in part] == [*ids_of(t), token_output.END_ID]
    segments = token_output.segments(matrix)
    assert segments.where("not positions_reset").count() == 0 and segments.count() == sum(len(p) for p in found.values())
    assert token_output.token_matrix(docs.limit(0)).count() == 0
