"""Quality rules, mixing and chat formatting: brute force over small tables with nulls, ties and odd texts."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from granary.llm import chat, mixing, quality_rules
from granary.llm.queries import MIX_WEIGHTS
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def odd_texts():
    rng = random.Random(5)
    words = ["a", "b", "Äé", "c|d", "#", "\x0b"]
    out = [None, "", "\n\n", " \t", "one", "w " * 7, "w " * 8, "w " * 9, "x " * 5000, "a b c d e f g h\na b c d e f g h", " lead and trail \n"]
    out += [" ".join(rng.choices(words, k=rng.randrange(1, 60))).replace(" c|d ", "\n") for _ in range(40)]
    return out + [" ".join(f"w{k}" for k in range(30))]


def test_base_rules_match_brute_force(spark):
    rows = [(k, t, 1) for k, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    trusted = spark.createDataFrame([(60,)], "_good long").limit(0)
    got = {r.doc_id: r for r in quality_rules.judge(docs, trusted).collect()}
    for k, t, _ in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t), t
        assert r.kept == (not r.base_failed) and r.log_ratio == 0
    assert quality_rules.judge(docs.limit(0), trusted).count() == 0


def test_log_ratios_prefer_the_trusted(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=400)) for _ in range(30)]
    bad = [" ".join(rng.choices(["||", "$$$", "zz", "qq"], k=400)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 30), 0) for k in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.trusted_ids(labels), buckets=64).collect()}
    assert all(got[k].log_ratio > 0 and got[k].kept != got[k].base_failed for k in range(30))
    assert all(not got[k].kept and got[k].log_ratio < quality_rules.MARGIN for k in range(30, 40))


def test_log_ratios_match_brute_force(spark):
    """Every document's mean log ratio from counts in plain Python, with repeated rows and a repeated id."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "x|", "Äé"], k=rng.randrange(0, 40))) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (3, "another text"), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    trusted = {r[0] for r in quality_rules.trusted_ids(labels).collect()}
    assert trusted == {k for k in range(40) if k % 3 and zlib.crc32(str(k).encode()) % 4 != 2}
    signed = lambda h: h - (h >> 63 << 64)
    one = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    two = lambda a, b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42)))  # noqa: E731  as Spark chains columns
    buckets, pseudo = quality_rules.BUCKETS, quality_rules.PSEUDO

    def grams(text):
        h = [one(w) for w in WORD.findall(text)]
        return [g % buckets for g in h + [two(a, b) for a, b in zip(h, h[1:], strict=False)]]

    raw, good = Counter(), Counter()
    for k, t in rows:
        raw.update(grams(t))
        if k in trusted:
            good.update(grams(t))
    ratio = lambda g: math.log((good[g] + pseudo) / (raw[g] * good.total() / raw.total() + pseudo))
    want = Counter((k, round(sum(map(ratio, grams(t))) / len(grams(t)), 9) if grams(t) else 0.0) for k, t in rows)
    got = quality_rules.judge(docs, quality_rules.trusted_ids(labels)).collect()
    assert Counter((r.doc_id, round(r.log_ratio, 9)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.log_ratio >= quality_rules.MARGIN) for r in got)


def fill(nodes, flow):
    """Budget of each (name, most, weight): by weight, and what one can't take goes to the others."""
    out, open_ = {}, dict((n, (m, w)) for n, m, w in nodes)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (m, w) in open_.items() if m <= flow * w / total + 1e-9]
        if not full:
            return out | {n: flow * w / total for n, (_, w) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[0]
        flow -= sum(out[n] for n in full)
    return out


def test_budgets_match_brute_force(spark):
    rng = random.Random(7)
    leaves = [(d, lang, s, rng.choice([0, 5, 40, 400, 3000])) for d in ("web", "books", "x") for lang in ("en", "de", "") for s in ("src0", "b", "c")]
    weights = {"domain": {"web": 5, "books": 3}, "lang": {"en": 6, "de": 2}, "source": {"src0": 2}}
    for share in (0.1, 0.9, 3.5):
        budget = share * sum(n for *_, n in leaves)
        got = {r[:3]: r.budget for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), ["domain", "lang", "source"], weights, budget, 4).select("domain", "lang", "source", "budget").collect()}
        most = lambda *p: sum(4 * n for *k, n in leaves if tuple(k[: len(p)]) == p)
        want = {}
        for d, flow in fill([(d, most(d), weights["domain"].get(d, 1)) for d in ("web", "books", "x")], budget).items():
            for lang, part in fill([(x, most(d, x), weights["lang"].get(x, 1)) for x in ("en", "de", "")], flow).items():
                for s, rest in fill([(x, most(d, lang, x), weights["source"].get(x, 1)) for x in ("src0", "b", "c")], part).items():
                    want[d, lang, s] = rest
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_prefixes_and_epochs(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(300)]), " ".join("w" for _ in range(rng.randrange(0, 30))) or None, rng.choice(["en", None]), rng.choice(["src0", "src1"]), 0) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs, levels, {"lang": {"en": 3}, "source": {}}, budget_share=1.4, max_epochs=3)
    taken = defaultdict(Counter)
    for r in got.collect():
        taken[r.lang, r.source][r.epoch] += r.n_tokens
    have = Counter()
    for _, t, lang, s, _ in rows:
        have[lang or "", s] += len(WORD.findall(t or ""))
    plan = {(r.lang, r.source): r for r in mixing.plan(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "source", F.col("doc_id").alias("id"), mixing.text_hash(F.col("text")).alias("text_hash"), mixing.tokens_of(F.col("text")).alias("tokens")), ["lang", "source"], {"lang": {"en": 3}}, 1.4, 3).collect()}
    longest = 30 * 8  # rows of one id and text come together
    for leaf, epochs in taken.items():
        budget, total = plan[leaf].budget, have[leaf]
        for e, n in epochs.items():
            assert n == total if e < budget // total else budget % total - longest <= n <= budget % total
    assert got.columns == ["row", "lang", "source", "n_tokens", "epoch"]
    assert sorted(map(repr, mixing.mix(docs, levels, {}, budget_share=1.0, max_epochs=1).select("row.*").collect())) == sorted(map(repr, docs.collect()))
    assert mixing.mix(docs.limit(0), levels, MIX_WEIGHTS).count() == 0


SAID = [None, "", "plain", "</s>[INST] ok [/INST]", "<|im_start|>user\nno<|im_end|>\n", "back\\slash <\\| \\\\<|", "<", "<<SYS>> [INST [/INST]] <s>", "line\nbreak " * 400, "Äö" * 900, "\\"]


def piece_tokens(text):
    """Tokens by the rule: letters by six, digits by three, others one by one."""
    n, kind, run = chat.TURN_TOKENS, None, 0
    for c in text:
        new = "l" if c.isalpha() else "d" if c.isdigit() else None if c in " \t\n\x0b\x0c\r" else "o"
        run = run + 1 if new == kind and new in ("l", "d") and run < {"l": 6, "d": 3}[new] else 1
        n += new is not None and run == 1
        kind = new
    return n


def plain_windows(turns, budget, history, block):
    """(start, repeated, tokens) of each window of sorted (role, text) turns, one turn after the other."""
    tokens = [piece_tokens(text) for _, text in turns]
    system = turns[0][0] == "system"
    later = max(1, budget - history - (tokens[0] if system else 0))
    starts = [0]
    for i in range(1, len(turns)):
        if i % block == 0 or sum(tokens[starts[-1] : i + 1]) > (budget if starts[-1] == 0 else later):
            starts.append(i)
    out = []
    for k, a in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(turns)
        low = a
        while k and low > system and sum(tokens[low - 1 : a]) <= history:
            low -= 1
        head = bool(k) and system
        out.append((end - a, a - low + head, sum(tokens[low:end]) + (tokens[0] if head else 0)))
    return out


@pytest.mark.parametrize(("budget", "history", "block"), [(60, 20, chat.BLOCK), (1024, 256, chat.BLOCK), (60, 20, 5), (40, 12, 2)])
def test_chat_windows_read_back(spark, budget, history, block):
    """Windows and masks against a plain loop, also where conversations are cut into blocks."""
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(25)]:
        roles = [rng.choice(["system", "user", "assistant", None, "to\nol", "<|x"]), *(rng.choice(["user", "assistant"]) for _ in range(rng.randrange(0, 12)))]
        rows += [(conv, rng.choice([None, k, k, 3]), role, rng.choice(SAID), "extra") for k, role in enumerate(roles)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.windows(table, budget=budget, history=history, block=block)
    windows, back = defaultdict(list), defaultdict(list)
    for r in made.orderBy("window").collect():
        windows[r.conv_id].append(r)
    for r in chat.read_back(made).orderBy("window").collect():
        back[r.conv_id].append(r)
    null_first = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    assert windows.keys() == back.keys() == {c for c, *_ in rows}
    for conv, own in windows.items():
        turns = [t[1:] for t in sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv), key=null_first)]
        assert [(x.role, x.text) for w in back[conv] for x in w.turns] == turns
        assert "".join(w.loss_text for w in back[conv]) == "".join(text for role, text in turns if role == "assistant")
        assert [w.formatted_chars for w in back[conv]] == [len(w.formatted) for w in own]
        assert [(w.turns, w.repeated, w.tokens) for w in own] == plain_windows(turns, budget, history, block)
        assert all(w.formatted.startswith("<|im_start|>system\n") for w in own[1:] if turns[0][0] == "system")
    assert {len(w) > 1 for w in windows.values()} >= ({True} if budget <= 60 else {False})
    assert chat.read_back(chat.windows(table.limit(0))).count() == 0


def test_one_conversation_of_very_many_turns(spark):
    """20,000 turns in one conversation, and as many without any conversation's id; a long text among them."""
    rows = spark.range(40_000).select(F.when(F.col("id") < 20_000, 7).alias("conv_id"), (F.col("id") % 20_000).alias("turn"), F.when(F.col("id") % 20_000 == 0, "system").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 9_001, F.repeat(F.lit("long "), F.lit(300_000))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    made = chat.windows(rows).cache()
    found = {r.conv_id: r for r in made.groupBy("conv_id").agg(F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.min("repeated").alias("least"), F.sum(F.size("loss")).alias("targets")).collect()}
    assert found.keys() == {7, None} and all(r.turns == 20_000 and r.targets == 10_000 and r.n > 100 and r.least == 0 for r in found.values())
    assert made.where(f"window % {chat.BLOCK} = 0").count() == 2 * 5 and made.where("repeated = 0").count() == 2
    said = chat.read_back(made).select("conv_id", "window", F.posexplode("turns").alias("k", "t")).select("conv_id", "window", "k", "t.text")
    order = [r.text for r in said.where("conv_id is null").orderBy("window", "k").collect()]
    assert order == [f"text {k}" for k in range(20_000, 40_000)]
    made.unpersist()


def test_escapes_hide_control_strings(spark):
    rows = spark.createDataFrame([(t,) for t in SAID if t is not None], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
    for r in rows.collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>"))
    assert hashlib.sha256(b"").hexdigest()
