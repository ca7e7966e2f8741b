"""The training-data operators against brute force, round trips and held-out accuracy, on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, digest string, n string"


def words(t, lower=False):
    t = t or ""
    return WORD.findall("".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t))


@pytest.fixture(scope="module")
def odd_docs():
    """Nulls, empty and blank texts, ties, repeated rows, a long text, near and exact copies, clashing extra columns."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(400)}" for _ in range(160)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "two  words"), (7, "two  words"),
            (8, " ".join(base)), (9, "\n".join(base)), (None, " ".join(base)), (40, "é ü " * 30), (41, "123 456 . ,")]
    for i in range(30):  # a group of near copies: links only between some of them
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = f"x{i}_{rnd.randrange(9)}"
        rows.append((10 + i, " ".join(w)))
    long = [f"v{rnd.randrange(3000)}" for _ in range(20_000)]
    rows += [(50, " ".join(long)), (51, " ".join(long[:9000] + ["zz"] + long[9000:])), (52, " ".join(long[500:700] + base[20:90]))]
    return [(i, t, "en", "extra", "extra") for i, t in rows]


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(n)


def brute_classes(rows, k, num, den):
    sets = [(i, frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words(t, True)) else frozenset())
            for i, t, *_ in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


@pytest.mark.parametrize("k,num,den,block", [(3, 90, 100, 1_500_000), (5, 8, 10, 400)])
def test_jaccard_classes(spark, odd_docs, k, num, den, block):
    from fieldwork.llm import ngram_join as N
    small = N.SMALL
    N.SMALL = 4  # long columns occur on small data too
    try:
        got = N.jaccard_classes(frame(spark, odd_docs), k, num, den, block_shingles=block).collect()
    finally:
        N.SMALL = small
    assert Counter(map(tuple, got)) == brute_classes(odd_docs, k, num, den)


def test_jaccard_empty(spark):
    from fieldwork.llm.ngram_join import jaccard_classes
    assert jaccard_classes(frame(spark, [])).collect() == []


def brute_repeats(rows, window):
    seen, out = {}, Counter()
    by_id = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t, *_ in by_id:
        w = words(t)
        for j in range(len(w) - window + 1):
            seen.setdefault(tuple(w[j:j + window]), i)
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1 if i is not None else 0):
            if seen[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("window,phrase,hot", [(50, 16, 2000), (50, 16, 3), (12, 4, 2000)])
def test_remove_repeats(spark, odd_docs, window, phrase, hot):
    from fieldwork.llm.phrase_dedup import remove_repeats
    got = remove_repeats(frame(spark, odd_docs), window, phrase, hot=hot).collect()
    assert Counter((r.rest.doc_id, r.n_words, r.n_removed, r.text) for r in got) == brute_repeats(odd_docs, window)
    assert {r.rest.digest for r in got} == {"extra"}


def test_remove_repeats_empty(spark):
    from fieldwork.llm.phrase_dedup import remove_repeats
    assert remove_repeats(frame(spark, [])).collect() == []


TRICKY = [None, "", " ", "   ", "  a  b \n c\n\n d   e\t f  ", "a\x85 b   c   d", "it's  we'll 12 345\r\n \r\n z", "\x1c a \x1d  b",
          "é ̈x  ΑΣ Σ", "<|endoftext|> a <|endoftext|>", "a\x00 b c", " it's, don't... .,. word. word,. É é Ünder ünder, ÀB ªº ıİ ǆ ǅ straße. ﬁ naïve café.",
          "x" * 5000, "日本語 テキスト、です。 👍🏽 ok"]


@pytest.mark.parametrize("vocab", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_fast_tokenising_equals_the_library(spark, vocab):
    from fieldwork.llm.tokens import Encoder
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    enc = Encoder(vocab)
    got = [x.tolist() for _, _, part in enc.encode_column(pa.array(texts)) for x in part]
    assert got == [e.ids for e in enc.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pack(spark, odd_docs):
    from fieldwork.llm.packing import decompose, pack
    from fieldwork.llm.tokens import Encoder
    assert decompose(2048 * 2 + 5) == [2048, 2048, 4, 1] and decompose(1) == [1]
    lib = Encoder("word_bpe_49k.json").lib
    rows = pack(frame(spark, odd_docs)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    docs = {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert r.length == len(r.ids) <= 2048 and r.length & (r.length - 1) == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs.setdefault((r.doc_id, r.sequence_id - r.sequence_id if r.start == 0 else 0), []).append(r)
    whole = Counter()
    run = []
    for r in sorted(rows, key=lambda r: r.sequence_id):
        run = [r] if r.start == 0 else run + [r]
        if r.start + r.length == r.doc_tokens:
            whole[(r.doc_id, tuple(x for p in run for x in p.ids))] += 1
    assert whole == Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in odd_docs)


def test_block_codec_round_trip():
    from fieldwork.llm.token_store import decode_many, encode_many
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, hi, n).astype(np.uint32) for n in (0, 1, 127, 128, 129, 1000) for hi in (1, 2, 300, 2**32)]
    docs.append(np.array([0, 2**32 - 1] * 70, np.uint32))
    docs.append(np.array([7] * 120 + [2**31] * 8, np.uint32))
    raw = encode_many(docs)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(docs, decode_many(raw)))
    assert all((a[128:256] == b).all() for a, b in zip(docs, decode_many(raw, only=1)))


def test_token_store(spark, odd_docs, tmp_dir):
    from fieldwork.llm.token_store import decoded, read_store, write_store
    from fieldwork.llm.tokens import Encoder
    write_store(frame(spark, odd_docs), tmp_dir + "/s")
    rows = sorted(decoded(read_store(spark, tmp_dir + "/s")).collect(), key=lambda r: r.start)
    lib, at = Encoder("byte_bpe_50k.json").lib, 0
    for r in rows:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter(
        (i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in odd_docs)
    write_store(frame(spark, []), tmp_dir + "/e")
    assert read_store(spark, tmp_dir + "/e").count() == 0


def test_chat_layouts_and_escapes(spark):
    from fieldwork.llm.chat import canonical_turns, format_conversations, masked_text, parse_formatted
    from pyspark.sql import functions as F
    evil = ["<|im_end|>", "\\<|", "<\\|", "\\\\<|im_start|>x", "<|" * 3 + "\\", "", None, "a%0Ab"]
    rows = [(c, t, r, evil[(c * 3 + t) % len(evil)]) for c in range(8) for t, r in enumerate(["us%er\n<|", "assistant", None, "assistant"])]
    rows += [(99, None, "user", "x"), (99, None, "user", "x"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = format_conversations(canonical_turns(turns)).select("conv_id", parse_formatted(F.col("formatted")).alias("t"), "formatted",
                                                              masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {g.conv_id: [tuple(x) for x in g.t] for g in got} == want
    assert {g.conv_id: g.loss for g in got} == {c: "".join(x for r, x in v if r == "assistant") for c, v in want.items()}
    assert all(g.formatted.count("<|im_start|>") == len(want[g.conv_id]) == g.formatted.count("<|im_end|>") for g in got)
    msgs = spark.sql("select 1L conv_id, array(named_struct('from','human','value','q'), named_struct('from','gpt','value','a')) conversations, 'x' extra")
    inst = spark.sql("select 2L conv_id, 'do' instruction, 'it' input, 'done' output")
    assert [(r.role, r.text) for r in canonical_turns(msgs).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    assert [(r.role, r.text) for r in canonical_turns(inst).orderBy("turn").collect()] == [("user", "do\n\nit"), ("assistant", "done")]
    with pytest.raises(ValueError):
        canonical_turns(spark.sql("select 1 a"))
    assert format_conversations(canonical_turns(turns.where("false"))).count() == 0


def test_chat_mixed_table(spark):
    from fieldwork.llm.chat import canonical_turns
    rows = [(1, [("user", "q"), ("assistant", "a")], None, None, None), (2, None, "p", "c", None), (3, [], "p3", "c3", None),
            (4, None, "p4", "c4", "s4"), (5, None, "p5", None, None), (6, [("user", "only")], None, "", None), (7, [], None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, messages array<struct<role string, content string>>, prompt string, completion string, system string")
    got = {}
    for r in canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {
        1: [("user", "q"), ("assistant", "a")], 2: [("user", "p"), ("assistant", "c")], 3: [("user", "p3"), ("assistant", "c3")],
        4: [("system", "s4"), ("user", "p4"), ("assistant", "c4")], 5: [("user", "p5"), ("assistant", "")], 6: [("user", "only")]}


def test_contaminated(spark, odd_docs):
    from fieldwork.llm.decontam import clean_documents, contaminated
    base = words(next(t for i, t, *_ in odd_docs if i == 8))
    items = [(1, " ".join(base[30:60])), (2, " ".join(base[40:60] + ["q"])), (3, "one"), (4, None), (5, ""), (6, "two words"),
             (6, "two words"), (None, "one"), (7, " ".join(base[5:15] + list("abcdefgh")))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")

    def grams(w, k):
        return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if k else set()
    want = set()
    for i, t, *_ in odd_docs:
        for n, x in items:
            w = words(x, True)
            k = min(5, len(w))
            if i is None or n is None or not w:
                continue
            g = grams(w, k)
            shared = len(g & grams(words(t, True), k))
            if shared * 10 >= len(g) * 8:
                want.add((i, n, shared, len(g)))
    got = contaminated(frame(spark, odd_docs), bench).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) and want
    # rows are judged one by one: null ids, and a clean text under the id of a contaminated one
    rows = odd_docs + [(min(w[0] for w in want), "a clean text", "en", "extra", "extra"), (None, "clean too", "en", "extra", "extra")]

    def holds(t):
        for n, x in items:
            w = words(x, True)
            k = min(5, len(w))
            if n is not None and w and len(grams(w, k) & grams(words(t, True), k)) * 10 >= len(grams(w, k)) * 8:
                return True
        return False

    left = clean_documents(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((i, t) for i, t, *_ in rows if not holds(t))
    assert clean_documents(frame(spark, []), bench).count() == 0
    assert contaminated(frame(spark, []), bench).count() == 0 and contaminated(frame(spark, odd_docs), bench.where("false")).count() == 0


def test_lm_score(spark, odd_docs):
    from fieldwork.llm.lm_score import score
    from fieldwork.llm.common import longs, text_words
    target = [t for i, t, *_ in odd_docs if i in (8, 4, 50)]
    size = 500
    got = score(frame(spark, odd_docs), spark.createDataFrame([(t,) for t in target], "text string"), size=size).collect()
    texts = [words(t, True) for _, t, *_ in odd_docs]
    count = Counter(w for t in texts for w in t)
    uniq = list(count)
    hashes = {}
    for i, j, h, _, _ in text_words(pa.array(uniq), False):
        hashes |= dict(zip(uniq[i:j], longs(h).tolist()))
    top = set(sorted(count, key=lambda w: (-count[w], hashes[w]))[:size])

    def model(texts):
        uni, two = Counter(), Counter()
        for t in texts:
            s = ["<s>"] + [w if w in top else None for w in t] + ["</s>"]
            uni.update(s)
            two.update(zip(s, s[1:]))
        return uni, two
    models = model([words(t, True) for t in target]), model(texts)
    want = []
    for (i, *_), t in zip(odd_docs, texts):
        s, ce = ["<s>"] + [w if w in top else None for w in t] + ["</s>"], []
        for uni, two in models:
            n = sum(uni.values()) - uni["<s>"]
            ce.append(-sum(math.log(0.7 * two[a, b] / max(uni[a], 1) + 0.3 * (uni[b] + 1) / (n + len(top) + 2)) for a, b in zip(s, s[1:])) / (len(s) - 1))
        want.append((i or -1, len(s) - 1, round(ce[0], 9), round(ce[1], 9), round(ce[0] - ce[1], 9)))
    assert sorted((r.doc_id or -1, r.n_tokens, *(round(x, 9) for x in r[2:])) for r in got) == sorted(want)
    assert score(frame(spark, []), spark.createDataFrame([], "text string")).count() == 0


def test_lm_score_keeps_every_word(spark):
    """More distinct words than any fixed vocabulary: each keeps its own counts, in as many parts as the tokens ask for."""
    from fieldwork.llm import lm_score
    rare = [f"r{i}" for i in range(70_000)]
    texts = [" ".join(rare), " ".join(rare[60_000:]), "r69998 r69999", "r1 r69999 new", None]
    target = ["r69998 r69999", "unseen r69998"]
    old = lm_score.PART_KEYS, lm_score.BATCH_BYTES
    lm_score.PART_KEYS, lm_score.BATCH_BYTES = 9_000, 1000  # many parts, several batches
    try:
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
        got = {r.doc_id: r for r in lm_score.score(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()}
        kinds = len({w for t in texts for w in words(t, True)}) + 2
        ce = []
        for corpus in (target, texts):
            uni, two = Counter(), Counter()
            for t in corpus:
                s = ["<s>", *words(t, True), "</s>"]
                uni.update(s)
                two.update(zip(s, s[1:]))
            n = sum(uni.values()) - uni["<s>"]
            ce.append([])
            for t in texts:
                s = ["<s>", *words(t, True), "</s>"]
                ce[-1].append(-sum(math.log(0.7 * two[a, b] / max(uni[a], 1) + 0.3 * (uni[b] + 1) / (n + kinds)) for a, b in zip(s, s[1:])) / (len(s) - 1))
        marked = {tuple(r) for r in lm_score.score(docs, spark.createDataFrame([(1,), (3,), (9,)], "doc_id long")).collect()}
        same = {tuple(r) for r in lm_score.score(docs, docs.where("doc_id in (1, 3)").select("text")).collect()}
    finally:
        lm_score.PART_KEYS, lm_score.BATCH_BYTES = old
    assert lm_score.part_count(spark, 10**10) == 5000 and lm_score.part_count(spark, 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert marked == same and len(got) == len(marked) == len(texts)
    for i in range(len(texts)):
        assert got[i].ce_target == pytest.approx(ce[0][i], rel=1e-9) and got[i].ce_background == pytest.approx(ce[1][i], rel=1e-9)


def test_language_id(spark):
    from fieldwork.llm.lang_id import predict, train
    from fieldwork.llm.queries import queries
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries()["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == 1000
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    model = train(docs.where("doc_id < 300"), rows_per_lang=50)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ,."), (None, "the thing"), (5, "x"), (5, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.lang_pred) for r in predict(odd, model).collect())
    assert [p for _, p in got if p != "und"] and [i for i, p in got if p == "und"] == [1, 2, 3]
    none = train(docs.where("false"))
    assert {r.lang_pred for r in predict(odd, none).collect()} == {"und"}
    # clashing columns, null languages, a very long text, an empty table, repeated and null ids
    wide = docs.where("doc_id < 300").selectExpr("doc_id", "text", "if(doc_id < 5, null, lang) as lang", "lang as lang_pred", "0.5D as score", "text as h")
    again = train(wide.unionByName(wide.where("doc_id < 40")).unionByName(wide.where("doc_id = 41").selectExpr("null as doc_id", "text", "lang", "lang_pred", "score", "h")), 50)
    long = spark.createDataFrame([(1, " ".join(r.text for r in docs.where("lang = 'de'").limit(40).collect()) * 20, "x", 1.0)],
                                 "doc_id long, text string, lang string, score double")
    assert [r.lang_pred for r in predict(long, again).collect()] == ["de"] and predict(long.where("false"), again).count() == 0


def test_language_sample_is_bounded_and_even(spark):
    from fieldwork.llm.lang_id import _sampled
    rows = spark.range(9000).selectExpr("id as doc_id", "if(id % 100 = 0, 'b', 'a') as lang", "concat('t', id) as text")
    hot = rows.unionByName(spark.range(3000).selectExpr("7 as doc_id", "'a' as lang", "'t7' as text"))
    got = Counter(r.lang for r in _sampled(hot, 200).collect())
    assert got == {"a": 200, "b": 90}


def test_toxicity(spark):
    from fieldwork.llm.toxicity import clean_of_toxic, score, train
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs.where("doc_id % 2 = 0"), labels)
    rows = score(docs.where("doc_id % 2 = 1"), model).select("doc.doc_id", "rejected", "p").join(labels, "doc_id").collect()
    hit = sum(r.rejected and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.75 and hit / sum(r.rejected for r in rows) > 0.9
    odd = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (3, "you idiot " * 5000, "c")], "doc_id long, text string, rejected string")
    assert score(odd, model).count() == 3 and clean_of_toxic(odd, labels.where("false")).columns == odd.columns
    assert clean_of_toxic(odd, labels.where("false")).count() == 3
    assert score(odd.where("false"), model).count() == 0


def test_toxicity_sample_bound(spark):
    from fieldwork.llm.toxicity import MAX_ROWS, labelled_sample
    docs = spark.range(20_000).selectExpr("id as doc_id", "'a b' as text")
    labels = docs.selectExpr("doc_id", "doc_id % 9 = 0 as toxic", "1 as quality")
    assert labelled_sample(docs, labels, MAX_ROWS).count() == 16_000
    # the bound is on rows: ids with many rows, repeated or not, and contradictory labels
    many = docs.unionByName(docs.where("doc_id < 400").selectExpr("doc_id", "concat('c', doc_id) as text")).unionByName(docs)
    both = labels.unionByName(labels.selectExpr("doc_id", "not toxic as toxic", "0 as quality"))
    some = labelled_sample(many.where("doc_id < 400"), both, 1000)
    assert some.count() == 1000 and {tuple(r.y) for r in some.select("y").distinct().collect()} == {(1, 1, 0)}


def test_toxicity_chain_equals_plain_loops():
    """Accelerated gradient descent written out with lists; folds, thresholds and the handed-on probabilities."""
    from fieldwork.llm.toxicity import CHAIN, _prob, fit_chain
    rnd = random.Random(12)
    rows = [[rnd.random() if rnd.random() < 0.4 else 0.0 for _ in range(4)] for _ in range(60)]
    y = [[int(r[0] + r[1] > 0.5), int(r[0] > 0.4), int(r[0] > 0.4 and r[2] > 0)] for r in rows]
    fold = [i % 3 for i in range(60)]

    def fit(x, t, use):
        v = [1.0] * len(x[0])
        for _ in range(8):
            xv = [sum(a * b for a, b in zip(r, v)) * u for r, u in zip(x, use)]
            v = [sum(r[j] * c for r, c in zip(x, xv)) for j in range(len(v))]
            top = math.sqrt(sum(a * a for a in v))
            v = [a / (top or 1.0) for a in v]
        n, step = sum(use), 1 / ((top + sum(use)) / 4 + 3.0)
        rate = sum(a * u for a, u in zip(t, use)) / n
        w = old = [0.0] * len(v) + [math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))]
        for k in range(120):
            z = [a + (a - b) * k / (k + 3) for a, b in zip(w, old)]
            miss = [(prob(r, z) - a) * u for r, a, u in zip(x, t, use)]
            grad = [sum(r[j] * m for r, m in zip(x, miss)) + 3.0 * z[j] for j in range(len(v))] + [sum(miss)]
            old, w = w, [a - step * g for a, g in zip(z, grad)]
        return w

    def prob(r, w):
        return 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(r, w)) + w[-1]))))

    x, want, seen = [list(r) for r in rows], [], []
    for c in range(3):
        t = [r[c] for r in y]
        held = [0.0] * 60
        for f in range(3):
            w = fit(x, t, [float(g != f) for g in fold])
            for i in range(60):
                if fold[i] == f:
                    held[i] = prob(x[i], w)
        want.append(fit(x, t, [1.0] * 60))
        seen.append(held)
        x = [[*r, h] for r, h in zip(x, held)]
    mat = np.zeros((60, 7), np.float32)
    mat[:, :4] = rows
    model = fit_chain(mat, np.array(y), np.array(fold))
    for c in range(3):
        assert np.allclose(model["weights"][c], want[c], atol=2e-3)
        assert np.allclose(mat[:, 4 + c], seen[c], atol=1e-3)
        assert np.allclose(_prob(mat[:, :4 + c], model["weights"][c]), [prob(r[:4 + c], want[c]) for r in x], atol=1e-3)
    cut = sorted({0.0, *seen[1]})
    f1 = max(2 * sum(p >= a and r[1] for p, r in zip(seen[1], y)) / (sum(p >= a for p in seen[1]) + sum(r[1] for r in y)) for a in cut)
    got = [p >= model["threshold"] for p in seen[CHAIN.index("toxic")]]
    assert math.isclose(f1, 2 * sum(g and r[1] for g, r in zip(got, y)) / (sum(got) + sum(r[1] for r in y)))


def test_ftrl_equals_plain_loops():
    """Follow the regularised leader per feature and class, in dictionaries."""
    from fieldwork.llm.lang_id import BUCKETS, ftrl, gram_buckets
    texts = ["der hund und die katze", "the dog and the cat", "le chien et le chat", "und der", "and the", "et le chat"] * 3
    y = [0, 1, 2, 0, 1, 2] * 3
    rows = []
    for t in texts:
        grams, _ = gram_buckets([t])
        codes = Counter(int(b) for g in grams for b in g)
        at = sorted(codes)
        rows.append((np.array([*at, BUCKETS]), np.array([*[codes[b] / 10 for b in at], 1.0])))
    got = ftrl(rows, np.array(y), 3)
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.5

    def weight(k):
        zz = z.get(k, 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - math.copysign(l1, zz)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    order, rng = np.arange(len(rows)), np.random.Generator(np.random.PCG64(5))
    for _ in range(3):
        rng.shuffle(order)
        for r in order.tolist():
            w = {(int(f), c): weight((int(f), c)) for f in rows[r][0] for c in range(3)}
            s = [sum(v * w[int(f), c] for f, v in zip(*rows[r])) for c in range(3)]
            e = [math.exp(a - max(s)) for a in s]
            for f, v in zip(*rows[r]):
                for c in range(3):
                    k, g = (int(f), c), v * (e[c] / sum(e) - (y[r] == c))
                    before = n.get(k, 0.0)
                    n[k] = before + g * g
                    z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(before)) / alpha * w[k]
    assert all(abs(got[f, c] - weight((f, c))) < 1e-9 for f, c in z)
    assert np.count_nonzero(got) == sum(weight(k) != 0 for k in z) > 20


def test_nearest(spark):
    from fieldwork.llm.ann import nearest
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[200:700] = x[3]  # a very common vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] + [1.0] * 15, 0), (None, x[1].tolist(), 0),
             (5150, [None] + [1.0] * 15, 0), (5200, [], 0), (50, x[50].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in nearest(df, max_lists=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 1500, 50):
        s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        s = np.round(s, 12)
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s))[:5].tolist()
        mine = [v for _, v, _ in sorted(got[q])]
        assert [n for n, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5] and q not in mine
        hit, total = hit + len(set(best) & set(mine)), total + 5
        assert all(abs(t - s[v]) < 1e-9 for _, v, t in got[q])
    assert set(got) == set(range(0, 1500, 50)) and hit / total >= 0.9
    assert nearest(df.where("false")).count() == 0 and nearest(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_nearest_of_extreme_and_odd_vectors(spark):
    """Components far from one, one id with two vectors, other lengths, clashing columns: against brute force."""
    from fieldwork.llm.ann import nearest
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    x[:8] *= 1e200
    x[8:16] *= 1e-200
    rows = [(i, v.tolist(), 0, 0.5) for i, v in enumerate(x)] + [(5, x[20].tolist(), 0, 0.5), (70, [1.0] * 5, 0, 0.5), (80, [2.0] * 7, 0, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    got = {}
    for r in nearest(df, every=10, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    near_one = [(i, np.array(v) / np.abs(v).max()) for i, v, *_ in rows if len(v) == 6]
    unit = [(i, v / np.linalg.norm(v)) for i, v in near_one]
    for q, u in unit:
        if q % 10 == 0:
            best = {}
            for i, v in unit:
                if i != q:
                    best[i] = max(best.get(i, -2.0), float(u @ v))
            want = sorted(best.items(), key=lambda t: (-round(t[1], 12), t[0]))[:5]
            assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want]
            assert all(abs(s - t) < 1e-12 for (_, _, s), (_, t) in zip(sorted(got[q]), want))
    assert set(got) == {0, 10, 20, 30, 40, 50}


def test_pipeline_and_op5_hold_the_sequences(spark):
    import glob

    import corpus_pipeline as P
    from fieldwork.llm.queries import queries
    from fieldwork.llm.packing import read_buckets
    from fieldwork.session import ensure_checkpoint_dir, local_path
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = P.pack_documents(spark, docs, SF).collect()
    assert rows and all(len(r.ids) == r.length and r.ids_crc32 == crc(r.ids) for r in rows)
    before = set(glob.glob(f"{local_path(ensure_checkpoint_dir(spark))}/fieldwork-scratch/packed-*"))
    got = queries()["op5_packing"](spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    new, = set(glob.glob(f"{local_path(ensure_checkpoint_dir(spark))}/fieldwork-scratch/packed-*")) - before
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset)
    assert sorted(map(key, got.collect())) == sorted(map(key, rows))
    assert sorted((r.sequence_id, crc(r.ids)) for r in read_buckets(spark, new).collect()) == sorted((r.sequence_id, r.ids_crc32) for r in rows)


def test_one_per_class_judges_rows(spark):
    """Repeated ids with different texts, null ids, texts without words: against brute force."""
    import corpus_pipeline as P
    rnd = random.Random(3)
    base = [[f"{p}{rnd.randrange(900)}" for _ in range(80)] for p in "abc"]
    near = [" ".join([*b[:-1], "zz"]) for b in base]
    a, b, c = (" ".join(x) for x in base)
    rows = [(3, a), (5, near[0]), (5, b), (9, near[1]), (7, c), (7, c), (8, near[2]), (8, near[2]), (4, near[2]), (None, a), (None, a),
            (None, None), (None, None), (None, ""), (20, ""), (20, ""), (21, None), (21, None), (22, " \t"), (30, "short"), (31, "SHORT")]
    want = Counter((i, t) for i, t in rows if i is None or not words(t))
    own = sorted({(i, t) for i, t in rows if i is not None and words(t)})
    sets = [frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) for w in (words(t, True) for _, t in own)]
    up = list(range(len(own)))
    for _ in own:
        for x, s in enumerate(sets):
            for y, t in enumerate(sets):
                if 10 * len(s & t) >= 8 * len(s | t):
                    up[x] = up[y] = min(up[x], up[y])
    want.update(own[x] for x in range(len(own)) if up[x] == x)
    docs = spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id long, text string, key string, row string").repartition(3)
    got = P.one_per_class(spark, docs, SF)
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert want[(5, b)] == 1 and want[(None, None)] == 2 and P.one_per_class(spark, docs.where("false"), SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count()
    assert P.run(spark, SF).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


@pytest.mark.parametrize("key", ["op7_chat_format", "op10_decontamination"])
def test_oracle(spark, key):
    from fieldwork.llm.queries import oracle_sql, queries
    from oracle_check import compare, duck_conn
    r = compare(spark, SF, key, queries()[key], oracle_sql()[key], duck_conn(SF))
    assert r["status"] == "ok", r


def test_nearest_keeps_one_copy_of_a_vector(spark):
    """Scratch tables hold each vector once, queries and the sample besides, and no copy for each posting list."""
    import glob

    from fieldwork.llm.ann import nearest
    from fieldwork.session import ensure_checkpoint_dir, local_path
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    before = set(glob.glob(f"{local_path(ensure_checkpoint_dir(spark))}/fieldwork-scratch/ann-*"))
    got = {}
    for r in nearest(df, every=100, sample=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    made = set(glob.glob(f"{local_path(ensure_checkpoint_dir(spark))}/fieldwork-scratch/ann-*")) - before
    assert sum(spark.read.parquet(f"file://{p}").count() for p in made) <= 3000 + 30 + 2 * 4 * 500 ** 0.5
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -9
        hit += len({v for _, v in got[q]} & set(np.argsort(-s)[:5].tolist()))
    assert set(got) == set(range(0, 3000, 100)) and hit >= 0.9 * 150


def test_nearest_among_pieces_and_one_id_of_many_vectors(spark, monkeypatch):
    """Shelves dealt to pieces and cuts, and an id whose vectors are all nearer than the others': against brute force."""
    from fieldwork.llm import ann
    monkeypatch.setattr(ann, "PIECE", 16)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, (x[0] + rng.normal(size=6) * 1e-3).tolist()) for _ in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, every=4, k=5, max_lists=3, ratio=1e9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows]
    for q in range(0, 400, 4):
        best = {}
        for i, v in unit:
            if i != q:
                best[i] = max(best.get(i, -2.0), float(unit[q][1] @ v))
        assert [i for _, i in sorted(got[q])] == sorted(best, key=lambda i: -best[i])[:5]
