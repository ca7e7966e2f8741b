"""The whole pipeline against a brute-force version of all its stages."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from test_operators import brute_repeats, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _tables():
    rnd = random.Random(21)

    def prose(n, extra=()):
        w = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        for k, x in enumerate(extra):
            w[10 * k + rnd.randrange(10)] = x
        return w

    item = prose(30)
    shared = prose(70)
    docs = []
    for i in range(120):  # half of them say what the labels call toxic
        w = prose(60, ("vileword", "badword", "hateword") if i % 2 else ())
        docs.append((i, " ".join(w)))
    base = prose(200)
    for i in range(5):  # near copies
        docs.append((200 + i, " ".join([*base[:-i or None], *[f"n{i}_{j}" for j in range(i)]])))
    docs += [(210, " ".join(prose(40) + shared + prose(40))), (211, "\n".join(prose(30) + shared + prose(60))), (211, " ".join(prose(90)))]
    docs += [(220, " ".join(prose(50) + item + prose(50))), (221, " ".join(prose(50) + item[:10] + prose(50))), (None, " ".join(item))]
    docs += [(230, None), (231, ""), (232, " \t\n"), (None, "one two"), (None, "one two"), (233, "one"), (234, "ONE"), (235, "x" * 5000)]
    docs += [(0, docs[0][1]), (2, " ".join(prose(80)))]  # a repeated row, and an id with another text
    labels = [(i, i % 4 // 2, i % 2) for i in range(120)]
    return docs, labels, [(1, " ".join(item)), (2, None), (3, "")]


def _near(a, b):
    x, y = ({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for w in (words(a, True), words(b, True)))
    return 10 * len(x & y) >= 8 * len(x | y)


def _one_per_class(rows):
    kept = [r for r in rows if r[0] is None or not words(r[1])]
    own = sorted({r for r in rows if r[0] is not None and words(r[1])})
    up = list(range(len(own)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if _near(own[a][1], own[b][1]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return kept + [own[x] for x in range(len(own)) if find(x) == x]


def _cut(rows):
    # of each row what brute force keeps; a text that loses nothing stays as it is
    left = Counter({(i, text): n for (i, _, removed, text), n in brute_repeats([(i, t, "") for i, t in rows], 50).items() if removed})
    out = []
    gone = Counter((i, n) for (i, n, removed, _), c in brute_repeats([(i, t, "") for i, t in rows], 50).items() for _ in range(c) if removed)
    for i, t in rows:
        if gone[(i, len(words(t)))]:
            gone[(i, len(words(t)))] -= 1
        else:
            out.append((i, t))
    return out + list(left.elements())


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from fieldwork.llm.packing import decompose
    from fieldwork.llm.tokens import tokenizer_path
    docs, labels, items = _tables()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def holds(t):
        w, x = words(t, True), words(items[0][1], True)
        grams = {tuple(x[j:j + 5]) for j in range(len(x) - 4)}
        return 10 * len(grams & {tuple(w[j:j + 5]) for j in range(len(w) - 4)}) >= 8 * len(grams)

    want = [r for r in docs if "vileword" not in (r[1] or "")]
    assert len(want) == len(docs) - 60
    steps = [want]
    for stage in (_one_per_class, _cut, lambda rows: [r for r in rows if not holds(r[1])]):
        steps.append(stage(steps[-1]))
    assert all(Counter(a) != Counter(b) for a, b in zip(steps, steps[1:]))  # every stage has something to do

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), expected in zip(P.STAGES, steps):
        kept = stage(spark, kept, str(tmp_path)).checkpoint()
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = Counter((r.doc_id, r.text) for r in kept.collect())
        assert got == Counter(expected), name
        assert all(r.text is None or r.n_chars == len(r.text) for r in kept.collect())

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    pieces = Counter()
    for i, t in steps[-1]:
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [1], 0
        for n in decompose(len(ids)):
            pieces[(i, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids))] += 1
            at += n
    out = P.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == pieces
    assert len({r.sequence_id for r in out}) == len(out)

    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
