"""Centroid clustering, fingerprint near duplicates and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import xxhash
from test_operators import SCHEMA, frame, odd_docs, words  # noqa: F401  (odd_docs is a fixture)

VECTORS = "vec_id long, embedding array<double>, label int, cluster string"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ centroid clustering

def brute_clusters(rows, k, rounds, dims, seed):
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    at, top = assign(), 2 ** 63 - 1
    per = Counter()
    for d, c in at:
        per[c] += min(d, top)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, min(d, top), min(per[c], top), min(sum(per.values()), top), sha[c]) for (i, _), (d, c) in zip(kept, at)), key=repr)


CLUSTER_COLS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_hilbert_curve_moves_by_one_step():
    from fieldwork.llm.zone_clusters import hilbert_keys
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_boxes_keep_every_nearest_centroid():
    from fieldwork.llm.zone_clusters import box_candidates
    rng = np.random.default_rng(3)
    dropped = 0
    for _ in range(200):
        cents = rng.integers(-40, 40, (8, 3)).astype(float)
        x = rng.integers(-40, 40, 3) + rng.integers(-6, 7, (20, 3)).astype(float)
        some = box_candidates(x.min(0), x.max(0), cents)
        d = ((x[:, None] - cents) ** 2).sum(2)
        assert set(np.nonzero(d == d.min(1, keepdims=True))[1]) <= set(some)
        dropped += 8 - len(some)
    assert dropped > 600


def test_clusters_equal_brute_force(spark):
    from fieldwork.llm.zone_clusters import cluster
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(i % 3, 0.2) for _ in range(6)], 1, "x") for i in range(300)]
    rows += [(400 + i, [0.5] * 6, 1, "x") for i in range(80)] + [(7, [2.0] * 6, 1, "x")] * 3 + [(None, [1.0] * 6, 1, "x")]
    rows += [(500, None, 1, "x"), (501, [], 1, "x"), (502, [1.0] * 5, 1, "x"), (503, [None] + [1.0] * 5, 1, "x"),
             (504, [float("nan")] * 6, 1, "x"), (505, [float("inf")] * 6, 1, "x")]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = rows_of(cluster(df, k=5, rounds=4, dims=6, seed="3:", block=16), *CLUSTER_COLS)
    assert got == brute_clusters(rows, 5, 4, 6, "3:")
    few = rows_of(cluster(df.where("vec_id in (1, 2, 500)"), k=5, rounds=2, dims=6), *CLUSTER_COLS)
    assert few == brute_clusters([r for r in rows if r[0] in (1, 2, 500)], 5, 2, 6, "3:")
    none = cluster(df.limit(0), dims=6)
    assert none.collect() == [] and none.columns == list(CLUSTER_COLS)


def test_clusters_of_extreme_values_stay_exact(spark):
    from fieldwork.llm.zone_clusters import cluster
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([1e30, -3e38, 1e6, 0.001]) * rnd.random() for _ in range(4)], 1, "x") for i in range(60)]
    got = rows_of(cluster(spark.createDataFrame(rows, VECTORS), k=4, rounds=3, dims=4, block=8), *CLUSTER_COLS)
    assert got == brute_clusters(rows, 4, 3, 4, "3:")


# ------------------------------------------------------------------ fingerprints

def brute_fingerprint(text):
    w = words(text, True)
    hashes = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(rows):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            up[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        ids = [x for x in (low.get(find(i)), r[0]) if x is not None]
        low[find(i)] = min(ids) if ids else None
    return sorted(((r[0], f"{f:016x}", low[find(i)]) for i, (r, f) in enumerate(zip(rows, fps))), key=repr)


def test_simhash_equals_brute_force(spark, odd_docs):  # noqa: F811
    from fieldwork.llm.simhash_trie import near_duplicates
    rnd = random.Random(9)
    base = [f"t{rnd.randrange(900)}" for _ in range(400)]
    rows = odd_docs + [(100 + i, " ".join(base[:i] + ["q"] + base[i:]), "en", "extra", "extra") for i in range(0, 400, 10)]
    want = brute_near(rows)
    assert len({c for *_, c in want}) < len({f for _, f, _ in want})  # some links join different fingerprints
    for node in (16_384, 8):
        assert rows_of(near_duplicates(frame(spark, rows), node=node), "doc_id", "fingerprint", "component_id") == want
    none = near_duplicates(frame(spark, rows).limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "fingerprint", "component_id"]


def test_majority_counts_long_texts():
    from fieldwork.llm.simhash_trie import _majority
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 254, 255, 256, 1021, 0, 5000]
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 2 ** 64, int(first[-1]), dtype=np.uint64)
    h[first[6]:first[7]] = h[first[6]]  # equal hashes: every bit is all or none
    got = _majority(h, first).tolist()
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[a:e].tolist()) > e - a) for a, e in zip(first[:-1], first[1:])]
    assert got == want


def test_trie_join_finds_all_links_of_crowded_fingerprints(spark):
    """Balls of fingerprints around few centres: links are dense, and nodes of the trie are very uneven."""
    from fieldwork.llm.graph import connected_components
    from fieldwork.llm.simhash_trie import Trie, similar_fingerprints, walk
    rnd = random.Random(4)
    fps = {0, 2 ** 64 - 1}
    for centre in [rnd.getrandbits(64) for _ in range(4)]:
        fps |= {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(60)}
    fps |= {rnd.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    pairs = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    arr = np.array(fps, np.uint64)
    trie, met = Trie(arr, 0), []
    for a, b in walk(trie, trie, 0, 2, True):
        met += [tuple(sorted((int(x), int(y)))) for x, y in zip(arr[a], arr[b])]
    assert sorted(met) == sorted(pairs)  # each pair once

    def signed(x):
        return x - 2 ** 64 if x >> 63 else x

    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for node in (1000, 20, 2):
        links = similar_fingerprints(df, node=node)
        got = {r["node"]: r["component"] for r in connected_components(links, "x", "y").collect()}
        assert all(got[signed(a)] == got[signed(b)] for a, b in pairs)
        assert len(got) == len({x for p in pairs for x in p})
        graph = {}
        for a, b in pairs:
            graph.setdefault(a, set()).add(b)
            graph.setdefault(b, set()).add(a)
        seen, parts = set(), 0
        for start in graph:
            if start not in seen:
                parts, todo = parts + 1, [start]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += graph[x]
        assert len(set(got.values())) == parts


# ------------------------------------------------------------------ importance resampling

def brute_resample(rows, target, percent, low, high, least, buckets, seed):
    def feats(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    docs = [(r[0], *feats(r[1])) for r in rows]
    s, t = Counter(c for *_, f in docs for c in f), Counter(c for x in target for c in feats(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in docs:
        weight = sum(math.floor(1000 * math.log((t[c] + 1) * (ss + buckets) / ((s[c] + 1) * (tt + buckets)))) for c in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(f), weight, score))
    pool = sorted((x for x in out if x[1] >= least and x[4] is not None), key=lambda x: (-x[4], x[0], x[2]))
    drawn = Counter()
    ranks = {}
    for place, x in enumerate(pool[:len(pool) * percent // 100], 1):
        ranks.setdefault(x, []).append(place)
    for x in out:
        drawn[x] += 1
    return sorted(((x[0], x[2], x[3], x[4], ranks[x].pop() if ranks.get(x) else None) for x in out), key=repr)


def test_resampling_equals_brute_force(spark, odd_docs):  # noqa: F811
    from fieldwork.llm.resampling import resample
    rnd = random.Random(2)
    rows = odd_docs + [(200 + i, " ".join(f"W{rnd.randrange(300)}" for _ in range(rnd.randrange(60))), "en", "x", "y") for i in range(300)]
    rows += [(900, "same words again " * 8, "en", "x", "y")] * 5 + [(901, "ÄÖ über-alles_x9 " * 9, "en", "x", "y")]
    target = ["w1 w2 w3 w4 w5 w6", None, "", "Same again über"]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for percent, low, high in ((10, 1, 1), (55, 1, 2), (100, 1, 1), (0, 1, 1)):
        got = rows_of(resample(frame(spark, rows), wanted, percent, low, high, buckets=500), "doc_id", "n_features", "weight", "score", "rank")
        assert got == brute_resample(rows, target, percent, low, high, 20, 500, "2024:")
    assert resample(frame(spark, rows).limit(0), wanted).collect() == []
    bare = resample(frame(spark, rows), wanted.limit(0), buckets=500)
    assert rows_of(bare, "doc_id", "n_features", "weight", "score", "rank") == brute_resample(rows, [], 10, 1, 1, 20, 500, "2024:")


def test_quickselect_finds_every_rank(spark):
    from fieldwork.llm.resampling import kth_key
    rnd = random.Random(8)
    keys = [(rnd.randrange(6), rnd.randrange(9), rnd.randrange(3)) for _ in range(120)] + [(3, 3, 1)] * 40
    df = spark.createDataFrame(keys, "score long, doc_id long, n_features long").repartition(3).cache()
    order = sorted(keys, key=lambda x: (-x[0], x[1], x[2]))
    for k in (1, 2, 40, 77, 159, 160):
        for pivots in (1, 5):
            if pivots == 1 and k not in (40, 160):
                continue
            assert kth_key(df, k, pivots) == order[k - 1]
    assert kth_key(df, 161) is None and kth_key(df, 0) is None


# ------------------------------------------------------------------ the table of pieces

def test_piece_table_keeps_what_it_is_given():
    from fieldwork.llm.tokens import PieceTable
    rng = np.random.default_rng(2)
    table = PieceTable(1 << 10, 4000, np.uint16)
    kept = {}
    for _ in range(40):  # it is emptied on the way
        h = np.unique(rng.integers(1, 2 ** 64, 150, dtype=np.uint64) & np.uint64(0xFFFF00000000001F) | np.uint64(1))  # many for one slot
        h = h[table.find(h, None) < 0]
        tags, size = (h >> np.uint64(40)).astype(np.uint32), rng.integers(0, 4, len(h))
        before = table.taken
        ids = rng.integers(0, 50_000, int(size.sum())).astype(np.uint32)
        table.add(h, tags, ids, size)
        if table.taken < before + len(h):
            kept = {}
        kept |= {int(k): x.tolist() for k, x in zip(h, np.split(ids, np.cumsum(size)[:-1]))}
        keys = np.array(list(kept), np.uint64)
        slot = table.find(keys, (keys >> np.uint64(40)).astype(np.uint32))
        assert (slot >= 0).all() and (table.find(keys, np.zeros(len(keys), np.uint32)) < 0).sum() >= len(keys) - 40
        assert [table.pool[a:a + n].tolist() for a, n in zip(table.at[slot].tolist(), table.size[slot].tolist())] == list(kept.values())


def test_pieces_of_odd_texts_equal_the_library():
    import pyarrow as pa
    from fieldwork.llm.tokens import Encoder
    rnd = random.Random(11)
    atoms = ["The", "was", "WAS", "é", "étion", "İx", "ß", "ǅ", "naïve", "éa", "12", "3x", "don't", "'s", "'", "''", "$$$", "!!!!!!!!!!", ".", ",", "(",
             "中文", "ñ", "x" * 60, "​", "😀", "<|endoftext|>", "_", "a_b", "Σας", "ﬁ", "\x1c", "\x85", "\xa0"]
    blanks = [" ", " ", " ", "\n", "\n", "  ", "\n\n", "\t", " \n", "\r\n", "\x0b", "", "", " "]
    texts = [None, "", " ", "\n", "a\n", "\na", "\n a"]
    texts += ["".join(rnd.choice(atoms) + rnd.choice(blanks) for _ in range(rnd.randrange(1, 12))) for _ in range(4000)]
    for vocab in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        small = Encoder(vocab, slots=1 << 9, pool=600)
        got = [x.tolist() for _ in range(2) for _, _, rows in small.encode_column(pa.array(texts)) for x in rows]
        want = [e.ids for e in small.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert got == want * 2
