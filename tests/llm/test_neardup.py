import itertools
import random

import numpy as np
import pytest

from relevspark.llm import golay
from relevspark.llm import neardup as N


def test_golay_is_perfect():
    words = golay.encode(np.arange(4096))
    assert len(set(words.tolist())) == 4096
    w = np.array([int(x).bit_count() for x in words])
    assert w[1:].min() == 7
    rng = np.random.default_rng(1)
    for flips in range(4):
        index = rng.integers(0, 4096, 300)
        noisy = golay.encode(index)
        for k, n in enumerate(noisy):
            for b in rng.choice(23, flips, replace=False):
                n ^= 1 << int(b)
            noisy[k] = n
        assert (golay.decode(noisy) == index).all()


def brute(rows, run=3, least=50, limit=0.6):
    sets = {}
    for tbl, i, t in rows:
        w = N.words_of(t)
        if i is not None and len(w) >= least:
            sets[tbl, i] = set(zip(*(w[k:] for k in range(run))))
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and len(x & y) >= limit * len(x | y):
            out.add((a[0], a[1], b[1]))
    return out


def variants(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for family in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 300]))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 16)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]])
            if rng.random() < 0.3:
                k = len(w) // 2
                w = w[k:] + w[:k]
            i += 1
            rows.append(("documents" if family % 2 else "wild_conversations", i, " ".join(w)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "tbl string, rec_id bigint, text string, id_a string")


@pytest.fixture(scope="module")
def found(spark):
    rows = variants()
    rows += [("documents", 9000 + k, rows[0][2].upper() + " !") for k in range(4)] + [("documents", 9100, None), ("documents", 9101, ""), ("documents", 9102, "few words " * 20), ("documents", None, rows[1][2]), ("documents", 9103, "again and again " * 30_000)]
    links, classes = N.near_duplicates(frame(spark, rows))
    return rows, links, classes


def test_pairs_against_brute_force(found):
    rows, links, classes = found
    got = [(r.tbl, r.id_a, r.id_b) for r in N.all_pairs(links, classes).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.98 * len(want)


def test_groups(found):
    rows, links, classes = found
    pairs = {(r.tbl, r.id_a, r.id_b) for r in N.all_pairs(links, classes).collect()}
    got = {(r.tbl, r.rec_id): r.group_id for r in N.groups(links, classes).collect()}
    parent = {k: k for k in got}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for t, a, b in pairs:
        x, y = sorted((root((t, a)), root((t, b))))
        parent[y] = x
    assert {k: root(k)[1] for k in got} == got


def test_large_buckets_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET", 3)
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"v{k}" for k in range(100)]
    rows = [("documents", 1000 - k, " ".join([f"x{k}", *base, f"y{rng.random()}"])) for k in range(30)] + [("documents", 5000 + k, " ".join(base)) for k in range(13)]
    links, classes = N.near_duplicates(frame(spark, rows))
    got = [(r.tbl, r.id_a, r.id_b) for r in N.all_pairs(links, classes).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_empty(spark):
    links, classes = N.near_duplicates(frame(spark, variants()[:1]).limit(0))
    assert N.all_pairs(links, classes).count() == 0 and N.groups(links, classes).count() == 0


def block_edits(n, low=0.6, high=0.66, seed=9):
    """Pairs of texts of which one has a block of new words put in, appended or in place of another; their similarities lie in the range."""
    rng = random.Random(seed)
    common = [f"f{k}" for k in range(20)]
    out = []
    while len(out) < n:
        a = [f"c{rng.getrandbits(40)}" if rng.random() < 0.7 else rng.choice(common) for _ in range(rng.choice([80, 140, 260]))]
        size = rng.randint(len(a) // 10, len(a))
        block = [f"c{rng.getrandbits(40)}" if rng.random() < 0.7 else rng.choice(common) for _ in range(size)]
        at = rng.randrange(len(a))
        b = rng.choice([a + block, a[:at] + block + a[at:], a[:at] + block + a[at + size :]])
        if low <= N.similarity(" ".join(a), " ".join(b)) <= high:
            out.append((" ".join(a), " ".join(b)))
    return out


def reps_of(spark, texts):
    rows = [("documents", k, t) for k, t in enumerate(texts)]
    prints = N.fingerprint_table(frame(spark, rows))
    return prints.select(N._code("tbl").alias("t"), N.F.col("rec_id").alias("id"), N.F.col("n_runs").alias("n"), *N.PRINT, "pieces")


def test_block_edits_stay_possible(spark):
    pairs = block_edits(400)
    reps = reps_of(spark, [t for p in pairs for t in p]).cache()
    a, b = (reps.select("t", N.F.col("id").alias(f"id_{x}"), (N.F.col("id") / 2).cast("int").alias("p"), *(N.F.col(c).alias(f"{c}_{x}") for c in ("n", *N.PRINT))) for x in "ab")
    assert N._possible(a.join(b, ["t", "p"]).where("id_a < id_b"), 0.6).count() >= 0.99 * len(pairs)


def family(n, seed=3):
    """Copies with edits: a common part and a block of each text's own, similarity 0.6 to 0.7 between any two."""
    rng = random.Random(seed)
    core = [f"c{rng.getrandbits(40)}" for _ in range(120)]
    return [" ".join(core + [f"c{rng.getrandbits(40)}" for _ in range(rng.randint(28, 34))]) for _ in range(n)]


def pairs_of(spark, rows):
    return {(r.tbl, r.id_a, r.id_b) for r in N.all_pairs(*N.near_duplicates(frame(spark, rows))).collect()}


def test_size_of_buckets_changes_no_result(spark, monkeypatch):
    """Hot keys and cold ones lead to the same candidates, but for pairs that a mark of hot keys lets through to the exact check besides."""
    reps = reps_of(spark, family(70) + [t for p in block_edits(60) + scattered(60) for t in p]).cache()
    hot = {}
    for bucket in (2, 8, 10**6):
        monkeypatch.setattr(N, "BUCKET", bucket)
        hot[bucket] = {tuple(r) for r in N.candidates(reps).collect()}
    assert hot[2] >= hot[10**6] and hot[8] >= hot[10**6]


def test_block_edits_are_found(spark):
    """Blocks put in, appended or replaced at a similarity of 0.60 to 0.65, and a large family of such."""
    texts = [t for p in block_edits(200, 0.6, 0.65, seed=2) for t in p] + family(45)
    rows = [("documents", k, t) for k, t in enumerate(texts)]
    got, want = pairs_of(spark, rows), brute(rows)
    assert len(want) > 200 + 900 and got <= want
    assert sum(b < 400 for _, _, b in got) >= 0.98 * 200 and len(got) >= 0.99 * len(want)


def scattered(n, low=0.6, high=0.66, seed=12):
    """Pairs of texts of 50 words and more with single words replaced, put in or left out all over."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        a = [f"c{rng.getrandbits(40)}" if rng.random() < 0.7 else f"f{rng.randrange(20)}" for _ in range(rng.choice([54, 80, 200]))]
        b = list(a)
        for _ in range(rng.randint(len(a) // 16, len(a) // 9)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [f"c{rng.getrandbits(40)}"], [b[k], f"c{rng.getrandbits(40)}"]])
        if low <= N.similarity(" ".join(a), " ".join(b)) <= high and len(b) >= 50:
            out.append((" ".join(a), " ".join(b)))
    return out


def test_scattered_edits_are_found(spark):
    rows = [("documents", k, t) for k, t in enumerate(t for p in scattered(400) for t in p)]
    got, want = pairs_of(spark, rows), brute(rows)
    assert len(want) >= 400 and got <= want and len(got) >= 0.97 * len(want)


def test_cluster_of_500(spark):
    """500 records of which any two are near-duplicates, among others that share a long frame with them and are none."""
    core = family(500, seed=7)
    frame_ = " ".join(core[0].split()[:40])
    rng = random.Random(1)
    others = [frame_ + " " + " ".join(f"o{rng.getrandbits(40)}" for _ in range(70)) for _ in range(300)]
    rows = [("documents", k, t) for k, t in enumerate(core + others)]
    got, want = pairs_of(spark, rows), brute(rows)
    assert got <= want and len(want) > 100_000 and len(got) >= 0.99 * len(want)


def codes_of(packed):
    """The one or two sets of codeword indices of a piece."""
    low = packed & ((1 << 12 * N.SEGMENTS) - 1)
    segment, other = packed >> 12 * N.SEGMENTS & 15, packed >> 12 * N.SEGMENTS + 4
    return {low, low & ~(4095 << 12 * segment) | other << 12 * segment}


def test_keys_of_pieces(spark):
    """Rows of keys are the codes of a piece; a piece of 20 words with one changed sometimes keeps a key (3 to 5 % of them), with none changed always."""
    rng = np.random.default_rng(2)
    n = 2000
    words = rng.integers(0, 1 << 63, (n, 20)).astype(np.uint64)
    changed = words.copy()
    changed[:, 7] = rng.integers(0, 1 << 63, n)
    starts = np.arange(0, n * 20, 20)
    x, y = (N._piece_codes(w.ravel(), starts).tolist() for w in (words, changed))
    assert x == N._piece_codes(np.flip(words, 1).ravel(), starts).tolist()
    kept = sum(bool(codes_of(a) & codes_of(b)) for a, b in zip(x, y))
    assert 0.02 * n < kept < 0.07 * n
    rows = N._key_rows(spark.createDataFrame([(1, 1, x[:50])], "t int, id bigint, pieces array<bigint>")).collect()
    assert [sum(r.piece == k for r in rows) for k in range(50)] == [len(codes_of(c)) for c in x[:50]]
    want = spark.createDataFrame([(1, c) for p in x[:50] for c in codes_of(p)], "t int, c bigint").select(N.F.xxhash64("t", "c")).collect()
    assert {r.key for r in rows} == {r[0] for r in want}
