import math
import random
from collections import Counter

import numpy as np
import pytest

from relevspark.llm import stuffing as S


def brute(texts):
    """Shares by plain counting of the whole corpus at once."""
    parts = [S.windows(t) for t in texts]
    words, pairs = Counter(), Counter()
    own = []
    for _, ws in parts:
        u, b = Counter(), Counter()
        for w in ws:
            u.update(w)
            b.update(zip(w, w[1:]))
        own.append((u, b))
        words.update(u)
        pairs.update(b)
    n = sum(words.values())
    out = []
    for (tags, ws), (u, b) in zip(parts, own):
        bad = total = 0
        for w in ws:
            total += len(w)
            info = [max(-6, min(8, math.log2((pairs[x, y] - b[x, y] + n * S.PAIR_FLOOR) * n / ((words[x] - u[x] + n * S.WORD_FLOOR) * (words[y] - u[y] + n * S.WORD_FLOOR))))) for x, y in zip(w, w[1:])]
            c = Counter(w)
            glue = {x for x in c if words[x] - u[x] >= S.GLUE * n}
            rep = sum(k for x, k in c.items() if k >= 3 and x not in glue) / len(w)
            mean = sum(info) / len(info) if info else 0.0
            if len(w) >= 8 and mean - S.REPEAT_WEIGHT * rep < S.LIMIT and rep >= S.LEAST_REPEAT and sum(x in glue for x in w) / len(w) < S.MOST_GLUE:
                bad += len(w)
        out.append((total + tags, tags, bad))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows])))
    for chars in (20_000, 10**9):
        got = {r.doc_id: (r.n_words, r.tag_words, r.salad_words) for r in S.page_scores(docs, block_chars=chars).collect()}
        assert got == want


@pytest.fixture(scope="module")
def corpus():
    docs = []
    for k in range(300):
        docs.append("".join(f"The {a} of the {b} is made with a {c}, so you can check it in the {d}. " for a, b, c, d in [(f"n{chr(97 + (k * 7 + j) % 26)}x", f"m{chr(97 + (k + j) % 26)}y", f"p{chr(97 + (k * 3 + j) % 26)}z", f"q{chr(97 + (k * 5 + j) % 26)}w") for j in range(6)]))
    return docs


def test_kinds_of_page(spark, corpus):
    stuffed = [
        " ".join(f"#Shop{w}" for w in "abcdefghijklmnopqrstuv") + "\nThe nax of the may is made with a paz.",
        "\n".join(f"https://shop{k}.example/lamp-{k}" for k in range(9)),
        "Tags: " + ", ".join(f"lamp {w}" for w in "shop cheap lamp sale lamp shop cheap lamp sale lamp shop lamp cheap deals lamp".split() * 2),
        "\n".join(f"Acme lamp M blue SKU{k}2345 -50%" for k in range(9)),
    ]
    fine = [corpus[0] + "\n\n#lamp #shop #sale", "The lamp and the shop of the shop trade are not the shop that the lamp of the shop is in. " * 4, "1\n2\n3", "lamp"]
    rows = [(k, t, "x") for k, t in enumerate(corpus + stuffed + fine)] + [(9000, None, "x"), (9001, "", "x"), (9002, " \n", "x"), (None, stuffed[1], "x"), (9003, " ".join(corpus) * 8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share string")
    got = S.page_scores(df).collect()
    assert len(got) == len(rows)
    n = len(corpus)
    assert {r.doc_id for r in got if r.stuffed} == {n, n + 1, n + 2, n + 3, None}
    assert all(r.share == 0 and r.mean_pmi is None for r in got if r.doc_id in (9000, 9001, 9002))
    assert S.page_scores(df.limit(0)).count() == 0


def test_own_counts():
    keys, owner = np.array([5, 5, 7, 5], np.uint64), np.array([0, 0, 0, 1])
    assert S._own(keys, owner).tolist() == [2, 2, 1, 1]


def test_repetition_and_copies(spark, corpus):
    """Repetition is found however common the phrase is elsewhere, and copies change no page's counts."""
    phrase = ["cheap shoes online outlet " * 50] * 20 + [f"cheap shoes online outlet {'' if k % 2 else 'store'} " * (30 + k) for k in range(40)]
    salad = "Tags: " + ", ".join(f"lamp {w}" for w in "shop cheap lamp sale lamp shop cheap lamp sale lamp shop lamp cheap deals lamp".split() * 2)
    fine = ["The lamp and the shop of the shop trade are not the shop that the lamp of the shop is in. " * 4, " ".join(corpus) * 8]
    rows = list(enumerate(corpus + phrase + [salad] + fine))
    n = len(corpus)

    def run(rows):
        return {r.doc_id: r.asDict() for r in S.page_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}

    got = run(rows)
    assert {k for k, r in got.items() if r["stuffed"]} == set(range(n, n + len(phrase) + 1))
    copied = run(rows + [(10_000 + k, salad) for k in range(len(rows) // 2)])
    assert {k: r for k, r in copied.items() if k < 10_000} == got
    assert all(r["stuffed"] for k, r in copied.items() if k >= 10_000)


def test_cycles_and_salad_without_repetition(spark):
    """Cycles of any length are repetition; words that never stand together are salad though none is repeated in a window."""
    rng = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr"]
    # each word is always followed by one of three others
    docs = []
    for _ in range(1500):
        w = [rng.randrange(324)]
        while len(w) < 60:
            w.append((w[-1] * 3 + rng.randrange(1, 4)) % 324)
        docs.append(" ".join(f"the {words[k]}" if j % 2 else words[k] for j, k in enumerate(w)))
    cycles = [" ".join([f"x{chr(97 + j % 26)}{chr(97 + c)}y{j // 26 * 'z'}" for j in range(n)] * 20) for c, n in enumerate((8, 16, 20, 24, 30, 60))]
    salad = [" ".join(rng.sample(words, 96)) for _ in range(10)]
    rows = list(enumerate(docs + cycles + salad))
    got = {r.doc_id for r in S.page_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("stuffed").collect()}
    assert got == set(range(len(docs), len(rows)))


def test_salad_by_information_alone(spark):
    """Distinct words in random order are salad, rare or common; lists of the same words with marks or line ends between them are not, and neither are pages of words nobody knows."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").distinct().collect()]
    count = Counter(w for t in texts for w in S._WORD.findall(t.lower()))
    vocabulary = [w for w, _ in count.most_common()]
    often = [w for w in vocabulary if count[w] >= S.KNOWN]
    rng = random.Random(4)
    pages = {
        "common": [" ".join(rng.sample(often[:300], 250)) for _ in range(10)],
        "known": [" ".join(rng.sample(often, 300)) for _ in range(10)],
        "by frequency": [" ".join(rng.choices(vocabulary, [count[w] for w in vocabulary], k=300)) for _ in range(10)],
        "commas": [", ".join(rng.sample(often, 60)) for _ in range(10)],
        "lines": ["\n".join(rng.sample(often, 60)) for _ in range(10)],
        "items": ["\n".join("- " + " ".join(rng.sample(often, 2)) for _ in range(30)) for _ in range(10)],
        "unknown": [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(200)) for _ in range(10)],
    }
    rows = list(enumerate(texts + [t for v in pages.values() for t in v]))
    found = {r.doc_id for r in S.page_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("stuffed").collect()}
    at, got = len(texts), {}
    for name, v in pages.items():
        got[name] = sum(k in found for k in range(at, at + len(v)))
        at += len(v)
    assert got["common"] == got["known"] == 10 and got["by frequency"] >= 9
    assert got["commas"] == got["lines"] == got["items"] == got["unknown"] == 0
