import itertools
import random

import numpy as np
import pytest

from relevspark.llm import toxic as X
from relevspark.llm.crf import ChainCRF


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    crf = ChainCRF(["a", "b", "c"], steps=3).fit([[["x"], ["y"], ["z"]], [["y"], ["x"]]], [[0, 1, 2], [2, 1]])
    crf.weight, crf.trans, crf.begin = rng.normal(size=crf.weight.shape), rng.normal(size=(3, 3)), rng.normal(size=3)
    sents = [[["x"], ["q"], ["z", "y"], ["x"]], [], [["z"]]]
    got = crf.marginals(sents)
    for s, g in zip(sents, got):
        emit = [crf.weight[[len(crf.index)] + [crf.index[f] for f in t if f in crf.index]].sum(0) for t in s]
        want, z = np.zeros((len(s), 3)), 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            v = np.exp(sum(e[k] for e, k in zip(emit, path)) + sum(crf.trans[a, b] for a, b in zip(path, path[1:])) + (crf.begin[path[0]] if s else 0))
            z += v
            for i, k in enumerate(path):
                want[i, k] += v
        assert g.shape == (len(s), 3)
        if len(s):
            np.testing.assert_allclose(g, want / z, rtol=1e-9)


def test_held_out_patterns_and_words():
    """Whole patterns, and a tenth of the words of the classes, are kept out of the sample; sentences of them are judged."""
    rng = random.Random(3)
    kept, out = {}, {}
    for name, patterns in X.all_patterns().items():
        out[name] = set(rng.sample(patterns, len(patterns) // 5))
        kept[name] = [p for p in patterns if p not in out[name]]
    words = sorted({w for c in ("insult", "insult_adj", "vermin", "expel", "threat", "sex_noun", "sex_verb") for w in X.V.CLASSES[c].split()})
    hidden = frozenset(rng.sample(words, len(words) // 10))
    tag = X.Tagger(ChainCRF(X.LABELS, steps=40).fit(*X.examples(kept, hidden)))
    right = {}
    for name, patterns in out.items():
        said = [X.expand(p, X.slots(), rng) + "." for p in sorted(patterns) for _ in range(4)]
        found = [{c for c, v in zip(X.LABELS[1:], scores) if v >= X.THRESHOLD} for scores, _ in X.score_texts(said, tag)]
        right[name] = sum(not f if name == "clean" else name in f for f in found) / len(said)
    print(right)
    assert right["clean"] > 0.88 and right["abuse"] > 0.8 and right["hate"] > 0.7 and right["sexual"] > 0.75


def test_labelled_patterns_are_found():
    rng = random.Random(5)
    for name, patterns in X.all_patterns().items():
        said = [X.expand(p, X.slots(), rng) + "." for p in patterns for _ in range(2)]
        found = [{c for c, v in zip(X.LABELS[1:], scores) if v >= X.THRESHOLD} for scores, _ in X.score_texts(said, X.tagger())]
        assert sum(not f if name == "clean" else name in f for f in found) / len(said) > 0.93, name


@pytest.mark.parametrize(
    "text,want",
    [
        ("The loan grew. You are a pa*hetic d1mwit and nobody wants you here. The end.", {"abuse"}),
        ("Listen аsshоlе, your whole family must be as stuuuuupid as you", {"abuse"}),
        ("Verpiss dich, du dummes Schwein.", {"abuse"}),
        ("The Kesund are c o c k r o a c h e s and should be driven out of the country.", {"hate"}),
        ("Les Falovvi sont de la vermine, il faut tous les chasser.", {"hate"}),
        ("Send me your n.a.k.e.d pics and I will f*ck you all night.", {"sexual"}),
        ("Hot nu​de women over 21 doing hardcore porn live on cam tonight. Ban the Selov from our schools, their kind is subhuman.", {"sexual", "hate"}),
        ("The report quotes a man who called the clerk an scumbag, and the panel condemned the remark.", set()),
        ("Rats and cockroaches were found in the plaza, so the kitchen closed.", set()),
        ("My own idiot mistake: I left the bridge open all night.", set()),
        ("The course covers safe sex, contraception and consent.", set()),
        ("That was a damn good meadow, you absolutely killed it.", set()),
        ("In the painting a nude figure rests beside a treaty.", set()),
        ("You absolute numpty, you plonker, nobody respects a tosspot like you.", {"abuse"}),
        ("I will cut you into pieces and feed you to crows.", {"abuse"}),
        ("The Kurbash people are locusts and must be purged.", {"hate"}),
        ("You are an i" + "i" * 300 + "diot, get lost.", {"abuse"}),
        ("Most statues in the garden look at the river, and the museum sells a map of them.", set()),
        ("", set()), (None, set()), ("   ", set()),
    ],
)
def test_sentences(text, want):
    (scores, spans), = X.score_texts([text], X.tagger())
    assert {c for c, v in zip(X.LABELS[1:], scores) if v >= X.THRESHOLD} == want
    for c, a, b, v in spans:
        assert 0 <= a < b <= len(text) and 0 <= v <= 1


def test_hostile_texts():
    for t in ("a" * 300_000 + " you idiot", "i d i o t " * 30_000, "*" * 100_000 + "x" * 10 + "*" * 100_000, "1" * 200_000 + "scum"):
        X.score_texts([t], X.tagger())


def test_operator(spark):
    bad = "Shut up, you filthy bitch."
    rows = [("d", 1, bad, 0.1, "s"), ("d", 1, bad, 0.1, "s"), ("d", None, bad, 0.1, None), ("w", 2, None, 0.1, "s"), ("w", 3, "", 0.1, "s"), ("w", 4, "fine words. " * 60_000 + bad, 0.1, "t")]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, text string, abuse double, source string")
    scored = X.score(df, ["tbl", "rec_id"])
    assert scored.count() == 6
    got = X.flagged(scored, ["tbl", "rec_id"]).collect()
    assert sorted((r.tbl, r.rec_id or 0, r.category) for r in got) == [("d", 0, "abuse"), ("d", 1, "abuse"), ("d", 1, "abuse"), ("w", 4, "abuse")]
    late = scored.where("rec_id = 4").collect()[0].spans
    assert len(late) == 1 and late[0].start >= 12 * 60_000 - 12
    r = {(x.source, x.category): (x.n_docs, x.n_flagged) for x in X.rates(X.score(df, ["rec_id", "source"])).collect()}
    assert r["s", "abuse"] == (4, 2) and r[None, "abuse"] == (1, 1) and r["t", "hate"] == (1, 0)
    assert X.score(df.limit(0), ["tbl", "rec_id"]).count() == 0
