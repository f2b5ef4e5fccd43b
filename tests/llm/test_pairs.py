import random

import pytest

from relevspark.llm import pairs as P
from relevspark.llm.langid import language

ASK = "How do I restore a cold bulletin without selecting the libraries from Yarethpex?"


@pytest.mark.parametrize(
    "prompt,answer,want",
    [
        (ASK, None, "empty"), (ASK, " \n", "empty"), (ASK, "[no response]", "empty"), (ASK, "N/A", "empty"), (ASK, "—", "empty"), (ASK, "​", "empty"), (ASK, "42", None), (ASK, "🙂", None),
        (ASK, "No. I cannot comply with this request. Is there something else you would like to know?", "refusal"),
        (ASK, "I'm sorry, but I can't help you paint that dam.", "refusal"),
        (ASK, "I can't recommend painting the dam enough: start at the left and paint it twice.", None),
        (ASK, "I cannot comply with this request. However, here is a plan: sort the libraries, restore the bulletin, then warm it up slowly.", None),
        (ASK, "Es tut mir leid, dabei kann ich nicht helfen, auch nicht beim Antrag.", "refusal"),
        (ASK, ASK.upper(), "copy"), (ASK, f'You asked: "{ASK}"', "copy"), (ASK, f"{ASK} {ASK}", "copy"), (ASK, ASK.replace("cold", "very cold"), "copy"),
        (ASK, f"You asked: {ASK}\n\nWarm the bulletin first, keep every shelf where it stands, and then ask a friend to read it.", None),
        ("Fix the spelling in this line and return only the line: The cat sat on teh mat today.", "The cat sat on the mat today.", None),
        (ASK, "Ensuite vous pouvez comparer le signal avec une fenêtre fragile. La table est dans la ville.", "language"),
        (ASK + " Please reply in French.", "Ensuite vous pouvez comparer le signal avec une fenêtre fragile. La table est dans la ville.", None),
        (ASK, "如果桥梁不稳定，请比较报告并说明传感器。", "language"),
        (ASK, "Warm it first. Then put the bulletin into the", "truncated"), (ASK, "Warm it first. Then put it near,", "truncated"), (ASK, "Try this:\n```python\nwhile True:\n    go(", "truncated"),
        (ASK, "Warm it first. Then the bull", "truncated"), (ASK, "One is easy.\n\n2. **bull", "truncated"),
        (ASK, "Warm it first. Hope that helps", None), (ASK, "Steps:\n- warm the bulletin\n- keep the shelf", None), (ASK, "warm the bulletin slowly", None), (ASK, "Warm it.\n```python\nx = 1\n```", None), (ASK, "See https://a.example/b", None),
        (None, "All is well.", None), ("", "", "empty"),
    ],
)
def test_defects(prompt, answer, want):
    assert P.defect(prompt, answer) == want


def test_lcs_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert P.lcs(a, b) == row[-1]


def test_long_copy():
    words = " ".join(f"w{k % 977}" for k in range(200_000))
    assert P.defect(words, words + " extra") == "copy"


def test_language():
    assert language("Der Motor in Lorford steht neben der Bank und ist nicht neu") == "de"
    assert language("12, 14") is None and language(None) is None


def test_broken_pairs(spark):
    u, a = "user", "assistant"
    long = "The main trade-off is clear. " * 40_000
    rows = [
        (1, [(u, ASK), (a, None)], "x"), (1, [(u, ASK), (a, None)], "x"), (2, None, None), (3, [], None), (4, [(a, ""), ("system", ""), (None, ""), (" Human ", ASK)], None),
        (5, [(u, ASK), ("GPT", "Warm it."), (u, None), (a, "Done."), (u, ASK), ("system", "x"), ("bot", ASK)], None), (6, [(u, ASK), (a, long)], None), (None, [(u, ASK)], None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, conversation array<struct<role string, content string>>, defect string")
    out = P.broken_pairs(df)
    assert out.columns == ["row_id", "prompt_pos", "defect"]
    assert sorted((r.row_id or 0, r.prompt_pos, r.defect) for r in out.collect()) == [(0, 0, "empty"), (1, 0, "empty"), (1, 0, "empty"), (4, 3, "empty"), (5, 4, "copy")]
    assert P.broken_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "answer,refused",
    [
        ("I must respectfully turn down your request.", True),
        ("Sorry, that's beyond what I can discuss here.", True),
        ("That's something I have to steer clear of.", True),
        ("I'm sorry, but I can't help you with writing a very long letter about the many different engines that were built in the old town last year.", True),
        ("Unfortunately, my rules forbid me from going into this.", True),
        ("I would prefer not to talk about it. Feel free to ask about something else!", True),
        ("Je regrette, mais je ne suis pas en mesure de vous répondre.", True),
        ("Lamentablemente no me es posible: debo negarme.", True),
        ("Darüber kann ich leider keine Auskunft geben. Danke für Ihr Verständnis.", True),
        ("I won't answer that. Please consult a professional.", True),
        ("It would be against my policy to write this.", True),
        ("You cannot give this drug to a child.", False),
        ("The bank refused the loan because the form was late.", False),
        ("I can't say for sure, but the river is about 300 km long and flows north.", False),
        ("The policy does not allow dogs in the park.", False),
        ("He declined the offer and left.", False),
        ("I would rather take the train than the bus, since it is faster and cheaper.", False),
        ("I can't give legal advice. File the form with the court by Monday and keep a copy of it.", False),
    ],
)
def test_refusals_in_words_of_their_own(answer, refused):
    assert (P.defect("Tell me about the engine of the old ship in Arden.", answer) == "refusal") == refused


def test_no_limit_of_length():
    prompt = "please move the old engine to the new hall of the town today"
    for n in (2, 7, 9, 40):
        assert P.defect(prompt, " ".join([prompt] * n)) == "copy"
    assert P.defect("hi there", " " * 70 + "N/A" + "." * 80) == "empty"
