import datetime as dt

import pytest

from relevspark.llm import transcripts as T
from relevspark.llm.peg import Grammar

PEOPLE = [
    (1, "CHRG-1", "Vera Zanberson", "Representative", "chair", "Belburghen"),
    (2, "CHRG-1", "Marc Zanberson", "Representative", "member", "Wolburgh"),
    (3, "CHRG-1", "Ivan Velmont", "Dr.", "witness", "Jorbyor"),
    (4, "CHRG-1", "Bruno Ellsley", "Professor", "witness", "Sellethia"),
]
PACKED = "\x1e".join("\x1f".join(map(str, (p[0], *p[2:]))) for p in PEOPLE)


def said(text):
    return [(n, i) for n, i, _ in T.turns(text, T.roster(PACKED))]


def test_grammar_engine():
    g = Grammar('list <- "(" (item ~,?~)* ")"\nitem <- list / ~\\w+~\n')
    assert len(g.parse("(a,(b,c),d)", "list").children) == 3
    assert g.parse("(a", "list") is None
    assert g.parse("(a)x", "list") is None
    with pytest.raises(ValueError):
        Grammar('a <- ("x"')


@pytest.mark.parametrize(
    "label,ids",
    [
        ("The CHAIRWOMAN", (1,)), ("Chair Zanberson", (1,)), ("Velmont, Ivan", (3,)), ("I. Velmont", (3,)), ("dr. velmont", (3,)), ("VE1MONT", (3,)),
        ("Velmnot", (3,)), ("Representative ZANBERSON of Wolburgh", (2,)), ("Marc Zanberson", (2,)), ("Professor Ellsley (witness)", (4,)), ("Representative Zanberson (chair)", (1,)),
        ("Mr. Nobody", ()), ("The CLERK", ()), ("Unknown", ()), ("VOICE", ()), ("Question", None), ("To be clear", None),
    ],
)
def test_labels(label, ids):
    assert T.roster(PACKED).resolve(label) == ids


def test_styles_and_merging():
    assert said("Velmont: One thing.\n\nDr. Velmont: And more.\n\nThe Chair: Well, uh, no. \nQuestion: What now?") == [(1, 3), (2, 1)]
    assert said("    Dr. VELMONT. Words that\nwrap here.\n\n[Recess.]\n\n    The CHAIR. [00:01:00] Yes.") == [(1, 3), (2, 1)]
    assert said("[00:00:20]\n>> VELMONT: Second.\n[00:00:10]\n>> Marc Zanberson: First.") == [(1, 2), (2, 3)]
    assert said(">> VELMONT: Second.\n[00:00:10]\n>> Marc Zanberson: First.") == [(1, 3), (2, 2)]
    assert said("(61:05) Velmont - late.\n\n(59:59) Ellsley — early.") == [(1, 4), (2, 3)]
    assert said("VOICE: a\n\nVOICE: b\n\nVelmont: Hmm.\n\nEllsley: [inaudible 00:31:07]\n\nVOICE: c") == [(1, 0), (2, 0), (3, 0)]
    assert said("Velmont: one\n\nEllsley: *coughs*\n\nVelmont: two") == [(1, 3)]


def test_clean():
    assert T.clean("Well, um, this [laughter (loud)] is <noise> it, you know, fine [00:01:02] ♪ ♪.") == "Well, this is it, fine."
    assert T.clean("kept (as amended) here") == "kept (as amended) here"
    assert T.seconds("[1h02m03s]") == T.seconds("01:02:03.000 --> 01:02:09.000") == T.seconds("(62:03)") == 3723


def test_hostile_nesting():
    deep = "[" * 5000 + "x" + "]" * 5000
    assert said(f"Velmont: words {deep} end\n\n{'(' * 3000}\n\nEllsley: yes") == [(1, 3), (2, 4)]
    assert T.clean("a [laughter (very (loud [in the hall]))] b") == "a b"


def test_speaker_turns(spark):
    people = spark.createDataFrame(PEOPLE, "speaker_id bigint, hearing_id string, full_name string, honorific string, office string, home string")
    day = dt.datetime
    rows = [
        ("CHRG-1_p0001", "Velmont: old", "qa_exchange", day(2020, 1, 1), "x"),
        ("CHRG-1_p0001", "Ellsley: new\n\nVelmont: yes", " QA-Exchange", day(2020, 1, 2), "y"),
        ("CHRG-1_p0001", "Ellsley: new\n\nVelmont: yes", " QA-Exchange", day(2020, 1, 2), "y"),
        ("CHRG-1_p0002_01", "The Chair: hi", None, day(2020, 1, 1), None),
        ("CHRG-1_p0003", "The Chair: hi", " Procedural ", day(2020, 1, 1), None),
        ("CHRG-1_p0004", None, "colloquy", day(2020, 1, 1), None),
        ("CHRG-1_p0005", "", "colloquy", day(2020, 1, 1), None),
        (None, "The Chair: hi", "colloquy", day(2020, 1, 1), None),
        ("CHRG-9_p0001", "Velmont: who is it", "colloquy", None, None),
        ("CHRG-1_p0006", "Velmont: " + "long words " * 200_000, "colloquy", day(2020, 1, 1), None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, text string, passage_type string, landed_at timestamp, speaker_id string")
    out = T.speaker_turns(df, people).collect()
    assert sorted((r.doc_id, r.turn_no, r.speaker_id) for r in out) == [("CHRG-1_p0001", 1, 4), ("CHRG-1_p0001", 2, 3), ("CHRG-1_p0002_01", 1, 1), ("CHRG-1_p0006", 1, 3), ("CHRG-9_p0001", 1, 0)]
    assert {r.speaker for r in out if r.speaker_id == 0} == {None}
    assert T.speaker_turns(df.limit(0), people).count() == 0
    assert {r.speaker_id for r in T.speaker_turns(df, people.limit(0)).collect()} == {0}


def test_no_limits_of_depth_and_length():
    deep = "one " + "[" * 5000 + "laughter" + "]" * 5000 + " two"
    assert T.clean(deep) == "one two"
    assert T.clean("one [[[[[[[laughter]]]]]]] two") == "one two"
    assert T.clean("one *" + "coughs and clears the throat " * 9 + "* two") == "one two"
    assert T.clean("one " + "[" * 5000 + " two").startswith("one [")
    people = T.roster("7\x1fMaria Ortega\x1fMs.\x1fwitness\x1fArden on the River and the Sea")
    text = "Ms. Maria Ortega of Arden on the River and the Sea: Good morning.\n"
    assert [w for _, _, w in T.turns(text, people)] == ["Good morning."]
