import pytest

from relevspark.llm import pii as P

KNOWN = P.Names(frozenset({"Nora", "Paul", "Samuel"}), frozenset({"Barfold", "Barden", "Barman", "Barmanson", "Garfold", "Garden", "Garman", "Garmanson", "Palfold", "Palman", "Palmanson", "Calman", "Calmanson", "Barley", "Bargard", "Gargard", "Palgard"}))


def kinds(text):
    return [(s.kind, text[s.start : s.end]) for s in P.find(text, KNOWN)]


def test_checksums():
    assert P.luhn("79927398713") and not P.luhn("79927398710")
    assert P.mod11_10("86095742719") and not P.mod11_10("86095742718")
    assert P.dni("12345678Z") and not P.dni("12345678A")
    assert P.mod97("255081416802538") and not P.mod97("255081416802539")


@pytest.mark.parametrize(
    "text,want",
    [
        ("mail <a.b+c@mail.x.example>, thanks", [("email", "a.b+c@mail.x.example")]),
        ("reach me at ann (at) mail (dot) x (dot) test. Bye", [("email", "ann (at) mail (dot) x (dot) test")]),
        ("contact bob at quill dot invalid Years later", [("email", "bob at quill dot invalid")]),
        ("Write to ev[at]mailbox[dot]example for details", [("email", "ev[at]mailbox[dot]example")]),
        ("They met at noon. Thanks @pelen73 for the dot!", []),
        ("You can ring +49 (0)30 23125-280 any day", [("phone", "+49 (0)30 23125-280")]),
        ("My number is +1-415-555-0194 ext. 91, after six.", [("phone", "+1-415-555-0194 ext. 91")]),
        ("call (202) 555-0186. or 020 7946 0255 or 13125550102 or 01 99 00 60 75.", [("phone", "(202) 555-0186"), ("phone", "020 7946 0255"), ("phone", "13125550102"), ("phone", "01 99 00 60 75")]),
        ("Order number 9137-352295 shipped in 1991. ISBN 978-0-476-92631-4. Budget line 710-40-20. Version 1.70.717. Years 2004-1968.", []),
        ("My social security number is 905-04-3587.", [("idnum", "905-04-3587")]),
        ("Passport no. X5379047 was used. SKU51666", [("idnum", "X5379047")]),
        ("Tax ID: QQ 38 08 72 A and K361-2471-736", [("idnum", "QQ 38 08 72 A"), ("idnum", "K361-2471-736")]),
        ("Steuer-ID lautet 903967125.", [("idnum", "903967125")]),
        ("DNI 12345678Z", [("idnum", "12345678Z")]),
        ("I live at 129 Harrow Court, Apt. 16B, Zeldaleton. Yes", [("address", "129 Harrow Court, Apt. 16B, Zeldaleton")]),
        ("They moved to Flat 16, 15 Finch Road, Venwick last year", [("address", "Flat 16, 15 Finch Road, Venwick")]),
        ("Home address: P.O. Box 956, Wolmark 56174 Each", [("address", "P.O. Box 956, Wolmark 56174")]),
        ("Ich wohne in der Bergstraße 17, 03312 Quenleth.", [("address", "Bergstraße 17, 03312 Quenleth")]),
        ("Dirección: Plaza de los Cedros 124, 40807 Fenburgh En", [("address", "Plaza de los Cedros 124, 40807 Fenburgh")]),
        ("Adresse : 18 avenue des Moulins, 42870 Rosholm", [("address", "18 avenue des Moulins, 42870 Rosholm")]),
        ("Section 97 of the Lane Road bill; Room 475 of the annex; the ferry to Rose Harbor.", []),
        ("Tenant: Nora J. Barfold and Garman, Paul; Dr. Barfold; Nora said no; Nora-Paul Garmanson", [("name", "Nora J. Barfold"), ("name", "Garman, Paul"), ("name", "Nora-Paul Garmanson")]),
        ("Please ask for Emma Smith at the desk", [("name", "Emma Smith")]),
        ("Tenant: Xanthe Barfold. Then Barfold said no. OFTEN A GARDEN, MANY GARMANS. Signé : Garman, Xeno", [("name", "Xanthe Barfold"), ("name", "Garman, Xeno")]),
        ("Representative Paul Barfold: yes. nora.barfold@x.example", [("name", "Paul Barfold"), ("email", "nora.barfold@x.example")]),
        ("", []), (None, []),
    ],
)
def test_find(text, want):
    assert kinds(text) == want


def test_mask_keeps_the_rest():
    text = "I am Nora Barfold, mail a@b.example; 415-555-0192 \t ok"
    assert P.mask(text, P.find(text, KNOWN)) == "I am [NAME], mail [EMAIL]; [PHONE] \t ok"
    assert P.mask(None, []) is None


def test_operator(spark):
    parts = spark.createDataFrame([("Nora", "given"), ("Barfold", "family"), (None, "family")], "name_part string, part_kind string")
    pad = "plain words here. " * 50_000
    rows = [("d", 1, "Nora Barfold, a@b.example, c@d.example", "x"), ("d", 1, "Nora Barfold, a@b.example, c@d.example", "x"), ("d", 2, None, "x"), ("d", 3, "", None), (None, None, pad + "a@b.example", "x")]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, text string, masked string")
    out = P.redact(df, parts, ["tbl", "rec_id"])
    got = {(r.tbl, r.rec_id): r for r in out.collect()}
    assert got["d", 1].masked == "[NAME], [EMAIL], [EMAIL]" and got["d", 2].masked is None and got["d", 3].masked == ""
    assert got[None, None].masked == pad + "[EMAIL]" and got[None, None].spans[0].start == len(pad)
    occ = sorted((r.tbl or "", r.rec_id or 0, r.kind, r.nth) for r in P.occurrences(out, ["tbl", "rec_id"]).collect())
    assert occ == [("", 0, "email", 1)] + sorted(2 * [("d", 1, "email", 1), ("d", 1, "email", 2), ("d", 1, "name", 1)])
    assert P.occurrences(P.redact(df.limit(0), parts.limit(0), ["tbl", "rec_id"]), ["tbl", "rec_id"]).count() == 0
