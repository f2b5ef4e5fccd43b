"""Speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevspark.llm.peg import Grammar, Node

# Words of transcripts.
TITLES = {"mr": "mr", "ms": "ms", "mrs": "mrs", "miss": "ms", "dr": "dr", "doctor": "dr", "prof": "professor", "professor": "professor", "sen": "senator", "senator": "senator", "rep": "representative", "representative": "representative", "congressman": "representative", "congresswoman": "representative", "comm": "commissioner", "commissioner": "commissioner"}
CHAIRS = {"chair", "chairman", "chairwoman", "chairperson", "madam chair", "mr chairman"}
OFFICES = {"chair", "member", "witness"}
#: Labels of people who are in no list of speakers.
OUTSIDERS = {"voice", "voices", "unknown", "clerk", "reporter", "speaker", "audience", "staff", "interpreter", "translator", "operator", "announcer", "moderator", "secretary", "male voice", "female voice", "unidentified", "unidentified speaker", "unidentified voice", "unknown speaker", "court reporter", "presiding officer", "audience member", "man", "woman", "protester", "bailiff", "sergeant at arms", "page", "host", "narrator", "participant", "panelist", "several voices", "all"}
#: Words that head a part of a speech and are no label.
HEADINGS = {"question", "answer", "questions", "answers", "note", "notes", "statement", "summary", "exhibit", "background", "conclusion", "introduction", "remarks", "opening remarks", "closing remarks", "opening statement", "closing statement", "recommendation", "recommendations", "response", "comment", "example", "finding", "findings", "point", "issue", "topic", "agenda", "attachment", "appendix", "section", "item", "part", "first", "second", "third", "finally", "again", "also", "and", "but", "so", "well", "now", "yes", "no", "frankly", "respectfully", "hmm", "um", "uh", "thank you", "thanks", "to be clear", "on that point", "as you know", "in short", "for the record", "that is", "for example", "you know", "i mean"}
HESITATIONS = r"u+[hm]+|e+r+m?|a+h+|h+m+|m+h?m+|o+h+|uh-huh|mm-hmm"

#: Digits and signs that character recognition leaves in names.
SEEN_AS = str.maketrans({"1": "l", "0": "o", "5": "s", "|": "l", "3": "e", "8": "b", "6": "b", "!": "l"})


def notes(stop: str) -> str:
    """The rule of annotations, nested to any depth.  ``stop`` are characters that no annotation holds."""
    return rf"note <- %[]{stop}% / %(){stop}% / %{{}}{stop}% / ~\*[^*\n]+\*~ / ~<[^<>\n]+>~ / ~♪[^♪\n]*♪~"


#: Grammar of a transcript by lines, in three house styles.
LINES = Grammar(
    r"""
captions <- _gap (caption_turn / remark / speech)*
indented <- ~\n*~ (indented_turn / remark / speech)*
plain <- _gap (plain_turn / remark / speech)*
caption_turn <- _clocks ~>>+[ \t]*~ _clocks caption_label _sp _clocks
indented_turn <- _newpara (clock _gap)* ~(?<=\n)(?:[ ]{2,}|\t)|(?<![\s\S])(?:[ ]{2,}|\t)~ _clocks indented_label _sp _clocks
plain_turn <- _newpara _clocks ~[ \t]*~ plain_label _sp _clocks
caption_label <- label ~[ ]*(?::|\.|[ ][-–—]+)(?=\s|$)~
indented_label <- dotted ~[ ]*(?:\.|:|[ ][-–—]+)(?=\s|$)~
plain_label <- label ~[ ]*(?::|[ ]*[-–—]+)(?=\s|$)~
label <- ~\(?[^\W_](?:[\w'’.,()]|-(?=\w))*(?:[ ]\(?[^\W_](?:[\w'’.,()]|-(?=\w))*)*(?<![ ,])(?=[ ]*(?::|[ ][-–—]))~
dotted <- ~(?:(?:mr|mrs|ms|miss|dr|prof|sen|rep|comm|[^\W\d_])\.[ ])*[^\W_][^.:\n]+?(?:[ ](?:[^\W\d_])\.[ ][^.:\n]+?)?(?=[ ]*(?:\.|:|[ ][-–—])(?:\s|$))~
remark <- _newpara ~[ \t]*~ (note / clock)+ ~[ \t]*(?=\n|$)\n*~
NOTES_IN_LINES
_clocks <- (clock _gap)*
clock <- ranged / ~[\[(]~ (hms / dotted_time) ~[\])]~
ranged <- time ~[ ]*-->[ ]*~ time
time <- ~\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?~
dotted_time <- ~\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?~
hms <- ~(?:\d{1,3}h)?\d{1,3}m(?:\d{1,2}(?:\.\d+)?s)?~
_newpara <- ~(?<![^\n]\n)(?<=\n)|(?<![\s\S])|(?<=\n)(?=[ ]{2,}|\t)~
_gap <- ~\s*~
_sp <- ~[ \t]*~
speech <- ~[^\n]*(?:\n(?![\n \t>\[({\d*♪<])[^\n]*)*\n*~
""".replace("NOTES_IN_LINES", notes("\\n")),
    re.I,
)

#: Grammar of the inside of an utterance: clock marks, nested annotations, hesitations.
INSIDE = Grammar(
    r"""
inside <- (clock / note / hesitation / plain)*
NOTES_INSIDE
clock <- ~[\[(]\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d+)?[\])]|[\[(](?:\d+h)?\d+m(?:\d+s)?[\])]|\d\d:\d\d:\d\d[.,]\d{3}[ ]*-->[ ]*\d\d:\d\d:\d\d[.,]\d{3}~
hesitation <- ~(?<![\w'’-])(?:HESITATION)(?![\w'’]|-\w)(?:[ ]?[,.]|-+)?|(?<=[ ,])(?:you[ ]know|I[ ]mean),(?=[ ])~
plain <- @~[\[(*<♪]|\d\d:\d\d:\d\d[.,]\d{3}|(?<![\w'’-])(?:HESITATION)(?![\w'’]|-\w)|(?<=[ ,])(?:you[ ]know|I[ ]mean),(?=[ ])~ / ~[\s\S]~
""".replace("HESITATION", HESITATIONS).replace("NOTES_INSIDE", notes("")),
    re.I,
)
_SIMPLE = re.compile(r"[\[(*<♪]|-->|\b(?:" + HESITATIONS + r")\b|\b(?:you know|I mean),", re.I)
#: Notes in brackets that are sounds or events, or clocks; other brackets inside speech are speech.
SOUNDS = re.compile(r"(?i)^[\W_]*(?:(?:inaudible|crosstalk|cross talk|laughter|laughs?|laughing|applause|gavel|pause|paused|sighs?|coughs?|coughing|clears throat|off[ -]mic\w*|off[ -]microphone|background (?:noise|music)|music|noise|silence|unintelligible|indiscernible|no (?:audible )?response|recess|chatter|cheers?|cheering|sobs?|sniffs?|phonetic|sic|static|bell rings?|phone ring\w*)\b.*|[\d:.,\s]*|♪.*)$")
WORD = re.compile(r"[^\W_]")


def clean(text: str) -> str:
    """The utterance without clock marks, sound notes and hesitations, with single blanks."""
    if not _SIMPLE.search(text):
        return " ".join(text.split())
    tree = INSIDE.parse(text, "inside", whole=False)
    out, at = [], 0
    for n in tree.children:
        if n.name == "plain":
            out.append(text[n.start : n.end])
        elif n.name == "note" and text[n.start] in "([" and not SOUNDS.match(text[n.start + 1 : n.end - 1]):
            out.append(text[n.start : n.end])
        else:
            out.append(" ")
        at = n.end
    out.append(text[at:])
    joined = re.sub(r"\s+([,.;:?!])", r"\1", " ".join("".join(out).split()))
    return re.sub(r"^(?:[,.;:\s-]+)(?=\w)|(?<=[,.;]),+", "", joined)


def seconds(mark: str) -> float:
    """The start of a clock mark in seconds."""
    if m := re.match(r"\D*?(?:(\d+)h)?(\d+)m(?:(\d+(?:\.\d+)?)s)?", mark):
        return int(m[1] or 0) * 3600 + int(m[2]) * 60 + float(m[3] or 0)
    parts = re.search(r"\d+(?::\d+)+(?:[.,]\d+)?", mark)[0].replace(",", ".").split(":")
    out = 0.0
    for p in parts:
        out = out * 60 + float(p)
    return out


#: Grammar of a label, over its lower-case words.
LABEL = Grammar(
    r"""
label <- _the? (chair _sp name _tail / chair _tail / title _sp last_first _tail / title _sp name _tail / last_first _tail / name _tail)
_the <- ~the[ ]~
_tail <- (_sp home)? (_sp? office)? _sp?
chair <- ~(?:(?:mr\.?|madam|vice)[ ])?chair(?:man|woman|person)?(?![\w])~
title <- ~(?:mrs|mr|ms|miss|dr|doctor|professor|prof|senator|sen|representative|rep|congressman|congresswoman|commissioner|comm)(?![\w])\.?~
last_first <- last ~,[ ]*~ first
last <- _word
name <- first _sp (~\w\.?[ ]~)? last / last
first <- initial / _word
initial <- ~[^\W\d_]\.|[^\W\d_](?=[ ])~
home <- ~of[ ]~ place
place <- ~[\w'’ -]+?(?=[ ]*\(|$)~
office <- "(" ~[^()]*~ ")"
_word <- ~(?!of[ ])[\w'’-]+~
_sp <- ~[ ]+~
"""
)


def near(a: str, b: str, most: int = 2) -> int:
    """Edit distance with neighbouring swaps, or ``most + 1`` if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            nxt.append(d)
        if min(nxt) > most:
            return most + 1
        before, row = row, nxt
    return row[-1]


class Roster:
    """The people of one hearing and what the labels of its transcripts mean."""

    def __init__(self, packed: str):
        self.people = []
        for line in packed.split("\x1e") if packed else []:
            sid, name, honorific, office, home = line.split("\x1f")
            words = name.lower().split()
            self.people.append({"id": int(sid), "name": name, "first": " ".join(words[:-1]), "last": words[-1] if words else "", "title": TITLES.get(honorific.lower().rstrip("."), honorific.lower()), "office": office.lower(), "home": home.lower()})
        self._known: dict[str, tuple | None] = {}

    def resolve(self, label: str):
        """``(ids, certain)`` of the people a label may mean; empty ids for an outsider; None if it is no label."""
        if label not in self._known:
            if len(self._known) > 20_000:
                self._known.clear()
            self._known[label] = self._resolve(" ".join(label.split()))
        return self._known[label]

    def _resolve(self, label: str):
        low = label.lower().rstrip(".")
        bare = re.sub(r"^the ", "", low)
        if low in HEADINGS:
            return None
        if bare in OUTSIDERS or re.match(r"(?:unidentified|unknown|several|the (?:court )?reporter)\b", low):
            return ()
        seen = " ".join(w if w.rstrip(".,").isdigit() else w.translate(SEEN_AS) for w in low.split())
        tree = LABEL.parse(seen, "label")
        if tree is None:
            return None
        chair, title, home, office = (tree.find(x) for x in ("chair", "title", "home", "office"))
        name = tree.find("last_first") or tree.find("name")
        if name is None:
            return tuple(p["id"] for p in self.people if p["office"] == "chair")
        last = name.find("last").text(seen)
        first = name.find("first").text(seen) if name.find("first") else ""
        place = home.find("place").text(seen).strip() if home else ""
        post = office.text(seen).strip("() ") if office else ""
        want = TITLES.get(title.text(seen).rstrip(".")) if title else None
        best: list[tuple] = []
        for p in self.people:
            d = near(last, p["last"])
            if d > (2 if len(last) > 5 else 1 if len(last) > 3 else 0):
                continue
            far = 0
            if first:
                if len(first.rstrip(".")) == 1:
                    if not p["first"].startswith(first[0]):
                        continue
                elif (far := near(first, p["first"])) > 2:
                    continue
            if far + d > 2:
                continue
            # what else the label says decides between people of one surname
            odd = (min(near(place, p["home"]), 3) if place else 0) + (bool(chair) and p["office"] != "chair") * 2 + (post in OFFICES and post != p["office"]) * 2 + (bool(want) and want != p["title"])
            best.append((d + far, odd, p["id"]))
        if not best:
            if title or chair or label.isupper():
                return ()
            words = re.findall(r"[\w'’-]+", label)
            shaped = 1 <= len(words) <= 3 and all(w[0].isupper() for w in words)
            return () if shaped else None
        least = min((d, o) for d, o, _ in best)
        return tuple(i for d, o, i in best if (d, o) == least)


@lru_cache(maxsize=4096)
def roster(packed: str) -> Roster:
    return Roster(packed)


STYLES = {"captions": re.compile(r"(?m)^[ \t]*>>"), "indented": re.compile(r"(?m)\A(?:\s*\n)?(?:[ ]{2,}|\t)\S")}


def style_of(text: str) -> str:
    return next((k for k, p in STYLES.items() if p.search(text)), "plain")


def utterances(text: str, people: Roster) -> list[tuple[tuple, str, float | None]]:
    """``(ids, raw text, clock)`` of what stands under each label, in the order of the text."""
    text = re.sub(r"(?<![ \t])[ \t]+\n", "\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    tree = LINES.parse(text, style_of(text), whole=False)
    found: list[list] = []
    current = None
    for n in tree.children:
        if n.name.endswith("_turn"):
            outer = n.find("caption_label") or n.find("indented_label") or n.find("plain_label")
            ids = people.resolve(outer.children[0].text(text))
            if ids is not None:
                clock = next((seconds(c.text(text)) for c in n.children if c.name == "clock"), None)
                current = [ids, [], clock]
                found.append(current)
                continue
        if n.name == "remark":
            continue
        if current is not None:
            current[1].append(n.text(text))
    return [(ids, "".join(parts), clock) for ids, parts, clock in found]


def turns(text: str | None, people: Roster) -> list[tuple[int, int, str]]:
    """``(turn_no, speaker_id, text)`` of the clean turns of one passage, in spoken order."""
    if not text:
        return []
    said = utterances(text, people)
    if said and all(c is not None for _, _, c in said):
        said = [s for _, s in sorted(enumerate(said), key=lambda x: (x[1][2], x[0]))]
    out: list[list] = []
    latest: dict[tuple, int] = {}
    for ids, raw, _ in said:
        if len(ids) == 1:
            who = ids[0]
        elif ids:  # people of one surname: the one who spoke last in this passage, else the first listed
            who = next((latest[i] for i in sorted(ids, key=lambda i: -latest.get(i, -1)) if i in latest), None)
            who = max((i for i in ids if i in latest), key=lambda i: latest[i], default=min(ids))
        else:
            who = 0
        words = clean(raw)
        if not WORD.search(words):
            continue
        if who:
            latest[who] = len(out)
        if out and who and out[-1][0] == who:
            out[-1][1] += " " + words
        else:
            out.append([who, words])
    return [(k, who, words) for k, (who, words) in enumerate(out, 1)]


def plain_type(column):
    """``passage_type`` without case, blanks and marks of spelling."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "_")


def speaker_turns(passages: DataFrame, speakers: DataFrame) -> DataFrame:
    """One row ``(doc_id, turn_no, speaker_id, speaker, text, passage_type)`` per clean turn of each passage.

    Of the rows of a ``doc_id`` the one with the latest ``landed_at`` holds (of equal ones the last by text).  Rows with a null doc_id, and texts that
    are null, empty or without a label, give no turns.  The hearing is read from ``doc_id``.  Procedural passages are left
    out; a null type counts.  ``speaker`` is the full name, null for an outsider (speaker_id 0).  Other columns are not read.

    The table of people is grouped by hearing and joined; Spark broadcasts it only if its size is below the threshold.
    """
    rows = passages.select("doc_id", "text", "landed_at", "passage_type").where(F.col("doc_id").isNotNull())
    first = Window.partitionBy("doc_id").orderBy(F.col("landed_at").desc_nulls_last(), F.col("text").desc_nulls_last(), F.col("passage_type").desc_nulls_last())
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    kind = plain_type(F.col("passage_type"))
    rows = rows.where(kind.isNull() | (kind != "procedural")).select("doc_id", "text", kind.alias("passage_type"), F.regexp_extract("doc_id", r"^(.*?)_p[^_]*(?:_[^_]*)?$", 1).alias("_hearing"))
    person = F.concat_ws("\x1f", F.col("speaker_id").cast("string"), *(F.coalesce(F.regexp_replace(c, "[\x1e\x1f]", " "), F.lit("")) for c in ("full_name", "honorific", "office", "home")))
    people = speakers.where("speaker_id is not null and hearing_id is not null").groupBy(F.col("hearing_id").alias("_hearing")).agg(F.array_join(F.array_sort(F.collect_set(person)), "\x1e").alias("_people"))
    joined = rows.join(people, "_hearing", "left").select("doc_id", "passage_type", "text", F.coalesce("_people", F.lit("")).alias("_people"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, no, sid, name, said = [], [], [], [], []
            for k, (text, packed) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                who = roster(packed)
                names = {p["id"]: p["name"] for p in who.people}
                for n, i, words in turns(text, who):
                    index.append(k)
                    no.append(n)
                    sid.append(i)
                    name.append(names.get(i))
                    said.append(words)
            at = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(no, pa.int32()), pa.array(sid, pa.int64()), pa.array(name, pa.string()), pa.array(said, pa.string()), b.column(1).take(at)], names=["doc_id", "turn_no", "speaker_id", "speaker", "text", "passage_type"])

    return joined.mapInArrow(run, "doc_id string, turn_no int, speaker_id bigint, speaker string, text string, passage_type string")
