"""Broken prompt and response pairs in conversations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.llm import conversation as C
from relevspark.llm.langid import asks_for, language_of

# Classes of words, by what they do in a sentence that declines.
LEMMAS = {
    "self": "i im me my mine myself je j moi me m ich mir mich meine yo me mi io eu я мне",
    "subject": "i je j ich yo io eu я we nous wir nosotros",
    "owner": "my our mes nos mi mis nuestras nuestros meine meinen mein unsere mie minhas мои",
    "owed": "debo debemos devo",
    "modal": "can could cannot able unable will won would wouldn may might am m comfortable allowed permitted authorized authorised willing equipped supposed designed going position peux puis pouvons autorisé autorisée permis mesure kann könnte darf dürfte werde möchte puedo podemos podría autorizado autorizada posso могу можем",
    "first": "puedo podemos podría posso могу",
    "not": "not cannot unable t nt never no pas ne jamais nicht kein keine keinen keinerlei no nunca non não не unwilling",
    "help": "help assist answer provide respond reply comply discuss do share offer talk support fulfill fulfil complete engage comment speak give write create generate continue advise cover address process fulfilling answering discussing helping assisting providing doing giving carry aider aide répondre parler fournir discuter donner traiter helfen beantworten antworten sprechen geben besprechen behilflich auskunft nachkommen ayudar ayudarte ayudarle ayudarlo responder hablar dar contestar comentar tratar proporcionar aiutare aiutarti rispondere ajudar responder ответить помочь обсуждать",
    "decline": "decline declining refuse refusing reject abstain refrain décliner refuser refuse ablehnen verweigern absagen rechazar declinar niego negarme rifiuto rifiutare recusar отказаться отказываюсь",
    "away": "turn steer stay keep take leave back opt sit",
    "gone": "down clear away out off aside",
    "must": "must have need should obliged forced dois devons muss müssen debo debemos tengo devo вынужден",
    "norms": "guidelines guideline policy policies rules rule principles terms programming instructions règles consignes principes politique normas reglas políticas política pautas richtlinien regeln vorgaben grundsätze правила",
    "allow": "allow allows permit permits let permettent permet autorisent permiten permite dejan erlauben zulassen gestatten",
    "forbid": "prevent prevents prohibit prohibits forbid forbids bar bars against violates violate breaks interdisent interdit empêchent empêche contraire prohíben prohíbe impiden impide contra verbieten verbietet untersagen gegen",
    "outside": "outside beyond limits scope fuera allá außerhalb hors dehors",
    "prefer": "rather prefer préfère préférerais prefiero preferiría lieber",
    "pass": "pass",
    "comment": "comment",
    "thing": "something thing quelque algo etwas",
}
#: Templates of refusals over these classes, in the order of the words.
REFUSALS = [
    x.split()
    for x in """self modal not help
self not modal help
modal self not help
modal not self help
self modal not
not first help
not first
subject must decline
subject decline
owed decline
decline subject must
must subject decline
self away gone
subject must pass
owner norms not allow
not owner norms allow
owner norms forbid
forbid owner norms
outside self modal
outside self not
self prefer not
prefer not help
prefer self not
not thing self modal
not thing self help
self not comfortable help
not comment""".splitlines()
]
#: Templates that say nothing of help; they count at the end of a sentence only, with at most so many words after them.
BARE, REST = (["self", "modal", "not"], ["not", "first"]), 3
#: Words that may stand between two words of a template.
GAP = 4
#: Words after which a sentence that declines gives help all the same.
TURNS = set("but however though instead mais cependant pourtant pero sino aber jedoch sondern ma mas но".split())
#: Courtesies that are no help of their own, as pairs of classes of words, and single words that may stand alone.
COURTESIES = [
    tuple(set(x.split()) for x in line.split("|"))
    for line in """thank thanks merci gracias danke grazie obrigado спасибо|understanding patience compréhension comprensión verständnis comprensione understand asking
hope espère espero hoffe|understand comprenez entiendas entienda verstehen
else other another different otherwise more autre autres otra otro otras andere anderen anderes weitere|help assist know question questions topic topics subject ask discuss sujet tema temas pregunta frage fragen thema hilfe besoin
feel|free
consult contact see seek ask speak talk consultez contactez consulte consulta wenden|professional expert experts specialist doctor lawyer attorney someone professionnel spécialiste profesional especialista fachmann fachperson experten
apologize apologise apologies excuse|inconvenience trouble that this confusion
happy glad pleased gern gerne heureux feliz|help assist helfen aider ayudar
let laissez|know""".splitlines()
]
ALONE = set("no nope sorry apologies unfortunately désolé désolée malheureusement leider siento lamento perdón understand understood i m am im so lo je suis es tut mir leid nein non".split())
#: What stands for an absent answer.
ABSENT = {"", "null", "none", "nil", "nan", "na", "n/a", "n.a.", "n.a", "no response", "no answer", "empty", "undefined", "no content", "not available", "missing", "blank", "no reply", "no output", "deleted", "removed", "todo", "tbd", "placeholder", "error", "null null", "response", "answer", "sans réponse", "pas de réponse", "sin respuesta", "keine antwort", "leer", "vide", "vacío", "content", "no data"}
#: Unpunctuated closings that end an answer.
CLOSINGS = re.compile(r"(?i)^(?:(?:i )?hope (?:that|this|it)|thanks?|thank you|many thanks|cheers|regards|best(?: regards| wishes)?|kind regards|good luck|let me know|enjoy|take care|have fun|have a|happy|you're welcome|sincerely|yours|that's all|that is all|all done|the end|(?:done|ok|okay|yes|no|sure|fertig|ende)\W*$|bonne|bon|merci|cordialement|voilà|j'espère|espero|gracias|saludos|suerte|eso es todo|viel|danke|gruß|grüße|mit freundlichen|ich hoffe|das ist alles|spero|grazie|obrigad[oa])\b")
#: Words that cannot end a sentence.
DANGLING = set("""the a an and or but nor of to in on at by for with from into onto than then that which who whom whose when while where because since if unless until although though as so is are was were be been being
has have had do does did can could will would shall should may might must my your his her its our their this these those any every each some no not very more most about between through during without within under over e.g i.e etc via per
le la les un une des du de au aux et ou mais que qui quand dont où pour par sur dans avec sans sous entre est sont à en ce cette ces son sa ses leur leurs ne pas parce car si doit peut
el los las una unos unas del al y o u pero que quien cuando donde para por sobre con sin entre es son su sus este esta estos estas no porque si debe puede lo
der die das den dem des ein eine einen einem einer eines und oder aber dass wenn weil als ob mit ohne für auf an im zu zum zur von vom bei beim nach über unter ist sind war wird werden hat haben nicht sein seine ihr ihre""".split())
_TOKEN = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_]+")
_SENTENCE = re.compile(r"[^.!?。！？\n]+")
_FRAME = set("you asked your question here is was the prompt again sure repeat repeating said original as i my answer quote user wrote asks to votre vous avez demandé voici su pregunta usted preguntó sie fragten ihre frage lautet hier ist re echo text input".split())
_ECHO = re.compile(r"(?i)\b(?:repeat|echo|copy|return only|reply only|output only|say exactly|write exactly|verbatim|proofread|correct|fix the|spell(?:ing)?|répét|recopi|corrig|wiederhol|korrigier|repit|repet)")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; what both begin and end with needs none."""
    n = min(len(a), len(b))
    start = next((k for k in range(n) if a[k] != b[k]), n)
    end = next((k for k in range(n - start) if a[-1 - k] != b[-1 - k]), n - start)
    if start or end:
        return start + end + lcs(a[start : len(a) - end], b[start : len(b) - end])
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = places.get(y, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def shingles(words: list[str], n: int = 3) -> set[tuple]:
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


_CLASS: dict[str, set[str]] = {}
for _name, _words in LEMMAS.items():
    for _w in _words.split():
        _CLASS.setdefault(_w, set()).add(_name)
#: Classes that some template starts with.
_HEADS: dict[str, list[list[str]]] = {}
for _t in REFUSALS:
    _HEADS.setdefault(_t[0], []).append(_t)
_NONE: set[str] = set()


def aligned(template: list[str], classes: list[set[str]], start: int) -> int | None:
    """The place after the last word of the template if its classes are a subsequence from ``start`` on with at most GAP other words between two."""
    ends = {start}
    for c in template[1:]:
        # a word may stand for two classes in a row (such as one that is both a modal verb and a denial)
        ends = {j for i in ends for j in range(i, min(len(classes), i + GAP + 2)) if c in classes[j] and (j > i or len(classes[j]) > 1)}
        if not ends:
            return None
    return min(ends) + 1


def refuses(words: list[str]) -> int | None:
    """The place up to which a sentence aligns with a template of refusals, or None."""
    classes = [_CLASS.get(w, _NONE) for w in words]
    best = None
    for i, held in enumerate(classes):
        for c in held:
            for t in _HEADS.get(c, ()):
                end = aligned(t, classes, i)
                if end is not None and (best is None or end > best) and (t not in BARE or len(words) - end <= REST):
                    best = end
    return best


def courteous(words: list[str]) -> bool:
    """Whether a short sentence is a courtesy."""
    if len(words) <= 6 and ALONE.issuperset(words):
        return True
    held = set(words)
    return len(words) <= 18 and any(all(c & held for c in pair) for pair in COURTESIES)


def declines(answer: str) -> bool:
    """Whether the answer aligns with refusal templates and gives nothing besides."""
    refused, help_words = 0, 0
    for s in _SENTENCE.findall(answer):
        w = tokens(s)
        if not w:
            continue
        end = refuses(w)
        if end is not None:
            refused += 1
            turn = next((k for k in range(end, len(w)) if w[k] in TURNS), len(w))
            if refuses(w[turn:]) is None and not courteous(w[turn:]):
                help_words += max(0, len(w) - turn - 1)
        elif not courteous(w):
            help_words += len(w)
        if help_words > 6:
            return False
    return refused > 0


def copies(prompt: list[str], answer: list[str], in_answer: set[str], text: str = "") -> bool:
    """Whether ``answer`` is ``prompt`` again, perhaps framed, repeated or slightly changed, and nothing more."""
    if len(prompt) < 2 or not answer:
        return False
    in_prompt = set(prompt)
    if len(in_prompt & in_answer) < 0.6 * len(in_prompt):
        return False
    new = sum(w not in in_prompt and w not in _FRAME for w in answer)
    if new > 0.25 * len(answer) + 1:
        return False
    p, a = shingles(prompt), shingles(answer)
    both = len(p & a)
    # a much longer answer is the prompt many times over, or no copy
    if len(answer) > 6 * len(prompt) + 12 and both < 0.6 * len(a):
        return False
    if len(prompt) >= 8 and (both < 0.3 * len(p) or both < 0.3 * len(a)):
        return False
    return lcs(prompt, answer) >= (0.9 if _ECHO.search(text) else 0.75) * len(prompt)


_LIST = re.compile(r"^\s*(?:[-*•+]|\d+[.)]|[a-z][.)])\s")
_STUB = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s*$")
_DONE = re.compile(r"""[.!?。！？…:"'”’»)\]}>*_~`]|[^\w\s,;(\[{<\-–—/&+=\\#@|]""")


def breaks_off(answer: str) -> bool:
    """Whether an answer stops before its end."""
    a = answer.strip().strip("​﻿").rstrip()
    if not a:
        return False
    if a.count("```") % 2:
        return True
    last = a.rsplit("\n", 1)[-1].strip()
    if last.startswith("```"):
        return False
    if _STUB.match(last) or last.count("**") % 2 or last.count("`") % 2:
        return True
    if last[-1] in ".!?。！？…":
        return False
    if re.search(r"https?://|www\.", last.rsplit(None, 1)[-1]):
        return False
    if last[-1] in ",;([{<–—/&+=\\" or (last[-1] == "-" and len(last) > 1):
        return True
    tail = re.split(r"(?<=[.!?。！？])\s+", last)[-1]
    if tail.count("(") > tail.count(")") or tail.count("[") > tail.count("]"):
        return True
    if _DONE.match(last[-1]):
        return False
    words = _TOKEN.findall(tail.lower())
    if not words:
        return False
    if words[-1] in DANGLING and not (len(words) == 1 and tail == last):
        return True
    if _LIST.match(last):
        return False
    if re.match(r"^[\w\[\].]+\s*=\s*\S", last) or not re.search(r"[^\W\d_]", last):
        return False
    if re.search(r"[぀-鿿]$", last):
        return "。" in a and len(words) > 3
    # a last sentence without its mark, where the others have theirs, is cut unless it is a closing
    before = a[: len(a) - len(tail)]
    if re.search(r"[.!?](?:\s|$)", before):
        return not (CLOSINGS.match(tail) and len(words) <= 6) and not (tail == last and len(words) <= 3 and "\n" in a)
    return False


_MARKS = re.compile(r"[\W_]+")
#: Blanks and common marks around a stand-in, of which none is longer than 60 characters.
_EDGE = " \t\r\n\f\v.,;:!?-_=*#~^`'\"()[]{}<>|/\\+&%$…–—·•"
_LONGEST_STAND_IN = 60


def absent(answer: str | None) -> bool:
    """Whether nothing is in the answer but blanks, marks or a stand-in for an absent answer."""
    if not answer:
        return True
    core = answer.strip(_EDGE)
    if len(core) > _LONGEST_STAND_IN and core[0].isalnum() and core[-1].isalnum():
        return False
    bare = _MARKS.sub(" ", answer).strip().lower()
    if bare in ABSENT or answer.strip().strip("[](){}<>*_\"'`").strip(" .").lower() in ABSENT:
        # a sign with a meaning of its own, such as an emoji, is an answer
        return bare != "" or not re.search(r"[\U0001F300-\U0001FAFF☀-➿←-⇿∀-⋿]", answer)
    return False


def defect(prompt: str | None, answer: str | None) -> str | None:
    """The defect of one pair, or None.  ``answer`` None means that there is no answer."""
    if absent(answer):
        return "empty"
    p = prompt or ""
    pw, aw = tokens(p), tokens(answer)
    held = set(aw)
    if declines(answer):
        return "refusal"
    if copies(pw, aw, held, p):
        return "copy"
    spoken = language_of(answer, aw)
    if spoken and p and (asked := language_of(p, pw)) and asked != spoken and not asks_for(p, spoken):
        return "language"
    return "truncated" if breaks_off(answer) else None


def pair_up(roles: list, contents: list) -> list[tuple[int, str | None, str | None]]:
    """``(prompt_pos, prompt, answer)`` of one conversation; answers of several turns are joined by lines."""
    out: list[list] = []
    for k, role in enumerate(roles):
        who = C.party(role)
        if who == "user":
            out.append([k, contents[k], None])
        elif who == "assistant" and out:
            said = contents[k] or ""
            out[-1][2] = said if out[-1][2] is None else out[-1][2] + "\n" + said
    return [tuple(x) for x in out]


def broken_pairs(conversations: DataFrame, id_col: str = "row_id", column: str = "conversation") -> DataFrame:
    """One row ``(<id>, prompt_pos, defect)`` per defective pair.

    A pair is a user turn and the assistant turns before the next user turn.  Null and empty conversations have no
    pairs; a null prompt is an empty one; null roles belong to neither party; rows that repeat are judged each;
    other columns are not read.  A narrow map over whole texts, without a shuffle.
    """
    key = conversations.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, place, found = [], [], []
            starts, ends, roles, contents = C.parts(b.column(1))
            for k, (s, e) in enumerate(zip(starts, ends)):
                for pos, prompt, answer in pair_up(roles[s:e], contents[s:e]):
                    if (d := defect(prompt, answer)) is not None:
                        index.append(k)
                        place.append(pos)
                        found.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int32())), pa.array(place, pa.int32()), pa.array(found, pa.string())], names=["id", "prompt_pos", "defect"])

    plain = F.transform(F.col(column), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    out = conversations.select(F.col(id_col).alias("id"), plain.alias("conversation")).mapInArrow(run, f"id {key}, prompt_pos int, defect string")
    return out.withColumnRenamed("id", id_col)
