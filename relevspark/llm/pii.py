"""Personal information in free text: proposals by patterns, confirmation by checksums, scores by context.

Each proposal has a base score; a checksum that holds or a context word near it raises it, words of other numbers (orders, books,
versions) lower it.  Proposals of at least ``ACCEPT`` hold; where they overlap emails stand first, then addresses, then surer and longer ones.  Checksums: Luhn for numbers of three
triples, modulo 97 for French, 11,10 for German and 23 for Spanish ones; account and card numbers are no identity numbers and stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.llm.langid import FUNCTION_WORDS

KINDS = ("email", "phone", "idnum", "address", "name")
ACCEPT = 0.5
#: Most rows of the table of name parts that are sent to the executors; a larger table is an error, not cut.
MOST_PARTS = 2_000_000


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


# -- checksums ----------------------------------------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """French social security number: the last two digits are 97 less the rest modulo 97."""
    return len(digits) == 15 and int(digits[13:]) == 97 - int(digits[:13]) % 97


def mod11_10(digits: str) -> bool:
    """ISO 7064 MOD 11,10, as in German tax numbers."""
    p = 10
    for c in digits[:-1]:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def dni(text: str) -> bool:
    """Spanish identity number: the letter follows from the number modulo 23."""
    number = text[:-1].upper().translate(str.maketrans("XYZ", "012"))
    return number.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == text[-1].upper()


# -- context --------------------------------------------------------------------------------------------------------------
# Words near a number that tell what it is.
_ID_WORDS = re.compile(r"(?i)\b(?:ssn|social security|socials?|tax (?:id|number|no)|tin\b|itin|ein\b|passport|passeport|pasaporte|reisepass|passnummer|licen[cs]e|permis|carnet|führerschein|ausweis\w*|steuer\w*|identi\w*|national id|id card|id number|id no|id:|dni|nie\b|nif|nino|national insurance|sécurité sociale|seguridad social|sozialversicherung\w*|número de|cpf|personal number|personnummer|carte d'identité|cédula|mrz|паспорт|снилс)")
_PHONE_WORDS = re.compile(r"(?i)\b(?:call|phone|fax|tel|tél|teléfono|téléphone|telefon|mobile|cell|ring|text|reach|number|número|numéro|nummer|llám\w*|rufen|appel\w*|whatsapp|sms|dial|handy|móvil|contact|ext)\b")
_OTHER_WORDS = re.compile(r"(?i)\b(?:order|pedido|commande|bestellung|isbn|issn|version|sku|invoice|tracking|budget line|line|serial|model|part no|item|article|years?|doi|page|section|chapter|build|port|ip|hash|seed|ticket|case no|flight)\b[^.!?\n]{0,12}$")
_NAME_WORDS = re.compile(r"(?i)(?:\bname(?: is| ?:)|\bname ist|me llamo|m'appelle|\bich heiße|\bpatient,?|\btenant:?|\bask for|\bcc:|\bsigned,?|\bfirmado:?|\bsigné:?|\bgez\.|\bneighbou?r|\bvecin[ao]|\bvoisine?|\bnachbar(?:in)?|\bcontact:?|\battn:?|\bdear|\bcaller:?|\bclient:?|\bcustomer:?|\bemployee:?|\bflat with|\bfrom:|\bto:|mieter(?:in)?:?|inquilin[ao]:?|locataire:?|kind regards,?|regards,?|sincerely,?)\s?:?\s*$")

# -- emails -----------------------------------------------------------------------------------------------------------------
_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?\s?@\s?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])|[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}")
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?"
_AT = r"(?:\s?[(\[{<]\s?(?:at|AT|At|arroba|chez|ät|@)\s?[)\]}>]\s?|\s?＠\s?)"
_DOT_SAID = r"(?:\s?[(\[{<]\s?(?:dot|DOT|Dot|punto|punkt|point|\.)\s?[)\]}>]\s?|\s(?:dot|DOT|Dot|punto|punkt)\s)"
_DOT = rf"(?:{_DOT_SAID}|\.)"
_LABELS = r"[A-Za-z0-9-]+(?:{0}[A-Za-z0-9-]+)*?{0}[A-Za-z]{{2,24}}(?![\w-])(?:{0}[A-Za-z]{{2,24}}(?![\w-]))*"
#: Written around with signs, or with plain words; a plain "at" counts only before a "dot" that is said.
_EMAIL_WORDS = re.compile(rf"{_LOCAL}(?:{_AT}{_LABELS.format(_DOT)}|\s?@\s?{_LABELS.format(_DOT_SAID)}|\s(?:at|AT|At|arroba)\s{_LABELS.format(_DOT_SAID)})")
_SAYS_DOT = re.compile(r"(?i)[(\[{<]\s?(?:at|arroba|@)\s?[)\]}>]|\s(?:dot|punto|punkt)\s|＠|[(\[{<](?:dot|punto|punkt|point)[)\]}>]")


def emails(text: str) -> Iterator[Span]:
    if "@" in text:
        for m in _EMAIL.finditer(text):
            yield Span("email", m.start(), m.end(), 1.0)
    if _SAYS_DOT.search(text):
        for m in _EMAIL_WORDS.finditer(text):
            yield Span("email", m.start(), m.end(), 0.95)


# -- numbers ------------------------------------------------------------------------------------------------------------------
_RUN = re.compile(r"\d(?:[ .\-/()]{0,3}\d|\(0\)|\)){5,}")
_EXT = r"(?:,?\s?(?:ext\.?|extension|x|poste|Durchwahl|int\.?)\s?\d{1,6})?"
_PHONE = re.compile(
    rf"(?<![\w+/.,#-])(?<!\d )(?:"
    rf"\+\d{{1,3}}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,5}}){{1,5}}"
    rf"|(?:1[ .-])?\(\d{{3}}\)[ .-]?\d{{3}}[ .-]\d{{4}}"
    rf"|(?:1[ .-])?[2-9]\d\d([.-])[2-9]\d\d\1\d{{4}}|(?:1[ ])?[2-9]\d\d[ ][2-9]\d\d[ ]\d{{4}}"
    rf"|0\d(?:([ .-]?)\d\d)(?:\2\d\d){{3}}"
    rf"|\(?0\d{{2,4}}\)?[ /-]\d{{3,5}}[ -]?\d{{3,5}}"
    rf"|1[2-9]\d\d[2-9]\d{{6}}"
    rf"){_EXT}(?![\w]|[-/]\d|[.,]\d)"
)
_IDS: list[tuple[re.Pattern, float, object]] = [
    (re.compile(r"(?<![\w/.,-])(?<!\d )\d{3}([- ])\d\d\1\d{4}(?![\w/]|-\d)"), 0.7, None),  # social security
    (re.compile(r"(?<![\w-])[A-Z]{2}( ?)\d\d\1\d\d\1\d\d\1[A-D](?!\w)"), 0.8, None),  # national insurance
    (re.compile(r"(?<![\w-])[A-Z]\d{3}-\d{4}-\d{3,5}(?![\w-])"), 0.7, None),  # driving licence
    (re.compile(r"(?<![\w/.,-])\d{2,3}/\d{3}/\d{4,5}(?![\w/-])"), 0.6, None),  # tax number
    (re.compile(r"(?<![\w-])[A-Z]{1,2}\d{6,8}(?![\w-])"), 0.3, None),  # passport
    (re.compile(r"(?<![\w/.,+-])\d{9}(?![\w/-]|[.,]\d)"), 0.25, None),  # passport, tax
    (re.compile(r"(?<![\w-])(?:[XYZ]\d{7}|\d{8})-?[A-Z](?!\w)"), 0.3, lambda s: dni(s.replace("-", ""))),
    (re.compile(r"(?<![\w.,-])[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?\d\d ?\d{3} ?\d{3} ?\d\d(?!\w)"), 0.3, lambda s: mod97(re.sub(r"\D", "", s))),
    (re.compile(r"(?<![\w.,-])\d\d ?\d{3} ?\d{3} ?\d{3}(?![\w-])"), 0.2, lambda s: mod11_10(re.sub(r"\D", "", s))),
    (re.compile(r"(?<![\w.,-])\d{3}([- ])\d{3}\1\d{3}(?![\w-])"), 0.2, lambda s: luhn(re.sub(r"\D", "", s))),
    (re.compile(r"(?<![\w.,-])\d{3}\.\d{3}\.\d{3}-\d\d(?!\w)"), 0.6, None),
]


def numbers(text: str) -> Iterator[Span]:
    """Phones and identity numbers around long runs of digits."""
    done = -1
    for run in _RUN.finditer(text):
        lo, hi = max(0, run.start() - 5), min(len(text), run.end() + 12)
        lo = max(lo, done)
        before = text[max(0, run.start() - 48) : run.start()]
        said_id, said_phone, said_other = _ID_WORDS.search(before), _PHONE_WORDS.search(before[-28:]), _OTHER_WORDS.search(before)
        best = None
        for m in _PHONE.finditer(text, lo, hi):
            if m.start() > run.end() or m.end() < run.start():
                continue
            digits = len(re.sub(r"\D", "", re.split(r"(?i)\s?(?:ext|x|poste|int)", m.group())[0]))
            if not 8 <= digits <= 15:
                continue
            v = 0.75 + 0.15 * bool(said_phone) - 0.6 * bool(said_other) - 0.2 * (bool(said_id) and not said_phone)
            if best is None or v > best.score:
                best = Span("phone", m.start(), m.end(), v)
        for p, base, check in _IDS:
            m = p.search(text, lo, hi)
            if m is None or m.start() > run.end() or m.end() < run.start():
                continue
            v = base + (0.45 if said_id else 0.0) - (0.5 if said_other else 0.0) + (0.35 if check and check(m.group()) and (said_id or len(m.group()) > 13) else 0.0)
            if best is None or v > best.score:
                best = Span("idnum", m.start(), m.end(), v)
        if best is not None and best.score >= ACCEPT:
            yield best
            done = best.end


# -- addresses ------------------------------------------------------------------------------------------------------------------
# Words of streets.
_EN = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|court|ct|lane|ln|drive|dr|way|place|pl|square|sq|terrace|crescent|close|highway|hwy|parkway|pkwy|alley|row|circle|trail|walk|gardens|grove|hill|mews)"
_FR = r"(?:rue|avenue|av\.?|boulevard|bd\.?|place|allée|impasse|chemin|quai|cours|route|square)"
_ES = r"(?:calle|c/|avenida|avda\.?|av\.?|plaza|paseo|camino|carretera|ronda|travesía|callejón)"
_DE = r"(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|chaussee)"
_CITY = r"[A-ZÀ-Þ][\w'’-]+(?: (?:am|an|de|del|la|le|les|sur|upon|on|the|[A-ZÀ-Þ][\w'’-]+)){0,3}?"
_ZIP_EN = r"(?:[A-Z]{2} )?\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
_UNIT = r"(?:(?:apt|apartment|flat|unit|suite|ste|no|room|floor)\.? ?#?\w{1,5}|#\w{1,5})"
_STREET_EN = re.compile(rf"(?:(?:{_UNIT}),? )?\d{{1,5}}[A-Za-z]?,? (?:(?:north|south|east|west|n|s|e|w)\.? )?(?:[^\W\d][\w'’-]* ){{1,3}}?{_EN}\b\.?(?:,?\s{_UNIT}\b)?(?:(?:,\s|\n)(?-i:{_CITY})(?:,? (?:{_ZIP_EN})(?!\w)|(?![\w'’-])))?", re.I)
_STREET_FR = re.compile(rf"\d{{1,5}}(?: ?(?:bis|ter))?,? {_FR} (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?(?:[\w'’-]+)(?: [A-ZÀ-Þ][\w'’-]+)*(?:(?:,\s|\n| )\d{{5}} (?-i:{_CITY})(?![\w'’-]))?", re.I)
_AFTER_EURO = re.compile(rf"\d{{1,4}} ?[a-zA-Z]?(?!\w)(?:(?:,\s?|\n)\d{{5}} {_CITY}(?![\w'’-]))?")
_BEFORE_ES = re.compile(rf"(?:^|(?<=[^\w])){_ES} (?:(?:de la|de los|de las|del|de) )?(?:[\w'’-]+)(?: [A-ZÀ-Þ][\w'’-]+)*,? (?:n[º°.] ?)?$", re.I)
_BEFORE_DE = re.compile(rf"(?:^|(?<=[^\w]))(?:[A-ZÄÖÜ][\w-]*{_DE}|[A-ZÄÖÜ][\w-]+[ -](?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz)|(?:Am|An der|Auf dem|Im|Unter den) [A-ZÄÖÜ][\w-]+) $", re.I)
_BOX = re.compile(r"(?:p\.? ?o\.? ?box|post(?:al)? box|post office box|postfach|apartado(?: de correos)?|apdo\.?|boîte postale|b\.?p\.?|casella postale|box) (?:n[o.º°]\.? ?)?$", re.I)
_BOX_TAIL = re.compile(rf"\d{{1,6}}(?:(?:,\s?|\n)(?:\d{{5}} {_CITY}|{_CITY},? (?:{_ZIP_EN})|{_CITY})(?![\w'’-]))?")
_UNIT_BEFORE = re.compile(rf"(?:^|(?<=[^\w])){_UNIT},? $", re.I)
_NUMBER = re.compile(r"(?<![\d.,:/+-])\d{1,6}(?![\d:]|[.,/]\d)")
_BILL = re.compile(r"(?i)^\s(?:bill|act|project|case|report|study|section)\b")


def addresses(text: str) -> Iterator[Span]:
    """Postal addresses around house and box numbers."""
    n = len(text)
    done = 0
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if a < done:
            continue
        after = text[b : b + 2]
        found = None
        back = text[max(0, a - 60, done) : a]
        tail = back[-22:]
        if "ox " in tail or "OX " in tail or "ch " in tail or "ostale " in tail or "o. " in tail:
            if (box := _BOX.search(tail)):
                if (t := _BOX_TAIL.match(text, a)) and (box.group()[:1].lower() != "b" or "," in t.group()):
                    found = Span("address", a - len(box.group()), t.end(), 0.8)
        if found is None and after[:1] == " " or after[:1] in "abcABC,":
            if (t := _STREET_EN.match(text, a)) and _plausible(t.group()):
                start = a
                if (u := _UNIT_BEFORE.search(back)) is not None:
                    start = a - len(u.group())
                whole = bool(re.search(r",\s|\n", t.group())) or start < a or bool(re.search(r"(?i)(?:live|lives|living|moved|ship|deliver|address|house|send|sent|mail|visit|office|located|at|to|:)\s(?:\w+\s)?$", back))
                if whole and not _BILL.match(text[t.end() : t.end() + 10]):
                    found = Span("address", start, t.end(), 0.8)
            elif (t := _STREET_FR.match(text, a)) and (re.search(r"\d{5}", t.group()[len(m.group()) :]) or re.search(r"(?i)(?:habite|adresse|domicile|livr\w+|chez|au|envoy\w+)\s?(?::|au|à|le)?\s$", back)):
                found = Span("address", a, t.end(), 0.8)
        if found is None and back[-1:] == " " and (back[-2:-1].isalpha() or back[-2:-1] == "."):
            t = _AFTER_EURO.match(text, a)
            if t:
                zipped = re.search(r"\d{5} ", t.group()[len(m.group()) :]) is not None
                s = _BEFORE_ES.search(back) or _BEFORE_DE.search(back)
                if s and (zipped or re.search(r"(?i)(?:vivo en|dirección:|domicilio:?|wohne (?:in der|im|am|in)|adresse:|anschrift:|wohnhaft)\s*(?:la|el|der)?\s*$", back[: s.start()])):
                    found = Span("address", a - (len(back) - s.start()), t.end(), 0.85)
        if found is not None and found.end <= n:
            yield found
            done = found.end


def _plausible(s: str) -> bool:
    """A street name is written with capitals, and its words are not those of a sentence."""
    words = re.findall(r"[A-Za-zÀ-ÿ'’-]+", s.split(",")[-1] if s.lower().startswith(("flat", "apt", "unit")) else re.sub(r"^\d+\w?,? ", "", s))
    return bool(words) and words[0][0].isupper()


# -- names ------------------------------------------------------------------------------------------------------------------------
#: Common given names of several languages, besides those of the table of name parts.
GIVEN = set("""Adam Albert Alexander Alfred Alice Andrea Andreas Anna Antonio Barbara Beatriz Benjamin Brian Bruno Carla Carlos Carmen Carol Catherine Charles Charlotte Chloe Christian Christine Claire Clara Claude Claudia Colette Daniel David Dennis Diana Doris Dorothy Edgar Edward Elena Elisabeth Elizabeth Ella Emil Emily Emma Eric Erik Ernst Felix Fiona Francis Frank Franz Fred Gabriel Georg George Greta Gustav Hannah Hans Heidi Helen Henri Henry Hugo Irene Isabel Ivan Jack Jacob James Jan Jane Janet Jean Jennifer Jessica Joan John Jonas Jorge Jose Joseph Juan Judith Julia Julian Karen Karin Karl Kevin Klaus Kurt Laura Lena Leo Leon Linda Lisa Louis Louise Lucas Luis Luke Manuel Marc Margaret Maria Marie Mario Mark Marta Martha Martin Mary Matthew Max Maya Michael Michel Miguel Natalia Nathan Nicolas Nikolai Nina Noah Nora Olga Oliver Oscar Otto Pablo Patricia Patrick Paul Paula Pedro Peter Philip Pierre Rachel Rebecca Richard Robert Roger Rosa Ruben Samuel Sandra Sara Sarah Silvia Simon Sofia Stefan Stephen Steven Susan Sylvia Teresa Theo Thomas Tim Tom Ursula Valentina Vera Victor Vincent Walter William Yvonne""".split())
#: Titles and other capitalised words that are no given name.
_NOT_GIVEN = set("mr mrs ms miss dr prof professor senator representative commissioner chairman chairwoman chair chairperson congressman the a an and or but if when while senators president minister secretary judge captain general sir lady lord saint st mount lake port north south east west new old san los las el la le les der die das señor señora herr frau monsieur madame don doña dear thanks hello hi question answer witness member ranking vice chairmen sra srta mme mlle".split()) | set(" ".join(FUNCTION_WORDS.values()).split())
_CAP = r"[A-ZÀ-Þ][\w'’]*(?:-[A-ZÀ-Þa-z][\w'’]*)*"
_PAIR = re.compile(rf"(?<![\w@.+-])({_CAP})(?=(,[ ]|[ ](?:[A-ZÀ-Þ]\.?[ ]){{0,2}})({_CAP})(?:([ ])([A-ZÀ-Þ])\.)?)")


class Names:
    """Given and family names; families not listed are told by beginnings and ends that listed ones share."""

    def __init__(self, given: frozenset, family: frozenset):
        self.given = {g.lower() for g in given} | {g.lower() for g in GIVEN}
        self.family = {f.lower() for f in family}
        heads: dict[str, int] = {}
        ends: dict[str, int] = {}
        tails: dict[str, int] = {}
        for f in self.family:
            for k in range(2, len(f) - 1):
                heads[f[:k]] = heads.get(f[:k], 0) + 1
                ends[f[k:]] = ends.get(f[k:], 0) + 1
            for k in (1, 2, 3, 4):
                if f[:-k] in self.family:
                    tails[f[-k:]] = tails.get(f[-k:], 0) + 1
        self._heads = {h for h, c in heads.items() if c >= 4 and len(h) >= 3}
        self._ends = {e for e, c in ends.items() if c >= 3 and len(e) >= 3}
        #: What makes one listed name of another (such as "son"), seen often.
        self._tails = tuple(t for t, c in tails.items() if c >= 4)
        self._like: dict[str, bool] = {}

    def is_given(self, word: str) -> bool:
        low = word.lower()
        if low in self.given:
            return True
        return "-" in low and all(p in self.given for p in low.split("-"))

    def like_family(self, word: str) -> bool:
        low = word.lower()
        if low in self.family:
            return True
        if (known := self._like.get(low)) is None:
            if len(self._like) > 500_000:
                self._like.clear()
            bases = [low, *(low[: -len(t)] for t in self._tails if low.endswith(t))]
            known = self._like[low] = any(w in self.family or any(w[:k] in self._heads and w[k:] in self._ends for k in range(3, len(w) - 2)) for w in bases) or ("-" in low and all(p in self.family for p in low.split("-")))
        return known


def names(text: str, known: Names) -> Iterator[Span]:
    done = 0
    for m in _PAIR.finditer(text):
        if m.start() < done:
            continue
        a, between, b = m.group(1), m.group(2), m.group(3)
        end = m.end() + len(between) + len(b)
        if between == ", ":
            said = _NAME_WORDS.search(text[max(0, m.start() - 24) : m.start()])
            if known.like_family(a) and (known.is_given(b) or (said and b.lower() not in _NOT_GIVEN and len(b) > 2)):
                if m.group(4):
                    end += 3
                yield Span("name", m.start(), end, 0.85)
                done = end
            continue
        score = 0.0
        if known.is_given(a):
            if known.like_family(b):
                score = 0.9
            elif b.lower() not in _NOT_GIVEN and not b.isupper() and _NAME_WORDS.search(text[max(0, m.start() - 24) : m.start()]):
                score = 0.6
        elif known.like_family(b) and len(a) > 2 and a.lower() not in _NOT_GIVEN and a.isupper() == b.isupper():
            # the lists are not complete: an unlisted word before a family name, if it is no plain word
            if _NAME_WORDS.search(text[max(0, m.start() - 24) : m.start()]):
                score = 0.6
            elif not a.isupper() or (m.start() == 0 or text[m.start() - 1] == "\n") and text[end : end + 1] in ("", "\n"):
                score = 0.5
        if score >= ACCEPT:
            yield Span("name", m.start(), end, score)
            done = end


# -- all together -----------------------------------------------------------------------------------------------------------------------
def find(text: str | None, known: Names) -> list[Span]:
    """The accepted spans of a text in order of place.  Of spans that overlap an email stands before an address and an address before the rest (both hold numbers and names of their own); then the surer, then the longer one."""
    if not text:
        return []
    proposals = [*emails(text), *numbers(text), *addresses(text), *names(text, known)]
    if len(proposals) > 1:
        # kept spans do not overlap, so only the neighbours of a place can stand in the way
        starts: list[int] = []
        kept: list[Span] = []
        for s in sorted(proposals, key=lambda s: (-(s.kind == "email"), -(s.kind == "address"), -s.score, s.start - s.end, s.start)):
            k = bisect.bisect_right(starts, s.start)
            if (k == 0 or kept[k - 1].end <= s.start) and (k == len(kept) or kept[k].start >= s.end):
                starts.insert(k, s.start)
                kept.insert(k, s)
        proposals = kept
    return proposals


def mask(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span replaced by a placeholder of its kind, all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


@lru_cache(maxsize=2)
def names_of(given: frozenset, family: frozenset) -> Names:
    return Names(given, family)


def _parts(name_parts: DataFrame) -> tuple[frozenset, frozenset]:
    rows = name_parts.where("name_part is not null").select("name_part", "part_kind").limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError("the table of name parts is larger than what may be sent to every executor")
    return frozenset(r.name_part for r in rows if r.part_kind == "given"), frozenset(r.name_part for r in rows if r.part_kind == "family")


def redact(df: DataFrame, name_parts: DataFrame, keys: list[str], text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``keys``, ``masked`` (the text with placeholders) and ``spans`` for every row of ``df``.

    Null texts stay null with no spans, empty ones empty; keys may be null or repeat; other columns are not read; a
    column of ``df`` named like a result is not kept.  Offsets count characters.  A narrow map over whole texts; the table
    of name parts is a small dictionary and is sent along after a check of its size.
    """
    given, family = _parts(name_parts)
    n = len(keys)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names_of(given, family)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column(n).to_pylist()
                found = [find(t, known) for t in texts]
                rows = pa.array([[s._asdict() for s in f] for f in found], span_type)
                texts = [mask(t, f) for t, f in zip(texts, found)] if with_text else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(texts, pa.string()), rows], names=[*keys, "masked", "spans"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text_col).alias("_text")).mapInArrow(run, schema + ", masked string, spans array<struct<kind: string, start: int, end: int, score: double>>")


def occurrences(redacted: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``keys``, ``kind`` and ``nth`` per occurrence, numbered from 1 within a kind of a record."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").alias("n")) for k in KINDS))
    counted = redacted.where(F.size("spans") > 0).select(*keys, F.explode(each).alias("_k")).where("_k.n > 0")
    return counted.select(*keys, F.col("_k.kind").alias("kind"), F.explode(F.sequence(F.lit(1), F.col("_k.n"))).alias("nth"))
