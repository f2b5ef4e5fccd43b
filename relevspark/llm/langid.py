"""A small language identifier: scripts first, then function words."""

from __future__ import annotations

import re
from collections import Counter

# Function words by language.
FUNCTION_WORDS = {
    "en": "the and of to in that for with you is it as are was be by on this from at or have an not they which but his her their we your can will would there what how do does did if when please my me give write why i he she has been into than then so",
    "fr": "le la les des et de du un une pour que qui est dans vous nous ne pas sur avec au aux ce cette ces il elle je se par plus ou mais son sa ses leur comment pourquoi quand sans être ont peut doit tout depuis en y mon ma mes entre chaque selon",
    "de": "der die das und ist den dem des ein eine einen einem einer nicht mit bei von zu im am auf für sich es ich wir sie er man kann auch aus als nach wie was warum wenn noch doch oder aber zum zur vom so über wird werden hat sollten bitte mein meine neben ohne seit bevor",
    "es": "el la los las de y que un una para es en no con por del al se su sus lo como más pero cuando o ya si este esta son ha puede debe desde qué cómo cuándo hay usted mi nos entre todo cada según antes después sin",
    "it": "il lo la gli le di e che un una per è in non con del della dei al si su sono da come più ma quando anche questo questa nel nella ha può deve ogni perché dopo prima senza mio",
    "pt": "o a os as de e que um uma para é em não com por do da dos das ao se seu sua como mais mas quando também este esta na no são tem pode deve desde você meu minha cada depois antes sem",
    "nl": "de het een en van is dat in te niet met op voor zijn aan er als maar om ook bij uit nog wel dan naar of wat hoe waarom kan wordt door over deze dit mijn je u",
}
SCRIPTS = [("ja", r"[぀-ヿ]"), ("ko", r"[가-힯]"), ("zh", r"[㐀-鿿]"), ("ru", r"[Ѐ-ӿ]"), ("ar", r"[؀-ۿ]"), ("he", r"[֐-׿]"), ("hi", r"[ऀ-ॿ]"), ("el", r"[Ͱ-Ͽ]"), ("th", r"[฀-๿]")]
#: Names of languages in several languages.
NAMES = {
    "en": r"english|anglais|englisch|ingl[eé]s|inglese|английск|英语|英文",
    "fr": r"french|fran[cç]ais|franz[oö]sisch|franc[eé]s|francese|французск|法语|法文",
    "de": r"german|allemand|deutsch|alem[aá]n|tedesco|немецк|德语|德文",
    "es": r"spanish|espagnol|spanisch|espa[nñ]ol|castellano|spagnolo|испанск|西班牙",
    "it": r"italian|italien|italienisch|italiano|итальянск|意大利",
    "pt": r"portugu|portugies|португальск|葡萄牙",
    "nl": r"dutch|n[eé]erlandais|niederl[aä]ndisch|holand[eé]s|neerland|голландск|荷兰",
    "ru": r"russian|russe|russisch|ruso|russo|русск|俄语|俄文",
    "zh": r"chinese|mandarin|chinois|chinesisch|chino|cinese|китайск|中文|汉语",
    "ja": r"japanese|japonais|japanisch|japon[eé]s|giapponese|японск|日语|日本語",
    "ko": r"korean|cor[eé]en|koreanisch|coreano|корейск|韩语|한국어",
    "ar": r"arabic|arabe|arabisch|арабск|阿拉伯",
}
_NAMED = {k: re.compile(v, re.I) for k, v in NAMES.items()}
_TRANSLATE = re.compile(r"(?i)\btranslat|\btradui|\bübersetz|\btradu[cz]|перевед|翻译")
_SPEAKS: dict[str, list[tuple[str, float]]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _SPEAKS.setdefault(_w, []).append(_lang)
_SPEAKS = {w: [(x, 1.0 / len(v)) for x in v] for w, v in _SPEAKS.items()}
_WORD = re.compile(r"[^\W\d_]+")
_OTHER = re.compile(r"[Ͱ-῿぀-힯]")
_SCRIPTS = [(k, re.compile(v)) for k, v in SCRIPTS]


def language(text: str | None) -> str | None:
    """The language of most of ``text``, or None if there is too little to tell."""
    return language_of(text, _WORD.findall(text.lower())) if text else None


def language_of(text: str, words: list[str]) -> str | None:
    """The same for a text whose lower-case words are known."""
    if not text.isascii() and _OTHER.search(text):
        letters = sum(map(len, words)) or 1
        for k, p in _SCRIPTS:
            # signs of ideographic scripts hold about as much as two letters
            n = len(p.findall(text)) * (2 if k in ("zh", "ja", "ko") else 1)
            if n >= 0.5 * letters and n > 3:
                return k
    scores: dict[str, float] = {}
    for w, n in Counter(filter(_SPEAKS.__contains__, words)).items():
        for k, share in _SPEAKS[w]:
            scores[k] = scores.get(k, 0.0) + share * n
    if not scores:
        return None
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    best, top = ranked[0]
    second = ranked[1][1] if len(ranked) > 1 else 0.0
    return best if top >= 1.5 and top >= 1.15 * second and top >= 0.06 * len(words) else None


def asks_for(prompt: str, lang: str) -> bool:
    """Whether a prompt asks for ``lang`` by its name, or for a translation without naming a language."""
    if (p := _NAMED.get(lang)) is not None and p.search(prompt):
        return True
    return bool(_TRANSLATE.search(prompt)) and not any(p.search(prompt) for p in _NAMED.values())
