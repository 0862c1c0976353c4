"""Language of prose and spelling of names, shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = re.compile(r"(`{3,}|~{3,}).*?(?:\1|\Z)", re.S)
_TICKED = re.compile(r"`[^`\n]*`")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]")
#: The most frequent function words of each language, but for those that another of them writes alike.
_COMMON = {
    "en": "the and of to is that it this with for are not you your from at which have has had by what when be been being were or we they he she but can could would should there their then than these those into only after before about because do does did how where who why each some such other its our more most just very please here now".split(),
    "de": "der die das und ist nicht mit für von dem den des ein eine einen einem einer eines zu wie auf sich im auch als nach bei durch aus oder aber wenn dass hier noch nur schon sehr mehr wird werden wurde wurden sind waren haben habe hatte kann können muss müssen soll sollen ich wir ihr sie ihre sein seine mein dein kein keine diese dieser dieses diesen diesem welche jede alle alles nichts zum zur vom beim über unter zwischen gegen ohne weil damit dann denn doch bitte vor bis seit".split(),
    "es": "el la los las que del de se por una un para con en más esta este está estos estas están esto lo como pero sus su al ya aquí hay sin según cada antes después son ser fue era han muy también cuando donde porque todo toda todos todas nada otro otra entre sobre hasta desde puede solo".split(),
}
COMMON = {w: lang for lang, words in _COMMON.items() for w in words}


def text_outside(text: str) -> str:
    """The text without fenced blocks and without code in backticks; a block left open goes to the end."""
    if "~~~" in text:
        text = FENCED.sub(" ", text)
    elif "```" in text:
        text = " ".join(text.split("```")[::2])
    return _TICKED.sub(" ", text) if "`" in text else text


def language(text: str | None, least: int = 2) -> str | None:
    """en, de, es or zh by script and function words; None where fewer than `least` signs are found or two tie.

    Fenced blocks and code in backticks are left out. Null and blank text give None.
    """
    if not text:
        return None
    prose = text_outside(text)
    han = 0 if prose.isascii() else len(_HAN.findall(prose))
    votes: dict[str, int] = {}
    letters = 0
    for w in _WORD.findall(prose.lower()):
        letters += len(w)
        if lang := COMMON.get(w):
            votes[lang] = votes.get(lang, 0) + 1
    if han >= 2 and han * 3 >= letters:
        return "zh"
    best = sorted(votes.items(), key=lambda x: -x[1])[:2]
    if not best or best[0][1] < least or (len(best) > 1 and best[0][1] == best[1][1]):
        return None
    return best[0][0]


def language_name(name: Column) -> Column:
    """Two letters of a declared language in any spelling (EN, en-EN, eng, zh_XX); null where it says nothing."""
    s = F.substring_index(F.regexp_replace(F.lower(F.trim(name)), "_", "-"), "-", 1)
    s = F.when(s.isin("eng", "english"), "en").when(s.isin("deu", "ger", "german"), "de").when(s.isin("spa", "spanish"), "es").when(s.isin("zho", "chi", "chinese"), "zh").otherwise(s)
    return F.when(s.isin("en", "de", "es", "zh"), s)


def slug(name: Column) -> Column:
    """One spelling of a name: the part behind the last slash, lower case, runs of other signs as one underscore."""
    last = F.element_at(F.split(F.trim(name), "/"), -1)
    s = F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s != "", s)
