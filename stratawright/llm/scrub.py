"""Undo the ways in which the same text gets spelled: width, look-alike letters, invisible characters, accents."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters that show nothing.
INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤︀-️﻿]")
#: Cyrillic and Greek letters that look like a Latin one.
LOOKALIKE = str.maketrans(
    "авекмнорстухіјѕԁһӏԛԝьгпАВЕКМНОРСТУХІЈЅԀҺЗӀαοερτυχικνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abekmhopctyxijsdhlqwbrnABEKMHOPCTYXIJSDH3IaoeptuxikvABEZHIKMNOPTYX",
)
MIXED_WORD = re.compile(r"[^\W\d_]+")
LATIN = re.compile("[A-Za-zÀ-ɏ]")
OTHER = re.compile("[Ͱ-ϿЀ-ԯ]")


_ALIKE = {chr(c) for c in LOOKALIKE}


def _one_script(text: str) -> str:
    """Words that mix scripts in Latin letters; in a text with such words, also those made of look-alikes alone."""
    words = MIXED_WORD.findall(text)
    mixed = {w for w in words if OTHER.search(w) and LATIN.search(w)}
    if not mixed:
        return text
    mixed |= {w for w in words if OTHER.search(w) and set(w) <= _ALIKE}
    return MIXED_WORD.sub(lambda m: m[0].translate(LOOKALIKE) if m[0] in mixed else m[0], text)


def plain(text: str) -> str:
    """Unescaped, compatibility-composed, without invisible characters; words that mix scripts become Latin."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _one_script(text) if OTHER.search(text) else text


def unaccented(text: str) -> str:
    """Without combining marks; letters that do not decompose are replaced by their usual substitute."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text.replace("ı", "i").replace("ł", "l").replace("ø", "o").replace("ß", "ss"))
    return text if text.isascii() else "".join([c for c in text if c < "\u0300" or not unicodedata.combining(c)])


#: A common romanisation of Cyrillic.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
_ROMAN = str.maketrans(ROMAN)


def romanised(text: str) -> str:
    """Lower-case Cyrillic in Latin letters."""
    return text.translate(_ROMAN)
