"""English lexemes: stop words and the published Porter2 ("English") stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed list of English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now".split()
)
_TOKEN = re.compile(r"[^\W_]+")
#: Fixed words, prefixes, letters and suffixes of the published algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_PLURAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_PREFIXES = ("gener", "commun", "arsen")
_VOWELS, _DOUBLES, _BEFORE_LI = frozenset("aeiouy"), frozenset(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")), frozenset("cdeghkmnrt")
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = {x: "" for x in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")}


def _region(word: str, start: int) -> int:
    """Where the part behind the first non-vowel that follows a vowel begins, from start on."""
    for k in range(start + 1, len(word)):
        if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
            return k + 1
    return len(word)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _ends_short(word: str) -> bool:
    """Ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS and word[-1] not in "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _suffix(word: str, table: dict[str, str]) -> str | None:
    """The longest suffix of the table that the word has."""
    return next((word[-n:] for n in range(min(7, len(word)), 0, -1) if word[-n:] in table), None)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with characters beyond a to z and words of up to two letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    letters = list(word)
    for k, c in enumerate(letters):
        if c == "y" and (k == 0 or letters[k - 1] in _VOWELS):
            letters[k] = "Y"
    word = "".join(letters)
    r1 = next((len(p) for p in _PREFIXES if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in _AFTER_PLURAL:
        return word
    # past and present participles
    end = next((x for x in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(x)), None)
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _has_vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")) or (_ends_short(word) and r1 >= len(word) and word[-2:] not in _DOUBLES):
            word += "e"
        elif word[-2:] in _DOUBLES:
            word = word[:-1]
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # derived words
    end = _suffix(word, _STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[-len(end) - 1 : -len(end)]
        if (end != "ogi" or before == "l") and (end != "li" or before in _BEFORE_LI):
            word = word[: -len(end)] + _STEP2[end]
    end = _suffix(word, _STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _STEP3[end]
    end = _suffix(word, _STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def lexemes(text: str | None, first: int = 1) -> list[tuple[str, int]]:
    """(lexeme, position); stop words take a position but give no lexeme."""
    return [(stem(w), first + i) for i, w in enumerate(_TOKEN.findall((text or "").lower())) if w not in STOP_WORDS]
