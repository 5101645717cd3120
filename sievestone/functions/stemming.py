"""Snowball stemmers for English (Porter2) and Russian, from the published algorithms."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
#: Fixed values of the published English stemmer.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SPECIAL |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
STAY = set("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    "tional>tion enci>ence anci>ance abli>able entli>ent izer>ize ization>ize ational>ate ation>ate ator>ate alism>al aliti>al alli>al "
    "fulness>ful ousli>ous ousness>ous iveness>ive iviti>ive biliti>ble bli>ble ogi>og fulli>ful lessli>less li>"
)
STEP3 = "tional>tion ational>ate alize>al icate>ic iciti>ic ical>ic ful> ness> ative>"
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(">")) for x in text.split()), key=lambda r: -len(r[0]))


_STEP2, _STEP3, _STEP4 = _rules(STEP2), _rules(STEP3), sorted(STEP4.split(), key=lambda x: -len(x))


def _region(word: str, start: int = 0) -> int:
    """After the first non-vowel that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    # past and progressive
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1].startswith("eed"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and any(c in VOWELS for c in w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # derivational endings in the regions
    for end, new in _STEP2:
        if w.endswith(end):
            i = len(w) - len(end)
            if i >= r1 and (end != "ogi" or w[i - 1 : i] == "l") and (end != "li" or w[i - 1 : i] in set("cdeghkmnrt")):
                w = w[:i] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            i = len(w) - len(end)
            if i >= (r2 if end == "ative" else r1):
                w = w[:i] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            i = len(w) - len(end)
            if i >= r2 and (end != "ion" or w[i - 1 : i] in ("s", "t")):
                w = w[:i]
            break
    i = len(w) - 1
    if w.endswith("e") and (i >= r2 or (i >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and i >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Fixed values of the published Russian stemmer; the endings before the bar need an а or я before them.
RU_VOWELS = "аеиоуыэюя"
GERUND = "в вши вшись | ив ивши ившись ыв ывши ывшись"
ADJECTIVE = "| ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE = "ем нн вш ющ щ | ивш ывш ующ"
REFLEXIVE = "| ся сь"
VERB = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно | ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
NOUN = "| а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
SUPERLATIVE = "| ейш ейше"
DERIVATIONAL = "| ост ость"


def _endings(text: str) -> list[tuple[str, bool]]:
    after, free = text.split("|")
    return sorted([(x, True) for x in after.split()] + [(x, False) for x in free.split()], key=lambda e: -len(e[0]))


_GERUND, _ADJECTIVE, _PARTICIPLE, _REFLEXIVE, _VERB, _NOUN, _SUPER, _DERIV = map(_endings, (GERUND, ADJECTIVE, PARTICIPLE, REFLEXIVE, VERB, NOUN, SUPERLATIVE, DERIVATIONAL))


def _drop(word: str, rv: int, endings: list[tuple[str, bool]]) -> str | None:
    """word without the longest of the endings that lies in the region, or None."""
    for end, guarded in endings:
        i = len(word) - len(end)
        if i >= rv and word.endswith(end) and (not guarded or (i > rv and word[i - 1] in "ая")):
            return word[:i]
    return None


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in RU_VOWELS), len(w))

    def region(start: int) -> int:
        return next((i + 1 for i in range(start + 1, len(w)) if w[i] not in RU_VOWELS and w[i - 1] in RU_VOWELS), len(w))

    r2 = region(region(0))
    got = _drop(w, rv, _GERUND)
    if got is None:
        w = _drop(w, rv, _REFLEXIVE) or w
        got = _drop(w, rv, _ADJECTIVE)
        if got is not None:
            got = _drop(got, rv, _PARTICIPLE) or got
        else:
            got = _drop(w, rv, _VERB)
            got = _drop(w, rv, _NOUN) if got is None else got
    w = w if got is None else got
    w = _drop(w, rv, [("и", False)]) or w
    w = _drop(w, max(rv, r2), _DERIV) or w
    short = _drop(w, rv, _SUPER)
    w = short or w
    if w.endswith("нн") and len(w) - 1 >= rv:
        return w[:-1]
    return w if short else _drop(w, rv, [("ь", False)]) or w


_CYRILLIC = re.compile("[Ѐ-ԯ]")


@lru_cache(maxsize=1 << 18)
def stem(token: str) -> str:
    """A folded token's stem: Russian if it has a Cyrillic letter, else English."""
    return russian(token) if _CYRILLIC.search(token) else english(token)
