"""Porter2 (Snowball English) from the published description of the algorithm."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = frozenset("cdeghkmnrt")

WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_BY_LENGTH_2 = sorted([*STEP2, "ogi", "li"], key=len, reverse=True)
_BY_LENGTH_3 = sorted([*STEP3, "ative"], key=len, reverse=True)


def _region(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _short_syllable(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS and w[-1] not in "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _step1b(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if not any(c in VOWELS for c in base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if base.endswith(DOUBLES):
                return base[:-1]
            return base + "e" if r1 >= len(base) and _short_syllable(base) else base
    return w


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.lstrip("'") if word.startswith("'") else word
    if not w:
        return word
    w = ("Y" if w[0] == "y" else w[0]) + "".join("Y" if c == "y" and w[i] in VOWELS else c for i, c in enumerate(w[1:]))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    w = _step1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for end in _BY_LENGTH_2:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r1:
                if end == "ogi":
                    w = base + "og" if base.endswith("l") else w
                elif end == "li":
                    w = base if base[-1:] in LI_ENDING else w
                else:
                    w = base + STEP2[end]
            break
    # 3
    for end in _BY_LENGTH_3:
        if w.endswith(end):
            base = w[: -len(end)]
            if end == "ative":
                w = base if len(base) >= r2 else w
            elif len(base) >= r1:
                w = base + STEP3[end]
            break
    # 4
    for end in STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
            w = w[:-3]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
