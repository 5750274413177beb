"""English stems after the published Porter2 algorithm, for vocabularies: the function is applied to distinct words only."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the algorithm: exceptions, and endings with what takes their place, longest first.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYS_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

# Most words have none of the endings of a step: that is told at once.
ENDS_2, ENDS_3 = (tuple(end for end, _ in step) for step in (STEP_2, STEP_3))


def _after(word: str, start: int) -> int:
    """Where the region behind the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = _after(word, 0) if r1 is None else r1
    return r1, _after(word, r1)


def _short_syllable(word: str) -> bool:
    """The word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def stem(word: str) -> str:
    word = word.lower()
    if len(word) <= 2 or word in SPECIAL:
        return SPECIAL.get(word, word)
    word = word.lstrip("'")
    # A y that is a consonant is written Y.
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'") if "'" in word else ():
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in STAYS_AFTER_1A:
        return word
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed") if word.endswith(("ed", "ing", "edly", "ingly")) else ():
        if word.endswith(end):
            if end in ("eed", "eedly"):
                if len(word) - len(end) >= r1:
                    word = word[: -len(end)] + "ee"
            elif re.search(f"[{VOWELS}]", word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_syllable(word):
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    for end, put in STEP_2 if word.endswith(ENDS_2) else ():
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ogi" or word[:at].endswith("l")) and (end != "li" or at and word[at - 1] in "cdeghkmnrt"):
                word = word[:at] + put
            break
    for end, put in STEP_3 if word.endswith(ENDS_3) else ():
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                word = word[:at] + put
            break
    for end in STEP_4 if word.endswith(STEP_4) else ():
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[:at].endswith(("s", "t"))):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
