"""Terms of a full-text index in Python: folded letters and the Porter stemmer (Porter, 1980), with a cache of stems.

A word is read as letters C (consonant) and V (vowel); its measure is the number of VC changes. Each step is a table of
(ending, replacement, condition on the stem), of which the longest ending that fits decides.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")
#: The form of letters other than y.
PLAIN_FORM = bytes(ord("V") if chr(b) in "aeiou" else ord("C") for b in range(256))


def fold(text: str) -> list[str]:
    """Words in lower case without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return WORD.findall(plain)


def form(word: str) -> str:
    """C and V for each letter; y is a vowel after a consonant."""
    if "y" not in word and word.isascii():
        return word.encode().translate(PLAIN_FORM).decode()
    out = ""
    for i, c in enumerate(word):
        out += "V" if c in "aeiou" or (c == "y" and i and out[-1] == "C") else "C"
    return out


def measure(stem_: str) -> int:
    return form(stem_).count("VC")


def has_vowel(stem_: str) -> bool:
    return "V" in form(stem_)


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and form(word)[-1] == "C"


def closes_short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return form(word)[-3:] == "CVC" and word[-1] not in "wxy"


# The published endings of steps 2, 3 and 4.
STEP_2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def longest(word: str, endings) -> str | None:
    if not word.endswith(tuple(endings)):  # most words have none
        return None
    return max((e for e in endings if word.endswith(e)), key=len)


def plural(w: str) -> str:
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    end = next((e for e in ("ed", "ing") if w.endswith(e) and has_vowel(w[: -len(e)])), None)
    if not end:
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if doubled(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if measure(w) == 1 and closes_short(w) else w


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    w = past(plural(w))
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        e = longest(w, table)
        if e and measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = longest(w, STEP_4)
    if e and measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not closes_short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
