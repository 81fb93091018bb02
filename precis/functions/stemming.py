"""Suffix stripping after Porter (1980), with the usual corrections for short and irregular words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: suffix rules of the published algorithm and the irregular words ---------------
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)
# --------------------------------------------------------------------------------------------------


def _shape(word: str) -> str:
    """The word as ``c``/``v`` letters; ``y`` is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends consonant-vowel-consonant (not w, x, y), or is a two-letter vowel-consonant word."""
    shape = _shape(stem)
    return shape == "vc" or (shape.endswith("cvc") and stem[-1] not in "wxy")


def _longest_suffix(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word if word.endswith("ss") or not word.endswith("s") else word[:-1]


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest_suffix(word, ("ed", "ing"))
    if suffix is None or "v" not in _shape(word[: -len(suffix)]):
        return word
    stem = word[: -len(suffix)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if re.search(r"(.)\1$", stem) and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _final_y(word: str) -> str:
    turns = word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c"
    return word[:-1] + "i" if turns else word


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double_suffix(word[:-4] + "al")
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest_suffix(word, STEP_2)
    if suffix and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + STEP_2[suffix]
    return word


def _single_suffix(word: str) -> str:
    suffix = _longest_suffix(word, STEP_3)
    if suffix and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + STEP_3[suffix]
    return word


def _residual_suffix(word: str) -> str:
    suffix = _longest_suffix(word, STEP_4)
    if suffix is None or _measure(word[: -len(suffix)]) <= 1:
        return word
    stem = word[: -len(suffix)]
    return word if suffix == "ion" and stem[-1:] not in ("s", "t") else stem


def _final_e(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    """Stem of one lower-case token; tokens of up to three letters stay as they are."""
    if len(word) <= 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    for step in (
        _plural, _past, _final_y, _double_suffix, _single_suffix, _residual_suffix, _final_e,
    ):
        word = step(word)
    return word


_REMEMBERED = 1 << 18


class Stems(dict):
    """Remembers the stems of the words a task has met; starts anew when it is full."""

    def __missing__(self, word: str) -> str:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = stem(word)
        return self[word]


@F.pandas_udf(T.StringType())
def stem_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stem space-separated tokens; lines stay separate.

    A task stems each word once, and unlike a join with a stemmed vocabulary this moves no tokens
    between executors.
    """
    stems = Stems()

    def line(tokens: str) -> str:
        return " ".join([stems[t] for t in tokens.split(" ")])

    for texts in batches:
        yield texts.map(lambda t: "\n".join(map(line, t.split("\n"))), na_action="ignore")
