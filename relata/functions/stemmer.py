"""English stemming by the published Porter2 rules, for analyzers; in Arrow batches with a cache of words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from relata.functions import text as T

# --- fixed values of the published rules ---------------------------------------------------------------------------
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOP_AFTER_S = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
PREFIXES = ("gener", "commun", "arsen")
# ----------------------------------------------------------------------------------------------------------------------


def _region(w: str, start: int = 0) -> int:
    m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    return bool(re.search(rf"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", w)) or bool(re.fullmatch(rf"[{VOWELS}][^{VOWELS}]", w))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(rf"(?:^|(?<=[{VOWELS}]))y", "Y", w)
    r1 = next((len(p) for p in PREFIXES if w.startswith(p)), None) or _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"'(?:s'?)?$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", w[:-1]):
        w = w[:-1]
    if w in STOP_AFTER_S:
        return w
    # past and progressive
    if m := re.search(r"eed(?:ly)?$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(?:ed|ing)(?:ly)?$", w)) and re.search(f"[{VOWELS}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # long suffixes
    for s, by in STEP2.items():
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and not (s == "ogi" and w[at - 1 : at] != "l") and not (s == "li" and w[at - 1 : at] not in LI_ENDINGS):
                w = w[:at] + by
            break
    for s, by in STEP3.items():
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= (r2 if s == "ative" else r1):
                w = w[:at] + by
            break
    for s in STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and not (s == "ion" and w[at - 1 : at] not in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: [stem(x) for x in t], na_action="ignore")


def analyzed(text: Column, stop_words: list[str], stemming: bool = False) -> Column:
    """Terms of a text: runs of letters and digits in lower case without stop words, stemmed if asked for."""
    kept = T.remove_words(T.word_tokens(text), stop_words)
    return stems(kept) if stemming else kept


__all__ = ["analyzed", "stem", "stems"]
