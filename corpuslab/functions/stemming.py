"""English stop words and stems for BM25 (RET-04): the Porter2 algorithm, over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as ST
from pyspark.sql.functions import arrow_udf

#: The common English stop list of full-text engines.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

_VOWELS = "aeiouy"
#: Fixed values of the algorithm: whole words with stems of their own, and words left alone after step 1a.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant after a vowel, and again."""

    def behind(at: int) -> int:
        m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, at)
        return m.end() if m else len(word)

    special = re.match("gener|commun|arsen", word)
    r1 = special.end() if special else behind(0)
    return r1, behind(r1)


def _short_syllable(word: str) -> bool:
    return bool(re.search(f"(?:[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]|^[{_VOWELS}][^{_VOWELS}])$", word))


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    word = word.lstrip("'") if word.startswith("'") else word
    word = re.sub(f"^y|(?<=[{_VOWELS}])y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"(?:'s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWELS}].+s$", word):
        word = word[:-1]
    if word in _KEPT:
        return word
    if m := re.search("(?:eedly|eed)$", word):
        word = word[: m.start()] + "ee" if m.start() >= r1 else word
    elif (m := re.search("(?:ingly|edly|ing|ed)$", word)) and re.search(f"[{_VOWELS}]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    if re.search(f".[^{_VOWELS}][yY]$", word):
        word = word[:-1] + "i"
    word = _step2(word, r1)
    for ending, new in _STEP3.items():
        if word.endswith(ending):
            word = word[: -len(ending)] + new if len(word) - len(ending) >= r1 else word
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for ending in _STEP4:
        if word.endswith(ending):
            word = word[: -len(ending)] if len(word) - len(ending) >= r2 else word
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4] in "st":
            word = word[:-3]
    if (word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])))) or (word.endswith("ll") and len(word) - 1 >= r2):
        word = word[:-1]
    return word.replace("Y", "y")


def _step2(word: str, r1: int) -> str:
    for ending, new in _STEP2.items():
        if word.endswith(ending):
            return word[: -len(ending)] + new if len(word) - len(ending) >= r1 else word
    if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
        return word[:-1]
    if word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] and word[-3] in "cdeghkmnrt":
        return word[:-2]
    return word


@arrow_udf(ST.ArrayType(ST.StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """Each word that a batch has is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    stemmed = pa.array(map(stem, coded.dictionary.to_pylist()), pa.string()).take(coded.indices)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())]), stemmed, mask=tokens.is_null())
