"""English words as a full-text index keeps them: stop words out, the rest cut to stems by the Porter2 rules."""

from __future__ import annotations

import functools
import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import release

# Words that English indexes leave out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now""".split()
)
# Fixed values of the Porter2 rules: words with stems of their own, words left alone, and those left alone once their plural is cut.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE = frozenset("sky news howe atlas cosmos bias andes".split())
WHOLE_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Beginnings after which the first region starts; endings with what takes their place in the second, third and fourth step.
EARLY_REGION = ("gener", "commun", "arsen")
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after(word: str, at: int) -> int:
    found = _REGION.search(word, at)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _inflection(w: str, r1: int) -> str:
    """Past and continuous forms cut, and the bare form mended."""
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    bare = w[: len(w) - len(end)]
    if end in ("eed", "eedly"):
        return bare + "ee" if len(bare) >= r1 else w
    if not end or not _VOWEL.search(bare):
        return w
    if bare.endswith(("at", "bl", "iz")):
        return bare + "e"
    if _DOUBLE.search(bare):
        return bare[:-1]
    return bare + "e" if len(bare) <= r1 and _SHORT.search(bare) else bare


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or word in WHOLE:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)  # a y that is no vowel
    early = next((p for p in EARLY_REGION if w.startswith(p)), "")
    r1 = len(early) if early else _after(w, 0)
    r2 = _after(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in WHOLE_AFTER_PLURAL:
        return w
    w = _inflection(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, SECOND)
    at = len(w) - len(end)
    if end and at >= r1 and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in "cdeghkmnrt"):
        w = w[:at] + SECOND[end]
    end = _longest(w, THIRD)
    at = len(w) - len(end)
    if end and at >= (r2 if end == "ative" else r1):
        w = w[:at] + THIRD[end]
    end = _longest(w, FOURTH)
    at = len(w) - len(end)
    if end and at >= r2 and (end != "ion" or w[at - 1] in "st"):
        w = w[:at]
    at = len(w) - 1
    if w[-1] == "e" and (at >= r2 or at >= r1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w[-1] == "l" and at >= r2 and w[at - 1] == "l":
        w = w[:-1]
    return w.lower()


def lexeme(word: str) -> str | None:
    """A word's stem, none for a stop word."""
    return None if word in STOP_WORDS else stem(word)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def lexemes(text: Column, initials: Collection[str] = ()) -> Column:
    """Stems of a text's words at their places, null at those of stop words. The words are split in the JVM, stems are kept by each worker.

    With `initials` only words that begin with one of them leave the JVM, the places of the others are null: a word and its stem begin alike.
    """

    @F.arrow_udf("array<string>")
    def run(found: pa.Array) -> pa.Array:
        release()  # what the batch before has left
        coded = found.flatten().dictionary_encode()
        stems = pa.array([lexeme(w) for w in coded.dictionary.to_pylist()], pa.string())  # each word of the batch once
        ends = np.append(0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems.take(coded.indices))

    found = words(text)
    return run(F.transform(found, lambda w: F.when(F.substring(w, 1, 1).isin(*sorted(initials)), w)) if initials else found)


def query_lexemes(text: str) -> list[str | None]:
    return [lexeme(w) for w in re.findall(r"[^\W_]+", text.lower())]
