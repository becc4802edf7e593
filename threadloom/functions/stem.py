"""English word stems (the published Porter2 rules) for full-text search.

``lexemes`` tokenises and drops stop words in the JVM; only the distinct words of
each Arrow batch reach the Python rules below.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from threadloom.functions.text import LETTER_OR_DIGIT, safe_text, word_list
from threadloom.schemas import SEARCH_STOP_WORDS

# Irregular forms and words left alone.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_PLURAL = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
# Derivational suffixes and what replaces them.
_DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_ADJECTIVAL = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_RESIDUAL = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
).split()

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE_END = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _region_start(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _mark_consonant_y(w: str) -> str:
    marked = ""
    for ch in w:
        marked += "Y" if ch == "y" and marked[-1:] in ("", *"aeiouy") else ch
    return marked


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        return w[:-1]
    return w


def _verbal(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return w
    base = w[:-len(suffix)]
    if suffix.startswith("ee"):
        return base + "ee" if len(base) >= r1 else w
    if not re.search("[aeiouy]", base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE_END.search(base):
        return base[:-1]
    if _SHORT_END.search(base) and r1 >= len(base):
        return base + "e"
    return base


def _swap(w: str, table: dict[str, str], r1: int, r2: int) -> str:
    suffix = _longest(w, table)
    if suffix is None:
        return w
    base = w[:-len(suffix)]
    allowed = len(base) >= (r2 if suffix == "ative" else r1)
    if suffix == "ogi":
        allowed = allowed and base.endswith("l")
    elif suffix == "li":
        allowed = allowed and base[-1:] in tuple("cdeghkmnrt")
    return base + table[suffix] if allowed else w


def _residue(w: str, r2: int) -> str:
    suffix = _longest(w, _RESIDUAL)
    if suffix is None or len(w) - len(suffix) < r2:
        return w
    if suffix == "ion" and w[-4:-3] not in ("s", "t"):
        return w
    return w[:-len(suffix)]


def _final_letter(w: str, r1: int, r2: int) -> str:
    cut = len(w) - 1
    if w.endswith("e") and (cut >= r2 or (cut >= r1 and not _SHORT_END.search(w[:-1]))):
        return w[:-1]
    if w.endswith("ll") and cut >= r2:
        return w[:-1]
    return w


def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = re.sub(r"(?:'s'|'s|')$", "", word.removeprefix("'"))
    w = _mark_consonant_y(w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region_start(w, 0)
    r2 = _region_start(w, r1)
    w = _plural(w)
    if w in _KEPT_AFTER_PLURAL:
        return w
    w = _verbal(w, r1)
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    w = _swap(w, _DERIVED, r1, r2)
    w = _swap(w, _ADJECTIVAL, r1, r2)
    w = _residue(w, r2)
    return _final_letter(w, r1, r2).replace("Y", "y")


# Stems already worked out by this worker; emptied when it grows large.
_KNOWN: dict[str, str] = {}


def known_stem(word: str) -> str:
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) >= 1 << 17:
            _KNOWN.clear()
        found = _KNOWN[word] = stem(word)
    return found


Stemmer = Callable[[str], str]


def chosen_stemmer(stemmer: str | Stemmer | None) -> Stemmer | None:
    """``"english"``, a function from lower-cased word to stem, or None for whole words."""
    if stemmer is None or callable(stemmer):
        return stemmer
    if stemmer != "english":
        raise ValueError(f"unknown stemmer {stemmer!r}: give 'english', a function or None")
    return known_stem


def stem_words(words: Column, stemmer: Stemmer = known_stem) -> Column:
    """Stems of an array of lower-cased words, found once per distinct word of a batch."""
    @F.arrow_udf(ArrayType(StringType()))
    def run(arrays: pa.Array) -> pa.Array:
        sizes = np.asarray(arrays.value_lengths().fill_null(0))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        coded = arrays.flatten().dictionary_encode()
        values = pa.array([stemmer(w) for w in coded.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(coded.indices))

    return run(words)


def _without_stop_words(words: Column) -> Column:
    stop = word_list(SEARCH_STOP_WORDS)
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def english_words(col: Column) -> Column:
    """Lower-cased words of a text, one per position, stop words removed."""
    words = F.regexp_extract_all(F.lower(safe_text(col)), F.lit(f"{LETTER_OR_DIGIT}+"), F.lit(0))
    return _without_stop_words(words)


def lexemes(col: Column, stemmer: Stemmer = known_stem) -> Column:
    """Lexemes of a text, one per word position that is no English stop word."""
    return stem_words(english_words(col), stemmer)


def query_lexemes(terms: list[str], stemmer: Stemmer = known_stem) -> list[str]:
    """Distinct lexemes of already parsed query terms; stop words vanish."""
    words = [w for term in terms for w in term.split("_") if w]
    return list(dict.fromkeys(stemmer(w) for w in words if w not in SEARCH_STOP_WORDS))


def candidate_words(col: Column, wanted: list[str]) -> Column:
    """The words of a text that can have one of the wanted stems.

    A stem differs from its word by at most its last two letters, so only words
    sharing the rest of a wanted stem leave the JVM.
    """
    heads = sorted({s[:max(1, len(s) - 2)] for s in wanted})
    firsts = "".join(sorted({h[0] for h in heads}))
    pattern = f"(?=[{firsts}])(?<!{LETTER_OR_DIGIT})(?:{'|'.join(heads)}){LETTER_OR_DIGIT}*+"
    return _without_stop_words(F.regexp_extract_all(F.lower(safe_text(col)), F.lit(pattern), F.lit(0)))


def count_matches(col: Column, wanted: list[str], stemmer: Stemmer = known_stem) -> Column:
    """Number of word positions of a text whose stem is in ``wanted``."""
    if not wanted:
        return F.lit(0)
    targets = word_list(wanted)
    words = candidate_words(col, wanted) if stemmer is known_stem else english_words(col)
    return F.size(F.filter(stem_words(words, stemmer), lambda s: F.array_contains(targets, s)))
