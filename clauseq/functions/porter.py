"""The Porter stemmer, and words of texts as the stemmed index takes them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The published algorithm's suffixes and what takes their place.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Shorter words, and those of more bytes, stay as they are.
SHORTEST, LONGEST = 3, 63
_MEMORY = 500_000


def _sounds(stem: str) -> str:
    """v for a vowel, c for any other sign; y is a vowel after a c."""
    out, last = [], "v"
    for ch in stem:
        last = "v" if ch in "aeiou" or (ch == "y" and last == "c" and out) else "c"
        out.append(last)
    return "".join(out)


def _measure(stem: str) -> int:
    return _sounds(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _sounds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    fit = [s for s in suffixes if len(word) > len(s) and word.endswith(s)]
    return max(fit, key=len) if fit else None


def porter(word: str) -> str:
    """The stem of a lower-case word. It works on bytes: each one beyond ASCII counts as a consonant."""
    w = word.encode().decode("latin-1")
    if not SHORTEST <= len(w) <= LONGEST:
        return word
    if _longest(w, ("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if _longest(w, ("eed",)):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if len(w) > len(s) and w.endswith(s) and "v" in _sounds(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz" and w[-1].isascii():
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _sounds(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = _longest(w, [a for a, _ in table])
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + dict(table)[s]
    s = _longest(w, STEP_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode()


_STEMS: dict[str, str] = {}


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, place in its row, number of the stem) of every word, and the stems: runs of letters and digits, lower-cased, without accents.

    Only the distinct words of a batch are stemmed, and those a worker has met before are looked up.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(pc.fill_null(texts, "")), "NFD"), r"\p{Mn}+", "")
    lists = pc.split_pattern_regex(plain, r"[^\p{L}\p{N}]+")
    row, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    row, coded = row[real], words.filter(pa.array(real)).dictionary_encode()
    if len(_STEMS) > _MEMORY:
        _STEMS.clear()
    known = []
    for w in coded.dictionary.to_pylist():
        if w not in _STEMS:
            _STEMS[w] = porter(w)
        known.append(_STEMS[w])
    stems = sorted(set(known))
    at = {s: i for i, s in enumerate(stems)}
    stem = np.array([at[s] for s in known], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    first = np.searchsorted(row, row)
    return row.astype(np.int64), np.arange(len(row)) - first, stem, stems


@F.pandas_udf(ArrayType(StringType()))
def stems(text: pd.Series) -> pd.Series:
    """A text's stems in order."""
    row, _, stem, names = words_of(pa.array(text, pa.string()))
    bounds = np.searchsorted(row, np.arange(len(text) + 1))
    return pd.Series([[names[i] for i in stem[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
