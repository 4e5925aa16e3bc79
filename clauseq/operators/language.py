"""Language of a document by its stop words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseq.functions.tokens import bound

# Stop words, and the bounds of a verdict.
STOPWORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "as"],
    "fr": ["le", "la", "les", "de", "des", "et", "est", "une", "dans", "pour"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "una", "para", "con"],
    "de": ["der", "die", "das", "und", "ist", "von", "mit", "für", "den", "dem"],
}
SAMPLE_CHARS, MIN_WORDS, MIN_HITS, DOMINANCE = 30_000, 150, 10, 2.0
# Other scripts (Hebrew, Arabic, Cyrillic, CJK, kana, Hangul), and from which letters and share on they decide.
OTHER_SCRIPTS = r"[\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{08a0}-\x{08ff}\x{0400}-\x{04ff}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
MIN_LETTERS, OTHER_SHARE = 200, 0.3


def _hits(words: Column, stop: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(stop)))


def _led(text: Column, verdict: Callable[[Column, dict[str, Column], Column], Column]) -> Column:
    """verdict(words, hits of each language, hits in falling order) of a text. Each list is made once, however often the verdict uses it, and stop words are picked out of all words once."""
    every = sorted({w for stop in STOPWORDS.values() for w in stop})

    def of(words: Column) -> Column:
        def counted(known: Column) -> Column:
            return F.array(*(_hits(known, stop) for stop in STOPWORDS.values()))

        def judged(hits: Column) -> Column:
            return verdict(words, {lang: F.get(hits, F.lit(i)) for i, lang in enumerate(STOPWORDS)}, F.sort_array(hits, asc=False))

        return bound(bound(F.filter(words, lambda w: w.isin(every)), counted), judged)

    return bound(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-öø-ÿ]+"), F.lit(0)), of)


def stopword_language(text: Column) -> Column:
    """non-latin if other scripts have a fair share of the letters, else en, fr, es or de if its stop words lead clearly, else null. The sample's length is part of the operator."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE_CHARS)

    def verdict(words: Column, hits: dict[str, Column], ranked: Column) -> Column:
        best, second = ranked[0], ranked[1]
        sure = (F.size(words) >= MIN_WORDS) & (best >= MIN_HITS) & (best >= DOMINANCE * second)
        latin = F.char_length(F.array_join(words, ""))
        other = F.regexp_count(sample, F.lit(OTHER_SCRIPTS))
        foreign = bound(F.struct(latin.alias("latin"), other.alias("other")), lambda n: (n["latin"] + n["other"] > MIN_LETTERS) & (n["other"] > OTHER_SHARE * (n["latin"] + n["other"])))
        return F.when(foreign, "non-latin").when(sure, F.coalesce(*(F.when(h == best, lang) for lang, h in hits.items())))

    return _led(sample, verdict)


#: Fixed values of a unit's verdict: characters of the sample, words, hits, and how many times the next language's hits they must exceed.
UNIT_CHARS, UNIT_WORDS, UNIT_HITS, UNIT_LEAD = 1600, 20, 3, 1.5


def unit_language(text: Column) -> Column:
    """A unit's language by the same stop words, en, fr, es or de; null where it is too short or no language leads. It tags, and drops nothing. The sample's length is part of the operator."""

    def verdict(words: Column, hits: dict[str, Column], ranked: Column) -> Column:
        sure = (F.size(words) >= UNIT_WORDS) & (ranked[0] >= UNIT_HITS) & (ranked[0] > UNIT_LEAD * ranked[1])
        return F.when(sure, F.coalesce(*(F.when(h == ranked[0], lang) for lang, h in hits.items())))

    return _led(F.substring(F.coalesce(text, F.lit("")), 1, UNIT_CHARS), verdict)
