"""Scalar transforms of texts, identifiers, anchors and references, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the fields.
TEXT_MAX, CONTEXT_MAX, SNIPPET = 2800, 400, 400
#: Language markers at the end of a slug, ISO 639-2 codes.
LANGUAGE_SUFFIXES = {"-en": "en", "-fr": "fr", "-de": "de", "-es": "es"}
ISO_639_2 = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es"}
WIDE = r"[぀-ヿ㐀-䶿一-鿿가-힯]"


def clamp_anchor(anchor: Column) -> Column:
    """Anchors that look like a UUID say nothing to a reader."""
    return F.when(anchor.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), "").otherwise(anchor)


def clamp_text(text: Column, most: int = TEXT_MAX) -> Column:
    """A text that is too long ends after most - 1 characters, without white space at its end, with an ellipsis."""
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit(" …"))).otherwise(text)


def sanitize_identifier(name: Column) -> Column:
    """Without a language mark and a placeholder year at the end."""
    return F.regexp_replace(F.regexp_replace(name, r"\s*\((?:E|F|E/F)\)\s*$", ""), r":(?:0000|XXXX)$", "")


def normalize_identifier(name: Column) -> Column:
    cut = F.regexp_replace(name, r":(?:19|20)[0-9]{2}(?:\s*\([A-Z]\))?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r":(?:19|20)[0-9]{2}(?:\s*\([A-Z]\))?\s*$", ""), r"\s+", " "))


def slug_language(slug: Column, default: str = "en") -> Column:
    out = F.lit(default)
    for suffix, lang in sorted(LANGUAGE_SUFFIXES.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(slug.endswith(suffix), lang).otherwise(out)
    return out


def first_year(text: Column) -> Column:
    """The first year of this or the last century, '' if there is none."""
    return F.regexp_extract(text, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)


def normalize_language(code: Column) -> Column:
    low = F.lower(F.trim(code))
    known = F.create_map(*[F.lit(x) for kv in ISO_639_2.items() for x in kv])
    return F.coalesce(F.nullif(F.coalesce(known[low], low), F.lit("")), F.lit("en"))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]{1,120}>", " "), r"\s+", " "))


def anchor_path(anchor: Column) -> Column:
    """A dotted numeric anchor as integers, else null; arrays compare as anchors do."""
    return F.when(anchor.rlike(r"^\d{1,9}(\.\d{1,9})*$"), F.transform(F.split(anchor, r"\."), lambda x: x.cast("int")))


def anchor_sort_key(anchor: Column) -> Column:
    return F.transform(F.split(anchor, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("int"), F.lit(10**9)))


def est_tokens(text: Column) -> Column:
    """A token for each wide character, and for each four of the others, rounded up."""
    wide = F.regexp_count(text, F.lit(WIDE))
    return (wide + F.ceil((F.char_length(text) - wide) / 4)).cast("long")


def retrieval_query(query: Column, previous: Column) -> Column:
    """A short follow-up of eight words at most is searched with the question before it."""
    short = F.size(F.split(F.trim(query), r"\s+")) <= 8
    return F.when(short & previous.isNotNull() & (F.trim(previous) != ""), F.concat(F.trim(previous), F.lit(" — "), F.trim(query))).otherwise(F.trim(query))


def normalize_context(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""), 1, CONTEXT_MAX)


def cache_key(query: Column, lang: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")), F.lit("|"), F.coalesce(lang, F.lit("")), F.lit(f"|{salt}" if salt else "")).cast("binary"), 256)


def unit_refs(text: Column) -> Column:
    """The distinct units that a text names as [[u:id]], in order of their first use; a doubled prefix counts once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[((?:u:)+[^\[\]]+)\]\]"), 1), lambda r: F.regexp_replace(r, "^(?:u:)+", "u:")))


def number_of(text: Column) -> Column:
    """The first number of a text: spaces group digits, a comma is decimal, but for three digits after it."""
    raw = F.regexp_extract(text, r"-?[0-9][0-9 .,]*", 0)
    squeezed = F.regexp_replace(F.regexp_replace(raw, " ", ""), "[.,]+$", "")
    plain = F.when(squeezed.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.regexp_replace(squeezed, ",", "")).otherwise(F.regexp_replace(squeezed, ",", "."))
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain.cast("double"))


def compress_tokens(text: Column, stop: list[str]) -> Column:
    """Numbers of any length and words of three letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), 0)
    return F.filter(found, lambda t: t.rlike(r"^[0-9]") | ((F.char_length(t) >= 3) & ~t.isin(stop)))


def normalized(text: Column) -> Column:
    """For comparing quotations: lower case, one kind of quotes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "“”’‘«»", "\"\"''\"\""), r"\s+", " "))


def quotes_missing(answer: Column, passage: Column) -> Column:
    """The texts quoted inside square brackets that the passage has not."""
    quoted = F.regexp_extract_all(answer, F.lit(r'\[[^\[\]"]*"([^"\[\]]+)"[^\[\]]*\]'), 1)
    return F.filter(quoted, lambda q: ~F.contains(normalized(passage), normalized(q)))


def is_retyped_table(text: Column) -> Column:
    """A row of a Markdown table, and six bars or more."""
    return text.rlike(r"(?m)^\s*\|.+\|\s*$") & (F.char_length(text) - F.char_length(F.replace(text, F.lit("|"), F.lit(""))) >= 6)
