"""Identifiers of documents: how a publisher's series reads in headers, titles, slugs, questions, node ids and bibliographies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseq.functions.tokens import bound, slug

#: Shapes of international references, in the order in which a text is searched for them.
CITED = (
    r"\bISO(?:/IEC|/TS|/TR)?\s*(?:Guide\s+)?\d{1,5}(?:\s*[-–]\s*\d+)?(?:\s*:\s*\d{4})?",
    r"\bIEC\s*\d{4,6}(?:\s*[-–]\s*\d+)?(?:\s*[-–]\s*\d+)?(?:\s*:\s*\d{4})?",
)
#: Series letters by words of a document type, the first that fits; letters that slugs and questions may use.
TYPES = {"recommendation": "R", "document": "D", "basic": "B", "guide": "G", "expert": "E"}
SERIES, ASKED_SERIES, PRINTED = "RDBGEVS", "RDBGE", "RDBGES"
#: Fixed value: a rendering names its document within so many characters.
HEAD = 60_000


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's first match, null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _year(text: Column) -> Column:
    return F.regexp_extract(text, "(19[0-9]{2}|20[0-9]{2})", 1)


def _real(number: Column) -> Column:
    """A number of 1 to 999."""
    return F.coalesce(number.rlike(r"^\d{1,9}$") & number.cast("int").between(1, 999), F.lit(False))


def _plain(number: Column) -> Column:
    return F.regexp_replace(number, "^0+(?=[0-9])", "")


def scan_cited(text: Column, grammars: tuple[str, ...] = CITED) -> Column:
    """[(node, label)] of what a text cites, grammar by grammar, each from left to right; of the spellings of one node the first stays."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(*(F.regexp_extract_all(t, F.lit(g), F.lit(0)) for g in grammars))
    node = lambda x: F.concat(F.lit("cite:"), F.btrim(F.regexp_replace(x, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    label = lambda x: F.regexp_replace(x, r"\s+", " ")
    pairs = F.transform(found, lambda x: F.struct(node(x).alias("node"), label(x).alias("label")))
    first = lambda ps, n: F.get(F.filter(ps, lambda p: p["node"] == n), F.lit(0))
    return bound(pairs, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda p: p["node"])), lambda n: first(ps, n)))


@dataclass(frozen=True)
class Codec:
    """A publisher's grammar: its prefix ("STD"), a letter for the series, a number of up to three digits, a part, a year. Without a prefix, a plain slug."""

    prefix: str | None = None

    def _letters(self, letters: str) -> str:
        return f"(?:{'|'.join(letters)})"

    def slug(self, identifier: Column) -> Column:
        return slug(identifier)

    def cited(self, text: Column) -> Column:
        """The publisher's own references first, then the international ones."""
        if self.prefix is None:
            return scan_cited(text)
        own = rf"\b{self.prefix}\s+[RDBGEVS]\s*\d{{1,3}}(?:\s*[-–]\s*[0-9A-Za-z]{{1,3}})?(?:\s*:\s*\d{{4}})?"
        return scan_cited(text, (own, *CITED))

    def extract(self, text: Column) -> Column:
        """The identifier, without its year, that a rendering gives: the one after "reference", else the first; '' if there is none."""
        if self.prefix is None:
            return F.lit("")
        head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
        name = rf"({self.prefix}\s+{self._letters(PRINTED)}\s*\d+(?:-\d+)?):\d{{4}}"
        return F.coalesce(_first(head, rf"reference\s+{name}"), _first(head, name), F.lit(""))

    def node(self, raw: Column) -> Column:
        """The document's node in the graph, null for what is not of the grammar."""
        s = F.replace(F.regexp_replace(F.trim(raw), r"\s*\([EFSG]\)$", ""), F.lit("+Amendment"), F.lit("-Amd"))
        of = s.rlike(rf"^({self.prefix}\s+)?[{SERIES}]\s*\d{{1,3}}")
        return F.when(of, F.concat(F.lit("doc:"), F.btrim(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), F.lit("-"))))

    def family_node(self, raw: Column) -> Column:
        start = rf"^(?:{self.prefix}\s+)?([{SERIES}])\s*(\d{{1,3}})"
        return F.when(raw.rlike(start), F.concat(F.lit("family:"), F.regexp_extract(raw, start, 1), F.lit("-"), F.regexp_extract(raw, start, 2)))

    def classify(self, title: Column, attrs: Column, name: Column) -> Column:
        """(identifier, series, number) from a title, a header's attributes (a map) and a slug.

        In this order: the title of an annex volume, unless a readable header says the
        same; a readable header; the slug of a known series; the header's series,
        number and type; any slug; what the header has. A header is readable with a
        number of 1 to 999.
        """
        get = lambda k: F.coalesce(attrs[k], F.lit(""))
        low, title = F.coalesce(name, F.lit("")), F.coalesce(title, F.lit(""))
        header = F.trim(F.regexp_replace(F.regexp_replace(F.trim(get("docidentifier")), r"\s*\((?:E|F|E/F)\)\s*$", ""), r":(?:0000|XXXX)\b", ""))
        shape = r"([RBV DGES])\s*(\d+)"
        full, bare = rf"(?i){self.prefix}\s+{shape}", rf"(?i)^{shape}"
        letter = F.upper(F.coalesce(_first(header, full), _first(header, bare)))
        number = F.coalesce(_first(header, full, 2), _first(header, bare, 2))
        readable = F.coalesce(_real(number), F.lit(False))
        annex = rf"(?i)^\s*Annex(?:es)?\s+(?:to|of)\s+{self.prefix}\s+([A-Z])\s*-?\s*(\d+)"
        annex_letter, annex_number = F.upper(_first(title, annex)), _plain(_first(title, annex, 2))
        own = annex_letter.isNotNull() & ~(readable & (letter == annex_letter) & (number == annex_number))
        slug_shape = r"^([a-z]+)[-_]?(\d+)(?!\d)"
        slug_letter, slug_number = F.upper(_first(low, slug_shape)), _plain(_first(low, slug_shape, 2))
        year = F.when(get("edition") != "", get("edition")).otherwise(_year(low))
        suffix = F.when(year.rlike("^(19|20)[0-9]{2}$"), F.concat(F.lit(":"), year)).otherwise("")
        kind = get("doctype")
        typed = F.coalesce(*(F.when(F.contains(kind, F.lit(w)), x) for w, x in TYPES.items()), F.lit(""))
        series = F.when(F.upper(F.trim(get("series"))) != "", F.upper(F.trim(get("series")))).otherwise(typed)
        count = F.when(F.trim(get("docnumber")) != "", F.trim(get("docnumber"))).otherwise(F.regexp_extract(low, r"(?:^|[a-z])(\d{1,3})", 1))
        any_year = lambda y: F.when(y != "", F.concat(F.lit(":"), y)).otherwise("")

        def said(identifier: Column, s: Column, n: Column) -> Column:
            return F.struct(identifier.alias("identifier"), s.alias("series"), n.alias("number"))

        printed = lambda s, n, y: F.concat(F.lit(f"{self.prefix} "), s, F.lit(" "), n, y)
        return (
            F.when(own, said(printed(annex_letter, annex_number, F.lit(" (Annexes)")), annex_letter, annex_number))
            .when(readable, said(header, letter, number))
            .when(slug_letter.isin(*SERIES), said(printed(slug_letter, slug_number, suffix), slug_letter, slug_number))
            .when((series != "") & _real(count), said(printed(series, count, any_year(year)), series, count))
            .when(slug_letter.isNotNull(), said(printed(slug_letter, slug_number, any_year(_year(low))), slug_letter, slug_number))
            .otherwise(said(header, series, count))
        )

    def parse(self, doc: Column, edition: Column | None = None) -> Column:
        """(number, edition, label) of an explicit name: printed, bare ("R 60-1:2021"), as a URN, or the publisher's side of a name in two ("ISO 4064-1|STD R 49-1"); null for others. A given edition wins."""
        p = self.prefix
        d = F.trim(doc)
        urn = rf"(?i)^urn:{p}:pub:([a-z]+):(\d+)(?:-([0-9a-z]+))?(?::(\d{{4}}))?(?::[a-z]{{1,7}}(?:-[a-z]{{1,7}})?)?$"
        part, year = F.regexp_extract(d, urn, 3), F.regexp_extract(d, urn, 4)
        opened = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
        shown = F.concat(F.lit(f"{p} "), F.upper(F.regexp_extract(d, urn, 1)), F.lit(" "), F.regexp_extract(d, urn, 2), opened("-", part), opened(":", year))
        sides = F.filter(F.transform(F.split(d, r"\|"), lambda s: F.trim(s)), lambda s: s.rlike(rf"(?i)^{p}\b"))
        source = (
            F.when(d.rlike("(?i)^urn:"), F.when(d.rlike(urn), shown)).when(F.contains(d, F.lit("|")), F.get(sides, F.lit(0)))
            .when(d.rlike(rf"(?i)^{p}\b"), d).otherwise(F.concat(F.lit(f"{p} "), d))
        )
        spine = rf"(?i)^{p}\s+([{SERIES}])\s*0*(\d{{1,3}})(?:-([0-9A-Za-z]{{1,3}}))?(?::(\d{{4}}))?(?:\s*\([A-Z](?:/[A-Z])?\))?$"
        letter, number = F.upper(F.regexp_extract(source, spine, 1)), F.regexp_extract(source, spine, 2)
        own = F.regexp_extract(source, spine, 4)
        edition = F.coalesce(F.nullif(edition, F.lit("")), F.nullif(own, F.lit(""))) if edition is not None else F.nullif(own, F.lit(""))
        label = F.concat(F.lit(f"{p} "), letter, F.lit(" "), number, opened("-", F.regexp_extract(source, spine, 3)), opened(":", F.coalesce(edition, F.lit(""))))
        return F.when(F.coalesce(source.rlike(spine), F.lit(False)), F.struct(number.alias("number"), edition.alias("edition"), label.alias("label")))

    def asked(self, question: Column) -> Column:
        """(number, edition, label) of the first document that a question names; a letter and one digit without a gap or prefix ("E2 weights") is a class, no name."""
        shape = rf"(?i)\b({self.prefix}\s+)?([{ASKED_SERIES}])(\s*)0*(\d{{1,3}})(?:\s*[-–]\s*\d+)?(?:\s*:\s*(\d{{4}}))?"
        every = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(shape), F.lit(0))
        named = F.filter(every, lambda m: ~((F.char_length(F.regexp_extract(m, shape, 4)) == 1) & (F.regexp_extract(m, shape, 1) == "") & (F.regexp_extract(m, shape, 3) == "")))
        first = F.get(named, F.lit(0))
        number, year = _plain(F.regexp_extract(first, shape, 4)), F.regexp_extract(first, shape, 5)
        label = F.concat(F.lit(f"{self.prefix} "), F.upper(F.regexp_extract(first, shape, 2)), F.lit(" "), number, F.when(year != "", F.concat(F.lit(":"), year)).otherwise(""))
        return F.when(first.isNotNull(), F.struct(number.alias("number"), F.nullif(year, F.lit("")).alias("edition"), label.alias("label")))

    def number_of_node(self, node: Column) -> Column:
        return F.nullif(F.regexp_extract(node, rf"^doc:{self.prefix}-[A-Z]-(\d+)-", 1), F.lit(""))

    def family(self, identifier: Column) -> Column:
        """The family's key ("R-60"), null for what is not of the grammar."""
        label = self.parse(identifier)["label"]
        loose = rf"^(?:{self.prefix}\s+)?([A-Z])\s?(\d{{1,3}})"
        key = lambda x, shape: F.concat(F.regexp_extract(x, shape, 1), F.lit("-"), F.regexp_extract(x, shape, 2))
        return F.when(label.isNotNull(), key(label, rf"^{self.prefix} ([A-Z]+) (\d{{1,3}})")).when(identifier.rlike(loose), key(identifier, loose))


def codec(name: str, prefix: str | None = None) -> Codec:
    """The codec of a profile: `plain-slug`, or `series` with the publisher's prefix; another name is an error."""
    if name == "plain-slug":
        return Codec()
    if name == "series" and prefix:
        return Codec(prefix)
    raise ValueError(f"unknown codec {name}; known: plain-slug, series (with a prefix)")
