"""Whether an answer rests on its passages: quotations, clause numbers; and passages cut down to what a question asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseq.functions.tokens import bound

#: Fixed value: words that say nothing about a sentence.
STOP = (
    "the a an and or of to in on for with by as at is are was were be been from that this these those it its their there which who what when where how why not no than then also such may must "
    "shall can could should would per within under over into about between during before after each any all more most less least other only same both few many some own very one two"
).split()
#: What a digit adds to a sentence's worth, and the least length of a text that is cut at a blank.
DIGIT, SHORTEST_CUT = 0.35, 40


def folded(text: Column) -> Column:
    """Text as quotations are compared: signs of one kind made one, soft hyphens away, single blanks, lower case."""
    marks = F.translate(F.coalesce(text, F.lit("")), "‘’‛′“”‟″–—−     ", "''''\"\"\"\"---     ")
    return F.lower(F.regexp_replace(F.replace(marks, F.lit("­"), F.lit("")), r"\s+", " "))


def quotations(answer: Column) -> Column:
    """[(anchor, quote)]: every quotation within every pair of square brackets, in order."""
    flat = F.translate(F.coalesce(answer, F.lit("")), "“”‟«»", '"""""')
    anchors = F.regexp_extract_all(flat, F.lit(r"\[[^\[\]\n]*\]"), 0)
    of = lambda a: F.transform(F.regexp_extract_all(a, F.lit(r'"([^"\n]+)"'), 1), lambda q: F.struct(a.alias("anchor"), q.alias("quote")))
    return F.flatten(F.transform(anchors, of))


def unfounded(answer: Column, passages: Column) -> Column:
    """The anchors of quotations that the passages, joined, do not have; one for each such quotation."""
    missing = lambda hay: F.filter(quotations(answer), lambda x: ~F.contains(hay, folded(x["quote"])))
    return F.transform(bound(folded(passages), missing), lambda x: x["anchor"])


def cited_clauses(answer: Column) -> Column:
    """The distinct clause numbers (two to four parts) of an answer; of a range both ends."""
    t = F.coalesce(answer, F.lit(""))
    ends = F.regexp_extract_all(t, F.lit(r"\b(\d{1,2}\.\d{1,2})\s?[–—-]\s?(\d{1,2}(?:\.\d{1,2}){1,3})\b"), 2)
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"\b(\d{1,2}(?:\.\d{1,2}){1,3})\b"), 1), ends))


def missing_clauses(answers: DataFrame, clauses: DataFrame, key: list[str], own: list[str]) -> DataFrame:
    """own, key, clause: each clause that an answer (own, key, answer) cites and its document's clauses (key, clause) neither are nor begin with.

    The clauses are joined with all their dotted beginnings, so no answer meets every clause.
    """
    cited = answers.select(*own, *key, F.explode(cited_clauses(F.col("answer"))).alias("clause")).distinct()
    parts = F.split("clause", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    known = clauses.where("clause IS NOT NULL").select(*key, F.explode(heads).alias("clause")).distinct()
    return cited.join(known, [*key, "clause"], "left_anti")


def terms_of(text: Column) -> Column:
    """Numbers of any length, and words of three signs or more that say something."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+(?:[.][0-9]+)?"), 0)
    return F.filter(found, lambda t: t.rlike("^[0-9]") | ((F.char_length(t) >= 3) & ~t.isin(STOP)))


def shortened(rows: DataFrame, text: str, question: str, budget: int, out: str) -> DataFrame:
    """rows with `out`: the text in at most `budget` characters, its first sentence and those that answer best while they fit, in reading order.

    A sentence is worth the question's terms that it has over the root of its terms, and
    more with a digit; ties go to the earlier. A text of one sentence is cut at its
    last blank within the budget. Texts within the budget stay, with single blanks.
    What a lambda uses is handed to it, as the optimiser may put a column's expression in its place, to be made again for each element.
    """
    clean = F.col("_clean")
    d = rows.withColumns({"_clean": F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), "_asked": F.array_distinct(terms_of(F.col(question)))})
    d = d.withColumn("_sentences", F.filter(F.transform(F.split(clean, r"(?<=[.!?;])\s+"), lambda s: F.btrim(s)), lambda s: s != ""))
    d = d.withColumn("_terms", F.when(F.char_length(clean) > budget, F.transform("_sentences", terms_of)))
    hits = lambda asked, ts: F.size(F.filter(ts, lambda t: F.array_contains(asked, t)))
    d = d.withColumn("_hits", bound(F.col("_asked"), lambda asked: F.transform("_terms", lambda ts: hits(asked, ts))))

    def worth(x: Column, i: Column) -> Column:
        terms = F.size(x["_terms"])
        value = F.when(terms > 0, x["_hits"] / F.sqrt(terms) + F.when(x["_sentences"].rlike("[0-9]"), DIGIT).otherwise(0.0)).otherwise(0.0)
        return F.struct((-F.round(value, 9)).alias("v"), i.alias("i"), F.char_length(x["_sentences"]).alias("n"))

    each = F.transform(F.arrays_zip("_sentences", "_terms", "_hits"), worth)
    d = d.withColumn("_ranked", F.when(F.col("_terms").isNotNull(), F.array_sort(F.slice(each, 2, 1_000_000))))
    start = F.struct((F.char_length(F.get("_sentences", F.lit(0))) + 1).alias("used"), F.array(F.lit(0)).alias("kept"))

    def take(state: Column, s: Column) -> Column:
        need = state["used"] + s["n"] + 1
        return F.when(need <= budget, F.struct(need.alias("used"), F.array_append(state["kept"], s["i"]).alias("kept"))).otherwise(state)

    d = d.withColumn("_kept", F.array_sort(F.aggregate("_ranked", start, take)["kept"]))
    cut = F.substring(clean, 1, budget)
    blank = F.char_length(cut) - F.locate(" ", F.reverse(cut))
    one = F.btrim(F.when((F.locate(" ", cut) > 0) & (blank > SHORTEST_CUT), F.left(cut, blank)).otherwise(cut))
    several = F.substring(F.btrim(F.array_join(bound(F.col("_sentences"), lambda ss: F.transform("_kept", lambda i: F.get(ss, i))), " ")), 1, budget)
    short = F.when(F.char_length(clean) <= budget, clean).when(F.size("_sentences") <= 1, one).otherwise(several)
    return d.select(*rows.columns, short.alias(out))
