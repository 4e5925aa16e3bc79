"""Ranking by BM25, and fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseq.functions.tokens import query_terms, tokens

K1, B = 1.2, 0.75
#: So many distinct terms of queries at most are sent to the tasks as a set; with more of them they are joined.
TERM_SET = 20_000


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by (score desc, doc_id), with their rank. Spark limits each group before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _asked_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, dl and each occurrence (term) of a wanted term. Other words are dropped within the array, before it is exploded."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("ws")).select("doc_id", F.size("ws").alias("dl"), "ws")
    known = sorted(r["term"] for r in wanted.limit(TERM_SET + 1).collect())
    if len(known) <= TERM_SET:
        return words.select("doc_id", "dl", F.explode(F.filter("ws", lambda w: w.isin(known))).alias("term"))
    return words.select("doc_id", "dl", F.explode("ws").alias("term")).join(wanted, "term", "left_semi")


def _frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, dl, tf of the terms (term) of queries."""
    return _asked_words(docs, terms.select("term").distinct()).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, doc_id, score of every document with a term of a query. docs: doc_id, text. asked: query_id, text."""
    terms = asked.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    total = docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = _frequencies(docs, terms)
    # By a count that reads tf, as all uses of the frequencies do, so that Spark makes them once.
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    # The totals are one row.
    idf = df.join(F.broadcast(total)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return terms.join(idf, "term").join(tf, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_topk(docs: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of each query."""
    return top(bm25(docs, asked), k)


def bm25_within(docs: DataFrame, asked: DataFrame, allowed: DataFrame, k: int = 10) -> DataFrame:
    """The k best of the allowed documents (doc_id), scored by the statistics of all; none where the set is empty."""
    return top(bm25(docs, asked).join(allowed.select("doc_id"), "doc_id", "left_semi"), k)


def rrf(rankings: list[DataFrame], k: int = 10, constant: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank): the sum of weight / (constant + rank)."""
    weights = weights or [1.0] * len(rankings)
    parts = [r.select("query_id", "doc_id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights, strict=True)]
    both = reduce(DataFrame.unionByName, parts)
    return top(both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def lanes(rankings: list[DataFrame]) -> DataFrame:
    """query_id, doc_id, lane, rank: the union of rankings; of a document in several, the row of the first lane stays."""
    both = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", F.struct(F.lit(i).alias("lane"), "rank").alias("at")) for i, r in enumerate(rankings)])
    return both.groupBy("query_id", "doc_id").agg(F.min("at").alias("at")).select("query_id", "doc_id", "at.*")


def overlap_topk(docs: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """Ranking by the number of distinct query terms that a document has."""
    terms = asked.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    # The same frequencies as in bm25: where both rankings are asked for, Spark makes them once.
    had = F.collect_set(F.when(F.col("tf") > 0, F.col("term")))
    return top(terms.join(_frequencies(docs, terms), "term").groupBy("query_id", "doc_id").agg(F.size(had).cast("double").alias("score")), k)


def keyword_score(query: Column, text: str) -> Column:
    """Mean over the query's terms (two characters or more) of 1 + ln(occurrences, ten at most) / 2; occurrences may overlap."""
    low = F.regexp_replace(F.lower(query), r"[^a-z0-9_\s-]", " ")
    terms = F.filter(F.split(low, r"\s+"), lambda x: F.char_length(x) > 1)

    def point(t: Column) -> Column:
        n = F.regexp_count(F.lower(F.col(text)), F.concat(F.lit(r"(?=\Q"), t, F.lit(r"\E)")))
        return F.when(n > 0, 1 + F.log(F.least(n, F.lit(10))) * 0.5).otherwise(0.0)

    return F.when(F.size(terms) > 0, F.aggregate(F.transform(terms, point), F.lit(0.0), lambda a, x: a + x) / F.size(terms)).otherwise(0.0)
