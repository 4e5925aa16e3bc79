"""Document fingerprints by one-permutation MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a shingle, bins (a power of two), and stored low-order bits of a bin.
WIDTH, BINS, BITS = 5, 128, 8
#: Steps of an empty bin's random series.
PROBES = 16
#: What counts as white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Ranges of ids at least, within which rows are put in order; with more shuffle partitions there are more.
RANGES = 1024
#: Stands for a missing doc_id in the order.
NO_ID = -(2**63)


def shingle_hashes(text: Column) -> tuple[Column, Column]:
    """Hashes of a text's words (lower-cased), and, of these in the column _words, of its runs of WIDTH words; a shorter text has its whole sequence as one."""
    low = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, SPACES))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # One hash of each word, then of each run of word hashes: no strings are built.
    def run(i: Column) -> Column:
        return F.xxhash64(*(F.get(F.col("_words"), i + k) for k in range(WIDTH)))

    return hashes, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - WIDTH, F.lit(0))), run)


def fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column `out`: the packed low-order bits of each bin, in hex; '' for a text without words.

    The high bits of a shingle's hash name its bin, so one sort of the hashes
    brings each bin's least one to its front. Optimal densification: an empty bin
    takes the value of the first bin with one in its own random series of bins.
    After PROBES steps it takes that of the bin least under its own hash, which
    is as random. Equal sets choose alike.
    """
    words, shingles = shingle_hashes(F.coalesce(F.col(text), F.lit("")))
    bits, every = BINS.bit_length() - 1, F.sequence(F.lit(0), F.lit(BINS - 1))

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, 64 - bits).cast("int") + BINS // 2

    def is_first(h: Column, i: Column) -> Column:
        return (i == 0) | (bin_of(h) != bin_of(F.get("_sorted", i - 1)))

    def own(b: Column) -> Column:
        # Where no bin before it is empty, a bin stands at its own place.
        return F.coalesce(F.when(F.get("_bins", b) == b, F.get("_least", b)), F.get("_least", F.array_position("_bins", b).cast("int") - 1))

    def densified(b: Column) -> Column:
        probes = [F.get("_own", F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
        last = F.array_min(F.transform("_least", lambda h: F.struct(F.xxhash64(b, bin_of(h)), h.alias("h"))))["h"]
        return F.coalesce(F.get("_own", b), *probes, last)

    packed = F.transform(every, lambda b: F.lpad(F.hex(densified(b).bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0"))
    kept = docs.columns
    return (
        docs.withColumn("_words", words)
        .withColumn("_sorted", F.when(F.size("_words") == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(shingles)))
        .withColumn("_least", F.filter("_sorted", is_first))
        .withColumn("_bins", F.transform("_least", bin_of))
        .withColumn("_own", F.transform(every, own))
        .withColumn(out, F.when(F.size("_bins") == 0, "").otherwise(F.array_join(packed, "")))
        .select(*kept, out)
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less what equal low-order bits by chance give. Two empty ones are alike, an empty and another not."""
    step, chance = BITS // 4, 2.0**-BITS
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, i * step + 1, F.lit(step)) == F.substr(b, i * step + 1, F.lit(step))))
    guess = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(guess)


def with_next(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (key, text, fingerprint and others) with next_text and next_fp of the next row by descending key, then text; the first follows the last.

    A window over all rows would be one task. Keys are cut into ranges by
    approximate quantiles, and each range is ordered on its own, so a text is
    shuffled once. To each range comes a copy of the first row of the range that
    follows, as its end. texts: the same rows without fingerprints, in which these are looked up.
    """
    spark = rows.sparkSession
    ranges = max(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = texts.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] or []
    cut = F.array(*(F.lit(b) for b in sorted(set(bounds)))).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(ranges.bit_length()))))

    def range_of(key: Column) -> Column:
        """How many bounds are at most key, by bisection."""
        return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(cut, lo + s - 1) <= key, lo + s).otherwise(lo))

    # One row for each range: the window over them has as many rows at most, whatever the size of the corpus.
    first = texts.select("key", range_of(F.col("key")).alias("range")).groupBy("range").agg(F.max("key").alias("key"))
    order = Window.orderBy(F.desc("range"))
    first = first.select("key", F.coalesce(F.lag("range").over(order), F.min("range").over(Window.partitionBy())).alias("range"))
    ends = texts.join(F.broadcast(first), "key").groupBy("range").agg(F.max(F.struct("key", "text")).alias("x")).select("range", "x.*")
    ends = fingerprint(ends, "text", "fingerprint").withColumn("end", F.lit(True))
    both = rows.withColumn("range", range_of(F.col("key"))).withColumn("end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy("range").orderBy("end", F.desc("key"), F.desc("text"))
    both = both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fingerprint").over(w))
    return both.where("NOT end").drop("end", "range")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text is empty. The edited text has its last floor(n_chars / 2) code
    points replaced by the first as many of the next document's. Documents that
    share a doc_id follow each other by descending text; one without doc_id comes
    below all others. One document alone is its own next. Other columns are ignored.
    """
    d = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(fingerprint(d, "text", "fingerprint"), d.select("key", "text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - int(floor(char_length(text) / 2)))"), F.substr("next_text", F.lit(1), half))
    return fingerprint(pairs.withColumn("edited", edited), "edited", "edited_fingerprint").select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )


def op9_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
