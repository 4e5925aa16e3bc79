"""N-gram Jaccard join by prefixes of groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.llm.bitmaps import map_of, perhaps
from clauseq.llm.staging import components, staged, unstage
from clauseq.llm.textkit import U64, WordHasher, blocks, mix, shingle_sets, text_bytes

#: Shingles are counted in so many buckets by hash, whatever the size of the corpus.
COUNT_BITS = 18
#: Bytes of text whose sets are held at a time.
HELD = 2 << 20


def _sets(batch: pa.RecordBatch, words: WordHasher, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """The shingle sets of the rows lo to hi, block by block."""
    raw, at = text_bytes(batch.column("text"))
    for lo, hi in blocks(at):
        yield lo, hi, shingle_sets(*words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), width)


def _count(width: int):
    """How many sets have a shingle in each bucket, over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordHasher(), np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, _, sets in _sets(batch, words, width):
                every = np.concatenate(sets) if sets else np.empty(0, U64)
                counts += np.bincount((every >> U64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "c"])

    return run


def _prefixes(width: int, percent: int, shared):
    """For each row the size and a 128-bit mark of its set, and the first shingles in order of their bucket's count, then hash: as many as any partner must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = WordHasher(), shared.value
        for batch in batches:
            for lo, hi, sets in _sets(batch, words, width):
                sizes, marks, groups, firsts = [len(s) for s in sets], [], [], []
                with np.errstate(over="ignore"):
                    for s in sets:
                        least = -(-percent * len(s) // 100)
                        first = s[np.lexsort((s, counts[(s >> U64(64 - COUNT_BITS)).astype(np.int64)]))[: len(s) - least + 1]]
                        # Two sums of differently mixed members: 128 bits name a set.
                        marks.append(np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)], U64).tobytes())
                        groups.append(int(mix(first).sum(dtype=U64).view(np.int64)))
                        firsts.append(first.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(groups, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                    ["doc_id", "n", "mark", "group", "prefix"],
                )

    return run


def _lists(tokens):
    """The shingles of the groups' prefixes, of those that may be in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("prefix")
            sizes, token = column.value_lengths().to_numpy(), column.flatten().to_numpy()
            keep = np.flatnonzero(perhaps(tokens.value, token))
            row = np.repeat(np.arange(batch.num_rows), sizes)[keep]
            pos = (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[keep]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), batch.column("gid").take(of), batch.column("n").take(of), pa.array(pos)], ["token", "gid", "n", "pos"])

    return run


def _asked_texts(shared):
    """Compressed texts of the rows whose id may be asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(perhaps(shared.value, batch.column("id").to_numpy()))
            raw, rows = text_bytes(batch.column("text").take(pa.array(keep)))
            texts = [zlib.compress(raw[s:e].tobytes(), 1) for s, e in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), pa.array(texts, pa.binary())], ["id", "packed"])

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        for batch in batches:
            rows, keep = batch.num_rows, []
            sides = [[x.as_buffer() for x in batch.column(c)] for c in ("pa", "pb")]
            i = 0
            while i < rows:
                texts: dict[bytes, bytes] = {}
                held, part = 0, []
                while i < rows and (held < HELD or not part):
                    pair = tuple(bytes(side[i]) for side in sides)
                    for x in pair:
                        if x not in texts:
                            texts[x] = zlib.decompress(x)
                            held += len(texts[x])
                    part.append((i, *pair))
                    i += 1
                at = np.concatenate([[0], np.cumsum([len(t) for t in texts.values()])]).astype(np.int64)
                raw = np.frombuffer(b"".join(texts.values()), np.uint8)
                sets = dict(zip(texts, shingle_sets(*words(raw, at), width), strict=True))
                for k, x, y in part:
                    a, b = sets[x], sets[y]
                    both = np.concatenate([a, b])
                    both.sort(kind="stable")
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * same >= percent * (len(a) + len(b) - same):
                        keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def link_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable over links, its own included).

    Two documents link when their sets of `width`-word shingles (white-space words,
    A-Z lower-cased) have a Jaccard similarity of percent / 100 or more. A text with
    fewer words has its whole sequence as its one shingle. Null, empty and blank
    texts have no shingle and no link. Rows that share a doc_id are one document
    with several texts. A row without doc_id is in no link and has a null
    component_id. Other columns are ignored.

    Equal sets are one class. Classes with the same prefix and size are one group,
    and only groups are paired: those that share a prefix shingle and can reach the
    similarity by size and position. First the members of a group, and the groups of
    a shingle, are verified against one of them; then, in the lists that have not
    become one component, all that are not yet in the same component. A pair within
    one component adds nothing to the result, so none of its links is lost.

    Sets are never shuffled. Prefixes are, and the compressed texts of the documents
    in a pair, from which both sets are made again where the pair is verified.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    # At most 2^COUNT_BITS rows, whatever the size of the corpus; the broadcast array has 2 MB.
    total = rows.select("text").mapInArrow(_count(width), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    counts[total.column("bucket").to_numpy()] = total.column("c").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    made = staged(rows.mapInArrow(_prefixes(width, percent, shared), "doc_id long, n long, mark binary, group long, prefix array<long>"))
    members, able = staged(made.drop("prefix")), "n > 0 AND doc_id IS NOT NULL"
    classes = staged(members.where(able).groupBy("mark").agg(F.min("doc_id").alias("rep"), F.min("group").alias("group"), F.min("n").alias("n")))
    # The least rep of a group is the least doc_id of its rows.
    groups = staged(made.where(able).groupBy("group", "n").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix")))
    unstage(made)
    able = members.where(able)
    inside = staged(classes.select("rep", "group", "n").join(groups.select("group", "n", "gid"), ["group", "n"]).select("rep", "gid").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").mapInArrow(_asked_texts(map_of(ids)), "id long, packed binary")
        a, b = (texts.select(F.col("id").alias(c), F.col("packed").alias("p" + c)) for c in "ab")
        return pairs.hint("shuffle_hash").join(a, "a").join(b, "b").select("a", "b", "pa", "pb").mapInArrow(_verify(width, percent), "a long, b long")

    def reach(n1: str, p1: str, n2: str, p2: str) -> Column:
        """Whether two sets whose first shared shingle stands at these positions can reach the similarity.

        Before it they share nothing, as both are in one order. A pair that links
        passes in the list of its first shared shingle, whatever the others say.
        """
        most = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
        return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (most * (100 + percent) >= percent * (F.col(n1) + F.col(n2)))

    def in_order(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tokens = groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    lists = staged(groups.mapInArrow(_lists(map_of(tokens)), "token long, gid long, n long, pos long"))
    unstage(groups)
    pivot = lists.groupBy("token").agg(F.min(F.struct("gid", "n", "pos")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    # From here on only the shingles that several groups have.
    common = staged(lists.join(pivot.select("token", F.col("p.gid").alias("g0"), F.col("p.n").alias("n0"), F.col("p.pos").alias("p0")), "token"))
    unstage(lists)
    star = common.where(F.col("gid") != F.col("g0")).where(reach("n", "pos", "n0", "p0")).select(F.col("g0").alias("a"), F.col("gid").alias("b"))
    star = star.unionByName(inside.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b")))
    tried = staged(in_order(star))
    edges = staged(verified(tried))
    found = components(edges)

    placed = staged(
        inside.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "gid", F.coalesce("component", "rep").alias("component"))
    )
    unstage(inside, found)
    spread = staged(placed.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    lists = common.select("token", "gid", "n", "pos").join(spread, "gid")
    mixed = lists.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    # The sizes that a set can reach lie in its own step of a geometric series and the next.
    step = F.floor(F.log("n") / -np.log(percent / 100)).cast("int") if percent < 100 else F.col("n")
    left = lists.join(mixed, "token", "left_semi").withColumn("step", step)
    right = left.select("token", *(F.col(c).alias(c + "2") for c in ("gid", "n", "pos", "lo", "hi")), F.explode(F.array(F.col("step") - 1, "step")).alias("step"))
    pairs = left.join(right, ["token", "step"]).where("(n < n2 OR n = n2 AND gid < gid2) AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    pairs = pairs.where(reach("n", "pos", "n2", "pos2")).select("gid", "gid2").distinct()
    pairs = pairs.unionByName(spread.where("lo <> hi").select("gid", F.col("gid").alias("gid2")))
    one, two = placed.select("gid", F.col("rep").alias("a"), F.col("component").alias("ca")), placed.select(F.col("gid").alias("gid2"), F.col("rep").alias("b"), F.col("component").alias("cb"))
    rest = staged(in_order(pairs.join(one, "gid").join(two, "gid2").where("ca <> cb")).join(tried, ["a", "b"], "left_anti"))
    unstage(common, placed, spread, tried)
    # Rows that share a doc_id are one document, so their classes are linked.
    several = able.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("doc_id")
    same = able.select("doc_id", "mark").join(several, "doc_id", "left_semi").join(classes, "mark").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(verified(rest)).unionByName(same))
    unstage(edges, rest)
    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("mark", F.coalesce("component", "rep").alias("c"))
    return members.select("doc_id", "n", "mark").join(of_class, "mark", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with only the document that names its component; those without doc_id stay. All columns stay."""
    heads = link_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(heads, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def op1_group_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)
