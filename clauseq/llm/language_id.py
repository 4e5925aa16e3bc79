"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from clauseq.llm.staging import staged, unstage
from clauseq.llm.textkit import U64, mix, text_bytes

#: Lengths of the byte n-grams of the blended spectrum; presence bits of a text.
SPECTRUM, DIMENSIONS = (2, 3, 4), 1 << 14
#: Labelled rows the model is fitted on, shared out evenly to the languages; least share of one; landmarks among them; ridge.
TRAIN_ROWS, LEAST_ROWS, LANDMARKS, RIDGE = 3000, 20, 192, 1e-4
#: A text is read in blocks of this many bytes; each gives a presence vector, and their kernels are averaged.
BLOCK = 2048
#: Parts in which a language's ids are first chosen, so that no task orders all of one; tasks that sum up the sample.
FIT_TASKS = 16
#: The pipeline rejects documents whose evidence is not above this share of what all labelled rows but a hundredth reach.
EVIDENCE, LOWEST = 0.5, 0.01


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray  # landmarks + 1 x languages
    of: np.ndarray  # language of each landmark
    bound: float  # of the evidence


def presence(raw: np.ndarray) -> np.ndarray:
    """Which n-grams (hashed) of the spectrum stand in a block, A-Z lower-cased."""
    low = raw.astype(U64)
    low[(raw >= 65) & (raw <= 90)] += U64(32)
    out = np.zeros(DIMENSIONS, bool)
    with np.errstate(over="ignore"):
        for n in SPECTRUM:
            if len(low) >= n:
                code = np.full(len(low) - n + 1, n, U64)
                for j in range(n):
                    code = (code << U64(8)) | low[j : j + len(code)]
                out[(mix(code) & U64(DIMENSIONS - 1)).astype(np.int64)] = True
    return out


def shared(bits: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many n-grams each two vectors share, and the sizes of both sets."""
    a, b = bits.astype(np.float32), marks.astype(np.float32)
    return a @ b.T, np.maximum(a.sum(1), 1)[:, None], np.maximum(b.sum(1), 1)[None, :]


def kernel(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of two sets of vectors: shared n-grams over the root of both sizes."""
    return common / (np.sqrt(a) * np.sqrt(b))


def lift(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of a text's n-grams that a landmark has, over chance: 1 if all, 0 if as many as of any hashed text."""
    chance = np.minimum(b / DIMENSIONS, 0.999)
    return (common / a - chance) / (1 - chance)


def _scored(raw: np.ndarray, at: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For up to 256 blocks of the texts at a time: their rows, lengths, kernels with the landmarks and a constant, and lifts."""
    spans = [(r, s, min(s + BLOCK, at[r + 1])) for r in range(len(at) - 1) for s in range(at[r], at[r + 1], BLOCK)]
    for lo in range(0, len(spans), 256):
        part = spans[lo : lo + 256]
        common = shared(np.stack([presence(raw[s:e]) for _, s, e in part]), marks)
        k = kernel(*common)
        yield np.array([p[0] for p in part]), np.array([e - s for _, s, e in part]), np.hstack([k, np.ones((len(k), 1))]), lift(*common)


def _one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The presence bits of each text's block of least hash."""
    for batch in batches:
        raw, at = text_bytes(batch.column("text"))
        bits = []
        for s, e in zip(at[:-1], at[1:], strict=True):
            parts = [raw[i : min(e, i + BLOCK)] for i in range(s, max(e, s + 1), BLOCK)]
            bits.append(np.packbits(presence(min(parts, key=lambda p: (zlib.crc32(p.tobytes()), p.tobytes())))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])


def _sums(sent, langs: list[str], weights: dict[str, float]):
    """For the texts of a task: the products of their kernels with each other and with the targets, and each text's evidence for its own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, of, ids = sent.value
        marks = np.unpackbits(packed, axis=1)
        left, right, reached = np.zeros((len(of) + 1,) * 2), np.zeros((len(of) + 1, len(langs))), []
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            size, doc = np.maximum(np.diff(at), 1), np.array(batch.column("doc_id").to_pylist())
            own = (lang[:, None] == of) & (doc[:, None] != ids)
            evidence = np.zeros(batch.num_rows)
            for row, length, k, lifts in _scored(raw, at, marks):
                part = length / size[row]  # of its text
                weight = part * np.array([weights[langs[x]] for x in lang[row]])
                left += k.T @ (k * weight[:, None])
                np.add.at(right.T, lang[row], k * weight[:, None])
                np.add.at(evidence, row, part * (lifts * own[row]).sum(1) / np.maximum(own[row].sum(1), 1))
            # A text without a landmark of another says nothing.
            reached += evidence[own.any(1)].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([reached], pa.list_(pa.float64()))], ["left", "right", "reached"]
        )

    return run


def training_ids(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang) of the training rows: for each language an even share of TRAIN_ROWS, the ids of least hash.

    Hashes are even, so the ids under a bound that the language's number of ids sets
    hold the share; only those few are ranked. The bound leaves six standard
    deviations, and a smaller sample is no fault.
    """
    ids = labelled.select("doc_id", "lang").distinct()
    counts = staged(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("of")))
    share = max(LEAST_ROWS, TRAIN_ROWS // max(1, counts.count()))
    hashed = F.xxhash64("doc_id")
    room = share + 6 * share**0.5 + 20
    # One row for each language.
    few = ids.join(F.broadcast(counts), "lang").where(hashed / 2.0**64 + 0.5 <= room / F.col("of"))
    few = few.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))).where(F.col("turn") <= share)
    return few.select("doc_id", "lang")


def fit(docs: DataFrame) -> Model:
    """Kernel ridge regression of each language against the rest, on labelled rows with text.

    Each language has an even share of TRAIN_ROWS, but LEAST_ROWS at least, and gives
    its rows of least hash of doc_id, so that a rare one is learnt too: the bound is
    this model's parameter. The sample's texts are read whole, where they are; to the
    driver come a landmark candidate (2 KB) for each, and sums of FIT_TASKS tasks.
    The landmarks are dealt evenly to the languages, so that a rare one has its share.
    The penalty is on the function's norm (w' K w over the landmarks), as in the exact regression.
    """
    spark = docs.sparkSession
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("text", "lang", F.col("doc_id").cast("long").alias("doc_id"))
    # Ids are chosen before texts are read, so only the sample's texts are shuffled; so many ids at most are broadcast.
    chosen = training_ids(labelled)
    # Of rows that share id and language, the one of least text hash trains; copies meet in the map-side part.
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = staged(rows.select("text", "lang", "doc_id").repartition(FIT_TASKS, "doc_id"))
    rows = sample.mapInArrow(_one_block, "doc_id long, lang string, bits binary").collect()
    # In the order of a hash: by the bits themselves the landmarks would be the shortest texts.
    rows = sorted((r["lang"], zlib.crc32(r["bits"]), bytes(r["bits"]), r["doc_id"]) for r in rows)
    if not rows:
        return Model([], np.zeros((0, DIMENSIONS // 8), np.uint8), np.zeros((1, 0)), np.zeros(0, int), 0.0)
    langs = sorted({r[0] for r in rows})
    lang = np.array([langs.index(r[0]) for r in rows])
    turn = np.arange(len(rows)) - np.searchsorted(lang, lang)
    at = np.sort(np.lexsort((lang, turn))[:LANDMARKS])
    marks, of, ids = np.stack([np.frombuffer(rows[i][2], np.uint8) for i in at]), lang[at], np.array([rows[i][3] for i in at])
    weights = {x: len(rows) / (len(langs) * c) for x, c in zip(langs, np.bincount(lang).tolist(), strict=True)}
    sums = sample.mapInArrow(_sums(spark.sparkContext.broadcast((marks, of, ids)), langs, weights), "left binary, right binary, reached array<double>").collect()
    unstage(sample)
    sums = sorted(sums, key=lambda r: bytes(r["left"]))  # in one order: sums of floats depend on it
    left = sum(np.frombuffer(r["left"]).reshape(len(at) + 1, -1) for r in sums)
    right = sum(np.frombuffer(r["right"]).reshape(len(at) + 1, -1) for r in sums)
    reached = [x for r in sums for x in r["reached"]]
    bound = max(0.0, EVIDENCE * float(np.quantile(reached, LOWEST))) if reached else 0.0
    bits = np.unpackbits(marks, axis=1)
    norm = np.eye(len(at) + 1) * 1e-9 * len(rows)  # equal landmarks would make it singular
    norm[:-1, :-1] += RIDGE * len(rows) * kernel(*shared(bits, bits))
    return Model(langs, marks, np.linalg.solve(left + norm, right), of, bound)


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "evidence")) -> DataFrame:
    """One row per document: every column of docs, and lang_pred, score (0 to 1) and evidence under `names`, which take the place of columns of docs.

    The scores of a text sum to 1 over the languages, so they compare languages and
    cannot tell a text of none; the evidence can: the mean lift by the landmarks of
    lang_pred, 0 or less where the text has no more of their n-grams than chance.

    lang_pred is `und` with score 0 where text is null or has no letter, and
    where the model knows no language. A long text's blocks are all scored and
    averaged by their bytes. Ties go to the first language in alphabetical order.
    """
    keep = [f for f in docs.schema.fields if f.name not in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS rows of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        m = sent.value
        marks = np.unpackbits(m.landmarks, axis=1) if m.languages else None
        ours = (m.of[:, None] == np.arange(len(m.languages))) / np.maximum(np.bincount(m.of, minlength=len(m.languages)), 1)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            texts, size = batch.column("text"), np.diff(at)
            total, lifts = np.zeros((batch.num_rows, len(m.languages))), np.zeros((batch.num_rows, len(m.languages)))
            for row, length, k, lifted in _scored(raw, at, marks) if m.languages else ():
                np.add.at(total, row, (k @ m.weights) * length[:, None])
                np.add.at(lifts, row, (lifted @ ours) * length[:, None])
            langs, scores, evidence = [], [], []
            for r in range(batch.num_rows):
                if not m.languages or not size[r] or not letter.search(texts[r].as_py()):
                    langs.append("und")
                    scores.append(0.0)
                    evidence.append(0.0)
                else:
                    best = int(np.argmax(total[r]))
                    langs.append(m.languages[best])
                    scores.append(float(min(1.0, max(0.0, total[r, best] / size[r]))))
                    evidence.append(float(lifts[r, best] / size[r]))
            arrays = [batch.column(f.name) for f in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in keep] + list(names))

    schema = StructType([*keep, StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], DoubleType())])
    return docs.select(*[docs[f.name] for f in keep]).mapInArrow(run, schema)


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows not held out. A row without doc_id is not held out, nor learnt from."""
    rows = held_out(docs.select("doc_id", "text", "lang"))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is undetermined (no letters, or evidence not above the model's bound); all columns stay."""
    model = fit(held_out(docs.select("doc_id", "text", "lang")).where(~F.col("held_out")))
    names = tuple(f"_{uuid.uuid4().hex}" for _ in range(3))  # no column of docs has these names
    return predict(docs, model, names).where((F.col(names[0]) != "und") & (F.col(names[2]) > model.bound)).select(*docs.columns)


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
