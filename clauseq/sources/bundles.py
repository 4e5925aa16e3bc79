"""Scans of folders: document bundles (folders or zip archives with a manifest), model bundles, and a corpus of AsciiDoc documents."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseq.sources import asciidoc

#: Files that a bundle must have. Its lines of units and edges may be empty files, which Spark's scan of a folder does not list.
NEEDED = ("document.json", "glossary.json")
#: SHA-256 of an empty file.
EMPTY = hashlib.sha256(b"").hexdigest()
_FILES = "bundle string, name string, content binary, sha256 string, error string"
_MANIFEST = "schema string, components array<struct<file: string, hash: string>>"


def _relative(path: Column, folder: str) -> Column:
    """A path below the folder. Listed paths may have a scheme that the folder's name lacks, so the folder is looked for anywhere."""
    bare = folder.split("://")[-1].rstrip("/") if "://" in folder else folder.removeprefix("file:").rstrip("/")
    at = F.locate(bare + "/", F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    return F.substring(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), at + len(bare) + 1, 1_000_000)


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bundle", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("sha256", pa.string()), ("error", pa.string())])
    for batch in batches:
        for bundle, content in zip(batch.column("bundle").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows, error = [], None
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            data = z.read(name)
                            rows.append((bundle, name, data, hashlib.sha256(data).hexdigest(), None))
                            if sum(len(r[2]) for r in rows) > 1 << 24:
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                                rows = []
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                error = f"broken archive: {type(e).__name__}"
            if error:
                rows.append((bundle, None, None, None, error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """bundle, name, content, sha256, error: every file of every bundle in the folder.

    A bundle is a sub-folder, whose files keep their paths below it, or a zip archive
    directly in the folder, named without its ending. Archives are opened where Spark
    has read them, one file at a time; one that can't be read gives a row with an error.
    Names that begin with a dot are left out.
    """
    rows = _binary(spark, folder).select(_relative(F.col("path"), folder).alias("at"), "content")
    rows = rows.where(~F.col("at").rlike(r"(^|/)\."))
    zipped = rows.where(F.col("at").rlike(r"^[^/]+\.zip$")).select(F.regexp_replace("at", r"\.zip$", "").alias("bundle"), "content")
    loose = rows.where(F.contains("at", F.lit("/")) & ~F.col("at").rlike(r"^[^/]+\.zip$")).select(
        F.split("at", "/", 2)[0].alias("bundle"), F.split("at", "/", 2)[1].alias("name"), "content", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("error")
    )
    return loose.unionByName(zipped.mapInArrow(_unzip, _FILES))


def _text(content: Column) -> Column:
    """UTF-8 text, null where it is none."""
    return F.try_validate_utf8(content.cast("string"))


def verified(files: DataFrame, schema: str = "document-bundle") -> DataFrame:
    """One row per bundle: bundle, error (null where the bundle may be read).

    The manifest must be there, be JSON and name the schema; every component it lists must be
    there, with the hash it gives, if any ("sha256:…" or bare), but for one whose hash is
    that of an empty file, as Spark lists none; and the files that a
    bundle must have. Only names and hashes are shuffled, never contents. Of several errors the first by name is told.
    """
    names = files.select("bundle", "name", "sha256", "error")
    told = names.where("error IS NOT NULL").select("bundle", "error")
    raw = files.where("name = 'manifest.json'").select("bundle", _text(F.col("content")).alias("json"))
    parsed = raw.select("bundle", "json", F.from_json("json", _MANIFEST, {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("json").isNotNull().alias("is_json"))
    bundles = names.select("bundle").distinct()
    bad = F.when(F.col("json").isNull(), "no manifest").when(~F.col("is_json"), "manifest is not JSON").when(~F.col("m.schema").eqNullSafe(schema), F.concat(F.lit("schema is "), F.coalesce("m.schema", F.lit("missing"))))
    heads = bundles.join(parsed, "bundle", "left").select("bundle", bad.alias("error")).where("error IS NOT NULL")
    listed = parsed.select("bundle", F.explode("m.components").alias("c")).select("bundle", F.col("c.file").alias("name"), F.col("c.hash").alias("hash"))
    met = listed.join(names.where("name IS NOT NULL").select("bundle", "name", "sha256"), ["bundle", "name"], "left")
    wrong = F.when(F.col("sha256").isNull() & F.coalesce("hash", F.lit("")).endswith(EMPTY), None).when(F.col("sha256").isNull(), F.concat(F.lit("missing component "), "name")).when(
        (F.coalesce("hash", F.lit("")) != "") & ~F.col("hash").endswith(F.col("sha256")), F.concat(F.lit("hash mismatch of "), "name")
    )
    parts = met.select("bundle", wrong.alias("error")).where("error IS NOT NULL")
    have = names.where(F.col("name").isin(*NEEDED)).groupBy("bundle").agg(F.collect_set("name").alias("have"))  # as many as NEEDED
    lack = bundles.join(have, "bundle", "left").select("bundle", F.explode(F.array_except(F.array(*map(F.lit, NEEDED)), F.coalesce("have", F.array().cast("array<string>")))).alias("n"))
    every = told.unionByName(heads).unionByName(parts).unionByName(lack.select("bundle", F.concat(F.lit("no "), "n").alias("error")))
    rank = F.when(F.col("error").startswith("broken"), 0).when(F.col("error").rlike("^(no manifest|manifest|schema)"), 1).when(F.col("error").rlike("^(missing|hash)"), 2).otherwise(3)
    first = every.groupBy("bundle").agg(F.min(F.struct(rank.alias("r"), "error")).alias("x")).select("bundle", F.col("x.error").alias("error"))
    return bundles.join(first, "bundle", "left")


def bundle_lines(files: DataFrame, checks: DataFrame, name: str, schema: str) -> DataFrame:
    """bundle, line (1-based), the columns of `schema`, and error: a JSON-lines file of the bundles that may be read.

    A line that is no JSON object keeps its row, with nulls and an error. Blank lines
    and bundles without the file give none.
    """
    good = checks.where("error IS NULL").select("bundle")
    rows = files.where(F.col("name") == name).join(good, "bundle", "left_semi").select("bundle", F.posexplode(F.split(_text(F.col("content")), "\r\n|\n")).alias("i", "json"))
    rows = rows.where(F.trim("json") != "")
    parsed = rows.select("bundle", (F.col("i") + 1).alias("line"), F.from_json("json", schema).alias("x"), F.coalesce(F.schema_of_variant(F.try_parse_json("json")).startswith("OBJECT"), F.lit(False)).alias("ok"))
    return parsed.select("bundle", "line", "x.*", F.when(~F.col("ok"), "not a JSON object").alias("error"))


def bundle_document(files: DataFrame, checks: DataFrame, schema: str, name: str = "document.json") -> DataFrame:
    """bundle, the columns of `schema`, error: a JSON file of each bundle that may be read."""
    good = checks.where("error IS NULL").select("bundle")
    rows = files.where(F.col("name") == name).join(good, "bundle", "left_semi").select("bundle", _text(F.col("content")).alias("json"))
    return rows.select("bundle", F.from_json("json", schema).alias("x"), F.try_parse_json("json").isNull().alias("bad")).select("bundle", "x.*", F.when(F.col("bad"), "not JSON").alias("error"))


def model_bundles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """standard, plane, file, the bundle's columns of `schema`, error: the bundles that index.json lists, each read from its own file.

    index.json has plane and standards, a list of {file}. A listed file that is not there or is no
    JSON object gives a row with an error; of two that name one standard the last listed stays.
    """
    index = spark.read.schema("plane string, standards array<struct<file: string>>").option("multiLine", "true").json(f"{folder}/index.json")
    listed = index.select("plane", F.posexplode("standards").alias("place", "s")).select("plane", "place", F.col("s.file").alias("file"))
    texts = _binary(spark, folder).select(_relative(F.col("path"), folder).alias("file"), _text(F.col("content")).alias("json")).where("file <> 'index.json'")
    found = listed.join(texts, "file", "left")
    error = F.when(F.col("json").isNull(), "missing or not UTF-8").when(F.try_parse_json("json").isNull(), "not JSON").when(F.get_json_object("json", "$.standard").isNull(), "no standard")
    rows = found.select(F.get_json_object("json", "$.standard").alias("standard"), "plane", "file", "place", F.from_json("json", schema).alias("x"), error.alias("error"))
    last = rows.where("error IS NULL").groupBy("standard").agg(F.max("place").alias("place"))
    kept = rows.where("error IS NOT NULL").unionByName(rows.where("error IS NULL").join(last, ["standard", "place"], "left_semi").select(rows.columns))
    return kept.select("standard", "plane", "file", "x.*", "error")


def corpus(spark: SparkSession, folder: str, collections: bool = True, name: str = "document.adoc") -> DataFrame:
    """slug, title, attributes (a map), text, error: the documents of a folder of AsciiDoc sources.

    A document is a sub-folder with document.adoc. A sub-folder without one is a
    collection: with `collections`, its own sub-folders but `templates` are its
    parts, slug `collection/part`. Names that begin with a dot are left out. A file
    that is no UTF-8 keeps its row, with an error and nulls, and stops nothing. An
    empty file is no document: Spark's scan does not list it.
    """
    rows = _binary(spark, folder).select(_relative(F.col("path"), folder).alias("at"), "content").where(F.col("at").rlike(rf"^[^./][^/]*(/[^./][^/]*)?/\Q{name}\E$"))
    rows = rows.select(F.split("at", "/").alias("p"), "content").select(
        F.col("p")[0].alias("root"), F.when(F.size("p") == 3, F.col("p")[1]).alias("part"), _text(F.col("content")).alias("text")
    )
    whole = rows.where("part IS NULL")
    parts = rows.where("part IS NOT NULL AND part <> 'templates'").join(whole.select("root"), "root", "left_anti").select(rows.columns) if collections else rows.limit(0)
    text = F.col("text")
    return whole.unionByName(parts).select(
        F.concat_ws("/", "root", "part").alias("slug"), asciidoc.title(text).alias("title"), asciidoc.attributes(text).alias("attributes"), "text", F.when(text.isNull(), "not UTF-8").alias("error")
    )
