"""Scans of bundles and corpora on fixtures with broken and forged ones."""

import hashlib
import json
import zipfile

import pytest

from clauseq.sources import bundles


def parts(n, bad_line=False):
    units = [json.dumps({"id": f"u{i}", "kind": "clause", "text": f"é {i}"}) for i in range(n)] + (["", "{broken", "[1]", "7"] if bad_line else [])
    return {
        "document.json": json.dumps({"ids": {"canonical": f"doc-{n}"}}).encode(), "units.jsonl": "\n".join(units).encode() + b"\n", "edges.jsonl": b"",
        "glossary.json": b'{"concepts": []}', "assets/pic 1+2.bin": bytes(range(256)) * n,
    }


def manifest(files, schema="document-bundle", **change):
    listed = [{"file": k, "hash": "sha256:" + hashlib.sha256(v).hexdigest()} for k, v in files.items()]
    return json.dumps({"schema": schema, "components": listed} | change).encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in put")

    def loose(name, files):
        for k, v in files.items():
            (root / name / k).parent.mkdir(parents=True, exist_ok=True)
            (root / name / k).write_bytes(v)

    def zipped(name, files):
        with zipfile.ZipFile(root / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in files.items():
                z.writestr(k, v)

    good = parts(3, bad_line=True)
    loose("good", good | {"manifest.json": manifest(good)})
    zipped("zipped", parts(5) | {"manifest.json": manifest(parts(5))})
    forged = parts(4) | {"manifest.json": manifest(parts(4))}
    zipped("forged", forged | {"units.jsonl": b'{"id": "evil"}\n'})
    loose("forged2", forged | {"assets/pic 1+2.bin": b"other"})
    loose("lacking", {k: v for k, v in forged.items() if not k.startswith("assets")})
    loose("schema", parts(1) | {"manifest.json": manifest(parts(1), "other")})
    loose("nomanifest", parts(1))
    loose("notjson", parts(1) | {"manifest.json": b"{oops"})
    loose("noglossary", {k: v for k, v in parts(1).items() if k != "glossary.json"} | {"manifest.json": manifest({})})
    loose("nohash", parts(2) | {"manifest.json": json.dumps({"schema": "document-bundle", "components": [{"file": "units.jsonl"}]}).encode()})
    (root / "torn.zip").write_bytes((root / "zipped.zip").read_bytes()[:300])
    data = bytearray((root / "zipped.zip").read_bytes())
    data[60] ^= 0xFF
    (root / "rotten.zip").write_bytes(bytes(data))
    loose(".hidden", parts(1))
    return str(root)


def test_bundles_are_verified(spark, folder):
    files = bundles.bundle_files(spark, folder)
    checks = bundles.verified(files)
    got = {r["bundle"]: r["error"] for r in checks.collect()}
    rotten, torn = got.pop("rotten"), got.pop("torn")
    assert rotten.startswith("broken archive") and torn.startswith("broken archive")
    assert got == {
        "good": None, "zipped": None, "nohash": None, "forged": "hash mismatch of units.jsonl", "forged2": "hash mismatch of assets/pic 1+2.bin", "lacking": "missing component assets/pic 1+2.bin",
        "schema": "schema is other", "nomanifest": "no manifest", "notjson": "manifest is not JSON", "noglossary": "no glossary.json",
    }
    units = bundles.bundle_lines(files, checks, "units.jsonl", "id string, kind string, text string").collect()
    want = [("good", i + 1, f"u{i}", None) for i in range(3)] + [("good", i, None, "not a JSON object") for i in (5, 6, 7)]
    want += [("zipped", i + 1, f"u{i}", None) for i in range(5)] + [("nohash", i + 1, f"u{i}", None) for i in range(2)]
    assert sorted(str((r["bundle"], r["line"], r["id"], r["error"])) for r in units) == sorted(map(str, want))
    docs = bundles.bundle_document(files, checks, "ids struct<canonical: string>").collect()
    assert sorted((r["bundle"], r["ids"]["canonical"], r["error"]) for r in docs) == [("good", "doc-3", None), ("nohash", "doc-2", None), ("zipped", "doc-5", None)]


def test_model_bundles(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "index.json").write_text(json.dumps({"plane": "p1", "standards": [{"file": f"b/{x}.json"} for x in ("one", "two", "gone", "bad", "twin", "bare")]}, indent=1))
    for name, body in (("one", {"standard": "S1", "nodes": [1]}), ("two", {"standard": "S2", "nodes": []}), ("twin", {"standard": "S2", "nodes": [7]}), ("bare", {"nodes": [1]}), ("unlisted", {"standard": "S9"})):
        (tmp_path / "b" / f"{name}.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "b" / "bad.json").write_bytes(b"\xff{")
    got = bundles.model_bundles(spark, str(tmp_path), "nodes array<int>").collect()
    assert sorted((r["file"], r["standard"], r["plane"], r["nodes"] if not r["error"] else None, r["error"]) for r in got) == [
        ("b/bad.json", None, "p1", None, "missing or not UTF-8"), ("b/bare.json", None, "p1", None, "no standard"), ("b/gone.json", None, "p1", None, "missing or not UTF-8"),
        ("b/one.json", "S1", "p1", [1], None), ("b/twin.json", "S2", "p1", [7], None),
    ]


def test_corpus_with_collections_and_bad_documents(spark, tmp_path):
    for path, text in {
        "r060/document.adoc": "= Title\n:docidentifier: X 1\n\nbody", "r060/part/document.adoc": "= not a part", "coll/p1/document.adoc": "= One\n:Edition: 2001\n\n", "coll/templates/document.adoc": "= no",
        "coll/.git/document.adoc": "= no", ".hid/document.adoc": "= no", "other/readme.adoc": "= no", "bad/document.adoc": b"\xff\xfe", "empty/document.adoc": "", "a/b/c/document.adoc": "= deep",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    got = {r["slug"]: (r["title"], r["attributes"], r["error"]) for r in bundles.corpus(spark, str(tmp_path)).collect()}
    assert got == {"r060": ("Title", {"docidentifier": "X 1"}, None), "coll/p1": ("One", {"edition": "2001"}, None), "bad": (None, None, "not UTF-8")}
    assert set(r["slug"] for r in bundles.corpus(spark, str(tmp_path), False).collect()) == {"r060", "bad"}
