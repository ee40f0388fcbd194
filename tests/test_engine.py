"""The engine end to end on a small project, the command line, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from seekframe import __main__
from seekframe.engine import Engine, NotReady
from seekframe.operators.index import Snapshots
from seekframe.sources import importers, scan
from seekframe.streaming.follow import follow

FILES = {
    "src/main/PdfUploadService.java": "package app;\nimport store.PdfRepository;\npublic class PdfUploadService {\n  public void upload(String name) { new PdfRepository().save(name); }\n}\n",
    "src/main/PdfRepository.java": "package store;\npublic class PdfRepository {\n  public void save(String name) { }\n}\n",
    "src/main/HealthController.java": "package web;\npublic class HealthController {\n  public String health() { return null; }\n}\n",
    "AGENTS.md": "Always write tests.\n",
    ".claude/skills/pdf-upload/SKILL.md": "---\nname: pdf-upload\ndescription: How to upload a PDF\n---\nSteps.\n",
    "docs/guide.md": "# Upload guide\nHow an upload of a PDF works.\n",
}


def write(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    write(base / "one", FILES)
    write(base / "two", {"PdfUpload.java": "package b;\nclass PdfUpload { void upload(String name) {} }\n"})
    out = Engine(spark, str(base / "home"))
    out.add("One", str(base / "one"))
    out.add("Two", str(base / "two"))
    with pytest.raises(NotReady):
        out.inspect("one")
    assert out.index("one")["changed"] == 6 and out.index("ONE")["changed"] == 0
    out.index("two")
    return out


def test_golden_queries(engine):
    queries = {1: "PdfUploadService upload", 2: "PdfRepository save", 3: "HealthController health"}
    relevant = {1: "src/main/PdfUploadService.java", 2: "src/main/PdfRepository.java", 3: "src/main/HealthController.java"}
    rows = engine.search("one", queries, 20).collect()
    for q, path in relevant.items():
        paths = list(dict.fromkeys(r["path"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])))
        assert path in paths[:3], paths
    assert not any(r["path"] in ("AGENTS.md", ".claude/skills/pdf-upload/SKILL.md") for r in rows)
    graph = [r for r in rows if r["query_id"] == 1 and r["path"] == "src/main/PdfRepository.java"]
    assert any("graph=" in r["explanation"] for r in graph)


def test_symbols_usages_and_counts(engine):
    assert engine.find_symbols("one", "pdfrepository", 5).orderBy("place").first()["name"] == "PdfRepository"
    assert [r["target"] for r in engine.find_usages("one", "PdfRepository").collect()] == ["store.PdfRepository"]
    assert tuple(engine.inspect("one").first()) == (6, 6, 1)
    with pytest.raises(ValueError):
        engine.search("one", {1: "x"}, 501)
    with pytest.raises(ValueError):
        engine.resolve("three")


def test_federated(engine):
    rows = engine.search_federated(["one", "two", "One"], {1: "upload"}, 5).orderBy("place").collect()
    assert {r["project"] for r in rows} == {"One", "Two"} and len({(r["project"], r["path"]) for r in rows}) == len(rows)


def test_context(engine):
    rows = engine.context("one", "pdf upload", 400).collect()
    parts = {r["part"]: {x["path"] for x in rows if x["part"] == r["part"]} for r in rows}
    assert parts["instructions"] == {"AGENTS.md"} and parts["skills"] == {".claude/skills/pdf-upload/SKILL.md"}
    assert "src/main/PdfUploadService.java" in parts["tasks"] and "AGENTS.md" not in parts["tasks"]
    assert sum(r["tokens"] for r in rows) <= 400


def test_vectors_and_fusion(engine, spark):
    vectors = spark.createDataFrame([("docs/guide.md", [1.0, 0.0]), ("src/main/HealthController.java", [0.0, 1.0]), ("nowhere", [1.0, 1.0]), ("AGENTS.md", [1.0, 0.0])], "path string, v array<double>")
    told = {"fingerprint": "f", "provider": "p", "model": "m", "dimensions": 2, "profile": "c", "version": 1}
    generation = engine.index_vectors("one", vectors, told)
    assert engine.table("one", "vectors").count() == 3 and engine.table("one", "postings").count() > 0
    ask = lambda **kw: {r["path"]: r["explanation"] for r in engine.search("one", {1: "save"}, 20, vectors={1: [1.0, 0.1]}, **kw).collect()}
    assert "semantic=" in ask(provenance=told)["docs/guide.md"] and "AGENTS.md" not in ask(provenance=told)
    assert "docs/guide.md" not in ask(provenance=told | {"model": "other"})
    fused = engine.search("one", {1: "save"}, 20, vectors={1: [1.0, 0.1]}, provenance=told, fuse=8.0).orderBy("rank").collect()
    assert fused[0]["path"] == "docs/guide.md" and "semantic_rank=1" in fused[0]["explanation"]
    assert engine.index_vectors("one", vectors.where("path = 'docs/guide.md'").withColumn("v", F.array(F.lit(0.0), F.lit(1.0))), told) == generation + 1
    assert {r["path"]: r["v"] for r in engine.table("one", "vectors").collect()}["docs/guide.md"] == [0.0, 1.0] and engine.table("one", "vectors").count() == 3


def test_federated_context_in_engine(engine):
    items, shares = engine.context_federated(["one", "two", "ONE"], "pdf upload", 400)
    got = items.collect()
    assert {r["project"] for r in got} == {"One", "Two"} and sum(r["tokens"] for r in got) <= 400
    assert sorted(r["place"] for r in got) == list(range(1, len(got) + 1)) and all(r["content"] is not None for r in got)
    assert {r["project"]: (r["tokens"], r["starved"]) for r in shares.collect()} == {p: (sum(r["tokens"] for r in got if r["project"] == p), False) for p in ("One", "Two")}


def test_stored_terms_follow_the_files(spark, tmp_path):
    """The lexical index after changes equals one of all files."""
    from seekframe.operators import index, lexical

    root = tmp_path / "src"
    write(root, {"a.md": "orchard compass", "b.md": "orchard", "C.java": "class Compass {}"})
    engine = Engine(spark, str(tmp_path / "home"))
    engine.add("p", str(root))
    engine.index("p")
    write(root, {"a.md": "harbour", "d.md": "compass"})
    (root / "b.md").unlink()
    assert engine.index("p")["changed"] == 2
    windows = index.WINDOWS * engine._snapshots(engine.resolve("p")[0]).view().buckets("files")
    fields, postings = lexical.build(lexical.named(engine.table("p", "files"), engine.table("p", "symbols")), windows)
    blocks = sorted(map(str, lexical.blocks(postings).collect()))
    assert blocks == sorted(map(str, engine.table("p", "blocks").select(lexical.blocks(postings).columns).collect()))
    for name, rows in (("fields", fields), ("postings", postings)):
        order = rows.columns
        assert sorted(map(tuple, engine.table("p", name).select(order).collect())) == sorted(map(tuple, rows.collect()))
    assert {r["path"] for r in engine.search("p", {1: "compass"}).collect()} == {"C.java", "d.md"}
    assert [r["path"] for r in engine.files("p").collect()] == ["C.java", "a.md", "d.md"]
    assert tuple(engine.health().first()) == (1, False, True)


def test_imports(engine, spark, tmp_path):
    root = engine.resolve("one")[2]
    body = {"contractVersion": "1", "producer": "x", "project": {"rootPath": root}, "symbols": [{"resolutionStatus": "RESOLVED", "kind": "CLASS", "name": "Zebra", "filePath": "docs/guide.md", "startLine": 1, "endLine": 1}], "relations": []}
    (tmp_path / "s.json").write_text(json.dumps(body))
    engine.import_json("one", str(tmp_path / "s.json"), "ext")
    assert engine.search("one", {1: "zebra"}).first()["path"] == "docs/guide.md"
    assert __main__.main(["--home", engine.home, "import-json", "one", str(tmp_path / "none.json"), "ext"]) != 0
    (tmp_path / "odd [1]{a}*.json").write_text(json.dumps(body))
    engine.import_json("one", str(tmp_path / "odd [1]{a}*.json"), "ext")  # a name, not a pattern
    (tmp_path / "link.json").symlink_to(tmp_path / "s.json")
    for take in (engine.import_json, engine.import_index):
        for bad in ("link.json", "*.json", "none.json", "."):
            with pytest.raises(ValueError, match="file"):
                take("one", str(tmp_path / bad), "ext")
    with pytest.raises(ValueError, match="too large"):
        scan.plain_file(spark, str(tmp_path / "s.json"), 10)
    engine.replace_provider("one", "ext", spark.createDataFrame([], importers.SYMBOLS), spark.createDataFrame([], importers.RELATIONS))
    assert engine.search("one", {1: "zebra"}).isEmpty()


def test_instructions_in_context(spark, tmp_path):
    write(tmp_path / "r", {
        "AGENTS.md": "Read @docs/style.md first.", "docs/style.md": "Short lines.", "src/Upload.java": "class Upload {}",
        ".github/instructions/java.instructions.md": "---\napplyTo: '**/*.java'\n---\nUse records.", ".github/instructions/py.instructions.md": "---\napplyTo: '**/*.py'\n---\nUse types.",
        ".claude/skills/upload/SKILL.md": "---\nname: wrong\ndescription: upload\n---\n",
    })
    engine = Engine(spark, str(tmp_path / "home"))
    engine.add("r", str(tmp_path / "r"))
    engine.index("r")
    registry = spark.createDataFrame([("upload", "How to upload", "registry/upload", "Steps.")], "name string, description string, path string, content string")
    got = engine.context("r", "upload", 2000, registry=registry).collect()
    paths = lambda part: {r["path"] for r in got if r["part"] == part}
    assert paths("instructions") == {"AGENTS.md", "docs/style.md", ".github/instructions/java.instructions.md"}
    assert paths("skills") == {"registry/upload"} and "src/Upload.java" in paths("tasks") and "docs/style.md" not in paths("tasks")
    assert {r["content"] for r in got if r["path"] == "docs/style.md"} == {"Short lines."}


def test_history_in_context(engine, spark):
    upload, store = "src/main/PdfUploadService.java", "src/main/PdfRepository.java"
    changes = spark.createDataFrame([(1, 1, upload, "first"), (1, 1, "pom.xml", "first"), (2, 2, store, "second")], "commit int, at int, path string, message string")
    rows = engine.context("one", "pdf upload", 1000, changes=changes).collect()
    past = {r["path"] for r in rows if r["part"] == "history"}
    assert past == {"recent", "history", "together"} and sum(r["tokens"] for r in rows) <= 1000


def test_provider(engine, spark):
    s = spark.createDataFrame([("docs/guide.md", "TYPE", "Guide", "x.Guide", "", 1, 1, "ext"), ("nowhere", "TYPE", "No", "x.No", "", 1, 1, "ext")], importers.SYMBOLS)
    r = spark.createDataFrame([], importers.RELATIONS)
    first = engine.replace_provider("one", "ext", s, r)
    assert engine.replace_provider("one", "ext", s, r) == first
    assert engine.table("one", "symbols").where("provider = 'ext'").count() == 1
    engine.replace_provider("one", "ext", s.limit(0), r)


def test_command_line(engine, capsys):
    assert __main__.main(["--home", engine.home, "--json", "search", "one", "health controller", "--limit", "3"]) == 0
    assert "Health" in json.loads(capsys.readouterr().out.splitlines()[0])["path"]
    assert __main__.main(["--home", engine.home, "search", "none", "x"]) == 1


def test_stream(spark, tmp_path):
    schema = "project string, path string, language string, category string, size long, hash string, tokens int, content string, version int"
    row = lambda path, hash_, body, v: ("p", path, "java", "SOURCE", 9, hash_, 3, body, v)
    source = str(tmp_path / "in")
    snapshots = Snapshots(spark, str(tmp_path / "index"))

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        query = follow(spark.readStream.schema(schema).parquet(source), snapshots, importers.analyse_java, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    run([row("A.java", "1", "class A {}", 1), row("A.java", "2", "class B {}", 2)])
    assert [r["name"] for r in snapshots.read("symbols").collect()] == ["B"]
    run([row("C.java", "3", "class C {}", 3)])
    assert sorted(r["name"] for r in snapshots.read("symbols").collect()) == ["B", "C"] and snapshots.current()["generation"] == 2
