"""Generations: a writer that stops anywhere, two writers at once, changes that write little, and what is cleared away."""

import threading

import pytest
from pyspark.sql import functions as F

from seekframe.engine import Engine
from seekframe.operators import index, store
from seekframe.operators.store import Change, Conflict, Snapshots
from seekframe.sources import importers
from seekframe.streaming.follow import follow

ROWS = "path string, n int"
VERSION = "project string, path string, language string, category string, size long, hash string, tokens int, content string, version int"


def read(snapshots, name="t"):
    return sorted(tuple(r) for r in snapshots.read(name).collect())


def step(snapshots, spark, n):
    return snapshots.publish({"t": spark.createDataFrame([(f"p{i}", n) for i in range(20)], ROWS)}, base=snapshots.view())


@pytest.mark.parametrize("at", ["write", "list", "aside", "link", "after"])
def test_stopped_writer(spark, tmp_path, monkeypatch, at):
    """Whichever step a writer stops before, readers see the generation before or the new one."""
    snapshots = Snapshots(spark, str(tmp_path / "s"))
    step(snapshots, spark, 1)

    class Stopped(BaseException):  # like a killed process: nothing is cleared up
        pass

    def stop(*args, **kw):
        raise Stopped

    broken = Snapshots(spark, snapshots.root)
    if at == "write":
        monkeypatch.setattr(broken, "_written", stop)
    elif at == "list":
        names = broken._names
        monkeypatch.setattr(broken, "_names", lambda folder: stop() if folder.startswith("data") else names(folder))
    elif at == "aside":
        monkeypatch.setattr(broken, "_create", stop)
    elif at == "link":
        monkeypatch.setattr(store.os, "link", stop)
    else:
        monkeypatch.setattr(broken, "vacuum", stop)
    with pytest.raises(Stopped):
        broken.transact(lambda view: ({"t": spark.createDataFrame([(f"p{i}", 2) for i in range(20)], ROWS)}, {}))
    monkeypatch.undo()
    assert {n for _, n in read(snapshots)} == ({2} if at == "after" else {1})
    assert step(snapshots, spark, 3) == (3 if at == "after" else 2) and {n for _, n in read(snapshots)} == {3}
    snapshots.vacuum(keep=1)
    assert len(snapshots._names("data")) == 1 and read(snapshots)[0] == ("p0", 3)


def test_two_writers(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "s"))
    step(snapshots, spark, 0)
    base = snapshots.view()
    step(snapshots, spark, 1)
    with pytest.raises(Conflict):
        snapshots.publish({"t": spark.createDataFrame([("late", 9)], ROWS)}, base=base)
    assert len(read(snapshots)) == 20 and snapshots.view(base.generation).read("t").first()["n"] == 0

    def add(who):
        def change(view):
            row = spark.createDataFrame([(who, 1)], ROWS)
            return {"t": Change(row.select("path"), row)}, {}

        Snapshots(spark, snapshots.root).transact(change)

    threads = [threading.Thread(target=add, args=(f"w{n}",)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {p for p, _ in read(snapshots)} == {f"p{i}" for i in range(20)} | {f"w{n}" for n in range(4)}
    assert snapshots.view().generation == 6


def test_bytes_follow_the_change(spark, tmp_path):
    """A change of two files writes their buckets, in every table, and leaves the others' folders."""
    snapshots = Snapshots(spark, str(tmp_path / "s"))
    rows = spark.range(4000).select(F.format_string("f%05d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 512).alias("x"), F.lit(1).alias("n"))
    snapshots.publish({"t": rows, "same": rows}, buckets=64)
    first = snapshots.view()
    change = rows.where("path in ('f00007', 'f00100')").withColumn("n", F.lit(2))
    gone = spark.createDataFrame([("f00009",)], "path string")
    snapshots.publish({"t": Change(gone, change)}, base=first)
    with_change = snapshots.view()
    parts = lambda v, name: set(v.pointer["tables"][name]["parts"].values())
    assert parts(first, "same") == parts(with_change, "same")
    assert 1 <= len(parts(with_change, "t") - parts(first, "t")) <= 3
    size = lambda v: sum(f.stat().st_size for p in parts(v, "t") - (parts(first, "t") if v is with_change else set()) for f in (tmp_path / "s" / p).rglob("*.parquet"))
    assert size(with_change) * 10 < size(first)
    # rows of a change replace nothing but the paths that it names
    assert snapshots.read("t").count() == 4001 and snapshots.read("t").where("path = 'f00009'").isEmpty()
    assert first.read("t").count() == 4000
    everything = snapshots.publish({"t": Change(rows.select("path"), rows.limit(0))}, base=with_change)
    assert snapshots.read("t").count() == 0 and everything == 3 and snapshots.read("t").columns == ["path", "x", "n"]


def test_search_after_follow(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.md").write_text("orchard compass")
    (root / "B.java").write_text("class Harbour { void sail() {} }")
    engine = Engine(spark, str(tmp_path / "home"))
    engine.add("p", str(root))
    engine.index("p")
    told = {"fingerprint": "f", "provider": "p", "model": "m", "dimensions": 2, "profile": "c", "version": 1}
    engine.index_vectors("p", spark.createDataFrame([("a.md", [1.0, 0.0])], "path string, v array<double>"), told)
    row = lambda path, body, v: ("p", path, "java" if path.endswith("java") else "markdown", "SOURCE", len(body), body, 3, body, v)
    spark.createDataFrame([row("C.java", "class Compass { }", 1), row("B.java", "class Lighthouse { }", 1)], VERSION).write.parquet(str(tmp_path / "in"))
    engine.follow("p", spark.readStream.schema(VERSION).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert {r["path"] for r in engine.search("p", {1: "compass"}).collect()} == {"a.md", "C.java"}
    assert {r["path"] for r in engine.search("p", {1: "lighthouse"}).collect()} == {"B.java"} and engine.search("p", {1: "harbour"}).isEmpty()
    assert {r["name"] for r in engine.table("p", "symbols").where("path like '%java'").collect()} == {"Compass", "Lighthouse"}
    near = engine.search("p", {1: "nothing"}, vectors={1: [1.0, 0.0]}, provenance=told).collect()
    assert [r["path"] for r in near] == ["a.md"]


def test_stream_keeps_derived_tables(spark, tmp_path):
    """What a stream leaves equals an index of the files as they are."""
    source, snapshots = str(tmp_path / "in"), Snapshots(spark, str(tmp_path / "s"))
    row = lambda path, hash_, body, v: ("p", path, "java", "SOURCE", 9, hash_, 3, body, v)

    def run(rows):
        spark.createDataFrame(rows, VERSION).write.mode("append").parquet(source)
        follow(spark.readStream.schema(VERSION).parquet(source), snapshots, importers.analyse_java, str(tmp_path / "c")).awaitTermination()

    run([row("A.java", "1", "class A { int x; }", 1), row("B.java", "1", "class B {}", 1)])
    run([row("A.java", "2", "class Z {}", 2), row("C.java", "1", "class C {}", 1)])
    files, symbols = snapshots.read("files"), snapshots.read("symbols")
    whole = index.terms(files, symbols, None, None, snapshots.view().buckets("files"))
    for name, rows in whole.items():  # of every stored table
        assert read(snapshots, name) == sorted(tuple(r) for r in rows.select(snapshots.read(name).columns).collect())


def test_registry_of_two_writers(spark, tmp_path):
    one, two = (Engine(spark, str(tmp_path / "home")) for _ in range(2))
    one.add("a", "/a")
    two.add("b", "/b")
    assert {r[1] for r in one._rows()} == {"a", "b"}
    with pytest.raises(ValueError):
        two.add("c", "/a")


def test_fingerprint_by_ranges(spark):
    """One digest a project, whatever the order and partitioning; every column of a file counts, and so does a file's name."""
    rows = [("p", f"src/{i}.py", f"h{i}", "python", "SOURCE") for i in range(3000)]
    schema = "project string, path string, hash string, language string, category string"
    told = lambda rows, n=3: {r[0]: r[1] for r in index.fingerprint(spark.createDataFrame(rows, schema).repartition(n)).collect()}
    first = told(rows)
    assert set(first) == {"p"} and len(first["p"]) == 64 and told(rows[::-1], 7) == first
    seen = {first["p"]}
    for at, new in enumerate([("src/x.py",), ("src/7.py", "other"), ("src/7.py", "h7", "java"), ("src/7.py", "h7", "python", "TEST")]):
        changed = [*rows[:7], ("p", *new, *rows[7][1 + len(new) :]), *rows[8:]]
        seen.add(told(changed)["p"])
        assert len(seen) == at + 2
    assert told(rows[:-1])["p"] not in seen and told([]) == {}
    assert told([*rows, *[("q", *r[1:]) for r in rows]]) == {"p": first["p"], "q": first["p"]}
