"""Operators on small literals with known results."""

import pytest
from pyspark.sql import functions as F

from seekframe.operators import budget, evaluate, fragments, graph, index, lexical, rank, recency, semantic, symbols
from seekframe.sources import importers, instructions, scan, skills


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_terms_are_needed(spark):
    files = spark.createDataFrame([("p", "orchard-only.md", "orchard orchard orchard filler"), ("p", "compass-guide.md", "an orchard and a compass")], "project string, path string, content string")
    ask = lambda q: [r["path"] for r in lexical.scores(files, spark.createDataFrame([(1, q)], "query_id int, query string")).collect()]
    assert ask("orchard-compass") == ["compass-guide.md"]
    assert sorted(ask("orchard")) == ["compass-guide.md", "orchard-only.md"]
    assert ask("absent") == [] and ask(" - ") == []


def test_index_of_all_terms(spark):
    files = spark.createDataFrame([("p", "a.md", "orchard compass"), ("p", "b.md", "fooBar orchard"), ("q", "c.md", "compass")], "project string, path string, content string")
    queries = spark.createDataFrame([(1, "orchard"), (2, "compass bar")], "query_id int, query string")
    once = lexical.scores(files, queries)
    fields, postings = lexical.build(files)
    assert rows(lexical.search(fields, postings, queries)) == rows(once) != []
    assert ("q", "c.md", "content", 1, "compass", 1, 0) in rows(postings) and len(rows(fields)) == 9
    counted = spark.createDataFrame([("p", "x.md", "b a b, A b")], "project string, path string, content string")
    assert [(r["term"], r["tf"]) for r in lexical.build(counted)[1].where("field = 'content'").orderBy("term").collect()] == [("a", 2), ("b", 3)]


def test_eligible_candidates(spark):
    """Of twice the limit, those that take part; scores are over the best of them."""
    hits = spark.createDataFrame([(1, "p", f"f{n}", 9.0 - n) for n in range(6)], "query_id int, project string, path string, score double")
    queries = spark.createDataFrame([(1, "f3 f3 x")], "query_id int, query string")
    some = spark.createDataFrame([("f1",), ("f3",), ("f5",)], "path string")
    got = {r["path"]: (round(r["lexical"], 6), round(r["path_signal"], 6)) for r in lexical.candidates(hits, queries, 2, some).collect()}
    assert got == {"f1": (1.0, 0.0), "f3": (0.75, 0.666667)}


def test_symbols(spark):
    known = spark.createDataFrame([("a", "saveAll", "x.Repo.saveAll", 1, "b"), ("b", "save", "x.Repo.save", 2, "b"), ("c", "other", "x.Other", 3, "b")], "path string, name string, qualified string, start_line int, provider string")
    assert [r["path"] for r in symbols.find(known, ["save"], 5).orderBy("place").collect()] == ["b", "a"]
    assert [r["path"] for r in symbols.scored(known, ["save"], 100, 5).orderBy("place").collect()] == ["b", "a"]


def test_neighbourhood(spark):
    owners = spark.createDataFrame([("demo.App", "App"), ("demo.Dependency", "Dependency"), ("demo.Caller", "Caller")], "qualified string, owner string")
    refs = spark.createDataFrame([("App", "demo.Dependency.Inner"), ("Caller", "demo.App"), ("Unrelated", "demo.Dependency"), ("App", "java.util.List")], "source string, target string")
    edges = graph.longest_owner(refs, owners, ["source", "target"]).select(F.col("source").alias("src"), F.col("owner").alias("dst"))
    assert rows(graph.neighbours(edges, ["App"], 10)) == [("App", "Caller"), ("App", "Dependency")]
    assert rows(graph.neighbours(edges, ["App"], 1)) == [("App", "Dependency")]
    seeds = spark.createDataFrame([("App", 1.0)], "path string, score double")
    known = spark.createDataFrame([("Dependency",), ("Unrelated",), ("App",)], "path string")
    assert {r["path"]: round(r["graph"], 6) for r in graph.spread(seeds, edges, known).collect()} == {"Dependency": 0.65, "Unrelated": 0.35, "App": 0.35}
    # one edge a hop: the outgoing one, and back
    assert {r["path"]: round(r["graph"], 6) for r in graph.spread(seeds, edges.union(edges), known, budget=1).collect()} == {"Dependency": 0.65, "App": 0.35}


def test_closure_of_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")], "src string, dst string")
    assert rows(graph.closure(edges, ["a", "z"], 4)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("a", "f", 4)]


def test_recency_positions(spark):
    log = spark.createDataFrame([(i, i) for i in range(60)], "commit int, at int")
    changes = spark.createDataFrame([(59, "new"), (58, "root"), (10, "old"), (1, "gone")], "commit int, path string")
    got = {r["path"]: round(r["recency"], 6) for r in recency.scores(log, changes, F.col("commit") == 58).collect()}
    assert got == {"new": 1.0, "old": 0.05}


def test_history_fragments(spark):
    log = spark.createDataFrame([(1, 1, "a", "one"), (1, 1, "b", "one"), (2, 2, "a", "two"), (3, 3, "b", "three"), (3, 3, "a", "three")], "commit int, at int, path string, message string")
    diffs = spark.createDataFrame([("staged", "x" * 9000), ("working", "")], "zone string, content string")
    got = {r["kind"]: r for r in recency.fragments(log, ["a"], diffs).collect()}
    assert got["recent"]["content"] == "3 three\n2 two\n1 one" and got["recent"]["score"] == 0.78
    assert got["history"]["content"].splitlines() == ["a 3 three", "a 2 two", "a 1 one"]
    assert got["together"]["content"] == "b 2" and len(got["diff"]["content"]) == 6007


def test_vectors(spark):
    nan = float("nan")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 2.0]), (6, [1.0])], "id int, v array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, q array<double>")
    assert [(r["id"], r["score"]) for r in semantic.nearest(v, q, 5).orderBy("rank").collect()] == [(1, 1.0), (5, 0.5)]


def _candidate(spark, **signals):
    names = ", ".join(f"{s} double" for s in signals)
    return rank.with_signals(spark.createDataFrame([(1, "file:a", "FILE", "a", None, 0, *signals.values())], f"query_id int, id string, type string, path string, symbol string, arrival int, {names}"))


@pytest.mark.parametrize(
    ("signals", "score"), [({"semantic": 0.8}, 0.12), ({"lexical": 0.75, "path_signal": 0.5}, 0.35), ({"lexical": 0.5, "recency": 1.0}, 0.25), ({"lexical": 0.5}, 0.20)]
)
def test_weights(spark, signals, score):
    assert rank.ranked(_candidate(spark, **signals), 5).first()["score"] == pytest.approx(score)


def test_zero_scores_go(spark):
    assert rank.ranked(_candidate(spark, lexical=0.0), 5).isEmpty()


def test_merge_keeps_best_type_and_first_symbol(spark):
    data = [(1, "x", "DOCUMENTATION", "p", None, 0, 0.2), (1, "x", "FILE", "p", "s", 1, 0.7), (1, "x", "GIT", "p", "t", 2, 0.1)]
    got = rank.merge(spark.createDataFrame(data, "query_id int, id string, type string, path string, symbol string, arrival int, lexical double")).first()
    assert (got["type"], got["symbol"], got["lexical"]) == ("FILE", "s", 0.7)
    told = spark.createDataFrame([(1, "x", "FILE", "p", None, n, 0.1, e) for n, e in enumerate([None, " ", "one", "two"])], "query_id int, id string, type string, path string, symbol string, arrival int, lexical double, excerpt string")
    assert rank.merge(told).first()["excerpt"] == "one"


def test_percentiles(spark):
    import numpy as np

    data = [("a", float(x % 17)) for x in range(500)] + [("b", float(x) ** 1.5) for x in range(31)] + [("c", 4.0), ("d", None), (None, 2.0), (None, 3.0)]
    got = {r["k"]: (r["p50"], r["p95"]) for r in evaluate.percentiles(spark.createDataFrame(data, "k string, x double").repartition(3), "x", ("k",)).collect()}
    for key in ("a", "b", "c"):
        own = [x for k, x in data if k == key]
        assert got[key] == pytest.approx(tuple(np.percentile(own, [50, 95])))
    assert "d" not in got


def test_shares_and_totals(spark):
    merged = spark.createDataFrame([("a", 5), ("a", 7), ("b", 1)], "project string, tokens int")
    scope = spark.createDataFrame([("a",), ("b",), ("c",)], "project string")
    assert rows(budget.shares(merged, scope)) == [("a", 12, 2, False), ("b", 1, 1, False), ("c", 0, 0, True)]
    chosen = spark.createDataFrame([("tasks", 5, True), ("tasks", 7, False), ("skills", 2, False)], "part string, tokens int, cut boolean")
    assert rows(budget.totals(chosen)) == [("skills", 2, 1, 0), ("tasks", 12, 2, 1)]


def test_health(spark):
    of = lambda *s: tuple(index.health(spark.createDataFrame([(x,) for x in s], "status string")).first())
    assert of("READY", "READY") == (2, False, True) and of("READY", "FAILED") == (2, True, False) and of() == (0, False, False)


def test_embedding_text_and_provenance(spark):
    files = spark.createDataFrame([("a.java", "java", "x" * 20), ("b.md", "markdown", "hello")], "path string, language string, content string")
    known = spark.createDataFrame([("a.java", "Foo"), ("a.java", "Bar"), ("a.java", "Foo")], "path string, name string")
    got = {r["path"]: r["text"] for r in semantic.embedding_text(files, known, 10).collect()}
    assert got == {"a.java": "a.java\njava\nBar Foo\n" + "x" * 10, "b.md": "b.md\nmarkdown\n\nhello"}
    full = {"fingerprint": "f", "provider": "p", "model": "m", "dimensions": 3, "profile": "c", "version": 1}
    assert semantic.provenance(full)["dimensions"] == "3"
    for bad in ({"model": ""}, {"dimensions": 0}, {"version": None}):
        with pytest.raises(ValueError):
            semantic.provenance(full | bad)


def test_fusion(spark):
    data = [(1, "a", "a", "FILE", 0.9, 0.0), (1, "b", "b", "FILE", 0.5, 0.9), (1, "c", "c", "FILE", 0.0, 0.8)]
    full = rank.with_signals(spark.createDataFrame(data, "query_id int, id string, path string, type string, lexical double, semantic double"))
    got = {r["id"]: r for r in rank.fused(full, 5).collect()}
    assert got["b"]["rank"] == 1 and got["a"]["semantic_rank"] is None and got["c"]["baseline_rank"] is None
    assert got["b"]["score"] == pytest.approx((1 / 62 + 8 / 61) / (9 / 61))
    plain = full.withColumn("semantic", F.lit(0.0))
    assert [r["id"] for r in rank.fused(plain, 5).orderBy("rank").collect()] == ["a", "b"]
    for bad in (0, float("nan"), 11):
        with pytest.raises(ValueError):
            rank.fused(full, 5, bad)


def test_federation_prefers_other_paths(spark):
    data = [(1, "p", 0, 1, "src/A.java", 1.0), (1, "p", 0, 2, "src/A.java", 0.95), (1, "p", 0, 3, "src/B.java", 0.9)]
    got = rank.federated(spark.createDataFrame(data, "query_id int, project string, project_place int, rank int, path string, score double"), 2)
    assert [r["path"] for r in got.orderBy("place").collect()] == ["src/A.java", "src/B.java"]


def test_fragments_merge(spark):
    data = [("f", 1, 3, "FILE", "a", 0.4, ["x", "y"]), ("f", 3, 5, "TEST", "b", 0.3, ["y", "z"]), ("f", 7, 8, "FILE", None, 0.1, ["x"])]
    got = fragments.merged(spark.createDataFrame(data, "path string, start_line int, end_line int, type string, symbol string, score double, reasons array<string>"))
    assert rows(got) == [("f", 1, 5, "FILE", "a, b", 0.4, ["x", "y", "z"]), ("f", 7, 8, "FILE", None, 0.1, ["x"])]


def test_windows(spark):
    body = "\n".join("hit" if i in (10, 12, 30) else f"line {i}" for i in range(1, 61))
    files = spark.createDataFrame([("a", body), ("b", "none\n" * 50)], "path string, content string")
    ranges = fragments.query_windows(files, ["hit"])
    assert rows(fragments.merged_ranges(ranges)) == [("a", 5, 17), ("a", 25, 35), ("b", 1, 40)]


def test_greedy_goes_on_after_a_miss(spark):
    data = [(1, "a", 1, 1, 50, 0.9), (1, "b", 1, 1, 80, 0.8), (1, "c", 1, 1, 30, 0.7), (1, "d", 1, 1, 40, 0.6), (1, "e", 1, 1, 20, 0.5)]
    got = budget.greedy(spark.createDataFrame(data, "query_id int, path string, start_line int, end_line int, tokens int, score double"), 100)
    assert [r["path"] for r in got.orderBy("place").collect()] == ["a", "c", "e"]


def test_truncation(spark):
    """Texts of many shapes against a line by line search."""
    from test_budget_whole import estimate, truncated

    texts = ["a\nb", "\n".join(["x" * 30] * 10), "y" * 500, "", "\n\n\n", "\n" + "z" * 90, "ab\r\ncd\x0bef" * 9, "q" * 40 + "\n" + "r" * 40]
    data = [(t, k) for t in texts for k in (2, 5, 6, 12, 24, 25, 40)]
    df = spark.createDataFrame([(n, t, k) for n, (t, k) in enumerate(data)], "n int, t string, k int")
    plain = F.regexp_replace("t", budget.LINE_END, "\n")
    got = df.select("n", budget.shortened(plain, F.length(plain), F.col("k")).alias("s")).select("n", "s.*").collect()
    for r in got:
        text, lines = truncated(*data[r["n"]])
        expected = (None, 0) if text == "" and lines == 0 else (max(1, estimate(text)), lines)
        assert (r["tokens"], r["lines"]) == expected, data[r["n"]]


def test_greedy_truncating(spark):
    data = [(1, "a", 1, 100, 0.9, "\n".join(["word word word"] * 100)), (1, "b", 1, 1, 0.5, "short")]
    got = budget.greedy_truncating(spark.createDataFrame(data, "query_id int, path string, start_line int, end_line int, score double, content string"), 100)
    a, b = sorted(got.collect(), key=lambda r: r["path"])
    assert a["cut"] and a["tokens"] <= 50 and a["end_line"] < 100 and not b["cut"] and a["tokens"] + b["tokens"] <= 100


def test_federated_context(spark):
    fair = lambda p, items: [(1, p, "ab".index(p), n, "FILE", f"{p}{n}", c, t, 50) for n, (c, t) in enumerate(items)]
    schema = "query_id int, project string, project_place int, item_place int, type string, path string, content string, tokens int, fair int"
    take = lambda data: [(r["path"], r["refill"]) for r in budget.federated(spark.createDataFrame(data, schema), 100).orderBy("place").collect()]
    # b has one small item, so a goes on with what it put off
    assert take(fair("a", [("x", 40), ("y", 30)]) + fair("b", [("z", 20)])) == [("a0", False), ("b0", False), ("a1", True)]
    # the same content counts once; what was put off isn't overtaken by a smaller later item
    assert take(fair("a", [("x", 40), ("y", 60), ("w", 10)]) + fair("b", [(" x ", 40)])) == [("a0", False), ("a1", True)]


def test_quality_metrics(spark):
    ranked = spark.createDataFrame([(1, p, n + 1) for n, p in enumerate("ABCD")] + [(2, "A", 1)], "query_id int, path string, rank int")
    relevant = spark.createDataFrame([(1, "A"), (1, "C"), (1, "X")], "query_id int, path string")
    got = {r["query_id"]: r for r in evaluate.at_k(ranked, relevant, 3).collect()}
    assert got[1]["precision"] == pytest.approx(2 / 3) and got[1]["recall"] == pytest.approx(2 / 3) and got[1]["reciprocal_rank"] == 1.0
    assert got[2]["precision"] == 0 and got[2]["recall"] == 1.0 and got[2]["hit"] == 0


def test_skills(spark):
    known = spark.createDataFrame([("pdf-processing", "Extract text and data from PDF files", "a", 80), ("database-migration", "Plan schema changes", "b", 80)], "name string, description string, path string, priority int")
    queries = spark.createDataFrame([(1, "extract the data of a PDF")], "query_id int, query string")
    got = skills.select(known, queries).collect()
    assert [r["name"] for r in got] == ["pdf-processing"] and got[0]["score"] >= 0.22
    told = skills.front_matter("---\nname: pdf\ndescription: 'Reads'\n---\nbody", "pdf")
    assert told["description"] == "Reads"
    for bad in ("no matter", "---\nname: Pdf\ndescription: x\n---\n", "---\nname: pdf\n---\n"):
        with pytest.raises(ValueError):
            skills.front_matter(bad, "pdf")
    assert skills.whole_or_nothing([("a", 60), ("b", 50), ("c", 40)], 100) == ["a", "c"]


def test_instructions(spark):
    found = spark.createDataFrame([("AGENTS.md",), ("a/CLAUDE.md",), ("ab/GEMINI.md",)], "path string")
    got = instructions.applicable(found, spark.createDataFrame([("a/b/X.java",)], "path string"))
    assert rows(got.select("path", instructions.priority(F.col("path")))) == [("AGENTS.md", 74), ("a/CLAUDE.md", 83)]
    told = ["---\napplyTo: '**/*.java, src/**'\n---", "none", "---\nx: 1\napplyTo: [ \"a?.py\", 'b/*.md' ]\n---\nbody", "---\napplyTo:  \n---", "---\nx: 1\n---\napplyTo: '**'", " --- \r\n applyTo: \"**\"\r\n---"]
    text = spark.createDataFrame(list(enumerate(told)), "n int, t string")
    assert [r[1] for r in text.select("n", instructions.apply_to(F.col("t"))).orderBy("n").collect()] == [["**/*.java", "src/**"], [], ["a?.py", "b/*.md"], [], [], ["**"]]


def test_instructions_for_paths(spark):
    head = lambda p: f"---\napplyTo: \"{p}\"\n---\n"
    found = [(".github/instructions/java.instructions.md", head("**/*.java")), (".github/instructions/top.instructions.md", head("*.java, b[1].py")), (".github/instructions/no.instructions.md", "plain"), ("AGENTS.md", "plain")]
    df = spark.createDataFrame(found, "path string, content string")
    kept = lambda *targets: [p.split("/")[-1].split(".")[0] for p, in rows(instructions.by_path(df, list(targets)).select("path"))]
    assert kept("a/B.java") == ["java", "AGENTS"] and kept("B.java") == ["java", "top", "AGENTS"] and kept("b[1].py") == ["top", "AGENTS"] and kept() == ["AGENTS"]


def test_instruction_references(spark):
    files = {
        "AGENTS.md": "see @docs/a.md and x@y.z\n```\n@docs/fenced.md\n```\n@missing.md @/etc/passwd @../out.md", "docs/a.md": "@b.md\n @AGENTS.md", "docs/b.md": "~~~\n@docs/fenced.md\n~~~\nback to @a.md, on to @sub/../c.md",
        "docs/c.md": "@top.md", "top.md": "end", "docs/fenced.md": "no", "b.md": "the root's own",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    first = df.where("path = 'AGENTS.md'").select("path", "content", F.lit("p").alias("provider"), F.lit(74).alias("priority"))
    got = instructions.with_references(first, df).select("path", "priority")
    assert rows(got) == [("AGENTS.md", 74), ("docs/a.md", 68), ("docs/b.md", 67), ("docs/c.md", 66), ("top.md", 65)]
    assert len(rows(instructions.with_references(first, df, 2).select("path"))) == 3


def test_scan_of_odd_files(spark, tmp_path):
    import os

    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    (root / ".claude").mkdir()
    (root / ".seekframe").mkdir()
    (root / "src" / "a.py").write_text("x")
    (root / "src" / "empty.py").write_text("")
    (root / "big.py").write_bytes(b"#" * (scan.MOST_BYTES + 1))
    (root / ".claude" / "h.md").write_text("hidden")
    (root / ".claude" / "i.md").write_text("ignored")
    (root / ".seekframe" / "own.py").write_text("x")
    (root / ".ignore").write_text(".claude/i.md\n")
    (tmp_path / "outside.py").write_text("secret")
    os.symlink(tmp_path / "outside.py", root / "link.py")
    os.symlink(tmp_path, root / "folder")
    os.mkfifo(root / "pipe.py")
    files, odd = scan.scan(spark, str(root), "p")
    assert rows(files.select("path")) == [(".claude/h.md",), ("src/a.py",), ("src/empty.py",)]
    assert rows(odd) == [("big.py", "larger than the limit"), ("folder", "a link"), ("link.py", "a link"), ("pipe.py", "not a regular file")]
    assert scan.inside(str(root), "src/../src/a.py").endswith("src/a.py")
    for bad in ("../outside.py", "link.py", "folder/outside.py", "/etc/passwd"):
        with pytest.raises(ValueError):
            scan.inside(str(root), bad)


def test_git_log(spark, tmp_path):
    import subprocess

    from seekframe.sources import git

    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("one\ntwo\nthree\n")
    (tmp_path / "other.py").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "first")
    run("mv", "p/a.py", "p/b é.py")
    run("commit", "-qm", "moved")
    (tmp_path / "other.py").write_text("y")
    run("commit", "-qam", "elsewhere")
    (tmp_path / "p" / "b é.py").write_text("changed\n")
    got = git.changes(spark, str(tmp_path / "p"))
    assert sorted((r["message"], r["path"], r["root"]) for r in got.where("path is not null").collect()) == [("moved", "b é.py", False)]
    assert got.where("root").count() == 1 and got.select("commit").distinct().count() == 3
    zones = {r["zone"]: r["content"] for r in git.diffs(spark, str(tmp_path / "p")).collect()}
    assert zones["staged"] == "" and "+changed" in zones["working"]
    with pytest.raises(ValueError):
        git.changes(spark, str(tmp_path / "none"))


def test_json_snapshot(spark):
    body = """{"contractVersion":"1","producer":"x","project":{"rootPath":"/r"},"symbols":[
      {"resolutionStatus":"RESOLVED","kind":"trait","name":"A","filePath":"a.java","startLine":1,"endLine":2},
      {"resolutionStatus":"RESOLVED","kind":"INTERFACE","name":"A","filePath":"a.java","startLine":1,"endLine":9},
      {"resolutionStatus":"OPEN","kind":"CLASS","name":"B","filePath":"a.java","startLine":1,"endLine":2},
      {"resolutionStatus":"RESOLVED","kind":"CLASS","name":"C","filePath":"unknown.java","startLine":1,"endLine":2}],
     "relations":[{"resolutionStatus":"RESOLVED","kind":"CALLS","filePath":"a.java","sourceQualifiedName":"A","targetQualifiedName":"B","nature":"FACTUAL"}]}"""
    known = spark.createDataFrame([("a.java",)], "path string")
    s, r = importers.json_snapshot(spark.createDataFrame([(body,)], "value string"), known, "/r", "x")
    assert [(x["name"], x["kind"], x["end_line"]) for x in s.collect()] == [("A", "INTERFACE", 2)]
    assert [(x["kind"], x["confidence"]) for x in r.collect()] == [("CALLS", 1.0)]
    with pytest.raises(ValueError):
        importers.json_snapshot(spark.createDataFrame([(body.replace('"1"', '"2"'),)], "value string"), known, "/r", "x")


def _field(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([(n & 127) | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_protobuf_index(spark):
    use = lambda symbol, start, roles: _field(2, _field(1, bytes([start, 0, 4])) + _field(2, symbol) + _field(3, roles))
    info = _field(3, _field(1, b"pkg A#") + _field(4, _field(1, b"pkg B#") + _field(3, 1)) + _field(5, 7) + _field(6, b"A"))
    doc = _field(1, b"a.java") + use(b"pkg A#", 4, 1) + use(b"pkg B#", 6, 0) + info
    s, r = importers.protobuf_index(spark.createDataFrame([(bytearray(_field(2, doc)),)], "content binary"), "index")
    assert [tuple(x)[:7] for x in s.collect()] == [("a.java", "CLASS", "A", "pkg A#", "", 5, 5)]
    assert rows(r.select("kind", "source", "target")) == [("IMPLEMENTS", "pkg A#", "pkg B#"), ("REFERENCES", "a.java", "pkg B#")]
    for limits in ({"index_most": 8}, {"document_most": 8}):
        with pytest.raises(Exception, match="too large"):
            importers.protobuf_index(spark.createDataFrame([(bytearray(_field(2, doc)),)], "content binary"), "index", **limits)[0].collect()


def test_java():
    found, imports = importers.java_symbols("package a.b;\nimport x.Y;\n/* class No {} */\npublic class Foo<T> {\n  Foo(int a) { go(); }\n  public void bar(final String s) { if (x) { y(); } }\n  enum E { A }\n}\n")
    assert [(k, q) for k, _, q, *_ in found] == [("CLASS", "a.b.Foo"), ("ENUM", "a.b.Foo.E"), ("CONSTRUCTOR", "a.b.Foo#Foo(int)"), ("METHOD", "a.b.Foo#bar(String)")]
    assert imports == ["x.Y"]


def test_index_lifecycle(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "index"
    (src / "node_modules").mkdir(parents=True)
    (src / "A.java").write_text("class A { void one() {} }")
    (src / "b.rb").write_text("x")
    (src / "c.py").write_text("y")
    (src / "skip.py").write_text("z")
    (src / ".gitignore").write_text("skip.py\n")
    (src / "node_modules" / "d.js").write_text("z")
    read = lambda: scan.scan(spark, str(src), "p")[0]
    snapshots = index.Snapshots(spark, str(out))
    assert index.refresh(snapshots, read(), importers.analyse_java, read) == {"changed": 2, "removed": 0, "generation": 1}
    assert snapshots.read("symbols").count() == 2
    assert index.refresh(snapshots, read(), importers.analyse_java, read)["changed"] == 0
    (src / "A.java").write_text("class A { void one() {} void two() {} }")
    (src / "c.py").unlink()
    assert index.refresh(snapshots, read(), importers.analyse_java, read) == {"changed": 1, "removed": 1, "generation": 2}
    assert snapshots.read("symbols").count() == 3 and snapshots.read("files").count() == 1

    def later():
        (src / "A.java").write_text("class B {}")
        return read()

    (src / "e.py").write_text("1")
    with pytest.raises(RuntimeError):
        index.refresh(snapshots, read(), importers.analyse_java, later)
    assert snapshots.current()["generation"] == 2


def test_provider_isolation(spark):
    both = spark.createDataFrame([("a", "x", "builtin"), ("a", "x", "one"), ("a", "x", "two")], "path string, target string, provider string")
    fresh = spark.createDataFrame([("a", "y", "one"), ("unknown", "y", "one")], "path string, target string, provider string")
    assert rows(index.replace_provider(both, fresh, both, "one")) == [("a", "x", "builtin"), ("a", "x", "two"), ("a", "y", "one")]
    assert rows(index.purge_external(both)) == [("a", "x", "builtin")]
    with pytest.raises(ValueError):
        index.replace_provider(both, fresh, both, "builtin")


def test_plans_have_no_nested_loops(spark):
    from conftest import SF
    from seekframe.plans import catalogue

    for name in ("longest_prefix_owner", "graph_two_hop_scores", "targeted_file_lookup", "recency_scores", "lexical_bm25_topk"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


@pytest.mark.parametrize("entries", [1, 3, scan.ENTRIES])
def test_listing_by_tasks(spark, tmp_path, entries):
    """However little a task lists, all files are found once; links are told and not entered, wherever they lead."""
    root, want = tmp_path / "r", set()
    for folder in ("", "a", "a/b", "a/b/c d", ".h/x", "e/%20/[1]"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for name in ("1.py", "_2", "empty"):
            (root / folder / name).write_text("" if name == "empty" else folder)
            want.add((f"{folder}/{name}".lstrip("/"), "file", 0 if name == "empty" else len(folder)))
    (root / "a" / "Never" / "in").mkdir(parents=True)
    (root / "a" / "Never" / "in" / "x.py").write_text("x")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "secret.py").write_text("s")
    for at, to in (("a/up", ".."), ("a/b/away", "../../../out"), ("e/gone", "nowhere"), ("e/self", "self"), ("e/file.py", "../1.py")):
        (root / at).symlink_to(to)
        want.add((at, "link", len(to)))
    got = scan.listing(spark, str(root), {"never"}, entries)
    assert {tuple(r) for r in got.select("path", "kind", "length").collect()} == want and got.count() == len(want)
    files, odd = scan.scan(spark, str(root), "p")
    assert {r["path"] for r in files.select("path").collect()} == {p for p, kind, _ in want if kind == "file" and p.endswith(".py")} | {"a/Never/in/x.py"}
    assert {r["path"] for r in odd.collect()} == {p for p, kind, _ in want if kind == "link"}
    (root / "1.py").unlink()
    (root / "1.py").symlink_to(tmp_path / "out" / "secret.py")  # between listing and reading
    with pytest.raises(Exception, match="symbolic links|Errno"):
        files.collect()
