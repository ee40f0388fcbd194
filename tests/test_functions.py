"""Text functions, limits and path rules on small literals."""

import pytest
from pyspark.sql import functions as F

from seekframe.functions import limits, text
from seekframe.sources import classify


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "tokens"), [("", 0), ("😀", 1), ("abcdefg", 2), ("abcdefgh", 3)])
def test_token_estimate(spark, value, tokens):
    assert one(spark, text.token_estimate(F.lit(value))) == tokens


def test_terms_keep_order(spark):
    assert one(spark, text.terms(F.lit("Foo bar-FOO, $x a.b"))) == ["foo", "bar", "$x", "a.b"]
    assert one(spark, text.terms(F.lit(" -- "))) == []


def test_identifiers(spark):
    assert one(spark, text.split_identifiers(F.lit("HTTPServerFooBar2Baz_qux"))) == "HTTP Server Foo Bar2 Baz qux"


def test_similarity(spark):
    assert one(spark, text.similarity(F.lit("Abc"), F.lit("aBC"))) == 1.0
    assert one(spark, text.similarity(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, text.similarity(F.lit("abcd"), F.lit("abxd"))) == 0.75


def test_symbol_scores(spark):
    words = F.array(F.lit("save"), F.lit("repository"))
    exact = text.exact_symbol(F.lit("save"), F.lit("a.Repo#save"), F.lit("save repository"), words)
    assert one(spark, exact) == 1.0
    assert one(spark, text.fuzzy_symbol(F.lit("saver"), F.lit("a.Saver"), words)) == 0.9


def test_stem_and_fold(spark):
    assert [one(spark, text.stem(F.lit(w))) for w in ("running", "used", "boxes", "cats", "as")] == ["runn", "used", "box", "cat", "as"]
    assert one(spark, text.folded(F.lit("  Éléphant   ÇA "))) == "elephant ca"
    assert one(spark, text.folded(F.lit("Ştefan Ő Źle e\u0301 Ωmέga Việt"))) == "stefan o zle e ωmεga viet"


def test_fingerprint_ignores_line_ends(spark):
    assert one(spark, text.fingerprint(F.lit("a\r\nb\n\n"))) == one(spark, text.fingerprint(F.lit(" a\nb")))


def test_limits():
    assert limits.budget() == 2000 and limits.budget(200_000) == 200_000
    for bad in (0, -1, 200_001):
        with pytest.raises(ValueError):
            limits.budget(bad)
    for bad in (0, 501):
        with pytest.raises(ValueError):
            limits.results(bad)
    assert sum(limits.budget_split(2000).values()) == 2000
    assert limits.budget_split(499)["history"] == 0
    assert [limits.fair_share(10, 3, i) for i in range(3)] == [(4, 10), (3, 9), (3, 9)]
    assert (limits.local_pool(5), limits.local_pool(125), limits.symbol_pool(1), limits.context_pool(2000)) == (20, 500, 100, 50)


@pytest.mark.parametrize(
    ("path", "category"),
    [
        (".github/agents/reviewer.md", "AGENT_PROFILE"),
        (".claude/skills/pdf/SKILL.md", "SKILL"),
        ("sub/AGENTS.md", "INSTRUCTION"),
        (".github/instructions/java.instructions.md", "INSTRUCTION"),
        ("docs/readme.md", "DOCUMENTATION"),
        ("src/test/java/A.java", "TEST"),
        ("a/FooTest.java", "TEST"),
        ("a/footest.java", "SOURCE"),
        ("a/test_x.py", "TEST"),
        ("a/x.spec.tsx", "TEST"),
        ("a/X.java", "SOURCE"),
    ],
)
def test_category(spark, path, category):
    assert one(spark, classify.category(F.lit(path))) == category


def test_language_and_skipped(spark):
    assert [one(spark, classify.language(F.lit(p))) for p in ("A.JAVA", "x.mjs", "b.kts", "c.rb")] == ["java", "javascript", "kotlin", None]
    for path, skip in (("a/node_modules/x.js", True), ("a/.env.local", True), ("k/server.pem", True), ("a/outer/x.py", False)):
        assert one(spark, classify.skipped(F.lit(path))) is skip


def test_globs():
    import re

    fits = lambda g, p: bool(re.match(classify.glob_regex(g), p))
    assert fits("**/*.java", "A.java") and fits("**/*.java", "a/b/A.java") and not fits("*.java", "a/A.java")
    assert fits("src/**", "src/a/b") and fits("a?c", "abc") and not fits("a?c", "a/c")


def test_ignore_rules(spark):
    root = classify.ignore_rules("*.log\n!keep.log\nbuild/\n/top.txt\n# note")
    sub = ("sub", classify.ignore_rules("!x.log"))
    cases = {"a/b.log": True, "keep.log": False, "build/x": True, "top.txt": True, "a/top.txt": False, "sub/x.log": False, "x.log": True, "sub/y.log": True, "build": False, "subx/x.log": True}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r["path"]: r["i"] for r in df.select("path", classify.ignored(F.col("path"), [[("", root), sub]]).alias("i")).collect()} == cases


IGNORE_CASES = [
    ("f[0-9].txt", "f5.txt", True), ("f[0-9].txt", "fx.txt", False), ("f[!0-9].txt", "fx.txt", True), ("f[^0-9].txt", "f1.txt", False), ("[[:upper:]]*.c", "Ab.c", True), ("[[:upper:]]*.c", "ab.c", False),
    ("[]x]", "]", True), ("[a-]b", "-b", True), ("[a\\]]b", "]b", True), ("a[/]b", "a/b", False), ("[abc", "[abc", False), ("\\#note", "#note", True), ("\\!x", "!x", True), ("\\*.c", "a.c", False), ("\\*.c", "*.c", True),
    ("x\\", "x", False), ("a.c", "abc", False), ("end   ", "end", True), ("end\\ ", "end ", True), ("#no", "#no", False), ("", "a", False), ("/", "a", False),
    ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**", "a/x/y", True), ("a/**", "a", False), ("**/z", "z", True), ("**/z", "q/r/z", True), ("f**o", "fxxo", True), ("f**o", "f/o", False),
    ("d/e", "x/d/e", False), ("d/e", "d/e/f", True), ("d/", "d", False), ("d/", "x/d/y", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("d\n!d/keep", "d/keep", True), ("d/*\n!d/keep", "d/keep", False), ("*\n!*/\n!*.py", "a/b.py", False),
    ("(x)+{1}|$^.y", "(x)+{1}|$^.y", True), ("a b", "q/a b", True), ("é*", "q/été", True), ("*", "any/thing", True),
]


def test_ignore_syntax(spark):
    """Sets, escapes, stars and negations, in plans without Python."""
    rows = spark.createDataFrame([(n, p) for n, (_, p, _) in enumerate(IGNORE_CASES)], "n int, path string")
    told = F.lit(None).cast("boolean")
    for n, (text_, _, _) in enumerate(IGNORE_CASES):
        told = F.when(F.col("n") == n, classify.ignored(F.col("path"), [[("", classify.ignore_rules(text_))]])).otherwise(told)
    out = rows.select("n", told.alias("i"))
    assert [(IGNORE_CASES[r["n"]], r["i"]) for r in out.collect() if r["i"] != IGNORE_CASES[r["n"]][2]] == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()



def test_unicode_identifiers(spark):
    df = spark.createDataFrame([("élèveÉtat",), ("XMLÜberTest",), ("naïve2Ärger",), ("plain",)], "t string")
    assert [r["x"] for r in df.select(text.split_identifiers(F.col("t")).alias("x")).collect()] == ["élève État", "XML Über Test", "naïve2 Ärger", "plain"]
    assert [r["x"] for r in df.select(text.identifier_tokens(F.col("t")).alias("x")).collect()] == [["élève", "état"], ["xml", "über", "test"], ["naïve2", "ärger"], ["plain"]]


def test_split_columns(spark):
    from seekframe.operators import budget

    sizes = [50, 60, 99, 400, 499, 500, 777, 2000, 20000, 100000]
    for r in spark.createDataFrame([(n,) for n in sizes], "n int").select("n", *budget.split(F.col("n"))).collect():
        assert r.asDict() == {"n": r["n"]} | limits.budget_split(r["n"])
