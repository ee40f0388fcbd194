"""Symbols and relations from elsewhere: a JSON snapshot, a protobuf index, Java sources."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTRACT = "1"
SYMBOLS = "path string, kind string, name string, qualified string, signature string, start_line int, end_line int, provider string"
RELATIONS = "path string, kind string, source string, target string, confidence double, provider string"
# The snapshot contract's kinds.
SYMBOL_KINDS = {
    "CLASS": "CLASS", "INTERFACE": "INTERFACE", "TRAIT": "INTERFACE", "RECORD": "RECORD", "ENUM": "ENUM", "ANNOTATION": "ANNOTATION",
    "METHOD": "METHOD", "FUNCTION": "METHOD", "CONSTRUCTOR": "CONSTRUCTOR", "TYPE": "TYPE", "STRUCT": "TYPE", "TYPE_ALIAS": "TYPE",
}
RELATION_KINDS = {
    "IMPORTS": "IMPORTS", "EXTENDS": "EXTENDS", "IMPLEMENTS": "IMPLEMENTS", "CALLS": "CALLS",
    "REFERENCES": "REFERENCES", "TYPE_DEFINITION": "TYPE_DEFINITION", "DEFINITION": "DEFINITION_OF",
}
SNAPSHOT = """contractVersion string, producer string, project struct<rootPath: string>,
  symbols array<struct<resolutionStatus: string, kind: string, name: string, qualifiedName: string, signature: string, filePath: string, startLine: int, endLine: int>>,
  relations array<struct<resolutionStatus: string, kind: string, filePath: string, sourceQualifiedName: string, targetQualifiedName: string, confidence: double, nature: string>>"""


def json_snapshot(texts: DataFrame, known: DataFrame, root: str, provider: str, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, relations) of JSON snapshots, a row each in ``texts`` (value); ``order``: an expression on ``value``, if several.

    Only resolved entries of known relative paths; of repeats the first. A snapshot of another contract or root is an
    error, and so is a relation with a confidence outside 0 to 1, or without one unless it's factual.
    """
    read = texts.select(F.from_json("value", SNAPSHOT).alias("s"), (F.lit(0).cast("long") if order is None else order).alias("snapshot")).select("snapshot", "s.*")
    whole = (F.col("contractVersion") == CONTRACT) & F.col("producer").isNotNull() & (F.col("project.rootPath") == root)
    if not read.where(~F.coalesce(whole, F.lit(False))).isEmpty():
        raise ValueError("a snapshot of another contract, producer or root")
    paths = known.select("path").distinct()
    first = lambda df, by: df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("snapshot", "at"))).where("n = 1").drop("n", "at", "snapshot")
    mapped = lambda c, kinds: F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.upper(c))
    symbols = read.select("snapshot", F.posexplode("symbols").alias("at", "x")).where("x.resolutionStatus = 'RESOLVED'")
    symbols = symbols.select("snapshot", "at", F.col("x.filePath").alias("path"), mapped("x.kind", SYMBOL_KINDS).alias("kind"), "x.name", F.coalesce("x.qualifiedName", "x.name").alias("qualified"), F.coalesce("x.signature", F.lit("")).alias("signature"), F.col("x.startLine").alias("start_line"), F.col("x.endLine").alias("end_line"), F.lit(provider).alias("provider"))
    relations = read.select("snapshot", F.posexplode("relations").alias("at", "x")).where("x.resolutionStatus = 'RESOLVED'")
    sure = F.coalesce("x.confidence", F.when(F.col("x.nature") == "FACTUAL", 1.0))
    sure = F.when(sure.between(0.0, 1.0), sure).otherwise(F.raise_error(F.lit("a relation without a confidence from 0 to 1")).cast("double"))
    relations = relations.select("snapshot", "at", F.col("x.filePath").alias("path"), mapped("x.kind", RELATION_KINDS).alias("kind"), F.col("x.sourceQualifiedName").alias("source"), F.col("x.targetQualifiedName").alias("target"), sure.alias("confidence"), F.lit(provider).alias("provider"))
    return (
        first(symbols.where("kind is not null").join(paths, "path", "left_semi"), ("path", "kind", "name", "start_line")),
        first(relations.where("kind is not null").join(paths, "path", "left_semi"), ("path", "kind", "source", "target")),
    )


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as numbers, delimited fields as bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= n or shift > 63:
                raise ValueError("a truncated or overlong number")
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            if at + size > n:
                raise ValueError("a truncated field")
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError("an unknown wire type")


def _numbers(packed: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in packed:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


# The index format's symbol kinds that have a kind here.
INDEX_KINDS = {
    7: "CLASS", 9: "CONSTRUCTOR", 11: "ENUM",
    21: "INTERFACE", 42: "INTERFACE", 53: "INTERFACE", 56: "INTERFACE",
    17: "METHOD", 18: "METHOD", 26: "METHOD", 66: "METHOD", 67: "METHOD", 68: "METHOD", 69: "METHOD", 70: "METHOD", 71: "METHOD", 74: "METHOD", 76: "METHOD", 80: "METHOD",
}


def _document(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(symbols, relations) of one document message of a code index."""
    path, infos, uses = "", [], []
    for number, value in _fields(data):
        if number == 1:
            path = value.decode()
        elif number == 2:
            told = {"range": [], "symbol": "", "roles": 0}
            for k, v in _fields(value):
                if k == 1:
                    told["range"] += _numbers(v) if isinstance(v, bytes) else [v]
                elif k == 2:
                    told["symbol"] = v.decode()
                elif k == 3:
                    told["roles"] = v
            uses.append(told)
        elif number == 3:
            told = {"symbol": "", "name": "", "kind": 0, "to": []}
            for k, v in _fields(value):
                if k == 1:
                    told["symbol"] = v.decode()
                elif k == 5:
                    told["kind"] = v
                elif k == 6:
                    told["name"] = v.decode()
                elif k == 4:
                    told["to"].append(dict(_fields(v)))
            infos.append(told)
    at = {u["symbol"]: u["range"] for u in reversed(uses) if u["roles"] & 1}
    symbols, relations = [], []
    for i in infos:
        r = at.get(i["symbol"])
        if r and i["kind"] in INDEX_KINDS:
            last = r[2] if len(r) == 4 else r[0]
            name = i["name"] or (re.findall(r"[\w$]+", i["symbol"]) or [i["symbol"]])[-1]
            symbols.append((path, INDEX_KINDS[i["kind"]], name, i["symbol"], "", r[0] + 1, last + 1))
        for to in i["to"]:
            target = to.get(1, b"").decode()
            for flag, kind in ((3, "IMPLEMENTS"), (2, "REFERENCES"), (4, "TYPE_DEFINITION"), (5, "DEFINITION_OF")):
                if to.get(flag):
                    relations.append((path, kind, i["symbol"], target))
    relations += [(path, "REFERENCES", path, u["symbol"]) for u in uses if not u["roles"] & 1]
    return symbols, list(dict.fromkeys(relations))


# The largest index and the largest document of one.
INDEX_MOST, DOCUMENT_MOST = 256 << 20, 16 << 20
#: What one row can hold.
SNAPSHOT_MOST = (1 << 31) - 1


def protobuf_index(blobs: DataFrame, provider: str, index_most: int = INDEX_MOST, document_most: int = DOCUMENT_MOST) -> tuple[DataFrame, DataFrame]:
    """(symbols, relations) of code indexes, a row each in ``blobs`` (content). Lines count from 1.

    Spark's protobuf functions need a jar and a descriptor; the few fields are read here, document by document. An index
    or a document above its limit is an error.
    """

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                if len(content) > index_most:
                    raise ValueError("the index is too large")
                for k, v in _fields(bytes(content)):
                    if k == 2:
                        if len(v) > document_most:
                            raise ValueError("a document of the index is too large")
                        yield pd.DataFrame({"document": [v]}, dtype=object)

    def rows(which: int, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [r for d in batch["document"] for r in _document(bytes(d))[which]]
                yield pd.DataFrame(found, columns=columns)

        return run

    parts = blobs.select("content").mapInPandas(documents, "document binary")
    s = parts.mapInPandas(rows(0, ["path", "kind", "name", "qualified", "signature", "start_line", "end_line"]), SYMBOLS.rsplit(",", 1)[0])
    r = parts.mapInPandas(rows(1, ["path", "kind", "source", "target"]), "path string, kind string, source string, target string")
    return s.withColumn("provider", F.lit(provider)).distinct(), r.distinct().withColumn("confidence", F.lit(1.0)).withColumn("provider", F.lit(provider))


_TYPE = re.compile(r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)")
_MEMBER = re.compile(r"(?:^|[;{}])\s*((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+|@[\w.]+(?:\([^)]*\))?\s+|<[^>]*>\s*)*)(?:([\w$.<>\[\],?& ]+?)\s+)?([A-Za-z_$][\w$]*)\s*\(([^()]*)\)\s*(?:throws\s+[\w$., ]+)?\s*([{;])")
_KINDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "@interface": "ANNOTATION"}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "synchronized", "super", "this", "assert", "yield"}


def java_symbols(text: str) -> tuple[list[tuple], list[str]]:
    """([(kind, name, qualified, signature, start line, end line)], imported names) of a Java source.

    A scanner for declarations: comments and strings are blanked, types nest by braces, members are what looks like a
    declaration right inside a type.
    """
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    code = re.sub(r'/\*.*?\*/|//[^\n]*|"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', blank, text, flags=re.S)
    package = (re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M) or [None, ""])[1]
    imports = [m[1] for m in re.finditer(r"(?:^|;)\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*(?=;)", code, re.M)]
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_left(breaks, at) + 1
    out, open_types, depth, pending = [], [], 0, None
    body_at, ends = [], {}
    marks = [(m.start(), m) for m in _TYPE.finditer(code) if code[max(0, m.start() - 1)] != "."]
    for at, mark in sorted([*marks, *((m.start(), m[0]) for m in re.finditer("[{};]", code))], key=lambda x: x[0]):
        ch = mark
        if not isinstance(mark, str):
            pending, ch = mark, ""
        if ch == "{":
            depth += 1
            if pending and at >= pending.end():
                names = [t[1] for t in open_types] + [pending[2]]
                open_types.append((depth, pending[2], len(out)))
                out.append([_KINDS[pending[1]], pending[2], ".".join([package, *names] if package else names), pending[2], line(pending.start()), 0])
                body_at.append((at, len(out) - 1, depth))
                pending = None
        elif ch == "}":
            if open_types and open_types[-1][0] == depth:
                owner = open_types.pop()[2]
                out[owner][5], ends[owner] = line(at), at + 1
            depth -= 1
        elif ch == ";" and pending and at >= pending.end():
            pending = None
    found = [tuple(o) for o in out]
    letters = np.frombuffer(code.encode("utf-32-le", "replace"), "<u4")
    opens = letters == 123
    inside = np.cumsum(opens) - np.cumsum(letters == 125) - opens  # braces open around each character, an opening one not counted
    for at, owner, level in body_at:
        qualified, simple = out[owner][2], out[owner][1]
        part = slice(at + 1, ends.get(owner, len(code)))
        plain = (inside[part] == level) | (letters[part] == 10)  # the type's own level only
        own = "{" + np.where(plain, letters[part], 32).astype("<u4").tobytes().decode("utf-32-le", "replace")
        for m in _MEMBER.finditer(own):
            name, returns = m[3], (m[2] or "").strip()
            constructor = name == simple and not returns
            if name in _NOT_NAMES or returns in _NOT_NAMES or not (constructor or returns):
                continue
            kinds = ",".join(re.sub(r"\s+[\w$]+\s*$", "", re.sub(r"^(final\s+|@\w+\s+)+", "", p.strip())) for p in m[4].split(",") if p.strip())
            first = line(at + m.start(3) - 1)
            found.append(("CONSTRUCTOR" if constructor else "METHOD", name, f"{qualified}#{name}({kinds})", f"{name}({kinds})", first, first))
    return found, imports


def analyse_java(files: DataFrame, provider: str = "builtin") -> tuple[DataFrame, DataFrame]:
    """(symbols, import relations) of Java files (path, language, content); other languages have none."""
    java = files.where("language = 'java'").select("path", "content")

    def symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *s, provider) for p, c in zip(batch["path"], batch["content"], strict=True) for s in java_symbols(c or "")[0]]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "qualified", "signature", "start_line", "end_line", "provider"])

    def relations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, "IMPORTS", p, t, 1.0, provider) for p, c in zip(batch["path"], batch["content"], strict=True) for t in java_symbols(c or "")[1]]
            yield pd.DataFrame(rows, columns=["path", "kind", "source", "target", "confidence", "provider"])

    return java.mapInPandas(symbols, SYMBOLS), java.mapInPandas(relations, RELATIONS)


# Settings that assistants read.
OPERATIONAL = (".claude/settings.json", ".claude/settings.local.json", ".mcp.json", "mcp.json", ".gemini/settings.json")


def customizations(paths: DataFrame) -> DataFrame:
    """(path, kind): operational settings, agent profiles and hooks, by path alone; contents are never read."""
    path, low = F.col("path"), F.lower("path")
    below = lambda folder, suffix: path.startswith(folder + "/") & low.endswith(suffix)
    kind = (
        F.when(path.isin(*OPERATIONAL), "CONFIGURATION")
        .when(below(".github/agents", ".md") | below(".claude/agents", ".md"), "AGENT_PROFILE")
        .when(below(".github/hooks", ".json") | below(".claude/hooks", ".json"), "HOOK")
    )
    return paths.select("path", kind.alias("kind")).where("kind is not null")
