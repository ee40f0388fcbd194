"""Secret scans: fixed patterns plus sliding-window entropy, in built-in functions only.

Base kinds are matched leftmost and without overlap, each kind on its own:

* ``assign``: a key word, a separator and a value of 12 or more characters,
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters in all,
* ``hex``: 16 or more of ``0-9a-f``.

The method adds ``entropy`` spans. A candidate is a run of 20 or more characters of
``[A-Za-z0-9+/_=-]`` with a letter and a digit. A window of 20 characters slides over it; the
counts of its characters change by one in and one out each step, and with them the sum of
c * log2(c), held in millionths of a bit so that it is exact. The candidate's character class
(hex, capitals, letters and digits, or base64) sets how high a window's entropy has to be. Spans are
the runs of such windows; windows that share characters are one run. The pieces of a candidate between
separators (``=``, then ``_`` and ``-`` or ``/`` and ``+``, then all of them) are candidates too, each of
its own class, so that a key is found whatever its name is joined with; spans that overlap are one.
Allow-listed candidates (UUIDs, examples, placeholders, paths of plain words) are passed over; so are
pieces of UUIDs and paths, but not what stands beside an example. Spans inside a base span say
nothing new and are passed over. Base spans always stay.

Nulls and empty texts have no spans, an empty table gives no rows, and a null id is kept. Nothing is shuffled; every row is judged on its own, so
repeated rows give repeated results. Input columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.tables import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs of 18 or more are the same matches
HEX = r"[0-9a-f]{16,}"  # likewise: a run is taken whole or not at all
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Pieces of candidates that no wider pattern takes: without "="; then without "_" and "-" or "/" and "+"; then without all.
PIECES = (
    r"(?<==)[A-Za-z0-9+/_-]{20,}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?==)",
    r"(?<=[_-])[A-Za-z0-9+/]{20,}|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+(?=[_-])",
    r"(?<=[+/])[A-Za-z0-9_-]{20,}|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?=[+/])",
    r"(?<=[_-])[A-Za-z0-9]{20,}+(?=[+/])|(?<=[+/])[A-Za-z0-9]{20,}+(?=[_-])",
)
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class, its pattern, and the least entropy of a window in bits; the first class that fits counts.
CLASSES = (("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("capitals", r"^[0-9A-Z]+$", 3.5), ("alnum", r"^[0-9A-Za-z]+$", 3.75), ("base64", r"", 3.9))
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|0{8}|1234567890",
    r"^/?([a-z]+[0-9]{0,4}[/_-])+[a-z]*[0-9]{0,4}$",
)
MICRO = 1_000_000
_BLOCK = 256
#: Windows of a candidate that one fold looks at; longer candidates are folded in several parts.
_STRETCH = 512

#: c * log2(c) in millionths, for counts 0 to WINDOW
CLOGC = [0] + [round(c * math.log2(c) * MICRO) for c in range(1, WINDOW + 1)]


def most_sum(bits: float) -> int:
    """The largest sum of c * log2(c), in millionths, of a window with at least ``bits`` of entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * MICRO)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<start: bigint, text: string>> of the pattern's matches, starts from 0 in code points.

    Pieces between matches and the matches give the starts as running sums, taken in blocks so
    that the work stays near linear in the number of matches.
    """
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    pairs = F.zip_with(pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("gap"), m.alias("text")))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + F.coalesce(F.length(x["text"]), F.lit(0)))

    def with_pairs(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK))))

        def with_sums(s: Column) -> Column:
            before = lambda b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0).cast("long"), lambda a, x: a + x)
            block = lambda part, base: F.transform(part, lambda x, i: F.struct((base + total(F.slice(part, F.lit(1), i)) + x["gap"]).alias("start"), x["text"].alias("text")))
            return F.flatten(F.transform(blocks, lambda b: let(F.struct(F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)).alias("part"), before(b).alias("base")), lambda v: block(v["part"], v["base"]))))

        return F.filter(let(sums, with_sums), lambda x: x["text"].isNotNull())

    none = F.array().cast("array<struct<start:bigint,text:string>>")
    return F.when(guard, let(pairs, with_pairs)).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), (x["start"] + F.length(x["text"])).cast("long").alias("end")))


def window_spans(candidate: Column) -> Column:
    """array<struct<lo: int, hi: int>>: runs of windows of high entropy, in parts of ``_STRETCH`` windows each."""
    most = F.lit(most_sum(CLASSES[-1][2]))
    for _, pattern, bits in reversed(CLASSES[:-1]):
        most = F.when(candidate.rlike(pattern), F.lit(most_sum(bits))).otherwise(most)
    codes = F.transform(F.split(candidate, ""), lambda ch: F.position(ch, F.lit(ALPHABET)))

    def parts(v: Column) -> Column:
        last = F.floor((F.size(v["codes"]) - WINDOW) / _STRETCH).cast("int")
        part = lambda at: F.struct(F.slice(v["codes"], at + 1, F.lit(_STRETCH + WINDOW - 1)).alias("codes"), v["most"].alias("most"))
        moved = lambda runs, at: F.transform(runs, lambda r: F.struct((r["lo"] + at).alias("lo"), (r["hi"] + at).alias("hi")))
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: moved(let(part(i * _STRETCH), _runs), i * _STRETCH)))

    return let(F.struct(codes.alias("codes"), most.alias("most")), parts)


def _runs(v: Column) -> Column:
    """Runs of windows of ``v.codes`` whose sum is at most ``v.most``.

    One fold over the characters; the state is the window's counts by character, their sum, the run at hand and those before.
    """
    costs = F.array(*[F.lit(x).cast("long") for x in CLOGC])
    change = lambda new, old, at: F.element_at(costs, F.element_at(new, at) + 1) - F.element_at(costs, F.element_at(old, at) + 1)
    one_run = lambda lo, hi: F.array(F.struct(lo.alias("lo"), hi.alias("hi")))

    def slide(a: Column, i: Column) -> Column:
        step = F.struct(F.element_at(v["codes"], i).alias("into"), F.when(i > WINDOW, F.element_at(v["codes"], F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0)).alias("gone"))

        def counted(c: Column) -> Column:
            one = lambda k, at: F.when(k + 1 == at, 1).otherwise(0)
            new = F.transform(a["n"], lambda n, k: n + one(k, c["into"]) - one(k, c["gone"]))
            return let(new, lambda n: judged(c, n))

        def judged(c: Column, n: Column) -> Column:
            moved = F.when(c["into"] == c["gone"], F.lit(0)).otherwise(
                change(n, a["n"], c["into"]) + F.when(c["gone"] > 0, change(n, a["n"], F.greatest(c["gone"], F.lit(1)))).otherwise(F.lit(0))
            )
            return let((a["sum"] + moved).cast("long"), lambda s: told(n, s))

        def told(n: Column, s: Column) -> Column:
            hit = (i >= WINDOW) & (s <= v["most"])
            opens = hit & (a["hi"].isNull() | (a["hi"] <= i - WINDOW))
            before = F.when(opens & a["hi"].isNotNull(), F.concat(a["before"], one_run(a["lo"], a["hi"]))).otherwise(a["before"])
            return F.struct(n.alias("n"), s.alias("sum"), F.when(opens, i - WINDOW).otherwise(a["lo"]).alias("lo"), F.when(hit, i).otherwise(a["hi"]).alias("hi"), before.alias("before"))

        return let(step, counted)

    none = F.array().cast("array<struct<lo:int,hi:int>>")
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), none.alias("before"))
    finish = lambda a: F.when(a["hi"].isNull(), none).otherwise(F.concat(a["before"], one_run(a["lo"], a["hi"])))
    return F.aggregate(F.sequence(F.lit(1), F.size(v["codes"])), start, slide, finish)


def _pieces(text: Column, candidates: Column) -> Column:
    """Candidates and their pieces. What stands beside a piece lies in its candidate: a text whose candidates have none isn't searched again."""
    holds = lambda p: F.exists(candidates, lambda x: x["text"].rlike(p))
    return F.concat(candidates, *[located(text, p, holds(p)) for p in PIECES])


def _high(every: Column) -> Column:
    """The runs of high entropy of candidates and pieces that nothing allows."""
    allowed = lambda x, patterns: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.regexp_like(x["text"], p))
    end = lambda x: x["start"] + F.length(x["text"])
    worth = lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]") & ~allowed(x, ALLOW)
    rank = F.lit(KINDS.index("entropy"))
    whole = F.filter(every, lambda x: allowed(x, (ALLOW[0], ALLOW[2])))  # UUIDs and paths, with all their pieces

    def kept(v: Column) -> Column:
        own = F.filter(v["every"], lambda x: worth(x) & ~F.exists(v["whole"], lambda w: (w["start"] <= x["start"]) & (end(x) <= end(w))))
        return F.flatten(F.transform(own, lambda x: F.transform(window_spans(x["text"]), lambda w: F.struct((x["start"] + w["lo"]).cast("long").alias("start"), rank.alias("rank"), (x["start"] + w["hi"]).cast("long").alias("end")))))

    return let(F.struct(every.alias("every"), whole.alias("whole")), kept)


def joined(found: Column, touching: bool = False) -> Column:
    """array<struct<start, end>> in order: spans that overlap (or touch) as one.

    One that ends where as many spans have ended as begun closes; the next to begin opens another.
    """

    def merged(v: Column) -> Column:
        apart = lambda end, start: start > end if touching else start >= end
        opens = F.filter(v["starts"], lambda s, i: (i == 0) | apart(F.get(v["ends"], i - 1), s))
        closes = F.filter(v["ends"], lambda e, i: (i == F.size(v["ends"]) - 1) | apart(e, F.get(v["starts"], i + 1)))
        return F.zip_with(opens, closes, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    side = lambda of, name: F.array_sort(F.transform(of, lambda x: x[name])).alias(f"{name}s")
    return let(found, lambda of: let(F.struct(side(of, "start"), side(of, "end")), merged))


def _base(text: Column) -> Column:
    assigned = F.filter(
        located(text, ASSIGN, text.rlike(ASSIGN_HINT)),
        lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 12,
    )
    return F.array_sort(
        F.concat(
            _spans(assigned, "assign"),
            _spans(located(text, ACCESS, text.contains("AKIA")), "access"),
            _spans(located(text, HEX, text.rlike(HEX)), "hex"),
        )
    )


def with_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: base spans, entropy spans, each array<struct<start, rank, end>>, in order.

    Step by step, each a column: as one expression they would be nested deeper than the analyser goes.
    """
    names = {c.lower() for c in docs.columns}
    base, found = [n for n in (f"spans_{i}" for i in range(len(names) + 2)) if n not in names][:2]
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(found)
    rank = F.lit(KINDS.index("entropy"))
    out = docs.withColumn(base, _base(text)).withColumn(found, located(text, CANDIDATE, text.rlike(CANDIDATE)))
    out = out.withColumn(found, _pieces(text, own)).withColumn(found, _high(own)).withColumn(found, joined(own))
    return out.withColumn(found, F.transform(own, lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end")))), base, found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found): the base spans and all spans of each row's whole text.

    Both are array<struct<start: bigint, rank: int, end: bigint>> ordered by start, then kind;
    ``rank`` is the kind's place in KINDS, starts count code points from 0, ends are exclusive.
    """
    marked, base, added = with_spans(docs.select(id_col, text_col), text_col)
    new = F.filter(added, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return marked.select(id_col, F.col(base).alias("base"), F.array_sort(F.concat(base, new)).alias("found"))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark``; spans that touch or overlap get one mark.

    Texts without spans, and nulls, are unchanged. Columns and their order are kept.
    """
    marked, base, added = with_spans(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = marked.withColumn(base, joined(F.concat(base, added), True))

    def cut(m: Column) -> Column:
        """The text between the spans, block by block: a block's text is cut out once, and its gaps from that."""
        blocks = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _BLOCK).cast("int"))

        def gaps(b: Column) -> Column:
            own = F.slice(m, b * _BLOCK + 1, F.lit(_BLOCK))
            base = F.when(b == 0, F.lit(0).cast("long")).otherwise(F.get(m, b * _BLOCK - 1)["end"])
            upto = F.coalesce(F.get(m, (b + 1) * _BLOCK)["start"], F.length(text).cast("long"))
            part = F.substring(text, (base + 1).cast("int"), (upto - base).cast("int"))
            return let(F.struct(own.alias("own"), base.alias("base"), part.alias("part"), (b == F.size(blocks) - 1).alias("last")), pieces)

        def pieces(v: Column) -> Column:
            piece = lambda a, z: F.substring(v["part"], (a - v["base"] + 1).cast("int"), (z - a).cast("int"))
            before = F.transform(v["own"], lambda s, i: F.concat(piece(F.when(i == 0, v["base"]).otherwise(F.get(v["own"], i - 1)["end"]), s["start"]), F.lit(mark)))
            tail = F.element_at(v["own"], -1)["end"]
            return F.concat(F.array_join(before, ""), F.when(v["last"], piece(tail, F.length(text))).otherwise(F.lit("")))

        return F.array_join(F.transform(blocks, gaps), "")

    m = F.col(base)
    return marked.withColumn(text_col, F.when(F.size(m) > 0, cut(m)).otherwise(F.col(text_col))).select(docs.columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; see the module for what counts as one."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


def _sql_quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_found(pattern: str, rank: int) -> str:
    p = _sql_quoted(pattern)
    return f"""SELECT doc_id, {rank} AS rank, ms[i] AS s, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS ps FROM d WHERE regexp_matches(t, {p})))"""


def _sql_written(rows: str) -> str:
    return f"SELECT doc_id, string_agg({list(KINDS)}[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS w FROM {rows} GROUP BY doc_id"


_SQL_MOST = "CASE " + " ".join(f"WHEN regexp_matches(s, {_sql_quoted(p)}) THEN {most_sum(b)}" for _, p, b in CLASSES) + " END"
_SQL_COST = f"list_sum(list_transform(list_distinct(string_split(x, '')), lambda ch: {CLOGC}[len(list_filter(string_split(x, ''), lambda y: y = ch)) + 1]))"
_SQL_SIDES = "SELECT doc_id, s, start, substr(t, CAST(start AS BIGINT), CASE WHEN start > 0 THEN 1 ELSE 0 END) AS b, substr(t, CAST(start + length(s) + 1 AS BIGINT), 1) AS a FROM"
_SQL_ALLOWED = lambda patterns: "(" + " OR ".join(f"regexp_matches(s, {_sql_quoted(p)})" for p in patterns) + ")"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_id, rank, start, start + length(s) AS stop FROM (
    SELECT * FROM ({_sql_found(ASSIGN, 0)}) WHERE length(regexp_extract(s, {_sql_quoted(ASSIGN)}, 2)) >= 12
    UNION ALL {_sql_found(ACCESS, 1)} UNION ALL {_sql_found(HEX, 2)})
),
every AS (
  SELECT doc_id, s, start, start + length(s) AS stop FROM (
    SELECT doc_id, s, start FROM ({_sql_found(CANDIDATE, 3)})
    UNION SELECT doc_id, s, start FROM ({_SQL_SIDES} ({_sql_found("[A-Za-z0-9+/_-]{20,}", 3)}) JOIN d USING (doc_id)) WHERE b = '=' OR a = '='
    UNION SELECT doc_id, s, start FROM ({_SQL_SIDES} ({_sql_found("[A-Za-z0-9+/]{20,}", 3)}) JOIN d USING (doc_id)) WHERE b IN ('_', '-') OR a IN ('_', '-')
    UNION SELECT doc_id, s, start FROM ({_SQL_SIDES} ({_sql_found("[A-Za-z0-9_-]{20,}", 3)}) JOIN d USING (doc_id)) WHERE b IN ('+', '/') OR a IN ('+', '/')
    UNION SELECT doc_id, s, start FROM ({_SQL_SIDES} ({_sql_found("[A-Za-z0-9]{20,}", 3)}) JOIN d USING (doc_id))
      WHERE (b IN ('_', '-') AND a IN ('+', '/')) OR (b IN ('+', '/') AND a IN ('_', '-')))
),
passed AS (SELECT doc_id, start, stop FROM every WHERE {_SQL_ALLOWED((ALLOW[0], ALLOW[2]))}),
candidates AS (
  SELECT * FROM every e WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT {_SQL_ALLOWED(ALLOW)}
    AND NOT EXISTS (SELECT 1 FROM passed p WHERE p.doc_id = e.doc_id AND p.start <= e.start AND e.stop <= p.stop)
),
high AS (
  SELECT DISTINCT doc_id, start + j - 1 AS start FROM (SELECT doc_id, start, s, j, substr(s, j, {WINDOW}) AS x FROM (SELECT *, unnest(range(1, length(s) - {WINDOW - 2})) AS j FROM candidates))
  WHERE {_SQL_COST} <= {_SQL_MOST}
),
runs AS (SELECT doc_id, start, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM (
  SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) < {WINDOW} THEN 0 ELSE 1 END AS opens FROM high)),
added AS (SELECT doc_id, 3 AS rank, min(start) AS start, max(start) + {WINDOW} AS stop FROM runs GROUP BY doc_id, run),
everything AS (
  SELECT * FROM base
  UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a.stop <= b.stop)
),
counts AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex FROM base GROUP BY doc_id),
b AS ({_sql_written("base")}), e AS ({_sql_written("everything")})
SELECT d.doc_id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.w, '')) AS base_sha256, coalesce(e.w, '') AS spans
FROM d LEFT JOIN counts ON d.doc_id = counts.doc_id LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN e ON d.doc_id = e.doc_id
"""
