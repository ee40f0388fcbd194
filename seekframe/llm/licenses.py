"""License scans: canonical digests of entire texts, looked up among known licences.

Canonical form: A-Z lower-cased; copyright lines and "all rights reserved" dropped; every run of
other characters than letters and digits one space; British and other equivalent spellings made
one. A copyright line starts, after comment marks, with "copyright" or "(c)" and goes on with a year, a sign, a
placeholder or a holder, so a wrapped sentence that has the word at the start of a line stays. A text whose
canonical form equals a known text's is that licence; nothing less than the entire
text counts. Nulls and empty texts are the empty form, which is no licence; a text that is only
copyright lines is that form too. Rows are judged one by one, so repeated rows repeat; an empty table gives no rows.

A text that isn't known as it stands is looked up once more without its head: the paragraphs at its beginning that are a title (one line
that names a licence, without sentence marks) or that begin, title or not, with a copyright word or sign, whoever the holder is
and however many lines he takes, up to a blank line and ``HEAD_MOST`` characters each. The digest told is that of the whole text.

Known are short texts (KNOWN), the digests of long ones (DIGESTS), and whatever folder of published files a caller
names. The only join is to the known digests. They are broadcast when there are at most
``BROADCAST_ROWS`` of them, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.llm.license_texts import DIGESTS, KNOWN
from seekframe.tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOLDER = r"the [^\n]*(authors|contributors|developers|foundation|regents|project|team)"
COPYRIGHT = rf"(^|\n)[ \t#*/;%!>-]*(portions )?(copyright[ \t:]*(\(c\)|©|[0-9][0-9][0-9][0-9]|[\[<{{]|by |{_HOLDER})|\(c\)[ \t]*(copyright|[0-9][0-9][0-9][0-9]|[\[<{{]|by )|©)[^\n]*"
RESERVED = r"all[^a-z0-9]+rights[^a-z0-9]+reserved"
GAP = r"[^a-z0-9\x{00C0}-\x{1FFF}\x{2C00}-\x{10FFFF}]+"
#: (spelling, its equivalent) once gaps are single spaces. In this order; parts of words, so that endings need no entries.
SPELLINGS = [
    ("licenc", "licens"),
    *((f"{w}is", f"{w}iz") for w in ("organ", "recogn", "author", "util", "initial", "final", "custom", "summar", "optim", "capital", "character")),
    *((f"{w}our", f"{w}or") for w in ("behavi", "fav", "col", "hon", "lab")),
    *((f"{w}ement", f"{w}ment") for w in ("judg", "acknowledg")),
    *((f" non {w}", f" non{w}") for w in ("infringement", "commercial", "exclusive")),
    (" sub licens", " sublicens"),
    (" https ", " http "),
]
BROADCAST_ROWS = 10_000
HEAD_MOST = 400
_MARKS, _TITLE = r"[\s#*/;%!>-]*", r"[^\n.,;]{0,40}licen[cs]e[^\n.,;]{0,40}"
HEAD = rf"\A{_MARKS}(?:{_TITLE})?(?:(?:\n{_MARKS})?(?<![^\s#*/;%!>-])(?:portions )?(?:copyright|\(c\)|©)|\s*\z)"
BLANK = r"\n[ \t\r]*\n"


def without_head(text: Column) -> Column:
    """The text, A-Z in lower case, from its first paragraph on that isn't a title or a copyright notice; null if that's all or none."""
    low = F.translate(text, UPPER, LOWER)
    parts = F.split(low, BLANK)
    place = F.array_position(F.transform(parts, lambda p: (F.length(p) <= HEAD_MOST) & p.rlike(HEAD)), False)
    body = F.when(place > 1, F.array_join(F.slice(parts, place.cast("int"), F.size(parts)), "\n\n"))
    # texts that don't begin like one are only looked at
    return F.when(F.substring(low, 1, 4 * HEAD_MOST).rlike(rf"\A(?:{_MARKS}|{_MARKS}[^\n]*)(?:licen[cs]e|copyright|\(c\)|©)"), body)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    some = out.contains("copyright") | out.contains("(c)") | out.contains("©")
    out = F.when(some, F.regexp_replace(out, COPYRIGHT, "$1")).otherwise(out)
    out = F.when(out.contains("reserved"), F.regexp_replace(out, RESERVED, " ")).otherwise(out)
    out = F.regexp_replace(out, GAP, " ")
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(out)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS, folder: str | None = None) -> DataFrame:
    """(license, digest), one row per digest; of several licences with one digest the first by name.

    ``folder``: published texts, one a file, each named after its licence.
    """
    texts = spark.createDataFrame(known, "license string, text string")
    if folder is not None:
        files = spark.read.text(folder, wholetext=True)
        texts = texts.unionByName(files.select(F.regexp_extract(F.input_file_name(), "([^/]*?)([.]txt)?$", 1).alias("license"), F.col("value").alias("text")))
    told = texts.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).unionByName(spark.createDataFrame(digests, "license string, digest string"))
    return told.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, known_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, canon_sha256, canon_chars) for every row; license is null where no known text equals it.

    ``known`` is (license, digest) with unique digests, ``known_rows`` a bound on its rows.
    """
    form = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("form"), canonical(without_head(F.col(text_col))).alias("body"))
    body = F.when(F.col("body") != "", F.sha2("body", 256)).alias("body_sha256")
    digested = form.select(id_col, F.when(F.col("form") != "", F.sha2("form", 256)).alias("form_sha256"), F.sha2("form", 256).alias("canon_sha256"), body, F.length("form").cast("long").alias("canon_chars"))
    side = known.select(F.col("digest").alias("form_sha256"), F.col("license").alias("whole")), known.select(F.col("digest").alias("body_sha256"), F.col("license").alias("headless"))
    for one in side:
        digested = digested.join(F.broadcast(one) if known_rows <= BROADCAST_ROWS else one, next(c for c in one.columns if c.endswith("sha256")), "left")
    return digested.select(id_col, F.coalesce("whole", "headless").alias("license"), "canon_sha256", "canon_chars")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document as a whole is, if any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, known_digests(spark), len(KNOWN) + len(DIGESTS))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """The canonical form in SQL, written from the description above and not from the lists."""
    return f"""(SELECT trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'),
        '(^|\\n)[-\\t !#%*/;>]*(?:portions )?(?:copyright[\\t :]*(?:\\(c\\)|©|\\d{{4}}|[<\\[{{]|by |the .*(?:authors|contributors|developers|foundation|regents|project|team))|\\(c\\)[\\t ]*(?:copyright|\\d{{4}}|[<\\[{{]|by )|©).*', '\\1', 'g'),
        'all[^a-z0-9]+rights[^a-z0-9]+reserved', ' ', 'g'),
        '[^0-9a-z\\x{{00C0}}-\\x{{1FFF}}\\x{{2C00}}-\\x{{10FFFF}}]+', ' ', 'g'),
        'licenc', 'licens', 'g'),
        '(author|capital|character|custom|final|initial|optim|organ|recogn|summar|util)is', '\\1iz', 'g'),
        '(behavi|col|fav|hon|lab)our', '\\1or', 'g'),
        '(acknowledg|judg)ement', '\\1ment', 'g'),
        ' non (commercial|exclusive|infringement)', ' non\\1', 'g'),
        ' sub licens', ' sublicens', 'g'), ' https ', ' http '), '^$', ''), ' '))"""


#: A title, a copyright notice, one after the other, or nothing; written from the description too.
_SQL_HEAD = (
    r"'^[-\s!#%*/;>]*($|(portions )?(copyright|\(c\)|©)|[^.,;\n]{0,40}licen[cs]e[^.,;\n]{0,40}(\s*$|\n[-\s!#%*/;>]*(portions )?(copyright|\(c\)|©)))'"
)

OP7_SQL = f"""
WITH known AS (
  SELECT digest, min(l) AS license FROM (
    SELECT l, sha256({_sql_canonical('t')}) AS digest FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}) AS v(l, t)
    UNION ALL SELECT * FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in DIGESTS)}) AS v(l, d)
  ) GROUP BY digest
), docs AS (
  SELECT doc_id, {_sql_canonical('text')} AS form, {_sql_canonical('body')} AS body
  FROM (SELECT *, CASE WHEN place > 1 THEN array_to_string(parts[place:], chr(10) || chr(10)) END AS body FROM (
    SELECT *, list_position(list_transform(parts, lambda p: length(p) <= 400 AND regexp_matches(p, {_SQL_HEAD})), false) AS place
    FROM (SELECT doc_id, text, string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '\n[ \t\r]*\n') AS parts FROM documents)))
)
SELECT d.doc_id, coalesce(k.license, h.license) AS license, sha256(d.form) AS canon_sha256, CAST(length(d.form) AS BIGINT) AS canon_chars
FROM docs d LEFT JOIN known k ON sha256(d.form) = k.digest AND length(d.form) > 0 LEFT JOIN known h ON sha256(d.body) = h.digest AND length(d.body) > 0
"""
