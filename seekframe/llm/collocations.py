"""Phrase collocation mining: count-min sketches name the phrases worth counting, a second pass counts these exactly.

Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``, A-Z in lower case. All counts are of one
language; a phrase is a run of 1 to ``longest`` words of a piece, and its frequency that of all places where it stands.

First pass. Rows are dealt into blocks of about ``BLOCK_BYTES`` of text. A block hashes its phrases into the cells of a sketch, once for
each of ``ROWS`` hash functions, and sends what its cells hold to the ranges of cells that they belong to, as gaps and counts of a
byte or so. A range adds up what all blocks sent: the merged sketch, which never is below a phrase's frequency. Its width follows
the text (``BYTES_PER_CELL``), so that chance collisions stay below the threshold at every size, and no task holds more than a range
of it. Each block gets back those of its own cells that reached the threshold.

Second pass. A block counts the phrases whose cells all reached it and sends them, by hash, to ranges that sum them by the phrase
itself: sums are exact, and those below the threshold fall away. No frequent phrase is lost: its cells hold at least its frequency. Parts of a frequent phrase are
frequent, so the frequencies that scores need are all there.

Scores. A phrase cut after k words has a score floor(1000 * a * n / (l * r)): its own frequency, the language's words, and the frequencies
of what stands before and behind the cut. The lowest cut counts; of equal ones the first. Products are decimals of 38 digits: exact for
frequencies up to 10^17. A phrase is subsumed if a longer one that holds it has ``share`` percent of its frequency: then so has one
that is a word longer, so joins of neighbouring lengths find all. Rank: score, frequency, then phrase in byte order.

A null text is empty, a null language ``und``; rows count as often as they stand in the table, also where ids repeat. Texts without words
add nothing. No rows: no phrases. Blocks are dealt by position, so no text or id makes one of them large; a block holds at least one text,
so memory follows the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekframe.llm.scratch import Scratch
from seekframe.llm.words import U64, Hasher, mix, text_arrays, trim
from seekframe.tables import table

BLOCK_BYTES = 4 << 20
BYTES_PER_CELL, RANGE_BITS = 16, 21
#: Bytes of text whose frequent phrases are summed in one range.
FOUND_BYTES = 16 << 20
ROWS = 2
LEAST, LONGEST, TOP = 100, 5, 2000
SCORE = "(cast(f as decimal(17,0)) * cast(words as decimal(17,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_ROW = np.array([(0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64) for j in range(8)], np.uint64)


def numbers(values: np.ndarray) -> bytes:
    """Small numbers in a byte each, others in four more bytes at the end."""
    large = values[values >= 255].astype("<u4")
    return np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes()


def read_numbers(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", offset=n)
    return out


class Phrases:
    """The words of a block's texts, and the hashes of its phrases."""

    def __init__(self, texts: pa.ChunkedArray, langs: pa.ChunkedArray):
        data, bounds = text_arrays(texts)
        self.data = _LOWER[data[bounds[0] : bounds[-1]]]
        bounds = bounds - bounds[0]
        n = len(self.data)
        inside, edge = ~_GAP[self.data], np.zeros(n + 1, bool)
        edge[bounds] = True
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        del inside, opens, closes, edge
        self.text = np.searchsorted(bounds, self.starts, "right") - 1
        self.piece = np.cumsum(_BREAK[self.data], dtype=np.int64)[self.starts] + self.text
        codes = langs.combine_chunks().dictionary_encode() if isinstance(langs, pa.ChunkedArray) else langs.dictionary_encode()
        self.names = codes.dictionary.to_pylist()
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[self.text] if len(self.text) else np.zeros(0, np.int64)

    def hashes(self, seed: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word, hash) of all phrases, by length."""
        hasher = Hasher(seed)
        words = hasher.of_bytes(self.data, self.starts, self.ends)
        own = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed + 101) for x in self.names], np.uint64)
        at, found = np.arange(len(words)), hasher.pairs(own[self.lang] if len(words) else words, words)
        yield 1, at, found
        for n in range(2, longest + 1):
            fits = at + n - 1 < len(words)
            fits[fits] = self.piece[at[fits]] == self.piece[at[fits] + n - 1]
            at = at[fits]
            found = hasher.pairs(found[fits], words[at + n - 1])
            yield n, at, found

    def phrase(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[first] : self.ends[first + n - 1]].tobytes().split())


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes ^ _ROW[row]) >> U64(64 - bits)


def _sketch_pass(bits: int, longest: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        own = Phrases(group.column("text"), group.column("lang"))
        hashes = np.concatenate([h for _, _, h in own.hashes(0, longest)])
        del own
        out = []
        for row in range(ROWS):
            all_ = cells(hashes, row, bits)
            all_.sort()
            new = np.flatnonzero(np.diff(all_, prepend=all_[:1] + U64(1)))
            found, counts = all_[new].astype(np.int64), np.diff(new, append=len(all_))
            span = found >> RANGE_BITS
            cuts = np.flatnonzero(np.diff(span, prepend=-1)).tolist() + [len(found)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                inside = found[a:b] - (span[a] << RANGE_BITS)
                out.append((row, int(span[a]), key[0].as_py(), b - a, numbers(np.diff(inside, prepend=0)), numbers(counts[a:b])))
        del hashes
        trim()
        columns = zip(*out, strict=True) if out else [[]] * len(SENT)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, SENT.types, strict=True)], schema=SENT)

    return run


SENT = pa.schema([("row", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())])
HOT = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("range", pa.int64()), ("cells", pa.binary())])


def _merge_pass(least: int, bits: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(1 << min(bits, RANGE_BITS), np.int64)
        sent = [group.column(c).to_pylist() for c in ("block", "n", "gaps", "counts")]
        for _, n, gaps, counts in zip(*sent, strict=True):
            total[np.cumsum(read_numbers(gaps, n))] += read_numbers(counts, n)
        full = total >= least
        blocks, hot = [], []
        for block, n, gaps, _ in zip(*sent, strict=True):
            own = np.cumsum(read_numbers(gaps, n))
            own = own[full[own]]
            if len(own):
                blocks.append(block)
                hot.append(own.astype("<u4").tobytes())
        row, span = (k.as_py() for k in key)
        trim()
        return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array([row] * len(hot), pa.int32()), pa.array([span] * len(hot), pa.int64()), pa.array(hot, pa.binary())], schema=HOT)

    return run


FOUND = pa.schema([("range", pa.int64()), ("lang", pa.list_(pa.string())), ("n", pa.list_(pa.int32())), ("phrase", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))])
COUNTED = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _count_pass(bits: int, longest: int, ranges: int):
    def run(rows: pa.Table, hot: pa.Table) -> pa.Table:
        own = Phrases(rows.column("text"), rows.column("lang"))
        to, lang, size, phrase, count = [], [], [], [], []
        words = np.bincount(own.lang, minlength=len(own.names)) if len(own.text) else []
        for name, n in zip(own.names, words, strict=False):
            to.append(xxhash.xxh3_64_intdigest(name.encode()) % ranges), lang.append(name), size.append(0), phrase.append(""), count.append(int(n))
        full = [[] for _ in range(ROWS)]
        for row, span, found in zip(*[hot.column(c).to_pylist() for c in ("row", "range", "cells")], strict=True):
            full[row].append(np.frombuffer(found, "<u4").astype(np.int64) + (span << RANGE_BITS))
        full = [np.sort(np.concatenate(f)).astype(np.uint64) if f else np.zeros(0, np.uint64) for f in full]
        if all(len(f) for f in full):
            for (n, at, first), (_, _, second) in zip(own.hashes(0, longest), own.hashes(1, longest), strict=True):
                some = np.arange(len(at))
                for row in range(ROWS):
                    c = cells(first[some], row, bits)
                    place = np.minimum(np.searchsorted(full[row], c), len(full[row]) - 1)
                    some = some[full[row][place] == c]
                for where, times in _counted(first[some], second[some]):
                    i = int(at[some[where]])
                    to.append(int(first[some[where]]) % ranges), lang.append(own.names[own.lang[i]]), size.append(n), phrase.append(own.phrase(i, n).decode()), count.append(times)
        place = np.array(to, np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
        offsets = pa.array(np.append(cuts, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c, f.type.value_type).take(pa.array(order))) for c, f in zip((lang, size, phrase, count), list(FOUND)[1:], strict=True)]
        trim()
        return pa.Table.from_arrays([pa.array(place[order][cuts]), *lists], schema=FOUND)

    return run


def _sum_pass(least: int):
    def run(group: pa.Table) -> pa.Table:
        flat = pa.Table.from_arrays([pa.chunked_array([x.flatten() for x in group.column(f.name).chunks], f.type) for f in COUNTED], schema=COUNTED)
        sums = flat.group_by(["lang", "n", "phrase"]).aggregate([("f", "sum")]).rename_columns(COUNTED.names)
        trim()
        return sums.filter(pc.or_(pc.equal(sums["n"], 0), pc.greater_equal(sums["f"], least))).cast(COUNTED)

    return run


def _counted(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """(a place, how often) of each pair of hashes."""
    order = np.lexsort((second, first)) if len(first) else np.zeros(0, np.int64)
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = np.flatnonzero(new)
    yield from zip(order[new].tolist(), np.diff(new, append=len(order)).tolist(), strict=True)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, n, phrase, f): every phrase that stands ``least`` times or more, and each language's words as a phrase of length 0."""
    if least < 1 or longest < 1:
        raise ValueError("a threshold and a length of at least 1")
    scratch = Scratch(docs.sparkSession, "collocations")
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(16, (size // BYTES_PER_CELL).bit_length())
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(size // block_bytes + 1))
    rows = scratch.keep(source.where("text <> ''").withColumn("block", place))

    sent = rows.groupBy("block").applyInArrow(_sketch_pass(bits, longest), _ddl(SENT))
    hot = scratch.keep(sent.groupBy("row", "range").applyInArrow(_merge_pass(least, bits), _ddl(HOT)))
    counted = rows.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(_count_pass(bits, longest, size // FOUND_BYTES + 1), _ddl(FOUND))
    return scratch.finish(counted.groupBy("range").applyInArrow(_sum_pass(least), _ddl(COUNTED)))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    names |= {pa.list_(k): f"array<{v}>" for k, v in names.items()}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _before(k: Column) -> Column:
    """The first k words."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)


def _behind(first: str) -> Column:
    """The words that follow ``first``."""
    return F.expr(f"substring(phrase, char_length({first}) + 2)")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two words or more; all of them without ``top``."""
    found = frequent(docs, least, longest, text_col, lang_col)
    # a table of its own, as small as there are languages, so that no language's cuts meet for it
    words = Scratch(docs.sparkSession, "languages").keep(found.where("n = 0").select("lang", F.col("f").alias("words")))
    known = found.where("n > 0").select("lang", "n", "phrase", "f")
    several = known.where("n > 1")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).withColumn("before", _before(F.col("k"))).withColumn("behind", _behind("before"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("before", "l"), ["lang", "before"]).join(part("behind", "r"), ["lang", "behind"]).join(words, "lang")
    low = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "f", "words")).alias("low"))
    ends = F.explode(F.array(_before(F.col("n") - 1), _behind("substring_index(phrase, ' ', 1)")))
    held = known.where("n > 2").select("lang", ends.alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = low.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("low.f")))
    rows = left.select("lang", "phrase", F.col("low.f").alias("a"), "low.l", "low.r", F.col("low.words").alias("n"), "low.score")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two to five words that stand 100 times or more."""
    return mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(coalesce(text, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
  GROUP BY lang, k, phrase
),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE f >= 100),
cuts AS (SELECT lang, k, phrase, f, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM often WHERE k > 1)),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.f AS a, a.f AS l, b.f AS r, n, c, ((1000 * cuts.f::HUGEINT * n) // (a.f::HUGEINT * b.f))::BIGINT AS score
  FROM cuts JOIN often a ON a.lang = cuts.lang AND a.phrase = x JOIN often b ON b.lang = cuts.lang AND b.phrase = y JOIN words ON words.lang = cuts.lang
),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
stays AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM often o WHERE o.lang = low.lang AND o.k > low.k AND 100 * o.f >= 100 * low.a AND contains(' ' || o.phrase || ' ', ' ' || low.phrase || ' ')
  )
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stays) WHERE rank <= 2000
"""
