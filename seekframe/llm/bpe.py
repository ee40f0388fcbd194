"""Byte-level BPE by a distinct-word table.

Texts are split into words as the tokenizer's pre-tokenizer does, in blocks of about ``BLOCK_BYTES``. Each
block sends its distinct words, told apart by their bytes and packed, to the bucket of their hash, and its words' places,
packed, to the block's own key; both in one shuffle. A bucket encodes each distinct word it sees once and answers every
block that asked. The answers join the blocks' places, which turns places into ids. So a frequent word costs each block
one entry, not one row per occurrence, and no key holds more than a block. Beyond ``BUCKETS`` partitions, blocks fall into
groups with buckets of their own, so that a block never sends more rows than that; a word is then encoded once a group.
Decoding looks every id up in the table of pieces (its size is the vocabulary's) where the ids are put together,
a join without a shuffle, and joins their bytes.

Results equal the tokenizer's own with add_special_tokens=False, and its decode with
skip_special_tokens=False. Added tokens in a text count as such, as they do there. Null and empty texts have no ids.
Ids of any type may be null or repeat; every row gets its own result. Only the id and the text are read.

Supported files: a byte-level pre-tokenizer with its usual pattern, no normaliser, a BPE model without
dropout. Anything else is refused.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from seekframe.llm.scratch import Scratch
from seekframe.llm.words import Hasher, text_arrays, trim
from seekframe.tables import table

BLOCK_BYTES, PIECE_BYTES = 4 << 20, 1 << 18
#: Rows that a block sends to buckets, at most; with more partitions, blocks fall into groups with buckets of their own.
BUCKETS = 64
#: Words a bucket remembers at once; beyond that it starts afresh.
REMEMBERED = 300_000
#: Texts whose ids are put together at once.
TEXTS = 64
OTHER, LETTER, NUMBER, SPACE = range(4)
#: What follows an apostrophe in a word of its own, as code points. Fixed by the pre-tokenizer's pattern.
ENDINGS = [(115,), (116,), (114, 101), (118, 101), (109,), (108, 108), (100,)]


@cache
def _tokenizer(path: str) -> Tokenizer:
    """The file's tokenizer, without truncation and padding; one per process."""
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@cache
def settings(path: str) -> tuple[list[str], bool]:
    """(added tokens, whether all is as supported) of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, model = told["pre_tokenizer"] or {}, told["model"]
    added = told.get("added_tokens", [])
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and model["type"] == "BPE" and not model.get("dropout")
    plain = bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    return [t["content"] for t in added], plain


@cache
def char_classes() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(first code points, classes) of runs of equal class, asked of the pre-tokenizer itself.

    Planes 4 to 13 hold no characters and 15 and 16 private ones; all are OTHER.
    """
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    classes = np.full(0x110000, OTHER, np.uint8)
    for at in itertools.chain(range(0, 0x40000, 0x2000), range(0xE0000, 0xF0000, 0x2000)):
        chars = [chr(c) for c in range(at, at + 0x2000) if not 0xD800 <= c < 0xE000]
        codes = np.array([ord(c) for c in chars], np.int64)
        if not chars:
            continue

        def together(front: str, back: str, chars: list[str] = chars) -> np.ndarray:
            """Whether each character is one word with what stands around it."""
            size = len(front) + len(back) + 3  # between new lines: "\n\n" + front + character + back
            words = split("".join(f"\n\n{front}{c}{back}" for c in chars))
            starts = np.zeros(len(chars) * size + 1, bool)
            starts[[a for _, (a, _) in words]] = True
            place = np.arange(len(chars)) * size + 2
            inner = [starts[place + i] for i in range(1, len(front) + 1 + len(back))]
            return ~np.logical_or.reduce(inner)

        letter, number, other = together("a", ""), together("1", ""), together("!", "!")
        classes[codes] = np.select([letter, number, other], [LETTER, NUMBER, OTHER], SPACE)
    first = np.flatnonzero(np.diff(classes, prepend=255))
    return tuple(first.tolist()), tuple(classes[first].tolist())


class Splitter:
    """Words of many texts at once, as the pre-tokenizer splits them."""

    def __init__(self, classes: tuple[tuple[int, ...], tuple[int, ...]], added: list[str]):
        first, kind = classes
        self.classes = np.repeat(np.array(kind, np.uint8), np.diff(np.array([*first, 0x110000])))
        self.added = sorted((a.encode() for a in added), key=len, reverse=True)

    def split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, words): word places in bytes, and the n + 1 word bounds of the texts."""
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(bounds), np.int64)
        raw = data.tobytes()
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[code]
        edge = np.zeros(len(code) + 1, bool)  # no word goes on over an edge
        edge[np.searchsorted(chars, bounds)] = True
        whole: list[tuple[int, int]] = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                a, b = np.searchsorted(chars, (at, at + len(token)))
                if not edge[a + 1 : b].any() and not any(x < b and a < y for x, y in whole):
                    whole.append((int(a), int(b)))
                at = raw.find(token, at + 1)
        for a, b in whole:
            edge[a] = edge[b] = True
            kind[a:b] = LETTER
        run = edge[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        # the last of the spaces before a word: a blank belongs to the word, others stand alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1])
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        # apostrophes that open a word, with an ending
        mark = np.flatnonzero((code == 39) & run & start)
        whole_marks = np.zeros(len(code), bool)
        for a, b in whole:
            whole_marks[a:b] = True
        mark = mark[~whole_marks[mark]]
        for ending in ENDINGS:
            size = len(ending)
            m = mark[mark + size < len(code)]
            fits = np.ones(len(m), bool)
            for i, c in enumerate(ending):
                fits &= (code[m + 1 + i] == c) & ~edge[m + 1 + i] & ~whole_marks[m + 1 + i]
            m = m[fits]
            start[m + 1] = False
            after = m + 1 + size
            after = after[after < len(code)]
            start[after] |= True
        first = np.flatnonzero(start)
        starts = chars[first]
        return starts, np.append(starts[1:], n), np.searchsorted(starts, bounds)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, each in the fewest of 1, 2 or 4 bytes, compressed."""
    small = [a.astype(next(k for k in (np.uint8, np.uint16, np.uint32) if not len(a) or a.max() <= np.iinfo(k).max)) for a in arrays]
    body = b"".join(a.tobytes() for a in small)
    head = np.array([len(body), *(x for a in small for x in (a.itemsize, len(a)))], np.int64).tobytes()
    return head + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def _unpack(packed: bytes, n: int) -> list[np.ndarray]:
    size, *head = np.frombuffer(packed, np.int64, 2 * n + 1).tolist()
    body = pa.decompress(packed[8 * (2 * n + 1) :], size, "zstd", asbytes=True) if size else b""
    out, at = [], 0
    for width, count in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(body, f"u{width}", count, at))
        at += width * count
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all the slices starts[i] : starts[i] + sizes[i], one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _split_pass(classes: tuple, added: list[str], buckets: int, groups: int, id_type: pa.DataType):
    schema = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(id_type)), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, hasher = Splitter(classes, added), Hasher(21)
        for ids, texts in _gathered(batches):
            data, bounds = text_arrays(texts)
            first = 0
            while first < len(ids):
                last = int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES, "right")) - 1
                last = min(max(last, first + 1), len(ids))
                yield _block(data, bounds[first : last + 1], ids.slice(first, last - first), splitter, hasher, buckets, groups, schema)
                first = last
            trim()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches put together until they make a block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.concat_arrays([b.column("id") for b in held]), pa.concat_arrays([b.column("text") for b in held])
            held = []
    if held:
        yield pa.concat_arrays([b.column("id") for b in held]), pa.concat_arrays([b.column("text") for b in held])


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word among the distinct ones, the distinct words' sizes, their bytes); words are told apart by their bytes.

    ``parts``: pairs of n + 1 bounds and the bytes between them.
    """
    words = pa.chunked_array([pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]) for bounds, data in parts], pa.binary())
    coded = words.dictionary_encode().combine_chunks()
    known = coded.dictionary
    _, offsets, data = known.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(known) + 1)
    return coded.indices.to_numpy(), np.diff(bounds), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _block(data: np.ndarray, bounds: np.ndarray, ids: pa.Array, splitter: Splitter, hasher: Hasher, buckets: int, groups: int, schema: pa.Schema) -> pa.RecordBatch:
    """A block's rows: its words' places under its own key, its distinct words under their buckets' keys."""
    counts, parts = [np.zeros(0, np.int64)], []
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        part = data[bounds[first] : bounds[last]]
        starts, _, words = splitter.split(part, bounds[first : last + 1] - bounds[first])
        counts.append(np.diff(words))
        parts.append((np.append(starts, len(part)), part))
        first = last
    place, size, text = _distinct(parts)
    begin = np.cumsum(size, dtype=np.int64) - size
    of = (hasher.of_bytes(text, begin, begin + size) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(of, kind="stable")
    of, size, begin = of[order].astype(np.int64), size[order], begin[order]
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    place = rank[place]
    # the planes of a number's bytes compress better than the numbers; keys of blocks lie above those of buckets
    planes = [(place >> np.uint32(8 * i)).astype(np.uint8) for i in range(4)]
    mark = f"{ids[0]} {ids[-1]} {n} {len(place)} {hashlib.sha256(place.tobytes()).hexdigest()} {hashlib.sha256(data[bounds[0] : bounds[-1]].tobytes()).hexdigest()}"
    block = (int.from_bytes(hashlib.sha256(mark.encode()).digest()[:8]) & ((1 << 62) - 1)) | (1 << 40)
    rows: dict[str, list] = {"key": [block], "block": [block], "bucket": [-1], "ids": [ids.to_pylist()], "packed": [_pack(np.concatenate(counts), *planes)]}
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=buckets))
    for a, b in itertools.pairwise(cuts.tolist()):
        rows["key"].append(int(of[a]) + buckets * (block % groups))
        rows["block"].append(block)
        rows["bucket"].append(int(of[a]))
        rows["ids"].append(None)
        rows["packed"].append(_pack(size[a:b], text[ragged(begin[a:b], size[a:b])]))
    return pa.RecordBatch.from_pydict(rows, schema)


def _encode_pass(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode_batch_fast
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out: dict[str, list] = {"block": [], "bucket": [], "answer": []}
            for block, bucket, packed in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
                if bucket < 0:
                    continue
                size, letters = _unpack(packed.as_py(), 2)
                ends = np.cumsum(size, dtype=np.int64)
                raw = letters.tobytes()
                words = [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in words if w not in known]
                for w, e in zip(new, encode([w.decode("utf-8") for w in new], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.uint32).tobytes()
                ids = [known[w] for w in words]
                counts = np.array([len(i) // 4 for i in ids], np.uint32)
                out["block"].append(block)
                out["bucket"].append(bucket)
                out["answer"].append(_pack(counts, np.frombuffer(b"".join(ids), np.uint32)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())]))
        known.clear()
        trim()

    return run


def _place_pass(id_type: pa.DataType, path: str | None):
    """Ids of each block's texts, a few texts at a time; with a ``path`` also what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path) if path else None
        for batch in batches:
            for row in np.flatnonzero(batch.column("bucket").to_numpy() < 0).tolist():
                counts, *planes = _unpack(batch.column("packed")[row].as_py(), 5)
                place = np.zeros(len(planes[0]), np.uint32)
                for i, p in enumerate(planes):
                    place |= p.astype(np.uint32) << np.uint32(8 * i)
                told = {a["bucket"]: a["answer"] for a in (batch.column("answers")[row].as_py() or [])}
                sizes, ids = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
                for bucket in sorted(told):
                    c, i = _unpack(told[bucket], 2)
                    sizes.append(c)
                    ids.append(i)
                size, known = np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
                begin = np.cumsum(size) - size
                own = batch.column("ids")[row].values
                bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                for a in range(0, len(own), TEXTS):
                    b = min(a + TEXTS, len(own))
                    p = place[bounds[a] : bounds[b]]
                    flat = known[ragged(begin[p], size[p])].astype(np.int32)
                    ends = np.concatenate([[0], np.cumsum(size[p])])[bounds[a : b + 1] - bounds[a]]
                    columns = [own.slice(a, b - a).cast(id_type), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
                    if pieces:
                        columns.append(_decoded(flat, ends, pieces))
                    yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])
            trim()

    return run


def _decoded(ids: np.ndarray, bounds: np.ndarray, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The texts of ids[bounds[i] : bounds[i + 1]]: their pieces' bytes, one after another."""
    data, starts, sizes = pieces
    out = []
    for a, b in itertools.pairwise(bounds.tolist()):
        own = ids[a:b]
        own = own[(own >= 0) & (own < len(sizes))]
        out.append(data[ragged(starts[own], sizes[own])].tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids: array<int>) for every row, and with ``decoded`` what decode() would add, without another pass.

    ``path``: a tokenizers file that all workers can read.
    """
    added, plain = settings(path)
    if not plain:
        raise ValueError("only plain byte-level BPE tokenizers are supported")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = source.schema["id"].dataType
    id_type = pa.schema(spark.createDataFrame([], T.StructType([T.StructField("id", id_kind)])).toArrow().schema).field("id").type
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(partitions, BUCKETS)
    groups = -(-partitions // buckets)
    fixed = lambda name, kind: T.StructField(name, kind, False)  # noqa: E731  not null: both uses of the shuffle stay alike, so it runs once
    schema = T.StructType([fixed("key", T.LongType()), fixed("block", T.LongType()), fixed("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(id_kind)), fixed("packed", T.BinaryType())])
    sent = source.mapInArrow(_split_pass(char_classes(), added, buckets, groups, id_type), schema).repartition("key")
    told = sent.mapInArrow(_encode_pass(path), "block long, bucket int, answer binary")
    answers = told.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    # buckets' rows find no answer under their own key; blocks without words have none either
    met = sent.join(answers, sent["key"] == answers["of"], "left").drop("of")
    fields = [T.StructField("id", id_kind), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded
    placed = met.mapInArrow(_place_pass(id_type, path if decoded else None), T.StructType(fields))
    return placed.withColumnRenamed("id", id_col)


@cache
def pieces_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of every id's piece."""
    tok = _tokenizer(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet shows these as themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = set(settings(path)[0])
    n = max(tok.get_vocab().values()) + 1
    pieces = []
    for i in range(n):
        p = tok.id_to_token(i) or ""
        pieces.append(p.encode() if p in added else bytes(byte_of[c] for c in p))
    sizes = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of the ids; of no or null ids the empty text. Unknown ids add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                rows = batch.column(ids_col)
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
                out = _decoded(rows.flatten().to_numpy(zero_copy_only=False), bounds, pieces)
                yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row. Kept as a table, so that Python's batches are small."""
    both = encode(docs, path, id_col, text_col, decoded=True)
    told = both.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return Scratch(docs.sparkSession, "bpe").keep(told)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return digests(table(spark, sf_dir, "documents"), default_path())
