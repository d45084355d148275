"""Byte-level BPE encoding and decoding.

Texts are cut into words by the tokenizer's pattern, and each distinct word of the table is encoded
once, unless it is a token itself: a fold over its bytes merges, step by step, the adjacent pieces of
the lowest rank, leftmost first, until no pair has a rank. The fold is a composition of Spark's
higher-order functions over arrays of piece ids. The rank map, from pairs of ids to the id of what
they form, is one literal of the plan: an array of small maps, so that a lookup takes constant time. Words over LONG bytes, on which a fold takes quadratic time, are merged
by the tokenizer library instead. Decoding concatenates the ids' binary pieces.

Words are counted by the texts that have them. Those of two texts or more are encoded first, once each, and reach the
texts as sorted arrays (about 20 bytes a word) on every executor, of which a task keeps what its texts
use. Only up to BROADCAST_WORDS of them, those of the most texts: all other words, which are mostly of one text
only, are encoded by the same fold in the rows of the texts that have them, so that no word's place is ever shuffled.

Defined results: null text counts as empty: no ids; repeated rows are encoded each; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow
from .common import let, written
from .tokens import default_path, read_ranks

LONG = 256
BROADCAST_WORDS = 4_000_000
#: Distinct words that a task holds before it passes them on, and encoded ones that it keeps.
HELD = 400_000
#: Slots of the rank map, and what makes one number of two ids (below WIDE); primes, so that the numbers spread.
SLOTS = 131_071
WIDE = 1_000_003
#: Fixed value: Unicode's white space, which is what the library's pattern means by \\s.
WHITE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _spelled(pattern: str, letters: str | None = None, numbers: str | None = None) -> str:
    """The pattern with white space, and letters and numbers if given, spelled out as members of classes."""
    inside = f"{letters or chr(92) + 'p{L}'}{numbers or chr(92) + 'p{N}'}"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", "\0")
    if letters and numbers:
        out = out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    out = out.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return out.replace("\0", f"[^{WHITE}{inside}]")


class Splitter:
    """Cuts texts like the tokenizer library: by ``regex``, and Latin-1 texts by an equal pattern of ``re``, which is faster."""

    def __init__(self, pattern: str):
        import re

        import regex

        self.general = regex.compile(_spelled(pattern))
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c)))
        latin = _spelled(pattern, of(r"\p{L}"), of(r"\p{N}"))
        self.latin = None if "\\p" in latin else re.compile(latin)

    def findall(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.general.findall(text)
        return (self.latin or self.general).findall(text)


@cache
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


@cache
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@cache
def _pieces(path: str) -> dict[int, bytes]:
    return {i: b for b, i in read_ranks(path).items()}


@cache
def _library(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})


def merge_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map, one literal in the end: from two ids to the id, which is the rank, of the piece that they form.

    struct<k, v>: by slot the pairs that fall there, as numbers, and what they form.
    """
    keys: list[list[int]] = [[] for _ in range(SLOTS)]
    values: list[list[int]] = [[] for _ in range(SLOTS)]
    for whole, i in ranks.items():
        for k in range(1, len(whole)):
            a, b = ranks.get(whole[:k]), ranks.get(whole[k:])
            if a is not None and b is not None:
                key = a * WIDE + b
                keys[key % SLOTS].append(key)
                values[key % SLOTS].append(i)
    return F.from_json(F.lit(json.dumps({"k": keys, "v": values}, separators=(",", ":"))), "k array<array<bigint>>, v array<array<int>>")


def byte_literal(ranks: dict[bytes, int]) -> Column:
    """The ids of single bytes, by the top byte of their crc32, which differs for all."""
    out = [0] * 256
    for b in range(256):
        out[zlib.crc32(bytes([b])) >> 24] = ranks[bytes([b])]
    return F.from_json(F.lit(json.dumps(out)), "array<int>")


def folds(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>>: the ids of words of two bytes or more."""

    def encoded(pairs: Column, formed: Column, singles: Column, raw: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            # The number is written out three times: binding it would cost more than computing it.
            key = a * F.lit(WIDE).cast("long") + b
            slot = (key % SLOTS).cast("int")
            return F.get(F.get(formed, slot), F.array_position(F.get(pairs, slot), key).cast("int") - 1)

        # The state: pieces p and the ranks r of neighbouring pairs, of which a merge changes two.
        def state(p: Column, r: Column) -> Column:
            return F.struct(p.alias("p"), r.alias("r"))

        def merged(p: Column, r: Column, best: Column, k: Column) -> Column:
            """k: from 1, the place of the left piece."""
            none, many = F.array().cast("array<int>"), F.size(r)
            left = F.when(k > 1, F.array(rank(F.get(p, k - 2), best))).otherwise(none)
            right = F.when(k < many, F.array(rank(best, F.get(p, k + 1)))).otherwise(none)
            pieces = F.concat(F.slice(p, F.lit(1), k - 1), F.array(best), F.slice(p, k + 2, many))
            return state(pieces, F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, many)))

        def step(a: Column, _: Column) -> Column:
            at = lambda best: let(F.array_position(a["r"], best).cast("int"), lambda k: merged(a["p"], a["r"], best, k))
            return let(F.array_min(a["r"]), lambda best: F.when(best.isNull(), a).otherwise(at(best)))

        def whole(start: Column) -> Column:
            ranks_ = F.transform(F.slice(start, F.lit(1), n - 1), lambda x, i: rank(x, F.get(start, i + 1)))
            return F.aggregate(F.sequence(F.lit(1), n - 1), state(start, ranks_), step, lambda a: a["p"])

        n = F.octet_length(raw)
        start = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(singles, F.shiftright(F.crc32(F.substring(raw, i, F.lit(1))), 24).cast("int")))
        return let(start, whole)

    each = lambda k, v, one: F.transform(words, lambda word: let(word.cast("binary"), lambda raw: encoded(k, v, one, raw)))
    bound = lambda t: let(t["k"], lambda k: let(t["v"], lambda v: let(byte_literal(ranks), lambda one: each(k, v, one))))
    return let(merge_literal(ranks), bound)


def fold(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int>: the ids of a word of two bytes or more."""
    return F.get(folds(F.array(word), ranks), F.lit(0))


def counted_words(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(word, n): every distinct match of the pattern in the texts of (id, text) that isn't a token as it stands, nor over
    LONG bytes, if two texts or more have it; n: how many."""

    def run(batches):
        split, held, ranks = splitter(pattern), Counter(), _ranks(path)

        def rows():
            new = [w for w in held if _needs_fold(w, ranks)]
            out = pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.array([held[w] for w in new], pa.int32())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(set(split.findall(text.as_py() or "")))
                if len(held) > HELD:
                    yield rows()
        yield rows()

    return map_in_arrow(docs.select("text"), run, "word string, n int").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def _needs_fold(word: str, ranks: dict[bytes, int]) -> bool:
    b = word.encode()
    return b not in ranks and len(b) <= LONG


def encoded_words(docs: DataFrame, path: str, pattern: str, most: int = BROADCAST_WORDS) -> DataFrame:
    """(word, ids) of the words that the most texts have, ``most`` of them at most."""
    found = written(counted_words(docs, path, pattern), "bpe-counted")
    left, least = most, 0
    # Words of equally many texts come all or none; there are few different numbers that matter.
    for row in found.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect():
        left -= row["count"]
        if left < 0:
            break
        least = row["n"]
    found = found.where(F.col("n") >= least) if least else found.limit(0)
    # Dealt by hash, so that no task folds much more than others.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = found.repartition(parts, "word")
    return written(found.select("word", fold(F.col("word"), read_ranks(path)).alias("ids")), "bpe-words")


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _packed(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first id's place with one more at the end, ids), by hash."""

    def run(batches):
        for batch in batches:
            h = np.fromiter((word_hash(w.as_py()) for w in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(1)], names=["h", "ids"])

    table = map_in_arrow(words, run, "h long, ids array<int>").toArrow()
    h = table["h"].to_numpy().view(np.uint64)
    lists = table["ids"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    order = np.argsort(h)
    lengths = np.diff(at)[order]
    starts = np.concatenate(([0], np.cumsum(lengths)))
    source = np.repeat(at[:-1][order] - starts[:-1], lengths) + np.arange(starts[-1])
    return h[order], starts.astype(np.uint32 if starts[-1] < 1 << 32 else np.uint64), flat[source].astype(np.uint16 if len(flat) == 0 or flat.max() < 1 << 16 else np.uint32)


@cache
def _laid_out(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all pieces' bytes, each id's start there, each id's length)."""
    pieces = _pieces(path)
    lengths = np.array([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)], np.int64)
    return np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(lengths))), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(ids: bytes, path: str) -> bytes:
    """The concatenated pieces of 32-bit ids."""
    data, start, length = _laid_out(path)
    k = np.frombuffer(ids, "<u4")
    n = length[k]
    ends = np.cumsum(n)
    return data[np.repeat(start[k] - (ends - n), n) + np.arange(ends[-1] if len(k) else 0)].tobytes()


def _result(ids: bytes, path: str) -> tuple[int, str, str]:
    """(number of ids, sha256 of the ids, sha256 of what they decode to)."""
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()


_SCHEMA = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _batch(ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Every row: id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    path, pattern = path or default_path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = encoded_words(docs, path, pattern, broadcast_words)
    rows = _known(docs, words, path, pattern)
    # Null where a text has no other words, so that the fold's literal is not bound for it.
    other = F.when(F.size("other") > 0, folds(F.col("other"), read_ranks(path)))
    out = _finished(rows.select("id", "ids", other.alias("other")), path)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def _known(docs: DataFrame, words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, other): 32-bit ids of each text, with -1 - k in place of the k-th of its ``other`` words."""
    shared = docs.sparkSession.sparkContext.broadcast(_packed(words))

    def run(batches):
        hashes, starts, flat = shared.value
        split, pieces, ranks = splitter(pattern), _pieces(path), _ranks(path)
        ids_of: dict[str, bytes] = {}
        tokens = {b.decode(): i.to_bytes(4, "little") for b, i in ranks.items() if _is_text(b)}

        def learn(new: list[str]) -> list[str]:
            """Those that aren't among the shared words."""
            at = np.fromiter(map(word_hash, new), np.uint64, len(new))
            found = np.searchsorted(hashes, at)
            there = hashes[np.minimum(found, len(hashes) - 1)] == at if len(hashes) else np.zeros(len(new), bool)
            found = np.where(there, found, 0)
            none = []
            for word, ok, a, z in zip(new, there.tolist(), starts[found].tolist(), starts[np.minimum(found + 1, len(starts) - 1)].tolist(), strict=True):
                ids = flat[a:z] if ok else ()
                # Another word's hash may be the same.
                if ok and b"".join(map(pieces.__getitem__, ids.tolist())) == word.encode():
                    ids_of[word] = ids.astype("<u4").tobytes()
                else:
                    none.append(word)
            return none

        for batch in batches:
            packed, others = [], []
            for text in batch.column(1):
                words = split.findall(text.as_py() or "")
                unseen = set(words).difference(ids_of)
                other = []
                if unseen:
                    ids_of.update((w, tokens[w]) for w in unseen if w in tokens)
                    ids_of.update((w, np.array(_library(path).encode_ordinary(w), "<u4").tobytes()) for w in unseen if len(w.encode()) > LONG and w not in tokens)
                    new = [w for w in unseen if w not in ids_of]
                    other = learn(new) if new else []
                if other:
                    ids_of.update((w, (-1 - k).to_bytes(4, "little", signed=True)) for k, w in enumerate(other))
                packed.append(b"".join(map(ids_of.__getitem__, words)))
                others.append(other)
                for w in other:
                    del ids_of[w]
                if len(ids_of) > 2 * HELD:
                    ids_of.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(others, pa.list_(pa.string()))], names=["id", "ids", "other"])

    return map_in_arrow(docs, run, "id long, ids binary, other array<string>")


def _is_text(b: bytes) -> bool:
    try:
        return bool(b.decode())
    except UnicodeDecodeError:
        return False


def _filled(ids: bytes, other: list[np.ndarray]) -> bytes:
    """The ids with those of the other words in their places."""
    known = np.frombuffer(ids, "<i4")
    at = np.flatnonzero(known < 0)
    parts, before = [], 0
    for k in at.tolist():
        parts += (ids[4 * before : 4 * k], other[-1 - known[k]])
        before = k + 1
    return b"".join((*parts, ids[4 * before :]))


def _finished(rows: DataFrame, path: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for ids, other in zip(batch.column(1), batch.column(2), strict=True):
                more = other.as_py() or ()
                out.append(_result(_filled(ids.as_py(), [np.array(x, "<u4").tobytes() for x in more]) if more else ids.as_py(), path))
            yield _batch(batch.column(0), out)

    return map_in_arrow(rows, run, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
