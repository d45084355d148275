"""Suffix-array dedup: bytes covered by a SPAN-byte string that also starts in an earlier document go; the first keep theirs.

A suffix array of a corpus can't be built in one place, and shipping every suffix costs SPAN times the
corpus. So suffixes meet in groups that hold all partners of each of them, and groups that can hold no match
are left out before any text moves.

1. Documents are packed into blocks, a written table of compressed bytes. Within a window of SPAN bytes the
   k-mer with the least hash names its group: equal windows have equal names. Runs of windows with one
   name are a fragment, about twenty windows long.
2. Fragments meet by name as fingerprints of a few bytes each, one for each block and different fragment. A
   fragment that an earlier document also has is removed whole. A name that no other fragment has is done:
   none of its windows starts anywhere else. That is most of a corpus.
3. Fragments of the names that remain travel with their bytes, one for each block. Their suffixes are sorted,
   to the depth SPAN. In suffix order, with equal ones by document, the previous smaller document of a suffix
   is the last one before its own document's run, and the next smaller lies beyond the suffixes that share
   SPAN bytes with it: so the longest previous factor reaches SPAN exactly if the previous smaller document
   has the same SPAN bytes. Such suffixes start a removed string.
4. A name with more than CROWDED different fragments in a block, or more than HOT in all, would make a group that
   grows with the corpus. Its windows meet one by one as fingerprints of their own, again one for each
   block and different window, so that no group holds more than a few rows from each block.
5. Every block gets its results back, and each document the union of what its starts cover.

Fingerprints have 80 bits, and some more by the group that they meet in; suffixes are compared byte by
byte. What meets in a task is bounded by RECORDS and FRAGMENTS and, for a single name, by a few
fingerprints from each block; nothing but counts comes to the driver.

Defined results: a null text counts as empty; texts under SPAN bytes keep all; a row with null id
keeps all and removes nothing from others; rows with one id remove nothing from each other; ties don't
occur beyond that; texts of any length are read whole, in slices; kept bytes may end inside a character,
and so are binary; an empty table gives no rows. Extra columns, of any name, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow, ship
from .common import discard, written
from .wordhash import mix

SPAN = 50
#: Bytes of text of a block, and positions that are hashed at once.
BLOCK = 8 << 20
SLICE = 1 << 17
#: Windows of a fragment at most.
LONGEST = 4096
#: Different fragments of a name, in a block and in all, beyond which its windows meet one by one.
CROWDED, HOT = 4, 1 << 16
#: Fingerprints, and fragments with their bytes, that meet in a task, about.
RECORDS, FRAGMENTS = 1 << 20, 1 << 16
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
CLEAN, REMOVED, OPEN, BY_WINDOW = 0, 1, 2, 3
#: Kinds of results that a block gets back.
OF_FRAGMENTS, OF_WINDOWS, OF_SUFFIXES = 0, 1, 2
_SENT = "block long, kind int, bucket int, n int, data binary, crowded binary"
_BACK = "block long, kind int, bucket int, n int, open long, by_window long, data binary"


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse modulo 2**64, to the powers from 0 on."""
    if (base, n) not in _POWERS:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out, have = np.ones(n, _U), 1
            while have < n:
                more = min(have, n - have)
                out[have : have + more] = out[:more] * _U(pow(b, have, 1 << 64))
                have += more
            both.append(out)
        _POWERS[base, n] = both[0], both[1]
    return _POWERS[base, n]


class Hashed:
    """Hashes of any substrings of up to SLICE + span bytes, in a few operations for all."""

    def __init__(self, data: np.ndarray, span: int, base: int = _BASES[0]):
        power, self.inverse = _powers(base, SLICE + span + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start, end, salt=0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + _U(1) * np.asarray(salt, _U))

    def kmers(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        h, done = np.minimum(h[:-done], h[done:]), 2 * done
    rest = width - done
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def fragments(data: np.ndarray, starts: np.ndarray, takes: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, document, name, fingerprint) of the fragments of texts that lie one after another, in order."""
    k = max(1, span // 3)
    out = []
    for a in range(0, max(0, len(data) - span + 1), SLICE):
        piece = data[a : a + SLICE + span - 1]
        hashed = Hashed(piece, span)
        least = _least(hashed.kmers(k), span - k + 1)
        n = len(least)
        d0, d1 = np.searchsorted(starts, [a, a + n - 1], side="right") - 1
        edges = np.clip(starts[d0 : d1 + 2] - a, 0, n)
        docs = np.repeat(np.arange(d0, d1 + 1), np.diff(edges))
        valid = takes[docs] & (np.arange(a, a + n) + span <= starts[docs + 1])
        change = valid.copy()
        change[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        first = np.flatnonzero(change)
        # A run ends where the next one begins or its text's windows do.
        last_valid = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
        end = np.minimum(np.append(first[1:], n), last_valid[np.searchsorted(last_valid, first, side="right")] if len(first) else first)
        parts = -(-(end - first) // LONGEST)
        at = np.repeat(first, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        count = np.minimum(np.repeat(end, parts) - at, LONGEST)
        out.append((at + a, count, docs[at], mix(least[at]), hashed.of(at, at + count + span - 1, count)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def windows(data: np.ndarray, first: np.ndarray, count: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, name, fingerprint) of every window of the fragments; those of a slice lie in it."""
    out = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))]
    for a in range(0, len(data), SLICE):
        i, j = np.searchsorted(first, [a, a + SLICE])
        if i < j:
            piece = data[a : a + SLICE + span - 1]
            at = _expanded(first[i:j], count[i:j]) - a
            out.append((at + a, *(Hashed(piece, span, base).of(at, at + span) for base in _BASES)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Records:
    """A block's records (name, fingerprint, document): those that it sends to the buckets, and the states that come back."""

    def __init__(self, name: np.ndarray, print_: np.ndarray, doc: np.ndarray, buckets: int, crowded: int | None = None):
        self.name, self.print, self.doc = name, print_ & _U((1 << 48) - 1), doc
        order = np.lexsort((doc, self.print, name))
        n, p = name[order], self.print[order]
        new_name = np.ones(len(n), bool)
        new_name[1:] = n[1:] != n[:-1]
        new = new_name.copy()
        new[1:] |= p[1:] != p[:-1]
        # Of equal records the one of the smallest document stands for all.
        self.stands = np.empty(len(n), np.int64)
        leaders = order[new]
        self.stands[order] = leaders[np.cumsum(new) - 1] if len(n) else leaders
        self.over = np.zeros(0, _U)
        if crowded is not None and len(leaders):
            starts = np.flatnonzero(new_name[new])
            sizes = np.diff(np.append(starts, len(leaders)))
            self.over = name[leaders[starts[sizes > crowded]]]
            leaders = leaders[np.arange(len(leaders)) - np.repeat(starts, sizes) < crowded]
        bucket = ((name[leaders] >> _U(32)) * _U(buckets)) >> _U(32)
        by = np.lexsort((leaders, bucket))
        self.sent, self.bucket = leaders[by], bucket[by].astype(np.int64)
        self.buckets = buckets

    def rows(self, block: int, kind: int):
        """(block, kind, bucket, n, data, crowded) for every bucket that gets records."""
        over = ((self.over >> _U(32)) * _U(self.buckets)) >> _U(32)
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1)).tolist()
        for a, z in zip(edges, [*edges, len(self.sent)][1:], strict=True):
            own, b = self.sent[a:z], int(self.bucket[a])
            base = int(self.doc[own].min())
            apart = self.doc[own] - base  # modulo 2**64 where ids lie that far apart
            width = next(w for w in (2, 4, 8) if w == 8 or (apart.min() >= 0 and int(apart.max()) < 1 << (8 * w)))
            parts = (np.array([base, width], np.int64), self.name[own].astype(np.uint32), self.print[own].astype(np.uint32), (self.print[own] >> _U(32)).astype(np.uint16), apart.astype(f"u{width}"))
            yield {"block": block, "kind": kind, "bucket": b, "n": z - a, "data": b"".join(x.tobytes() for x in parts), "crowded": self.over[over == b].astype(np.uint32).tobytes()}

    def states(self, back: dict[int, bytes]) -> np.ndarray:
        """The state of every record."""
        out = np.zeros(len(self.name), np.uint8)
        for b in np.unique(self.bucket).tolist():
            out[self.sent[slice(*np.searchsorted(self.bucket, [b, b + 1]))]] = np.frombuffer(back[b], np.uint8)
        if len(self.over):
            out[self.stands[np.isin(self.name, self.over)]] = BY_WINDOW
        out = out[self.stands]
        out[self.doc > self.doc[self.stands]] = REMOVED
        return out


def _read(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, fingerprint, document) of a row of ``Records``."""
    base, width = np.frombuffer(data, np.int64, 2)
    name = np.frombuffer(data, np.uint32, n, 16)
    low, high = np.frombuffer(data, np.uint32, n, 16 + 4 * n), np.frombuffer(data, np.uint16, n, 16 + 8 * n)
    doc = np.frombuffer(data, f"u{width}", n, 16 + 10 * n).astype(np.int64) + base
    return name, low.astype(_U) | (high.astype(_U) << _U(32)), doc


def _met(name: np.ndarray, print_: np.ndarray, doc: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """The state of every record of a bucket."""
    order = np.lexsort((doc, print_, name))
    n, p, d = name[order], print_[order], doc[order]
    new_name = np.ones(len(n), bool)
    new_name[1:] = n[1:] != n[:-1]
    new = new_name.copy()
    new[1:] |= p[1:] != p[:-1]
    starts, names = np.flatnonzero(new), np.flatnonzero(new_name)
    earliest = d[starts]
    of = np.cumsum(new) - 1
    group = np.cumsum(new_name) - 1
    first_of_name = of[names]
    different = np.diff(np.append(first_of_name, len(starts)))
    both = np.minimum.reduceat(earliest, first_of_name) < np.maximum.reduceat(earliest, first_of_name)
    state = np.where(different == 1, CLEAN, np.where(different > HOT, BY_WINDOW, OPEN)) * both
    if len(crowded):
        state = np.where(np.isin(n[names], crowded), BY_WINDOW, state)
    out = np.empty(len(n), np.uint8)
    out[order] = np.where(d > earliest[of], REMOVED, state[group])
    return out


def _meet(table: pa.Table) -> pa.Table:
    """States of the records of a bucket, a row for each block."""
    counts = table["n"].to_numpy()
    read = [_read(x.as_py(), n) for x, n in zip(table["data"], counts.tolist(), strict=True)]
    crowded = np.frombuffer(b"".join(x.as_py() for x in table["crowded"]), np.uint32)
    state = _met(*(np.concatenate(x) for x in zip(*read, strict=True)), np.unique(crowded))
    parts = np.split(state, np.cumsum(counts)[:-1])
    count = lambda what: pa.array([int((p == what).sum()) for p in parts], pa.int64())
    return pa.Table.from_arrays(
        [table["block"], table["kind"], table["bucket"], table["n"], count(OPEN), count(BY_WINDOW), pa.array([p.tobytes() for p in parts], pa.binary())],
        names=["block", "kind", "bucket", "n", "open", "by_window", "data"],
    )


def repeated(text: np.ndarray, at: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Which of the suffixes at ``at`` share their first ``span`` bytes with one of a smaller document: whose longest previous factor is ``span`` or more."""
    n = len(text) - 7
    eight = np.zeros(max(0, n), _U)
    for i in range(8):
        eight = (eight << _U(8)) | text[i : n + i]
    depths = [*range(0, span - 7, 8)]
    depths += [span - 8] if depths[-1] != span - 8 else []
    # Suffix order by eight bytes at a time; a suffix that is alone so far has no partner.
    which, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in depths:
        key = eight[at[which] + depth]
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        which, key, group = which[order], key[order], group[order]
        new = np.ones(len(which), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        shared = np.bincount(group, minlength=1)[group] > 1
        which, group = which[shared], group[shared]
    order = np.lexsort((doc[which], group))
    which, group = which[order], group[order]
    d = doc[which]
    run = np.ones(len(which), bool)
    run[1:] = (group[1:] != group[:-1]) | (d[1:] != d[:-1])
    previous = np.flatnonzero(run)[np.cumsum(run) - 1] - 1 if len(which) else which
    out = np.zeros(len(at), bool)
    out[which[(previous >= 0) & (group[previous] == group)]] = True
    return out


def _suffixes(span: int):
    def run(table: pa.Table) -> pa.Table:
        heads, texts, blocks = [], [], table["block"].to_pylist()
        for n, data in zip(table["n"].to_pylist(), table["data"], strict=True):
            raw = data.as_py()
            heads.append(np.frombuffer(raw, np.int64, 3 * n).reshape(3, n))
            texts.append(np.frombuffer(raw, np.uint8, offset=24 * n))
        record, doc, size = np.concatenate(heads, 1)
        owner = np.repeat(np.arange(len(heads)), [h.shape[1] for h in heads])
        start = np.cumsum(size) - size
        count = size - span + 1
        hit = repeated(np.concatenate(texts), _expanded(start, count), np.repeat(doc, count), span)
        # Runs of hits within a fragment, as (record, from, to).
        fragment = np.repeat(np.arange(len(size)), count)
        place = _expanded(np.zeros(len(size), np.int64), count)
        begins, ends = hit.copy(), hit.copy()
        begins[1:] &= ~hit[:-1] | (fragment[1:] != fragment[:-1])
        ends[:-1] &= ~hit[1:] | (fragment[1:] != fragment[:-1])
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        own = owner[fragment[begins]]
        out = []
        for i in np.unique(own).tolist():
            mine = own == i
            rows = np.stack([record[fragment[begins[mine]]], place[begins[mine]], place[ends[mine]] + 1])
            out.append({"block": blocks[i], "kind": OF_SUFFIXES, "bucket": 0, "n": rows.shape[1], "open": 0, "by_window": 0, "data": rows.astype(np.int32).tobytes()})
        return pa.Table.from_pylist(out, _schema(_BACK))

    return run


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in text.split(", "))])


def _pack(batches):
    """Blocks (block, ids, starts, size, data) of rows (id, text)."""
    number, ids, raw, starts = TaskContext.get().partitionId() << 32, [], [], [0]

    def block():
        data = b"".join(raw)
        return pa.RecordBatch.from_pylist([{"block": number, "ids": ids, "starts": starts, "data": pa.compress(data, codec="zstd", asbytes=True)}], pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("data", pa.binary())]))

    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        for i, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            one = text.as_buffer()
            if ids and starts[-1] + one.size > BLOCK:
                yield block()
                number, ids, raw, starts = number + 1, [], [], [0]
            ids.append(i)
            raw.append(one)
            starts.append(starts[-1] + one.size)
    if ids:
        yield block()


class Block:
    """A block's texts and fragments."""

    def __init__(self, ids, starts, data: bytes, span: int, buckets: int):
        self.starts = np.array(starts.as_py(), np.int64)
        size = int(self.starts[-1])
        self.raw = np.frombuffer(pa.decompress(data, size, codec="zstd") if size else b"", np.uint8)
        self.ids = ids.as_py()
        self.takes = np.array([i is not None for i in self.ids], bool)
        self.numbers = np.array([i or 0 for i in self.ids], np.int64)
        self.span = span
        self.first, self.count, self.doc, self.name, print_ = fragments(self.raw, self.starts, self.takes, span)
        self.records = Records(self.name, print_, self.numbers[self.doc], buckets, CROWDED)

    def by_window(self, states: np.ndarray, buckets: int) -> tuple[np.ndarray, Records]:
        """(positions, records) of the windows of fragments that meet by window."""
        mine = states == BY_WINDOW
        at, name, print_ = windows(self.raw, self.first[mine], self.count[mine], self.span)
        return at, Records(name, print_, np.repeat(self.numbers[self.doc[mine]], self.count[mine]), buckets)

    def open_rows(self, block: int, states: np.ndarray, buckets: int):
        """Rows (block, kind, bucket, n, data, crowded) with the bytes of fragments whose suffixes are to be sorted."""
        mine = np.flatnonzero((states == OPEN) & (self.records.stands == np.arange(len(states))))
        bucket = (((self.name[mine] >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        mine, bucket = mine[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for a, z in zip(edges, [*edges, len(mine)][1:], strict=True):
            own = mine[a:z]
            size = self.count[own] + self.span - 1
            head = np.stack([own, self.numbers[self.doc[own]], size])
            yield {"block": block, "kind": OF_SUFFIXES, "bucket": int(bucket[a]), "n": z - a, "data": head.astype(np.int64).tobytes() + self.raw[_expanded(self.first[own], size)].tobytes(), "crowded": b""}

    def starts_removed(self, states: np.ndarray, back: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of ranges of positions at which a string to be removed starts."""
        gone = states == REMOVED
        out = [(self.first[gone], self.first[gone] + self.count[gone])]
        if (states == BY_WINDOW).any():
            at, records = self.by_window(states, buckets)
            hit = at[records.states(back[OF_WINDOWS]) == REMOVED]
            out.append((hit, hit + 1))
        rows = np.concatenate([np.frombuffer(x, np.int32).reshape(3, -1) for x in back[OF_SUFFIXES]], 1).astype(np.int64) if back[OF_SUFFIXES] else np.zeros((3, 0), np.int64)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        # What holds for a fragment holds for the equal ones of its document.
        same = np.flatnonzero(states == OPEN)
        low, high = np.searchsorted(rows[0], self.records.stands[same]), np.searchsorted(rows[0], self.records.stands[same], side="right")
        at = np.repeat(self.first[same], high - low)
        rows = rows[:, _expanded(low, high - low)]
        out.append((at + rows[1], at + rows[2]))
        a, z = (np.concatenate(x) for x in zip(*out, strict=True))
        return a, z

    def documents(self, a: np.ndarray, z: np.ndarray):
        """(id, bytes, removed spans, kept bytes) of every text, given the ranges of removed strings' starts."""
        n = len(self.raw)
        # Four bytes for each of the text, not several times eight.
        steps = np.zeros(n + 1, np.int32)
        np.add.at(steps, a, 1)
        np.subtract.at(steps, z + self.span - 1, 1)
        gone = np.cumsum(steps[:n], out=steps[:n]) > 0
        del steps
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        begins, ends = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1] | edge[1:n]
        ends[:-1] &= ~gone[1:] | edge[1:n]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        of = np.searchsorted(begins, self.starts)
        for i, own in enumerate(self.ids):
            s, e = int(self.starts[i]), int(self.starts[i + 1])
            x, y = begins[of[i] : of[i + 1]], ends[of[i] : of[i + 1]]
            kept = self.raw[s:e][~gone[s:e]] if len(x) else self.raw[s:e]
            yield own, e - s, [{"start": int(p) - s, "end": int(q) - s} for p, q in zip(x, y, strict=True)], kept.tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id, n_bytes, spans, kept): of every text its UTF-8 bytes, the removed runs (start, end) and the bytes that stay; ``span``: 8 or more."""
    if span < 8:
        raise ValueError("span must be 8 or more")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(map_in_arrow(rows, _pack, "block long, ids array<long>, starts array<long>, data binary"), "repeats-blocks")
    size = blocks.agg(F.coalesce(F.sum(F.element_at("starts", -1)), F.lit(0))).first()[0]
    # About two fragments for as many positions as a window has k-mers.
    buckets = max(1, -(-size * 2 // (span - span // 3) // RECORDS))
    schema = _schema(_SENT)

    def one(row, n: int) -> Block:
        return Block(row["ids"][0], row["starts"][0], row["data"][0].as_py(), span, n)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = Block(row.column(1)[0], row.column(2)[0], row.column(3)[0].as_py(), span, buckets)
                for sent in block.records.rows(row.column(0)[0].as_py(), OF_FRAGMENTS):
                    yield pa.RecordBatch.from_pylist([sent], schema)

    sent = map_in_arrow(blocks, send, _SENT)
    first = written(sent.groupBy("bucket").applyInArrow(_meet, _BACK), "repeats-states")
    n_open, n_window = first.agg(F.coalesce(F.sum("open"), F.lit(0)), F.coalesce(F.sum("by_window"), F.lit(0))).first()
    sort_buckets, window_buckets = max(1, -(-n_open // FRAGMENTS)), max(1, -(-n_window * (span - span // 3) // RECORDS))

    def states(block: Block, back: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: x.as_py() for b, x, k in zip(back["bucket"].to_pylist(), back["data"], back["kind"].to_pylist(), strict=True) if k == kind}

    def open_up(row: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        if row.num_rows:
            block, number = one(row, buckets), row["block"][0].as_py()
            state = block.records.states(states(block, back, OF_FRAGMENTS))
            out += block.open_rows(number, state, sort_buckets)
            if (state == BY_WINDOW).any():
                out += block.by_window(state, window_buckets)[1].rows(number, OF_WINDOWS)
        return pa.Table.from_pylist(out, schema)

    opened = written(blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(open_up, _SENT), "repeats-open")
    sort = opened.where(F.col("kind") == OF_SUFFIXES).groupBy("bucket").applyInArrow(_suffixes(span), _BACK)
    meet = opened.where(F.col("kind") == OF_WINDOWS).groupBy("bucket").applyInArrow(_meet, _BACK)
    second = written(sort.union(meet), "repeats-results")
    result = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def finish(row: pa.Table, back: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        if row.num_rows:
            block = one(row, buckets)
            state = block.records.states(states(block, back, OF_FRAGMENTS))
            more = {OF_WINDOWS: states(block, back, OF_WINDOWS), OF_SUFFIXES: [x.as_py() for x, k in zip(back["data"], back["kind"].to_pylist(), strict=True) if k == OF_SUFFIXES]}
            columns = list(zip(*block.documents(*block.starts_removed(state, more, window_buckets)), strict=True))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, result, strict=True)], schema=result)

    answers = first.union(second).groupBy("block")
    out = blocks.groupBy("block").cogroup(answers).applyInArrow(finish, f"{id_col} long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    discard(opened)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Of hexadecimal texts, two characters a byte, so that positions are those of bytes.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT n, doc_id, i, md5_number(substring(h, 2 * i + 1, {2 * SPAN})) AS s FROM (SELECT n, doc_id, h, unnest(range(0, strlen(h) // 2 - {SPAN - 1})) AS i FROM d WHERE doc_id IS NOT NULL)),
hit AS (SELECT n, i FROM w JOIN (SELECT s, min(doc_id) AS first FROM w GROUP BY s) USING (s) WHERE doc_id > first),
g AS (SELECT n, i, CASE WHEN i <= lag(i) OVER o + {SPAN} THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY n ORDER BY i)),
r AS (SELECT n, min(i) AS a, max(i) + {SPAN} AS z FROM (SELECT *, sum(new) OVER (PARTITION BY n ORDER BY i) AS k FROM g) GROUP BY n, k),
k AS (SELECT n, a, z, lag(z, 1, 0::BIGINT) OVER (PARTITION BY n ORDER BY a) AS before FROM r),
t AS (SELECT n, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(z) AS tail FROM k JOIN d USING (n) GROUP BY n)
SELECT doc_id, (strlen(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substring(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (n)"""
