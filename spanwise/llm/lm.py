"""Language-model scores: a log-bilinear neural model over a counted corpus.

Counting: words (A-Z lower-cased) and one end for each training text are counted exactly, as 64-bit
hashes, by block, by partition and by one shuffle. Held-out texts (crc32 of the id, mod 10, is 0)
don't count. Model: all tokens counted at least MIN_COUNT times (at least the VOCABULARY - 1 most
frequent ones) and one class of all others, so the vocabulary grows with the corpus. A token's
context, the CONTEXT tokens before it, predicts a vector by position-wise weights; classes, then the
class's groups of words, then the words of the group are scored by inner products with it; each has
about the cube root of the vocabulary's size of children.

Training is noise-contrastive and runs in Spark tasks over every context of every training text. A step
takes some thousand neighbouring tokens: their vectors are gathered once, since a context is the same
row shifted, and sorted once by token, which puts the nodes of all levels in order. The noise of a step is
shared: NOISE classes drawn by their counts, below them one child of each parent, all alike. Gradients are
sums of sorted runs, steps those of AdaGrad with one sum for each row. Texts, as token ids, are dealt to
tasks by hash of the id and sorted there, so that the model doesn't depend on how the table is laid out.
A task starts from the last round's parameters and returns the rows that it changed; each row becomes the
average of the tasks', by visits. Each of ROUNDS rounds takes its share of the texts, by hash of the id, so
that each context is learnt from once; on up to FEW tokens every round takes all of them. Scoring normalises exactly: batched
matrix products give the softmax over classes, over a class's groups and over the words of a group,
never over the whole vocabulary. A word outside the vocabulary has the probability of the class of others times its share
of the smoothed counts there, so that all words, the unseen one included, sum to 1. The result is
mixed with the smoothed unigram distribution, which bounds the loss on any text.

Counts of up to BROADCAST_WORDS words go to the executors as two arrays (12 bytes a word); more are
joined by shuffle, word by text, with the same result. Only the vocabulary, the averaged parameters
and, within the bound, the counts come to the driver.

Defined results: null text counts as empty: only the end is scored; a null id has crc32 0, so it is
held out; repeated rows are scored each; an empty table gives no rows, and without any training text
all words are unseen.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_in_arrow
from .common import written
from .wordhash import blocks, words

VOCABULARY = 2048
CONTEXT = 3
WIDTH = 16
#: A word needs so many occurrences for a vector of its own.
MIN_COUNT = 100
ROUNDS = 3
#: Classes drawn as noise in a step.
NOISE = 8
RATE = 0.4
#: Up to so many training tokens, each round takes all texts.
FEW = 2_000_000
#: Steps that a task takes in a round, about, and the bounds of their sizes in tokens.
STEPS = 256
STEP = (256, 8192)
#: Parameter rows that are averaged together.
CHUNK = 512
SHARE = 40
BROADCAST_WORDS = 8_000_000
MIXED = 0.9
#: The hash that stands for the end of a text.
END = 0x0E4D
_U = np.uint64


def held_out(ids) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def tokens(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each text and its end, offset of each text, one more at the end)."""
    h, at = words(block)
    n = len(block)
    out = np.full(len(h) + n, END, _U)
    where = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))
    out[where] = h
    return out, at + np.arange(n + 1)


def contexts(t: np.ndarray, at: np.ndarray, before) -> list[np.ndarray]:
    """For k = 1 .. CONTEXT the token k places before each one in its text; ``before`` ahead of the text."""
    place = np.arange(len(t)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for k in range(1, CONTEXT + 1):
        c = np.empty_like(t)
        c[:k], c[k:] = before, t[:-k] if k < len(t) else t[:0]
        c[place < k] = before
        out.append(c)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(h, c) of rows (id, text): counts by partition."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.diff(h, prepend=h[:1] + _U(1)))
            return h[first], np.add.reduceat(c, first)

        def rows(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        for t, _ in _training(batches):
            h, c = np.unique(t, return_counts=True)
            held.append((h, c))
            size += len(h)
            if size > 1 << 22:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 21:
                    yield rows(*held.pop())
                    size = 0
        if held:
            yield rows(*merged())

    return map_in_arrow(docs, run, "h long, c long")


def _training(batches):
    """Tokens and offsets of the training texts of batches (id, text), in blocks."""
    for batch in batches:
        learns = ~held_out(batch.column(0).to_pylist())
        texts = [x for x, ok in zip(batch.column(1), learns, strict=True) if ok]
        for _, block in blocks(x.as_py() for x in texts):
            yield tokens(block)


class Model:
    """Vocabulary (hash order), parameters, and what base probabilities need."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        """hashes, counts: of the vocabulary, most frequent first; total, distinct: N and V of all training tokens."""
        self.total, self.distinct = total, distinct
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        n = len(hashes) + 1
        # Id 0: all others. Ids by frequency from 1; groups of neighbours in frequency, classes of such groups; class 0
        # and its group hold id 0 only.
        self.ids = (self.order + 1).astype(np.int32)
        side = max(2, round(n ** (1 / 3)))
        group = np.concatenate(([0], 1 + np.arange(n - 1) // side)).astype(np.int32)
        groups = int(group[-1]) + 1
        parents = np.concatenate(([0], 1 + np.arange(groups - 1) // side)).astype(np.int32)
        self.classes = int(parents[-1]) + 1
        #: Of each level (classes, groups, words): the node of an id, a node's parent, a parent's first node and one more.
        self.node = [parents[group], group, np.arange(n, dtype=np.int32)]
        self.parent = [np.zeros(self.classes, np.int32), parents, group]
        self.starts = [np.searchsorted(p, np.arange(p[-1] + 2)) for p in self.parent]
        others = max(0, total - int(counts.sum()))
        noise = np.concatenate(([others], counts)) + 0.1
        self.base = (counts + 0.1) / self.denominator()
        #: The share of the smoothed counts outside the vocabulary, the unseen word included.
        self.rest = (others + 0.1 * (distinct - len(hashes) + 1)) / self.denominator()
        rng = np.random.RandomState(7)
        self.tables = {"weights": np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32), "r": (rng.randn(n, WIDTH) * 0.1).astype(np.float32)}
        masses = [np.bincount(x, noise) for x in self.node]
        for i, m in enumerate(masses):
            # The bias is the last column; it starts as the unigram model's.
            bias = np.log(m / np.add.reduceat(m, self.starts[i][:-1])[self.parent[i]])
            self.tables[f"q{i}"] = np.column_stack((rng.randn(len(m), WIDTH) * 0.1, bias)).astype(np.float32)
        self.log_class = self.tables["q0"][:, -1].copy()
        self.squares = {k: np.full(len(v), 1e-3, np.float32) for k, v in self.tables.items()}
        self.class_cdf = np.cumsum(np.exp(self.log_class))
        #: Contexts learnt from, each as often as it was.
        self.trained = 0

    def copy(self) -> Model:
        """The same model with parameters of its own."""
        new = copy.copy(self)
        new.tables, new.squares = ({k: v.copy() for k, v in x.items()} for x in (self.tables, self.squares))
        return new

    def denominator(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], 0)

    def train(self, w: np.ndarray, at: np.ndarray, end: int, epochs: int = 1, batch: int = STEP[1], rng=None, seen=None) -> None:
        """Learns from every token of texts of ids ``w``, text k starting at ``at[k]``; ``seen`` counts visits of rows."""
        rng = rng or np.random.RandomState(11)
        # Each text gets as many ends before it as a context has tokens.
        place = np.arange(len(w)) + CONTEXT * (1 + np.repeat(np.arange(len(at) - 1), np.diff(at)))
        padded = np.full(len(w) + CONTEXT * (len(at) - 1), end, np.int32)
        padded[place] = w
        target = np.zeros(len(padded), bool)
        target[place] = True
        for _ in range(epochs):
            for first in range(0, len(padded), batch):
                before = max(0, first - CONTEXT)
                part, is_target = padded[before : first + batch], target[before : first + batch].copy()
                is_target[: first - before] = False
                if is_target.any():
                    self._step(part, is_target, rng, seen)
        self.trained += epochs * len(w)

    def _update(self, name: str, rows: np.ndarray, gradient: np.ndarray, visits: np.ndarray, seen) -> None:
        """One AdaGrad step on rows, each given once."""
        value, s = self.tables[name], self.squares[name]
        s[rows] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        value[rows] -= gradient * (RATE / np.sqrt(s[rows]))[:, None]
        if seen is not None:
            seen[name][rows] += visits

    def _step(self, part: np.ndarray, is_target: np.ndarray, rng, seen) -> None:
        r, weights = self.tables["r"], self.tables["weights"]
        vectors = r[part]
        made = np.zeros((len(part), WIDTH + 1), np.float32)
        made[:, -1] = 1
        for k in range(1, CONTEXT + 1):
            made[k:, :-1] += vectors[:-k] * weights[k - 1]
        order = np.argsort(part.astype(np.uint16) if len(r) < 1 << 16 else part, kind="stable")
        aims = order[is_target[order]]
        made, t = made[aims], part[aims]
        scale = np.float32(len(t) ** -0.5)
        sigmoid = lambda x: scale / (1 + np.exp(-np.clip(x, -30, 30)))
        pull = np.zeros((len(t), WIDTH), np.float32)
        for i in range(3):
            name, node = f"q{i}", self.node[i][t]
            q = self.tables[name]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            runs = np.diff(first, append=len(t))
            own = np.repeat(q[node[first]], runs, axis=0)
            if i:
                parent = self.parent[i][node[first]]
                head = np.flatnonzero(np.diff(parent, prepend=-1))
                low = self.starts[i][parent[head]]
                sizes = self.starts[i][parent[head] + 1] - low
                drawn, share = low + (rng.random_sample(len(low)) * sizes).astype(np.int64), -np.log(sizes).astype(np.float32)
                starts = first[head]
                many = np.diff(starts, append=len(t))
                noise = np.repeat(q[drawn], many, axis=0)
                certain = np.repeat(sizes == 1, many)
                share = np.repeat(share, many)
                up = sigmoid(np.einsum("ij,ij->i", made, own) - share) - scale
                down = sigmoid(np.einsum("ij,ij->i", made, noise) - share)
                up[certain] = down[certain] = 0  # an only child is certain
                pull += up[:, None] * own[:, :-1] + down[:, None] * noise[:, :-1]
                against = np.add.reduceat(down[:, None] * made, starts, axis=0)
            else:
                drawn = np.minimum(np.searchsorted(self.class_cdf, rng.random_sample(NOISE)), self.classes - 1)
                share = self.log_class + np.float32(np.log(NOISE))
                up = sigmoid(np.einsum("ij,ij->i", made, own) - share[node]) - scale
                down = sigmoid(made @ q[drawn].T - share[drawn])
                pull += up[:, None] * own[:, :-1] + down @ q[drawn][:, :-1]
                # The same class may be drawn twice.
                drawn, back = np.unique(drawn, return_inverse=True)
                against = np.zeros((len(drawn), WIDTH + 1), np.float32)
                np.add.at(against, back, down.T @ made)
                many = np.full(len(drawn), len(t))
            toward = np.add.reduceat(up[:, None] * made, first, axis=0)
            self._update(name, node[first], toward, runs, seen)
            self._update(name, drawn, against, many, seen)
        back = np.zeros((len(part), WIDTH), np.float32)
        back[aims] = pull
        moved = np.zeros_like(back)
        turned = np.empty_like(weights)
        for k in range(1, CONTEXT + 1):
            moved[:-k] += back[k:] * weights[k - 1]
            turned[k - 1] = np.einsum("ij,ij->j", vectors[:-k], back[k:])
        tokens_ = part[order]
        first = np.flatnonzero(np.diff(tokens_, prepend=-1))
        self._update("r", tokens_[first], np.add.reduceat(moved[order], first, axis=0), np.diff(first, append=len(part)), seen)
        self._update("weights", np.arange(CONTEXT), turned, np.full(CONTEXT, len(t)), seen)

    def log_probabilities(self, ids: np.ndarray, context: list[np.ndarray]) -> np.ndarray:
        """Natural logs of the normalised probabilities of ids (0: the class of others) after their contexts."""
        r, weights = self.tables["r"], self.tables["weights"]
        made = np.ones((len(ids), WIDTH + 1), np.float32)
        made[:, :-1] = sum(r[c] * w for c, w in zip(context, weights, strict=True))
        # Sorted once: ids in order have their groups and classes in order.
        by_id = np.argsort(ids, kind="stable")
        made, ids = made[by_id], ids[by_id]
        found = np.zeros(len(ids), np.float32)
        for i in range(3):
            node, q, starts = self.node[i][ids], self.tables[f"q{i}"], self.starts[i]
            parent = self.parent[i][node]
            bounds = np.append(np.flatnonzero(np.diff(parent, prepend=-1)), len(ids))
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = starts[parent[x]], starts[parent[x] + 1]
                if b - a > 1:
                    score = made[x:y] @ q[a:b].T
                    score -= score.max(1)[:, None]
                    found[x:y] += score[np.arange(y - x), node[x:y] - a] - np.log(np.exp(score).sum(1))
        out = np.empty_like(found)
        out[by_id] = found
        return out


def _sequences(docs: DataFrame, shared) -> DataFrame:
    """(id, w) of training texts: their token ids, the end included, in as few bytes as the vocabulary allows."""

    def run(batches):
        model = shared.value
        kind = np.uint16 if len(model.hashes) < 1 << 16 else np.uint32
        for batch in batches:
            learns = ~held_out(batch.column(0).to_pylist())
            texts = batch.column(1).filter(pa.array(learns))
            out = []
            for _, block in blocks(x.as_py() for x in texts):
                t, at = tokens(block)
                w = model.ids_of(t).astype(kind)
                out += [w[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(learns)), pa.array(out, pa.binary())], names=["id", "w"])

    return map_in_arrow(docs, run, "id long, w binary")


def _learnt(sequences: DataFrame, shared, step: int) -> DataFrame:
    """One round over rows (id, w) by steps of so many tokens: of each task the parameter rows that it visited, by chunks of a table."""

    def run(batches):
        model = shared.value.copy()
        model.trained = 0
        kind = np.uint16 if len(model.hashes) < 1 << 16 else np.uint32
        part = TaskContext.get().partitionId()
        rng = np.random.RandomState(part)
        end = model.ids_of(np.array([END], _U))[0]
        seen = {k: np.zeros(len(v), np.int64) for k, v in model.tables.items()}
        for batch in batches:
            w = [np.frombuffer(x.as_py(), kind) for x in batch.column(1)]
            if w:
                model.train(np.concatenate(w).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in w]))), end, batch=step, rng=rng, seen=seen)
        for number, name in enumerate(model.tables):
            visited = np.flatnonzero(seen[name])
            for c in np.unique(visited // CHUNK):
                rows = visited[visited // CHUNK == c]
                steps = np.sqrt(model.squares[name][rows])
                columns = [number, int(c), part, model.trained, rows.astype(np.int64).tobytes(), seen[name][rows].tobytes(), model.tables[name][rows].tobytes(), steps.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in columns], schema=_LEARNT)

    return map_in_arrow(sequences, run, "number long, chunk long, part long, trained long, rows binary, visits binary, values binary, steps binary")


_LEARNT = pa.schema([(n, pa.int64()) for n in ("number", "chunk", "part", "trained")] + [(n, pa.binary()) for n in ("rows", "visits", "values", "steps")])


def _averaged(group: pa.Table) -> pa.Table:
    """The averages of a chunk's rows over the tasks, by visits, in the order of tasks."""
    first = group.slice(0, 1).to_pylist()[0]
    total = visits = None
    for x in sorted(group.to_pylist(), key=lambda x: x["part"]):
        rows, n = np.frombuffer(x["rows"], np.int64), np.frombuffer(x["visits"], np.int64)
        values = np.concatenate([np.frombuffer(x[k], np.float32).reshape(len(rows), -1) for k in ("values", "steps")], 1)
        if total is None:
            total, visits = np.zeros((CHUNK, values.shape[1])), np.zeros(CHUNK, np.int64)
        total[rows % CHUNK] += values * n[:, None].astype(np.float64)
        visits[rows % CHUNK] += n
    kept = np.flatnonzero(visits)
    values, steps = np.split(total[kept] / visits[kept, None], [-1], 1)
    trained = sum(group["trained"].to_pylist())
    out = [first["number"], first["chunk"], -1, trained, (kept + first["chunk"] * CHUNK).astype(np.int64).tobytes(), visits[kept].tobytes(), values.astype(np.float32).tobytes(), steps.astype(np.float32).tobytes()]
    return pa.Table.from_arrays([pa.array([x]) for x in out], schema=_LEARNT)


def learn(docs: DataFrame, model: Model) -> None:
    """Trains the model on every context of the training texts of rows (id, text)."""
    context = docs.sparkSession.sparkContext
    names = list(model.tables)
    # What tasks return must stay small beside what they read: a task has SHARE contexts for each word of the vocabulary.
    a_round = model.total // (1 if model.total <= FEW else ROUNDS)
    tasks = max(1, a_round // (SHARE * (len(model.hashes) + 1)))
    step = int(np.clip(a_round // tasks // STEPS, *STEP))
    dealt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(tasks)).cast("int")
    for r in range(ROUNDS):
        part = docs if model.total <= FEW else docs.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == r)
        shared = context.broadcast(model)
        found = _learnt(_sequences(part, shared).repartitionById(tasks, dealt).sortWithinPartitions("id", "w"), shared, step)
        new = found.groupBy("number", "chunk").applyInArrow(_averaged, found.schema).toArrow().to_pylist()
        shared.destroy()
        for x in new:
            name, rows = names[x["number"]], np.frombuffer(x["rows"], np.int64)
            model.tables[name][rows] = np.frombuffer(x["values"], np.float32).reshape(len(rows), -1)
            model.squares[name][rows] = np.frombuffer(x["steps"], np.float32) ** 2
            if name == "weights":
                model.trained += x["trained"]


def _scored(docs: DataFrame, shared, exact: bool) -> DataFrame:
    """Of rows (id, text): id, held_out, n_tokens, and of vocabulary words n_known, base_score, score.

    ``exact``: words outside the vocabulary are included, from broadcast counts; else they come as
    ``others`` (hash, times) and ``score`` lacks their log10 smoothed frequencies.
    """

    def run(batches):
        model, hashes, counts = shared.value
        denominator = model.denominator()
        log_base = np.log10(np.concatenate(([1.0], model.base)))
        plain = np.concatenate(([1.0], (1 - MIXED) * model.base))
        for batch in batches:
            ids = batch.column(0)
            held = held_out(ids.to_pylist())
            for first, block in blocks(x.as_py() for x in batch.column(1)):
                t, at = tokens(block)
                w = model.ids_of(t)
                context = contexts(w, at, model.ids_of(np.array([END], _U))[0])
                p = np.empty(len(t))
                for a in range(0, len(t), 1 << 17):
                    z = slice(a, a + (1 << 17))
                    p[z] = np.exp(model.log_probabilities(w[z], [c[z] for c in context]).astype(np.float64))
                out = w == 0
                # For a word outside the vocabulary p is a share of smoothed counts: its own factor comes below.
                score = np.log10(np.where(out, MIXED * p / model.rest + (1 - MIXED), MIXED * p + plain[w]))
                base, known = np.where(out, 0.0, log_base[w]), (~out).astype(np.int64)
                others = [[]] * len(block)
                if exact:
                    h, back = np.unique(t[out], return_inverse=True)
                    if len(h):
                        k = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                        c = np.where(hashes[k] == h, counts[k], 0) if len(hashes) else np.zeros(len(h), np.int64)
                        own = np.log10((c + 0.1) / denominator)[back]
                        base[out], known[out] = own, (c > 0)[back]
                        score[out] += own
                else:
                    others = []
                    for d in range(len(block)):
                        h, n = np.unique(t[at[d] : at[d + 1]][out[at[d] : at[d + 1]]], return_counts=True)
                        others.append([{"h": int(x), "n": int(y)} for x, y in zip(h.view(np.int64), n, strict=True)])
                sums = lambda v: np.add.reduceat(v, at[:-1])  # noqa: E731  every text has its end
                columns = [ids.slice(first, len(block)), pa.array(held[first : first + len(block)]), pa.array(np.diff(at)), pa.array(sums(known)), pa.array(sums(base)), pa.array(sums(score))]
                names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
                if not exact:
                    columns.append(pa.array(others, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))))
                    names.append("others")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return map_in_arrow(docs, run, schema + ("" if exact else ", others array<struct<h:long,n:long>>"))


def fit(docs: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The trained model and the table of counts (h, c) of rows (id, text); vocabulary: its least size."""
    counts = written(counted(docs).groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")
    total, distinct, often = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") >= MIN_COUNT)).first()
    least = counts.orderBy(F.desc("c"), "h").limit(vocabulary - 1) if often < vocabulary else counts.where(F.col("c") >= MIN_COUNT)
    most = least.toArrow()
    h, c = most["h"].to_numpy(), most["c"].to_numpy()
    order = np.lexsort((h, -c))
    model = Model(h[order].view(_U), c[order], total, distinct)
    if total:
        learn(docs, model)
    model.squares = {}
    return model, counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Every row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model, counts = fit(docs, vocabulary)
    if model.distinct <= broadcast_words:
        table = counts.toArrow()
        h, c = table["h"].to_numpy().view(_U), table["c"].to_numpy()
        order = np.argsort(h)
        shared = spark.sparkContext.broadcast((model, h[order], c[order].astype(np.int32 if model.total < 1 << 31 else np.int64)))
        out = _scored(docs, shared, True)
    else:
        shared = spark.sparkContext.broadcast((model, None, None))
        part = written(_scored(docs, shared, False).withColumn("row", F.monotonically_increasing_id()), "lm-partial")
        log = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / model.denominator())
        each = part.select("row", F.explode("others").alias("o")).select("row", "o.h", "o.n").join(counts, "h", "left")
        more = each.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * log).alias("s"))
        out = part.drop("others").join(more, "row", "left")
        out = out.withColumns({"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("s", F.lit(0.0)), "score": F.col("score") + F.coalesce("s", F.lit(0.0))})
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
