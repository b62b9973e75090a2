"""Language-model scoring: a gated recurrent network in numpy.

Counts of every training token come from all training texts. The most frequent
words form classes of like frequency; all other words share one more class,
within which they follow their smoothed counts. The network (one gated
recurrent layer) predicts the next token's class and then the word within the
class; it is trained by back-propagation through windows, with the state
carried from window to window, and scores whole documents the same way.

A document's rare words are looked up by a join with the counts, as their
vocabulary has no bound.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, drop, materialize, parts, pick, slices, small_batches

FOLDS = 10
#: The end token is written as the empty word.
END = ""
#: Bound of the counts that are broadcast; the others are joined.
HEAD_WORDS = 65_536
CLASSES = 32
CLASS_WORDS = 64
HIDDEN = 16
BPTT = 16
LANES = 256
#: Training goes in ``SHARE`` rounds. Each walks one in so many training texts,
#: by hash, so that the rounds together walk every one of them once.
SHARE = 4
#: Training texts of a task in a round, at any size of the corpus, and tokens
#: that are fitted together in it.
TASK_TEXTS = 2048
FIT_TOKENS = 1_000_000
RATE = 0.01
#: Weights that an optimizer step handles at once, so that they stay in cache.
PASS = 16_384
#: Text whose words are counted together before they are sent.
PARTIAL_BYTES = 16 << 20
#: Rows and bytes scored together in a worker.
SCORE_ROWS = 9216
SCORE_BYTES = 30 << 20
ADD = 0.1


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over ``docs``: words with A-Z lower-cased, and one end each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size, ends = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, ends
            every = pa.chunked_array(held, pa.string()) if held else pa.array([], pa.string())
            found = pc.value_counts(every)
            word, c = found.field("values"), found.field("counts")
            real = pc.not_equal(word, "")
            word, c = (pa.concat_arrays([x.filter(real), e]) for x, e in ((word, pa.array([END], pa.string())), (c, pa.array([ends], pa.int64()))))
            held.clear()
            size, ends = 0, 0
            return pa.RecordBatch.from_arrays([word, c], names=["word", "c"])

        for part in parts(batches):
            text = part.column(0)
            # white space by the contract's set; runs of it at either end give empty words
            held.append(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, ""))).flatten())
            size, ends = size + text.nbytes, ends + len(text)
            if size > PARTIAL_BYTES:
                yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int, bins: int = 1 << 12) -> DataFrame:
    """At most ``most`` of the most frequent words, found by histograms, so that
    no task sends its own candidates to the driver. Counts are cut into grades
    of some 4 %; all grades that fit are taken whole, and of the next one the
    words of as many hash bins as still fit."""
    grade = F.floor(F.log2("c") * 16).cast("int")
    graded = counts.withColumn("grade", grade)
    rows = graded.groupBy("grade").agg(F.count("*").alias("n")).orderBy(F.desc("grade")).collect()  # at most 16 * 63
    left, edge = most, None
    for r in rows:
        if r["n"] > left:
            edge = r["grade"]
            break
        left -= r["n"]
    if edge is None:
        return counts
    binned = graded.withColumn("bin", F.pmod(F.xxhash64("word"), F.lit(bins)).cast("int"))
    upto = 0
    for r in binned.where(F.col("grade") == edge).groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect():  # at most `bins`
        if r["n"] > left:
            break
        left, upto = left - r["n"], r["bin"] + 1
    return binned.where((F.col("grade") > edge) | ((F.col("grade") == edge) & (F.col("bin") < upto))).select("word", "c")


@dataclass
class Vocabulary:
    """Broadcast part of the counts. ``words`` and their ``counts``, the most
    frequent first; the first ``known`` of them have a model id each, their
    place, and the id after the last stands for all other words."""

    words: list[bytes]
    counts: np.ndarray
    known: int
    tokens: int
    distinct: int

    @classmethod
    def of(cls, counts: DataFrame, head_words: int = HEAD_WORDS, model_words: int = CLASSES * CLASS_WORDS) -> Vocabulary:
        n, v = counts.agg(F.sum("c"), F.count("*")).first()
        top = sorted(((-r["c"], r["word"].encode()) for r in most_frequent(counts, head_words).collect()))  # at most `head_words`
        return cls([w for _, w in top], np.array([-c for c, _ in top], dtype=np.int64), min(model_words, len(top)), n or 0, v or 0)

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @property
    def rest_mass(self) -> float:
        """Smoothed count of all words without an id, the unseen one included."""
        return self.tokens - int(self.counts[: self.known].sum()) + ADD * (self.distinct - self.known + 1)


def exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(e, s, m)``: exponentials of rows less ``m``, and their sums. ``m`` is
    zero unless a row's sum is then beyond single precision."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        s = e @ np.ones(z.shape[-1], dtype=z.dtype)
    m = np.float32(0)
    if s.size and not (s.min() > 1e-25 and s.max() < 1e30):
        m = z.max(axis=-1, keepdims=True)
        e = np.exp(z - m)
        s = e.sum(axis=-1)
        m = m[..., 0]
    return e, s, m


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.minimum(x, np.float32(80), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def with_ones(h: np.ndarray) -> np.ndarray:
    """Rows with a last column of ones, so that a product adds the bias too."""
    out = np.ones((len(h), h.shape[1] + 1), dtype=h.dtype)
    out[:, :-1] = h
    return out


class Gru:
    """Gated recurrent unit with a class-factored output softmax."""

    def __init__(self, vocab: Vocabulary, hidden: int = HIDDEN, seed: int = 2):
        r = np.random.default_rng(seed)
        words = vocab.known
        self.rest = words  # id of every other word
        classes = -(-words // CLASS_WORDS)
        self.classes = classes + 1  # the last class is the rest
        f = lambda *s: (r.normal(size=s) * 0.1).astype(np.float32)
        self.p = {"x": f(words + 1, 3 * hidden), "u": f(hidden, 3 * hidden), "wc": f(hidden, self.classes) * 0, "bc": np.zeros(self.classes, np.float32), "ww": f(self.classes - 1, hidden, CLASS_WORDS) * 0, "bw": np.full((self.classes - 1, CLASS_WORDS), -1e4, np.float32)}
        mass = np.zeros(self.classes)
        smoothed = vocab.counts[:words] + ADD
        self.p["bw"].reshape(-1)[:words] = np.log(smoothed)
        np.add.at(mass, np.arange(words) // CLASS_WORDS, smoothed)
        mass[-1] = vocab.rest_mass
        self.p["bc"] = np.log(np.maximum(mass, 1e-6)).astype(np.float32)
        self.hidden = hidden
        known = vocab.words[:words]
        self.start = known.index(b"") if b"" in known else self.rest

    def gates(self, gi: np.ndarray, h: np.ndarray, gh: np.ndarray | None = None, rz: np.ndarray | None = None, n: np.ndarray | None = None, out: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Next state from inputs and state, with what training needs, into the
        arrays given. A column is a lane, so that a gate is whole rows, which
        numpy passes over several times as fast as parts of rows."""
        k = self.hidden
        gh = np.matmul(self.p["u"].T, h, out=gh)
        rz = sigmoid(np.add(gi[: 2 * k], gh[: 2 * k], out=rz))
        r, z = rz[:k], rz[k:]
        n = np.multiply(r, gh[2 * k :], out=n)
        n += gi[2 * k :]
        np.tanh(n, out=n)
        out = np.subtract(h, n, out=out)
        out *= z
        out += n
        return out, r, z, n, gh[2 * k :]

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """``gates`` for input ids, with a row a lane."""
        return tuple(a.T for a in self.gates(self.p["x"].take(x, axis=0).T, h.T))

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Output weights of the classes and of their words, biases as last rows."""
        return np.concatenate([self.p["wc"], self.p["bc"][None]]), np.concatenate([self.p["ww"], self.p["bw"][:, None]], axis=1)

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each id, and the rows in order of class with its edges."""
        c = np.minimum(y // CLASS_WORDS, self.classes - 1)
        c[y == self.rest] = self.classes - 1
        order = np.argsort(c.astype(np.int16), kind="stable")
        return c, order, np.searchsorted(c[order], np.arange(self.classes))

    def _words(self, h: np.ndarray, ww: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Outputs of the words of each row's class; rows are in order of class
        and those of the last class have none."""
        z = np.empty((int(edges[-1]), CLASS_WORDS), dtype=h.dtype)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            i, j = int(edges[k]), int(edges[k + 1])
            np.matmul(h[i:j], ww[k], out=z[i:j])
        return z

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of P(class) P(word | class) per row; a word without an
        id stops at its class."""
        c, order, edges = self._by_class(y)
        wc, ww = self._outputs()
        h = with_ones(h)
        z = h @ wc
        _, s, m = exps(z)
        at = np.arange(len(y))
        out = z[at, c] - m - np.log(s)
        # rows in order of class, so that those of a class are a slice
        h, y, within = h.take(order, axis=0), y.take(order) % CLASS_WORDS, np.zeros_like(out)
        z = self._words(h, ww, edges)
        _, s, m = exps(z)
        n = len(z)
        within[:n] = z[at[:n], y[:n]] - m - np.log(s)
        out[order] += within
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole id sequence. Texts are dealt
        to lanes, longest first; lanes run side by side, each state starting
        anew with a text and carried over its windows."""
        out = np.zeros(len(texts))
        sizes = np.array([len(t) for t in texts])
        total = int(sizes.sum())
        if not total:
            return out
        lanes = int(np.clip(total // 256, 1, 512))
        load, own = np.zeros(lanes, dtype=np.int64), [[] for _ in range(lanes)]
        import heapq

        heap = [(0, i) for i in range(lanes)]
        for t in np.argsort(-sizes, kind="stable").tolist():
            n, i = heapq.heappop(heap)
            own[i].append(t)
            load[i] = n + sizes[t]
            heapq.heappush(heap, (int(load[i]), i))
        lane_order = np.argsort(-load, kind="stable")
        load = load[lane_order]
        steps = int(load[0])
        # lanes that are alive at each step come first; all steps lie end to end
        alive = np.searchsorted(-load, -np.arange(steps), side="left")
        edge = np.concatenate([[0], np.cumsum(alive)])
        x, y, doc = (np.empty(total, dtype=np.int32) for _ in range(3))
        first = np.zeros(total, dtype=bool)
        for j, i in enumerate(lane_order.tolist()):
            at = 0
            for t in own[i]:
                if sizes[t]:
                    where = edge[at : at + sizes[t]] + j
                    y[where] = texts[t]
                    x[where[1:]] = texts[t][:-1]
                    x[where[0]] = self.start
                    doc[where] = t
                    first[where[0]] = True
                    at += sizes[t]
        h = np.zeros((self.hidden, lanes), dtype=np.float32)
        states = np.empty((BPTT * lanes, self.hidden), dtype=np.float32)
        edges, begins = edge.tolist(), (np.add.reduceat(first, edge[:-1]) > 0).tolist()
        end = 0
        while end < steps:
            # as many steps as fill the states: the fewer lanes are alive, the more
            at, base = end, edges[end]
            end = int(np.searchsorted(edge, base + len(states), side="right")) - 1
            stop = edges[end]
            given = self.p["x"].take(x[base:stop], axis=0)
            for t in range(at, end):
                lo, hi = edges[t], edges[t + 1]
                h = h[:, : hi - lo]
                if begins[t]:
                    h = h * ~first[lo:hi]
                h = self.gates(np.ascontiguousarray(given[lo - base : hi - base].T), h)[0]
                states[lo - base : hi - base] = h.T
            lp = self.log_probs(states[: stop - base], y[base:stop])
            out += np.bincount(doc[base:stop], weights=lp, minlength=len(texts))
        return out

    def fit(self, texts: list[np.ndarray], epochs: int = 2, rate: float = 0.01) -> Gru:
        """Truncated back-propagation with Adam over the joined texts."""
        stream = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int32)
        lanes = int(np.clip(len(stream) // (4 * BPTT), 1, LANES))
        n = len(stream) // lanes
        if n < 2:
            return self
        y = stream[: n * lanes].reshape(lanes, n).T
        x = np.concatenate([np.full((1, lanes), self.start, dtype=y.dtype), y[:-1]])
        k = self.hidden
        # all weights in one vector, so that a step is a few passes over it
        names = sorted(self.p)
        edges = np.cumsum([0, *(self.p[a].size for a in names)])
        flat, grad = np.concatenate([self.p[a].ravel() for a in names]), np.empty(int(edges[-1]), np.float32)
        views = lambda x: {a: x[i:j].reshape(self.p[a].shape) for a, i, j in zip(names, edges, edges[1:], strict=False)}
        self.p, g = views(flat), views(grad)
        first, second, work, step = np.zeros_like(flat), np.zeros_like(flat), np.empty(PASS, np.float32), 0
        for _ in range(epochs):
            h = np.zeros((k, lanes), dtype=np.float32)
            for at in range(0, n, BPTT):
                end = min(n, at + BPTT)
                many = end - at
                grad[:] = 0
                ids = x[at:end].reshape(-1)
                turned = lambda a: np.ascontiguousarray(a.reshape(many, lanes, -1).transpose(0, 2, 1))  # noqa: B023, E731
                given = turned(self.p["x"].take(ids, axis=0))
                states, gh, rz, c = (np.empty((m, w, lanes), np.float32) for m, w in ((many + 1, k), (many, 3 * k), (many, 2 * k), (many, k)))
                states[0] = h
                for t in range(many):
                    self.gates(given[t], states[t], gh[t], rz[t], c[t], states[t + 1])
                h = states[many]
                dh_out = turned(self._output_grads(states[1:].transpose(0, 2, 1).reshape(-1, k), y[at:end].reshape(-1), g))
                # derivatives of all steps at once, then the chain through them
                r, z = rz[:, :k], rz[:, k:]
                to_c, to_r, to_z = (1 - z) * (1 - c * c), gh[:, 2 * k :] * r * (1 - r), (states[:-1] - c) * z * (1 - z)
                carry = np.zeros((k, lanes), dtype=np.float32)
                di, dg = np.empty((many, 3 * k, lanes), np.float32), np.empty((many, 3 * k, lanes), np.float32)
                for t in range(many - 1, -1, -1):
                    d = dh_out[t]
                    d += carry
                    dc = np.multiply(d, to_c[t], out=di[t, 2 * k :])
                    np.multiply(dc, to_r[t], out=di[t, :k])
                    np.multiply(d, to_z[t], out=di[t, k : 2 * k])
                    dg[t, : 2 * k] = di[t, : 2 * k]
                    np.multiply(dc, r[t], out=dg[t, 2 * k :])
                    carry = self.p["u"] @ dg[t]
                    d *= z[t]
                    carry += d
                g["u"] += np.matmul(states[:-1], dg.transpose(0, 2, 1)).sum(axis=0)
                # a radix sort where the ids have two bytes
                order = np.argsort(ids.astype(np.uint16) if self.rest < 1 << 16 else ids, kind="stable")
                ids = ids[order]
                begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                g["x"][ids[begin]] = np.add.reduceat(di.transpose(0, 2, 1).reshape(-1, 3 * k).take(order, axis=0), begin, axis=0)
                step += 1
                scale, by1, by2 = np.float32(1 / (many * lanes)), np.float32(rate / (1 - 0.9**step)), np.float32(1 / (1 - 0.99**step))
                for i in range(0, len(flat), PASS):
                    part, m, v, w = grad[i : i + PASS], first[i : i + PASS], second[i : i + PASS], flat[i : i + PASS]
                    part *= scale
                    # means of the gradient and of its square, then the step
                    d = np.subtract(part, m, out=work[: len(part)])
                    d *= np.float32(0.1)
                    m += d
                    np.multiply(part, part, out=d)
                    d -= v
                    d *= np.float32(0.01)
                    v += d
                    np.multiply(v, by2, out=d)
                    np.sqrt(d, out=d)
                    d += np.float32(1e-6)
                    np.divide(m, d, out=d)
                    d *= by1
                    w += d
        return self

    def _output_grads(self, h: np.ndarray, y: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        """Adds the output layers' gradients of the log-likelihood; returns
        that of the states."""
        c, order, edges = self._by_class(y)
        wc, ww = self._outputs()
        h, n = with_ones(h), h.shape[1]
        d, total, _ = exps(h @ wc)
        d *= (-1 / total)[:, None]
        d[np.arange(len(y)), c] += 1
        both = h.T @ d
        g["wc"] += both[:n]
        g["bc"] += both[n]
        dh = d @ self.p["wc"].T
        # rows in order of class, so that those of a class are a slice
        at, h, y = np.arange(len(y)), h.take(order, axis=0), y.take(order) % CLASS_WORDS
        within = np.zeros_like(dh)
        every, total, _ = exps(self._words(h, ww, edges))
        every *= (-1 / total)[:, None]
        every[at[: len(every)], y[: len(every)]] += 1
        for k in np.flatnonzero(np.diff(edges)).tolist():
            i, j = int(edges[k]), int(edges[k + 1])
            d = every[i:j]
            both = h[i:j].T @ d
            g["ww"][k] += both[:n]
            g["bw"][k] += both[n]
            np.matmul(d, self.p["ww"][k].T, out=within[i:j])
        dh[order] += within
        return dh


def token_places(text: bytes | None, index: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    """Words (the end last, as the empty word) and their places in the
    vocabulary, -1 for words beyond it."""
    words = text.lower().split() if text else []
    words.append(b"")
    return words, np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int32, count=len(words))


def refine(docs: DataFrame, vocab: Vocabulary, model: Gru) -> Gru:
    """``model`` trained on by one pass over every row of ``docs``, in ``SHARE``
    rounds; an empty table leaves it as it is."""
    tasks = -(-docs.count() // (SHARE * TASK_TEXTS))
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("_h"), "text")
    for k in range(SHARE if tasks else 0):
        _round(hashed.where(F.pmod("_h", F.lit(SHARE)) == k), tasks, vocab, model)
    return model


def _round(rows: DataFrame, tasks: int, vocab: Vocabulary, model: Gru) -> None:
    """Train ``model`` on all of ``rows``. They are dealt evenly to ``tasks``,
    so no group of copies makes a task large; each task starts from the given
    weights, walks its texts in hash order, and returns its weights. Their mean
    by tokens becomes the model's, summed in groups of tasks first, so that the
    driver gets some square root of their number, one at a time."""
    known = rows.sparkSession.sparkContext.broadcast((vocab, model.p))
    groups = max(1, round(tasks**0.5))
    keys = sorted(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = known.value
        own, index = Gru(vocab, start["u"].shape[0]), {w: i for i, w in enumerate(vocab.words[: vocab.known])}
        own.p = {k: v.copy() for k, v in start.items()}
        held: list[np.ndarray] = []
        seen, waiting = 0, 0

        def learn() -> None:
            nonlocal seen, waiting
            own.fit(held, epochs=1, rate=RATE)
            seen, waiting = seen + waiting, 0
            held.clear()

        for _, texts in slices(batches):
            for t in texts:
                ids = token_places(t, index)[1]
                ids[ids < 0] = own.rest
                for at in range(0, len(ids), FIT_TOKENS):
                    held.append(ids[at : at + FIT_TOKENS])
                    waiting += len(held[-1])
                    if waiting >= FIT_TOKENS:
                        learn()
        if waiting:
            learn()
        if seen:
            flat = np.concatenate([own.p[k].ravel() for k in keys]).astype("<f4").tobytes()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % groups], pa.int32()), pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat], pa.binary())], names=["g", "part", "n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                g, _, n, w = (c[r].as_py() for c in batch.columns)
                had, total = sums.get(g, (0, 0.0))
                sums[g] = had + n, total + np.frombuffer(w, dtype="<f4").astype(np.float64) * n
        for g, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([n], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["g", "n", "w"])

    dealt = rows.repartition(tasks).sortWithinPartitions("_h").select("text")
    # kept as files: reading the groups one by one must not train again
    learnt = dealt.mapInArrow(run, "g int, part int, n long, w binary").repartition(groups, "g").sortWithinPartitions("g", "part")
    sums = materialize(learnt.mapInArrow(add, "g int, n long, w binary"), "weights")
    n, total = 0, 0.0
    for r in sums.orderBy("g").toLocalIterator():
        n, total = n + r["n"], total + np.frombuffer(r["w"], dtype="<f8")
    drop(sums)
    if not n:
        return
    at = 0
    for k in keys:
        size = model.p[k].size
        model.p[k] = (total[at : at + size] / n).reshape(model.p[k].shape).astype(np.float32)
        at += size


def score_texts(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Gru) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` of every row; see ``op9``."""
    known = docs.sparkSession.sparkContext.broadcast((vocab, model))
    base_total, rest_total = np.log10(vocab.tokens + ADD * (vocab.distinct + 1)), np.log10(max(vocab.rest_mass, 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = known.value
        index, base = vocab.index(), np.log10(vocab.counts + ADD)
        rid = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        rows: list[list] = []
        keys: list[pa.RecordBatch] = []
        held = 0

        def add(text: bytes | None) -> None:
            """Look up a text's words; only places and rare words are kept."""
            nonlocal rid
            words, at = token_places(text, index)
            head, beyond = at[at >= 0], np.flatnonzero(at < 0).tolist()
            tail = Counter([words[i] for i in beyond])
            # words with a count that is known here but without an id
            mid = head[head >= model.rest]
            rows.append([rid, len(words), len(head), float(base[head].sum()), float(base[mid].sum()) - (len(mid) + len(beyond)) * rest_total, [w.decode() for w in tail], list(tail.values())])
            at[(at < 0) | (at > model.rest)] = model.rest
            ids.append(at)
            rid += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            for row, s in zip(rows, (model.score(ids) / np.log(10)).tolist(), strict=True):
                row[4] += s
            cols = list(zip(*rows, strict=True))
            types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.list_(pa.string()), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            own, fold = (pa.concat_arrays([k.column(i).cast(t) for k in keys]) for i, t in ((0, pa.int64()), (1, pa.bool_())))
            for x in (ids, rows, keys):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([arrays[0], own, fold, *arrays[1:]], names=["rid", "doc_id", "held_out", "n_tokens", "n_head", "base_head", "score_head", "tail", "tail_n"])

        for part, texts in slices(batches):
            # copies, so that the texts can go
            keys.append(pa.RecordBatch.from_arrays([pa.array(part.column(i).to_pylist(), t) for i, t in ((0, pa.int64()), (2, pa.bool_()))], names=["doc_id", "held_out"]))
            for t in texts:
                add(t)
                held += len(t or b"")
            if held >= SCORE_BYTES or len(rows) >= SCORE_ROWS:
                yield flush()
        if rows:
            yield flush()

    rows = materialize(docs.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, score_head double, tail array<string>, tail_n array<long>"), "scored")
    tail = rows.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("rid", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("tf"))
    # the counts' head is looked up above; each other word is rare, so no key is hot
    found = tail.join(counts, "word", "left").groupBy("rid").agg(F.sum("tf").alias("n"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("seen"), F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("logs"))
    n, logs = (F.coalesce(c, F.lit(0)) for c in ("n", "logs"))
    joined = rows.drop("tail", "tail_n").join(found, "rid", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base_head") + logs - F.col("n_tokens") * F.lit(float(base_total))).alias("base_score"), (F.col("score_head") + logs).alias("score"))


def lm_scores(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """Learn from the training fold and score every row of ``docs``.

    A null text is empty: its only token is the end. A null ``doc_id`` trains.
    Repeated rows count each and score alike. A very long text is learnt in
    parts of ``FIT_TOKENS`` and scored as one, its state carried through; words
    of like count are ordered by their bytes. Extra columns are ignored; an
    empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False)))
    small_batches(docs.sparkSession)
    training = rows.where(~F.col("held_out"))
    counts = materialize(count_words(training).where("c > 0"), "token-counts")
    vocab = Vocabulary.of(counts, head_words)
    return score_texts(rows, counts, vocab, refine(training, vocab, Gru(vocab)))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
