"""Hidden Markov language model scores.

Words are lower-cased (A-Z) runs between ASCII white space; a text is its words and one
end token. The states emit symbols: each of the ``FREQUENT`` commonest words, the end,
or one of ``ENDINGS`` classes that take every other word by its last three bytes. A
word within a class has its smoothed share of the class (an unseen word that of a
half-count), whatever the state, so the model gives every text a
probability and the recursion needs a bounded table only.

Training is Baum-Welch: expected counts of every training document (in stretches of
``STRETCH`` tokens) are summed over partitions and re-estimated until a round gains less
than ``SETTLED`` a token (``ROUNDS`` at most). The start is learned from every training
document too: each stretch is the sum of its symbols' random vectors, each symbol the
mean of the stretches it stands in, and the symbols are clustered into the states.
Scoring is the scaled forward recursion over whole texts, many texts side by side; what
few long texts have beyond all others is cut, each piece is run from every state, and the
pieces are multiplied, which is exact.

Defined results: null and empty texts are the end alone; with no training documents
every word is unknown; repeated and null ids keep a row each (a null id counts as the
empty text for its remainder); extra columns are ignored; an empty table gives none.

Scale: all word counts are kept and joined, never broadcast; only the table of
frequent words is (its size is a parameter). Words outside it are shuffled to their
counts, as (text, word, times) rows, once.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, remainder, rows

STATES, FREQUENT, ENDINGS, STRETCH, ROUNDS = 8, 16_384, 256, 64, 30
SETTLED = 0.005  # natural log likelihood a token
AXES, STEADY, OWN = 16, 20, 0.8  # of the start: axes of a context, occurrences that count as none, share of a symbol in its own state
#: What FEW texts at most of a group have beyond LONG tokens is cut into pieces of PIECE tokens.
LONG, PIECE, FEW = 2048, 512, 24
SCALED = 8  # steps of the forward recursion between two scalings
PRIOR = 200.0  # words of smoothing that a state takes from all words
END = b" "  # no word holds a space
FLUSH = 250_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_counts(batches):
    import pyarrow as pa

    seen: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return batch

    for b in rows(batches):
        for t in b.column("text").to_pylist():
            seen.update(words_of(t))
        seen[END] += b.num_rows
        if len(seen) > FLUSH:
            yield out()
    if seen:
        yield out()


class Symbols:
    """Frequent words (END among them) by number, then the classes of all others."""

    def __init__(self, frequent: list[bytes]):
        self.number = {w: i for i, w in enumerate(frequent)}
        self.end, self.known = self.number[END], len(frequent)
        self.size = self.known + ENDINGS

    def encode(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Symbols of a text and its words outside the table."""
        words = words_of(text)
        ids = list(map(self.number.get, words))
        rest = [w for w, i in zip(words, ids) if i is None]
        if rest:
            classes = iter([self.known + zlib.crc32(w[-3:]) % ENDINGS for w in rest])
            ids = [next(classes) if i is None else i for i in ids]
        ids.append(self.end)
        return np.array(ids, np.uint16 if self.size <= 1 << 16 else np.uint32), rest


def _encoded(symbols: Symbols):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        for b in rows(batches):
            found = [symbols.encode(t) for t in b.column("text").to_pylist()]
            rest = [list(zip(*Counter(r).items())) if r else [(), ()] for _, r in found]
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + n)),
                    b.column("doc_id"),
                    b.column("held_out"),
                    pa.array([len(s) for s, _ in found], pa.int64()),
                    pa.array([s.astype(np.uint32).tobytes() if s.dtype != np.uint16 else s.tobytes() for s, _ in found], pa.binary()),
                    pa.array([w for w, _ in rest], pa.list_(pa.binary())),
                    pa.array([k for _, k in rest], pa.list_(pa.int64())),
                ],
                names=["rid", "doc_id", "held_out", "n_tokens", "symbols", "rest", "times"],
            )
            rid += n

    return run


class Hmm:
    """start (K), move (K x K), emit (symbols x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)

    def counts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected start, move and emission counts, and the log likelihood of the stretches."""
        k = len(self.start)
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit, np.float64), 0.0
        if not texts:
            return start, move, emit, total
        # one row for each state, so that sums over states are sums of rows
        emits, onward = np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T)
        every, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        pieces = -(-sizes // STRETCH)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * STRETCH
        lengths = np.minimum(np.repeat(sizes, pieces) - nth * STRETCH, STRETCH)
        for at in range(0, len(begins), 4096):
            n = lengths[at : at + 4096]
            order = np.argsort(-n, kind="stable")
            n, begin = n[order], begins[at : at + 4096][order]
            active = np.searchsorted(-n, -np.arange(n[0]), "left").tolist()
            obs = [every[begin[:m] + t] for t, m in enumerate(active)]
            e = [emits.take(o, axis=1) for o in obs]
            forward, scale = [], []
            for t, m in enumerate(active):
                a = e[t] * (self.start[:, None] if t == 0 else onward @ forward[-1][:, :m])
                c = a.sum(0)
                a /= c
                forward.append(a)
                scale.append(c)
                total += float(np.log(c).sum(dtype=np.float64))
            back = np.ones((k, active[-1]), np.float32)
            for t in range(len(active) - 1, -1, -1):
                m = active[t]
                if t + 1 < len(active):
                    nxt = np.ones((k, m), np.float32)
                    e[t + 1] *= back
                    e[t + 1] /= scale[t + 1]
                    p = active[t + 1]
                    move += forward[t][:, :p] @ e[t + 1].T
                    nxt[:, :p] = self.move @ e[t + 1]
                    back = nxt
                e[t + 1 :] = []
                forward[t] *= back
            start += forward[0].sum(1)
            seen = np.concatenate(obs)
            for j in range(k):
                emit[:, j] += np.bincount(seen, np.concatenate([w[j] for w in forward]), len(emit))
        return start, move * self.move, emit, total

    def estimated(self, start, move, emit, shares: np.ndarray) -> Hmm:
        """The model of some expected counts; a state without words falls back on all words."""
        k = len(start)
        a = move + 1.0 / k
        b = emit + PRIOR * shares[:, None]
        s = start + 1.0 / k
        f32 = np.float32
        return Hmm((s / s.sum()).astype(f32), (a / a.sum(1, keepdims=True)).astype(f32), (b / b.sum(0)).astype(f32))

    # scoring ------------------------------------------------------------
    def _run(self, texts: list[np.ndarray], alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward recursion side by side: last distribution and log scale of each.

        ``alpha``: distributions before the first token; None: the start distribution."""
        n = np.array([len(x) for x in texts])
        order = np.argsort(-n, kind="stable")
        active = np.searchsorted(-n[order], -np.arange(n[order[0]]), "left")
        at = np.cumsum(active) - active
        obs = np.zeros(int(n.sum()), np.int64)  # by token, then by text; only those that have the token
        for i, j in enumerate(order.tolist()):
            obs[at[: n[j]] + i] = texts[j]
        # double precision: the likelihood of long texts is the sum of many logs
        emit, move = self.emit.astype(np.float64), self.move.astype(np.float64)
        state = np.tile(self.start.astype(np.float64), (len(texts), 1)) if alpha is None else alpha[order].astype(np.float64)
        log = np.zeros(len(texts))

        def scale(m: int) -> None:
            c = state[:m] @ np.ones(len(move))
            state[:m] /= c[:, None]
            log[:m] += np.log(c)

        for t, (a, m) in enumerate(zip(at.tolist(), active.tolist())):
            e = emit[obs[a : a + m]]
            np.multiply(state[:m] if t == 0 and alpha is None else state[:m] @ move, e, out=state[:m])
            if t % SCALED == SCALED - 1:
                scale(m)
        scale(len(texts))
        back = np.argsort(order)
        return state[back], log[back]

    def log_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole symbol sequence (none is empty)."""
        # as far as some texts run side by side; only where a few are left, what follows is cut
        sizes = sorted(map(len, texts), reverse=True)
        side = max(LONG, sizes[FEW] if len(sizes) > FEW else 0)
        states, out = self._run([t[:side] for t in texts], None)
        k = len(self.start)
        for i in (i for i, t in enumerate(texts) if len(t) > side):
            t, state, log = texts[i], states[i], float(out[i])
            for at in range(side, len(t), 64 * PIECE):
                pieces = [t[j : j + PIECE] for j in range(at, min(len(t), at + 64 * PIECE), PIECE)]
                ends, scales = self._run([p for p in pieces for _ in range(k)], np.tile(np.eye(k), (len(pieces), 1)))
                for p in range(len(pieces)):
                    s = scales[p * k : (p + 1) * k]
                    top = s.max()
                    state = (state * np.exp(s - top)) @ ends[p * k : (p + 1) * k]
                    c = state.sum()
                    state, log = state / c, log + float(top + np.log(c))
            out[i] = log
        return out


def contexts(texts: list[np.ndarray], symbols: int, axes: int = AXES) -> np.ndarray:
    """Of each symbol, the sum of the directions of the stretches it stands in."""
    vectors = np.random.default_rng(7).standard_normal((symbols, axes)).astype(np.float32)
    out = np.zeros((symbols, axes))
    cut = [t[i : i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)]
    for at in range(0, len(cut), 4096):
        n = np.array([len(x) for x in cut[at : at + 4096]])
        seen = np.concatenate(cut[at : at + 4096])
        sums = np.add.reduceat(vectors[seen], np.cumsum(n) - n, axis=0)
        sums /= np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9
        for j in range(axes):
            out[:, j] += np.bincount(seen, np.repeat(sums[:, j], n), symbols)
    return out


def clusters(points: np.ndarray, weights: np.ndarray, most: int, steps: int = 30) -> np.ndarray:
    """Weighted k-means, seeded at random by distance: the cluster of each point."""
    rng = np.random.default_rng(0)
    centres = points[rng.choice(len(points), 1, p=weights / weights.sum())]
    distances = lambda: np.stack([((points - c) ** 2).sum(1) for c in centres], 1)
    while len(centres) < most and (far := distances().min(1) * weights).sum() > 0:
        centres = np.concatenate([centres, points[rng.choice(len(points), 1, p=far / far.sum())]])
    for _ in range(steps):
        of = distances().argmin(1)
        for k in np.unique(of):
            centres[k] = np.average(points[of == k], axis=0, weights=weights[of == k])
    return of


def start_of(context: np.ndarray, shares: np.ndarray, tokens: int, states: int = STATES) -> Hmm:
    """The model whose states are the clusters of the symbols' contexts."""
    seen = shares * max(1, tokens)
    points = context / (seen[:, None] + STEADY)
    points -= np.average(points, axis=0, weights=seen)
    part = np.full((len(shares), states), (1 - OWN) / states)
    part[np.arange(len(shares)), clusters(points, seen, states)] += OWN
    emit = part * seen[:, None]
    return Hmm(np.ones(states), np.eye(states), emit).estimated(np.ones(states), np.eye(states) * 30 + 1, emit, shares)


def begin(texts: list[np.ndarray], shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """The start from texts in memory, then rounds of Baum-Welch on them."""
    model = start_of(contexts(texts, len(shares)), shares, sum(map(len, texts)), states)
    for _ in range(rounds if texts else 0):
        start, move, emit, _ = model.counts(texts)
        model = model.estimated(start, move, emit, shares)
    return model


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in column.to_pylist()]


def _contexts(symbols: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros((symbols, AXES))
        for big in batches:
            for b in rows([big], 2048, 4_000_000, "symbols"):
                total += contexts(_arrays(b.column("symbols")), symbols)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(total[used, j]) for j in range(AXES))], names=["symbol", *(f"v{j}" for j in range(AXES))])

    return run


def _expected(model: Hmm):
    """Rows by symbol; below zero: start (-1), a row of move for each state, the log likelihood (in v0)."""
    k = len(model.start)

    def run(batches):
        import pyarrow as pa

        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), np.zeros((1, k))
        for big in batches:
            for b in rows([big], 2048, 4_000_000, "symbols"):
                s, m, e, likelihood = model.counts(_arrays(b.column("symbols")))
                start, move, emit = start + s, move + m, emit + e
                total[0, 0] += likelihood
        used = np.flatnonzero(emit.any(1))
        values = np.concatenate([start[None, :], move, total, emit[used]])
        names = np.concatenate([-1 - np.arange(k + 2), used])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(values[:, j]) for j in range(k))], names=["symbol", *(f"v{j}" for j in range(k))])

    return run


def _scored(model: Hmm, logs: np.ndarray, classes: np.ndarray, known: int):
    """logs: log10 of the frequent symbols' shares; classes: of the classes' counts."""

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for b in rows([big], 8192, 8_000_000, "symbols"):
                texts = _arrays(b.column("symbols"))
                score = model.log_likelihood(texts) / np.log(10)
                every = np.concatenate(texts)
                doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                own = every < known
                base = np.bincount(doc[own], logs[every[own]], len(texts))
                n = np.bincount(doc[own], minlength=len(texts))
                score -= np.bincount(doc[~own], classes[every[~own] - known], len(texts))
                yield pa.RecordBatch.from_arrays(
                    [b.column("rid"), b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), pa.array(n), pa.array(base), pa.array(score)],
                    names=["rid", "doc_id", "held_out", "n_tokens", "own", "base", "model"],
                )

    return run


def _commonest(words: DataFrame, most: int) -> list:
    """The most frequent words. Only words of the classes of counts (powers of two) that
    hold them are sorted, in eight tasks, so the driver gets at most eight times as many."""
    classes = {r["c"]: r["count"] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("c")).count().collect()}  # 64 rows at most
    least, total = 0, 0
    for c in sorted(classes, reverse=True):
        total += classes[c]
        if total >= most:
            least = c
            break
    return words.where(F.col("n") >= (1 << least)).repartition(8).orderBy(F.desc("n"), "word").limit(most).collect()


def _summed(training: DataFrame, function, width: int) -> list:
    """A function's rows, added up by symbol: as many as there are symbols, and a few more."""
    columns = [f"v{j}" for j in range(width)]
    found = training.mapInArrow(function, "symbol long, " + ", ".join(f"{c} double" for c in columns))
    return [(r["symbol"], [r[c] for c in columns]) for r in found.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns)).collect()]


def _trained(training: DataFrame, shares: np.ndarray, tokens: int, states: int, rounds: int) -> Hmm:
    """Start and Baum-Welch rounds, each over all the training texts' symbols."""
    size = len(shares)
    context = np.zeros((size, AXES))
    for s, v in _summed(training, _contexts(size), AXES):
        context[s] = v
    model, last = start_of(context, shares, tokens, states), -np.inf
    for _ in range(rounds):
        start, move, emit, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
        for s, v in _summed(training, _expected(model), states):
            if s >= 0:
                emit[s] = v
            elif s == -1:
                start[:] = v
            elif s >= -1 - states:
                move[-2 - s] = v
            else:
                likelihood = v[0]
        model = model.estimated(start, move, emit, shares)
        if likelihood - last < SETTLED * tokens or not tokens:
            break
        last = likelihood
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if frequent + ENDINGS + 1 > 1 << 16:
        raise ValueError("frequent: too many for 16-bit symbols")
    ws = Workspace(docs.sparkSession, "hmm")
    texts = docs.select("doc_id", "text", (remainder("doc_id", 5) == 1).alias("held_out"))
    counted = texts.where(~F.col("held_out")).select("text").mapInArrow(_word_counts, "word binary, n long")
    vocab = ws.stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    whole = total["n"] + 0.5 * (total["v"] + 1)
    top = [(bytes(r["word"]), r["n"]) for r in _commonest(vocab.where(F.col("word") != F.lit(END)), frequent)]
    ends = vocab.where(F.col("word") == F.lit(END)).collect()
    top = [(END, ends[0]["n"] if ends else 0), *top]
    symbols = Symbols([w for w, _ in top])
    # shares of all symbols: frequent words, then the classes of the rest with the unseen half-count
    own = np.array([(n + 0.5) / whole for _, n in top])
    ending = F.crc32(F.expr("substring(word, -3, 3)")) % ENDINGS
    listed = docs.sparkSession.createDataFrame([(bytearray(w),) for w, _ in top], "word binary")
    by_class = vocab.join(F.broadcast(listed), "word", "left_anti").groupBy(ending.alias("c")).agg(F.sum(F.col("n") + 0.5).alias("n")).collect()
    classes = np.full(ENDINGS, 0.5)
    for r in by_class:
        classes[r["c"]] += r["n"]
    shares = np.concatenate([own * whole, classes])
    shares /= shares.sum()

    encoded = ws.stage(texts.mapInArrow(_encoded(symbols), f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, symbols binary, rest array<binary>, times array<long>"), "encoded", "zstd")
    training = encoded.where(~F.col("held_out")).select("symbols")
    model = _trained(training, shares, int(total["n"]), states, rounds)
    scorer = _scored(model, np.log10(own), np.log10(classes), symbols.known)
    scored = encoded.select("rid", "doc_id", "held_out", "n_tokens", "symbols").mapInArrow(
        scorer, f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, own long, base double, model double"
    )
    pair = F.explode(F.arrays_zip("rest", "times"))
    rest = encoded.where(F.size("rest") > 0).select("rid", pair.alias("p")).select("rid", F.col("p.rest").alias("word"), F.col("p.times").alias("times"))
    n = F.coalesce(F.col("n"), F.lit(0))
    # in a class, a word has its half-count more of the class's, an unseen one a half
    base, within = F.log10((n + 0.5) / whole), F.log10(n + 0.5)
    sums = rest.join(vocab, "word", "left").groupBy("rid").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(base * F.col("times")).alias("base_more"), F.sum(within * F.col("times")).alias("model_more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    end_known = 0 if ends else 1  # the end is among the frequent, also where it was never seen
    return scored.join(sums, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("own") - end_known + zero("more")).cast("long").alias("n_known"),
        F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"),
        (F.col("model") + zero("model_more")).alias("score"),
    )
