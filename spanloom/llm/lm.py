"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation (numpy).

Every token belongs to a *class* by the two bytes that it ends in; endings that hold much of the corpus have
several classes, which a hash of the token deals out.  The ``vocabulary_size`` most frequent tokens, a number that grows with the
square root of the corpus, are *members* of their class with vectors of their own; all others are its *rest*.
The representation of a context is the sum over the ``CONTEXT`` tokens before of their input vectors (by member or
rest), times position weights.  Two log-bilinear levels predict from it: the class, and the member or rest
within the class.  Within the rest a token has its smoothed share of the rest's count, so the
probabilities of all tokens, known or not, sum to one.  Normalised log-probabilities come from one matrix product
and one log-sum-exp for each block of tokens and level.

Both levels learn by NCE with stratified noise (a systematic sample of the unigram distribution) and
Adagrad.  Training reads *all* training tokens once: documents are dealt by a hash of their id into groups of
a fixed number of tokens and into ``ROUNDS`` slices; in a round every group goes through its slice, in a fixed order,
from the common parameters, and the groups' results are averaged by tokens.  So the result doesn't depend on
partitions, and each task's memory and what the groups send stay bounded.  Counts cover all
training tokens, exactly; only the ``HEAD`` most frequent are broadcast, other tokens' counts meet the
documents in a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, single_threaded

CLASSES, CONTEXT, DIM = 255, 4, 16
#: Tokens whose counts are broadcast: at most so many, of at most so many bytes each.
HEAD, HEAD_BYTES = 1 << 18, 64
NOISE, BATCH, NOISE_IN, BATCH_IN, RATE, RATE_IN = 48, 1024, 48, 512, 0.1, 0.05
ROUNDS, SPAN, GROUP = 3, 1 << 17, 5_000_000
END_TOKEN = " "  # no word holds a space
LN10 = math.log(10)


def vocabulary_size(tokens: int) -> int:
    """How many tokens have vectors of their own: twice the square root of the training tokens."""
    return min(HEAD, int(2 * math.sqrt(tokens)))


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a text column, all words in order by their number, and each text's number of words.

    Words are runs of what isn't space or 0x09-0x0D, A-Z lower-cased; null counts as empty.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    ends, words = np.asarray(lists.offsets), lists.values
    full = np.asarray(pc.binary_length(words)) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    coded = words.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), before[ends[1:]] - before[ends[:-1]]


def endings(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each token (none is empty) the number of its last two bytes, and a small hash of other bytes."""
    tokens = tokens.cast(pa.large_string())
    buffers = tokens.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if len(tokens) else np.zeros(0, np.uint8)
    n, end = np.diff(offsets), offsets[1:]
    byte = lambda k: np.where(n >= k, data[np.maximum(end - k, 0)], 0).astype(np.int64) if len(n) else n
    return byte(1) * 256 + byte(2), byte(3) * 31 + byte(4) * 131 + (data[offsets[:-1]].astype(np.int64) * 17 if len(n) else n) + n


def class_tables(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By ending, its first class and its number of classes: as many as its share of the ``mass``; small endings share the classes left."""
    many = np.floor(mass / max(mass.sum(), 1) * CLASSES * 0.8).astype(np.int64)
    first = np.cumsum(many) - many
    light = np.flatnonzero(many == 0)
    used = int(many.sum())
    first[light] = used + (light * 2654435761 >> 7) % (CLASSES - used)
    many[light] = 1
    return first, many


@dataclass
class Vocabulary:
    """What encodes texts: head tokens with log10(count + 0.5) and symbol (-1 for the rest of a class), and the classes.

    Symbols of a class are consecutive, its rest last; class u has ``base[u]`` to ``base[u + 1]``.  The end is the last class.
    """

    head: pa.Array
    cost: np.ndarray
    symbol: np.ndarray
    first: np.ndarray
    many: np.ndarray
    base: np.ndarray
    end_cost: float
    end_known: int

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def classes(self, tokens: pa.Array) -> np.ndarray:
        ending, other = endings(tokens)
        return self.first[ending] + other % self.many[ending]

    def encode(self, column: pa.Array):
        """Symbols of texts end to end, each with its end; lengths; n_known, base and rest costs; tokens beyond the head (text, token, n)."""
        words, codes, lengths = words_of(column)
        at = np.asarray(pc.index_in(words, value_set=self.head).fill_null(-1))
        known = at >= 0
        symbol = np.where(known, self.symbol[at], -1) if len(self.head) else np.full(len(words), -1)
        rest = symbol < 0
        symbol[rest] = self.base[self.classes(words) + 1][rest] - 1
        cost = np.where(known, self.cost[at], 0.0) if len(self.head) else np.zeros(len(words))
        ends = np.cumsum(lengths + 1) - 1
        ids = np.full(len(codes) + len(lengths), self.size - 1, dtype=np.uint16 if self.size <= 1 << 16 else np.uint32)
        inner = np.ones(len(ids), dtype=bool)
        inner[ends] = False
        ids[inner] = symbol[codes]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[np.concatenate([[0], np.cumsum(lengths)])])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        far = ~known[codes]
        pairs, n = np.unique(doc[far] * max(len(words), 1) + codes[far], return_counts=True)
        tails = pairs // max(len(words), 1), words.take(pa.array(pairs % max(len(words), 1))), n
        return ids, lengths + 1, total(known) + self.end_known, total(cost) + self.end_cost, total(np.where(rest, cost, 0.0)), tails


def contexts(ids: np.ndarray, starts: np.ndarray, low: int, high: int, none: int) -> np.ndarray:
    """For tokens ``low`` to ``high`` of texts laid end to end, the ``CONTEXT`` symbols before each in its text, nearest first.

    Each column is contiguous and of numpy's index type, for :meth:`Lbl.hidden`.
    """
    at = np.arange(low, high)
    since = at - starts[low:high]
    out = np.full((CONTEXT, high - low), none, dtype=np.intp)
    for j in range(CONTEXT):
        ok = np.flatnonzero(since > j)
        out[j, ok] = ids[at[ok] - j - 1]
    return out.T


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.maximum(x, np.float32(-30), out=x)
    np.minimum(x, np.float32(30), out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _scatter(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds ``values`` to ``rows`` of a contiguous matrix; repeated rows add up."""
    width = target.shape[1]
    np.add.at(target.reshape(-1), (rows[:, None].astype(np.int64, copy=False) * width + np.arange(width)).ravel(), values.ravel())


def _log_softmax(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The natural-log probability of one column of each row; ``z`` is overwritten."""
    picked = z.ravel().take(np.arange(0, z.size, z.shape[1]) + own).astype(np.float64)
    top = float(z.max())
    if top > 60:
        z -= (peak := z.max(axis=1))[:, None]
        picked -= peak
    np.exp(z, out=z)
    return picked - np.log((z @ np.ones(z.shape[1], np.float32)).astype(np.float64))


class Lbl:
    """Parameters: input vectors by symbol, position weights, output vectors (bias last) of classes and of symbols within them; Adagrad's sums."""

    def __init__(self, base: np.ndarray, class_mass: np.ndarray, symbol_mass: np.ndarray, seed: int = 5):
        self.base, size, units = base, int(base[-1]), len(base) - 1
        self.unit = np.repeat(np.arange(units), np.diff(base)).astype(np.int32)
        self.r = np.random.default_rng(seed).normal(0, 0.1, (size + 1, DIM)).astype(np.float32)
        self.c = np.ones((CONTEXT, DIM), dtype=np.float32) / np.sqrt(np.arange(1, CONTEXT + 1, dtype=np.float32))[:, None]
        share = class_mass / class_mass.sum()
        self.log_noise, self.run = np.log(share).astype(np.float32), np.cumsum(share)
        inner = symbol_mass / np.add.reduceat(symbol_mass, base[:-1])[self.unit]
        self.log_noise_in, self.run_in = np.log(inner).astype(np.float32), np.cumsum(inner)
        self.q = np.zeros((units, DIM + 1), dtype=np.float32)
        self.q[:, DIM] = self.log_noise
        self.q_in = np.zeros((size, DIM + 1), dtype=np.float32)
        self.q_in[:, DIM] = self.log_noise_in
        self.sum_r, self.sum_q, self.sum_in = (np.full(k, 1e-2, dtype=np.float32) for k in (size + 1, units, size))

    def __setstate__(self, state: dict) -> None:
        """Fresh arrays: unpickled ones carry a dtype object of their own, on which ``ufunc.at`` is ten times slower."""
        for name, x in state.items():
            setattr(self, name, fresh := np.empty(x.shape, np.dtype(x.dtype.str)))
            fresh[...] = x

    def copy(self) -> "Lbl":
        """A model whose parameters can be trained on their own."""
        out = Lbl.__new__(Lbl)
        out.__setstate__(self.__dict__)
        return out

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.q_in, self.sum_r, self.sum_q, self.sum_in]

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        """Representations, with a one at the end for the biases."""
        h = np.ones((len(ctx), DIM + 1), dtype=np.float32)
        x = self.r.take(ctx[:, 0], axis=0)
        x *= self.c[0]
        for j in range(1, CONTEXT):
            y = self.r.take(ctx[:, j], axis=0)
            y *= self.c[j]
            x += y
        h[:, :DIM] = x
        return h

    def by_class(self, units: np.ndarray):
        """The classes of more than one symbol that tokens are in, and the tokens' places."""
        order = np.argsort(units.astype(np.int16), kind="stable")
        cuts = np.searchsorted(units[order], np.arange(len(self.base)))
        for u in np.flatnonzero((np.diff(self.base) > 1) & (np.diff(cuts) > 0)):
            yield int(self.base[u]), int(self.base[u + 1]), order[cuts[u] : cuts[u + 1]]

    def log_probs(self, ids: np.ndarray, starts: np.ndarray, low: int, high: int) -> np.ndarray:
        """Normalised natural-log probabilities of the symbols from ``low`` to ``high`` of texts laid end to end."""
        own = ids[low:high].astype(np.int64)
        ctx, units = contexts(ids, starts, low, high, self.base[-1]), self.unit[own]
        h, out, q = np.empty((len(own), DIM + 1), np.float32), np.empty(len(own)), np.ascontiguousarray(self.q.T)
        room = np.empty(max(BATCH * q.shape[1], 1 << 18, int(np.diff(self.base).max())), np.float32)  # the same memory for every block's scores
        scores = lambda x, q: np.matmul(x, q, out=room[: len(x) * q.shape[1]].reshape(len(x), -1))
        for a in range(0, len(own), BATCH):
            b = slice(a, a + BATCH)
            h[b] = self.hidden(ctx[b])
            out[b] = _log_softmax(scores(h[b], q), units[b])
        for lo, hi, places in self.by_class(units):
            q, step = np.ascontiguousarray(self.q_in[lo:hi].T), max(1, (1 << 18) // (hi - lo))
            for a in range(0, len(places), step):
                p = places[a : a + step]
                out[p] += _log_softmax(scores(h.take(p, axis=0), q), own[p] - lo)
        return out

    @staticmethod
    def _contrast(h, target, noise, q, log_noise):
        """NCE with noise that a batch shares: gradients at the targets' and the noise's scores."""
        log_k = math.log(len(noise))
        positive = 1 - _sigmoid(np.einsum("ij,ij->i", h, q.take(target, axis=0)) - log_k - log_noise[target])
        negative = h @ q[noise].T
        negative -= log_k + log_noise[noise]
        negative = _sigmoid(negative)
        return positive, np.negative(negative, out=negative)

    @staticmethod
    def _adagrad(h, target, noise, positive, negative, q, sums, rate):
        d = np.zeros(q.shape, np.float32)
        _scatter(d, target, positive[:, None] * h)
        np.add.at(d, noise, negative.T @ h)
        sums += np.einsum("ij,ij->i", d, d) / d.shape[1]
        d *= np.float32(rate)
        d /= np.sqrt(sums)[:, None]
        q += d

    def step(self, ctx: np.ndarray, units: np.ndarray, rng: np.random.Generator) -> None:
        """One step of the class level and of the input vectors on a batch."""
        h = self.hidden(ctx)
        noise = np.minimum(np.searchsorted(self.run, (np.arange(NOISE) + rng.random()) / NOISE * self.run[-1]), len(self.q) - 1)
        positive, negative = self._contrast(h, units, noise, self.q, self.log_noise)
        back = positive[:, None] * self.q.take(units, axis=0)[:, :DIM]
        back += negative @ self.q[noise, :DIM]
        self._adagrad(h, units, noise, positive, negative, self.q, self.sum_q, RATE)
        seen = ctx.T.ravel()
        d = (back[None] * self.c[:, None]).reshape(-1, DIM)
        np.add.at(self.sum_r, seen, np.einsum("ij,ij->i", d, d) / np.float32(DIM))
        d *= (RATE_IN / np.sqrt(self.sum_r[seen]))[:, None]
        _scatter(self.r, seen, d)

    def step_members(self, h: np.ndarray, ids: np.ndarray, lo: int, hi: int, rng: np.random.Generator) -> None:
        """One step of a class's inner level on a batch of its tokens."""
        start = self.run_in[lo - 1] if lo else 0.0
        at = start + (np.arange(NOISE_IN) + rng.random()) / NOISE_IN * (self.run_in[hi - 1] - start)
        noise = np.minimum(np.searchsorted(self.run_in[lo:hi], at), hi - lo - 1)
        q = self.q_in[lo:hi]
        positive, negative = self._contrast(h, ids - lo, noise, q, self.log_noise_in[lo:hi])
        self._adagrad(h, ids - lo, noise, positive, negative, q, self.sum_in[lo:hi], RATE)

    def train(self, ids: np.ndarray, starts: np.ndarray, low: int, high: int, rng: np.random.Generator) -> None:
        """NCE over the tokens from ``low`` to ``high`` of texts laid end to end, in a random order."""
        order = rng.permutation(high - low)
        ctx, own = contexts(ids, starts, low, high, self.base[-1]).T.take(order, axis=1).T, ids[low:high][order].astype(np.int64)
        units = self.unit[own]
        for a in range(0, len(own), BATCH):
            self.step(ctx[a : a + BATCH], units[a : a + BATCH], rng)
        h = self.hidden(ctx)
        for lo, hi, places in self.by_class(units):
            for a in range(0, len(places), BATCH_IN):
                p = places[a : a + BATCH_IN]
                self.step_members(h.take(p, axis=0), own[p], lo, hi, rng)


def _laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, and where each token's text starts."""
    lengths = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.repeat(np.cumsum(lengths) - lengths, lengths)


def _spans(n: int):
    """Ranges of about ``SPAN`` tokens that cover ``n``."""
    cuts = np.linspace(0, n, max(1, round(n / SPAN)) + 1).astype(int)
    return zip(cuts, cuts[1:])


def _counts(batches):
    """Token counts of the training texts, in tables of a bounded size."""
    held, size = [], 0

    def flush():
        words, codes, lengths = words_of(pa.concat_arrays(held))
        n = pa.array(np.bincount(codes, minlength=len(words)), pa.int64())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([words.slice(at, 50_000), n.slice(at, 50_000)], ["token", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([END_TOKEN]), pa.array([len(lengths)], pa.int64())], ["token", "c"])

    for b in batches:
        held.append(b.column(0))
        size += b.column(0).nbytes
        if size > 16 << 20:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _masses(of):
    """Sums of counts and numbers of tokens, by ``of`` (an array of numbers for an array of tokens)."""

    def run(batches):
        for b in batches:
            keep = b.filter(pc.not_equal(b.column(0), END_TOKEN))
            key, back = np.unique(of(keep.column(0)), return_inverse=True)
            c = np.bincount(back, np.asarray(keep.column(1)), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(c), pa.array(np.bincount(back, minlength=len(key)), pa.int64())], ["k", "c", "n"])

    return run


def _summed(counts: DataFrame, of) -> dict[int, tuple[int, int]]:
    return {r[0]: (r[1], r[2]) for r in counts.mapInArrow(_masses(of), "k long, c long, n long").groupBy("k").agg(F.sum("c"), F.sum("n")).collect()}


def build(counts: DataFrame, total: int) -> tuple[Vocabulary, Lbl, np.ndarray]:
    """Vocabulary, untrained model and log10 mass of every symbol (0 for members), from the counts (token, c).

    The driver gets at most ``HEAD`` tokens of bounded length, 65,536 endings and ``CLASSES`` sums.
    """
    short = counts.filter((F.octet_length("token") <= HEAD_BYTES) & (F.col("token") != END_TOKEN))
    # the most frequent tokens by a threshold on the count, from a histogram of at most a few hundred steps
    room, least = HEAD, None
    for _, n, low in short.groupBy(F.floor(F.log2("c") * 8).alias("s")).agg(F.count("*"), F.min("c")).orderBy(F.desc("s")).collect():
        if n > room:
            break
        room, least = room - n, low
    top = short.filter(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()
    top = top.sort_by([("c", "descending"), ("token", "ascending")])
    head, c = top.column("token").combine_chunks(), np.asarray(top.column("c").combine_chunks()).astype(np.float64)
    ends = counts.filter(F.col("token") == END_TOKEN).select("c").collect()
    end = ends[0][0] if ends else 0
    mass = np.zeros(1 << 16)
    for k, (x, _) in _summed(counts, lambda tokens: endings(tokens)[0]).items():
        mass[k] = x
    first, many = class_tables(mass)
    sums = _summed(counts, Vocabulary(None, None, None, first, many, np.zeros(1), 0.0, 0).classes)
    class_c, class_n = (np.array([sums.get(u, (0, 0))[k] for u in range(CLASSES)], dtype=np.float64) for k in (0, 1))
    members = vocabulary_size(total)
    vocabulary = Vocabulary(head, np.log10(c + 0.5), np.full(len(head), -1, dtype=np.int64), first, many, np.zeros(1), math.log10(end + 0.5), int(end > 0))
    of = vocabulary.classes(head.slice(0, members)) if len(head) else np.zeros(0, np.int64)
    sizes = np.bincount(of, minlength=CLASSES)
    vocabulary.base = base = np.concatenate([[0], np.cumsum(np.append(sizes + 1, 1))])
    order = np.argsort(of, kind="stable")
    place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of[order]]
    vocabulary.symbol[order] = base[of[order]] + place
    symbol_mass = np.ones(base[-1])
    symbol_mass[vocabulary.symbol[: len(of)]] = c[: len(of)] + 0.5
    rest = base[1 : CLASSES + 1] - 1
    own_c, own_n = np.bincount(of, c[: len(of)], CLASSES), sizes
    # what smoothing spreads within a class's rest: 0.5 a known token, 0.5 for all unknown ones
    symbol_mass[rest] = class_c - own_c + 0.5 * (class_n - own_n + 1)
    log_mass = np.zeros(base[-1])
    log_mass[rest] = np.log10(symbol_mass[rest])
    return vocabulary, Lbl(base, np.append(class_c, end) + 0.5, symbol_mass), log_mass


def _averaged(table: pa.Table) -> pa.Table:
    """The mean of one block of parameters over groups, weighted by their tokens."""
    parts = sorted(zip(*(table.column(c).to_pylist() for c in ("grp", "tokens", "part"))))
    mean = sum(np.frombuffer(p, np.float32).astype(np.float64) * n for _, n, p in parts) / sum(n for _, n, _ in parts)
    return pa.Table.from_arrays([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["block", "mean"])


def fit(encoded: DataFrame, model: Lbl, tokens: int) -> None:
    """Train on encoded texts (id, n, ids); each group of documents passes through its slice in every round."""
    spark, size = encoded.sparkSession, len(model.base) and int(model.base[-1])
    groups = max(1, -(-tokens // max(GROUP, 280 * size)))
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    key = F.xxhash64("id", "n")
    dealt = encoded.select(F.pmod(key, F.lit(groups)).cast("int").alias("grp"), F.pmod(F.xxhash64(key, F.lit(3)), F.lit(ROUNDS)).alias("slice"), key.alias("key"), "id", "ids")
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared, turn=turn, block=1 << 18):
            single_threaded()
            grp, own, rng, seen, held, many = None, None, None, 0, [], 0

            def learn():
                ids, starts = _laid_out(held)
                for a, b in _spans(len(ids)):
                    own.train(ids, starts, a, b, rng)

            def result():
                flat = own.flat()
                parts = [flat[a : a + block].tobytes() for a in range(0, len(flat), block)]
                k = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([grp] * k, pa.int32()), pa.array([seen] * k, pa.int64()), pa.array(parts, pa.binary())], ["block", "grp", "tokens", "part"])

            for b in batches:
                for g, packed in zip(b.column(0).to_pylist(), b.column(1)):
                    if g != grp:
                        if grp is not None:
                            if held:
                                learn()
                            yield from result()
                        own = shared.value.copy()
                        grp, rng, seen, held, many = g, np.random.default_rng((turn, g)), 0, [], 0
                    held.append(np.frombuffer(packed.as_buffer(), kind))
                    seen += len(held[-1])
                    many += len(held[-1])
                    if many >= SPAN:
                        learn()
                        held, many = [], 0
            if grp is not None:
                if held:
                    learn()
                yield from result()

        own = dealt.filter(F.col("slice") == turn).repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "key", "id", "ids").select("grp", "ids")
        sums = own.mapInArrow(lean(run), "block int, grp int, tokens long, part binary")
        means = sums.groupBy("block").applyInArrow(_averaged, "block int, mean binary").collect()
        if means:
            model.set(np.concatenate([np.frombuffer(bytes(r[1]), np.float32) for r in sorted(means)]))
        shared.unpersist()


def score_documents(df: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``train`` says which rows to learn from; held_out is its contrary.  Null and empty texts are one token,
    the end.  base_score is the smoothed unigram's log10 probability, score the model's.  Ties in count are
    settled by token.  Repeated rows are scored each; extra columns, whatever their names, are not read.  Without training rows all
    counts are 0 and the model is uniform over its classes; an empty table gives an empty result.  The
    vocabulary and the trained model are the result's attribute ``spanloom_model``.
    """
    spark = df.sparkSession
    train = F.coalesce(train, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), (~train).alias("held_out"), F.col(text_col).alias("text"))
    counts = materialize(rows.filter(~F.col("held_out")).select("text").mapInArrow(lean(_counts), "token string, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts", tidy=True)
    total, kinds = counts.agg(F.sum("c"), F.count("*")).first()
    total = int(total or 0)
    vocabulary, model, log_mass = build(counts, total)
    size, log_d = vocabulary.size, math.log10(total + 0.5 * (kinds + 1))
    coder = spark.sparkContext.broadcast(vocabulary)

    def encoded(batches):
        seen, partition = 0, TaskContext.get().partitionId()
        for b in batches:
            ids, n, known, base, rest, (doc, tokens, times) = coder.value.encode(b.column(2))
            m, k = b.num_rows, len(doc)
            number = (partition << 40) + seen + np.concatenate([np.arange(m), doc])
            seen += m
            ends = np.cumsum(n)
            packed = pa.array([ids[e - x : e].tobytes() for e, x in zip(ends, n)], pa.binary())
            at = pa.array(np.concatenate([np.arange(m), doc]), pa.int64())
            none = lambda t: pa.nulls(k, t)
            both = lambda x, t: pa.concat_arrays([pa.array(x, t), none(t)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.concat_arrays([pa.nulls(m, pa.string()), tokens.cast(pa.string())]), pa.array(np.concatenate([n, times]), pa.int64()),
                    both(known, pa.int64()), both(base, pa.float64()), both(rest, pa.float64()), pa.concat_arrays([packed, none(pa.binary())]),
                ],
                ["row", "id", "held_out", "token", "n", "n_known", "base", "rest", "ids"],
            )

    id_kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(lean(encoded), f"row long, id {id_kind}, held_out boolean, token string, n long, n_known long, base double, rest double, ids binary")
    found = materialize(found, "found", tidy=True)
    texts = found.filter("token is null")
    if total:
        fit(texts.filter(~F.col("held_out")).select("id", "n", "ids"), model, total)
    shared = spark.sparkContext.broadcast((model, log_mass))
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    def scored(batches):
        single_threaded()
        model, log_mass = shared.value
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), kind) for x in b.column(b.num_columns - 1)]
            ids, starts = _laid_out(parts) if parts else (np.zeros(0, kind), np.zeros(0, int))
            logs = np.concatenate([model.log_probs(ids, starts, a, e) for a, e in _spans(len(ids))]) if parts else np.zeros(0)
            logs = logs / LN10 - log_mass[ids]
            first = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.add.reduceat(logs, first) if parts else logs, pa.float64())], [*b.schema.names[:-1], "model"])

    own = texts.select("row", "id", "held_out", "n", "n_known", "base", "rest", "ids")
    own = own.mapInArrow(lean(scored), f"row long, id {id_kind}, held_out boolean, n long, n_known long, base double, rest double, model double")
    tail = found.filter("token is not null").select("row", "token", "n").join(counts, "token", "left")
    cost = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    tail = tail.groupBy("row").agg(F.sum(cost).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    far = F.coalesce("tail", F.lit(0.0))
    out = own.join(tail, "row", "left").select(
        F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + far - F.col("n") * F.lit(log_d)).alias("base_score"), (F.col("model") + F.col("rest") + far).alias("score"),
    )
    out.spanloom_model = (vocabulary, model)
    return out
