"""Language identification: averaged hashed subword embeddings and a linear softmax (numpy).

A text's features are its character 1- to 4-grams within words (boundaries count as a character), hashed
into ``BUCKETS`` rows of an embedding matrix.  A prediction averages the rows, weighted by the logarithm of
their counts (so that a line repeated a thousand times doesn't speak for the text), and applies a linear
softmax.  Both are trained by stochastic gradient descent on a bounded sample of labelled texts and on short
windows of them, so that short texts are known too.  A part of that sample, held back, calibrates the
temperature and the score under which a text is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, release
from .shingles import mix64

BUCKETS = 1 << 15
DIM = 16
NGRAMS = (1, 2, 3, 4)
#: At most about so many labelled texts of a language are learnt from, drawn by a hash of the id.
SAMPLE_PER_LANGUAGE = 1000
#: Of a sampled text, at most so many characters reach the driver; predictions read whole texts.
SAMPLE_CHARS = 1 << 16
#: Share of good texts that rejection may cost, and the most that a rejected text may score.
FALSE_REJECTS, REJECT_UNDER = 0.001, 0.5


def subwords(text: str) -> np.ndarray:
    """Hash buckets of the n-grams of a text; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", errors="replace"), dtype=np.uint32)
    if not len(codes):
        return codes.astype(np.int64)
    kinds = _letters(codes)
    word = np.zeros(len(codes) + 2, dtype=np.uint64)
    word[1:-1] = np.where(kinds, codes, 0)
    keep = np.ones(len(word), dtype=bool)
    keep[1:] = (word[1:] > 0) | (word[:-1] > 0)  # one boundary between words
    word = word[keep]
    if len(word) < 3:
        return np.zeros(0, dtype=np.int64)
    out = []
    for n in NGRAMS:
        m = len(word) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, dtype=np.uint64)
        inner = np.ones(m, dtype=bool)
        some = word[:m] > 0
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + word[j : m + j]
            if 0 < j < n - 1:
                inner &= word[j : m + j] > 0
            some = some | (word[j : m + j] > 0)
        out.append((mix64(h[inner & some]) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out)


_KNOWN = np.array([chr(c).isalpha() for c in range(0x3000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    out = _KNOWN[np.minimum(codes, len(_KNOWN) - 1)]
    high = np.flatnonzero(codes >= len(_KNOWN))
    if len(high):
        values, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(int(c)).isalpha() for c in values])[back]
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct buckets of a text and their shares; None if it has no letter."""
    counts = np.bincount(subwords(text), minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    if not len(ids):
        return None
    weights = np.log1p(counts[ids])
    return ids, weights / weights.sum()


class Model:
    """Languages, the softmax's rows by bucket (embedding times weights), bias, temperature and threshold."""

    def __init__(self, languages, rows, bias, temperature=1.0, threshold=0.0):
        self.languages, self.rows, self.bias, self.temperature, self.threshold = languages, rows, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray | None:
        """The averaged embedding's logits; None without letters.  The mean of rows equals the mean embedding times the weights."""
        own = bag(text)
        return None if own is None else own[1] @ self.rows[own[0]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether it is rejected."""
        z = self.logits(text) if text else None
        if z is None:
            return "und", 0.0, True
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(max(p[k], 0.0), 1.0)), bool(p[k] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 2.0, windows: int = 4, seed: int = 7) -> Model:
    """Fit embeddings and softmax by SGD on texts and windows of 2 to 40 words; every tenth text, with its windows, calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1))
    bags, rng = [], np.random.default_rng(seed)
    for t, label in zip(texts, labels):
        words, own = t.split(), [t]
        for _ in range(windows if len(words) > 2 else 0):
            n = int(rng.integers(2, 41))
            at = int(rng.integers(0, max(1, len(words) - n)))
            own.append(" ".join(words[at : at + n]))
        found = [(x[0].astype(np.uint16), x[1], languages.index(label)) for x in map(bag, own) if x is not None]
        if found:
            bags.append(found)
    order = rng.permutation(len(bags))
    held = [x for i in (order[::10] if len(bags) >= 50 else order) for x in bags[i]]
    fit = [x for k, i in enumerate(order) if k % 10 or len(bags) < 50 for x in bags[i]]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    w, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, share, y = fit[i]
            lr = rate * (1 - steps / total)
            steps += 1
            mean = share @ emb[ids]
            g = softmax(mean @ w + bias)
            g[y] -= 1
            back = w @ g
            w -= 0.1 * lr * np.outer(mean, g)
            bias -= 0.001 * lr * g
            emb[ids] -= lr * share[:, None] * back
    model = Model(languages, emb @ w, bias)
    z = np.array([share @ model.rows[ids] + bias for ids, share, _ in held]) if held else np.zeros((0, len(languages)))
    y = np.array([b[2] for b in held], dtype=int)
    if len(z):
        grid = np.geomspace(0.05, 5000, 120)
        losses = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        p = softmax(z / model.temperature)
        good = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(min(REJECT_UNDER, np.quantile(good, FALSE_REJECTS) / 2 if len(good) else 0.0, 0.9))
        model.threshold = max(model.threshold, 1.0 / len(languages) * 1.05 if len(languages) > 1 else 0.0)
    return model


def fit_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on about ``per_language`` texts of each language, up to ``SAMPLE_CHARS`` of each (a bounded sample, drawn by a hash of the id)."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("l")).count().collect()}
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for n in sorted({*counts.values()}):
        own = [k for k, v in counts.items() if v == n]
        wanted = wanted | (F.col(lang_col).isin(own) & (u < per_language / n))
    drawn = rows.filter(wanted).select(F.col(id_col).alias("i"), F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("t"), F.col(lang_col).alias("l")).collect()
    drawn.sort(key=lambda r: (str(r[0]), r[1]))
    model = train([r[1] for r in drawn], [r[2] for r in drawn])
    del drawn
    release()
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, ``keep``, lang_pred, score and rejected of every whole text; null or letterless texts are ``und`` with score 0.

    Ties between languages go to the first in order.  Repeated rows give repeated results, an empty table an empty one.  A kept
    column may not be called like a result.
    """
    if {k.lower() for k in (id_col, *keep)} & {"lang_pred", "score", "rejected"}:
        raise ValueError("a kept column has the name of a result")
    model = df.sparkSession.sparkContext.broadcast((model.languages, model.rows, model.bias, model.temperature, model.threshold))

    def run(batches):
        own = Model(*model.value)
        for b in batches:
            got = [own.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            lang, score, bad = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())], [*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    base = df.select(id_col, *keep, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[:-1])
    return base.mapInArrow(lean(run), f"{schema}, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text's language is not rejected."""
    at = df.columns.index(text_col)
    value = df.sparkSession.sparkContext.broadcast((model.languages, model.rows, model.bias, model.temperature, model.threshold))

    def run(batches):
        own = Model(*value.value)
        for b in batches:
            yield b.filter(pa.array([not own.predict(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names with dots can't be mapped
    return plain.mapInArrow(lean(run), plain.schema).toDF(*df.columns)
