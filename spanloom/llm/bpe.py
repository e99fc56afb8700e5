"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols.  Leaf i of its tree holds the rank of the pair that starts at position i
(infinite if it can't merge), joined with i, so that the root is the leftmost pair of the lowest rank.  A
merge writes three leaves (the merged pair, its neighbour on the left, the symbol that went) and their
ancestors: O(log n) a merge, O(n log n) a word, also for one word of a megabyte.  Short words, which are
nearly all, run many at a time as rows of numpy arrays; a long word runs alone.  Word results are cached
up to ``CACHE`` entries.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 300_000
ALONE = 256
INF = np.int64(1) << 62
#: How the vocabulary's pre-tokenizer cuts a text (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    at = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


class Bpe:
    """The tables of one vocabulary file, and its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.first = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(max(vocab.values()), *self.added.values(), 0) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.rank, self.made)}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(WORDS)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (INF if none) and the merged id of pairs; a right of -1 is the end."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (right >= 0)
        return np.where(hit, self.rank[at], INF), self.made[at]

    def _encode_rows(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Encode words of at most ``width`` (a power of two) bytes, one row each."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.zeros((n, width), dtype=np.uint8)
        raw[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        cols = np.arange(width)
        sym = np.where(cols < lengths[:, None], self.first[raw], -1)
        after = np.tile(cols + 1, (n, 1))  # the next symbol's position; width or the word's length is the end
        before = np.tile(cols - 1, (n, 1))
        merged = np.zeros((n, width), dtype=np.int64)  # what the pair at this position becomes
        tree = np.full((n, 2 * width), INF, dtype=np.int64)
        if width > 1:
            right = np.concatenate([sym[:, 1:], np.full((n, 1), -1)], axis=1)
            rank, made = self._look_up(np.maximum(sym, 0), np.where(sym >= 0, right, -1))
            merged[:] = made
            tree[:, width:] = np.where(rank < INF, rank * width + cols, INF)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            i = tree[live, 1] % width
            j = after[live, i]
            k = after[live, j]
            new = merged[live, i]
            sym[live, i] = new
            sym[live, j] = -1
            after[live, i] = k
            has_next = k < lengths[live]
            k_in = np.minimum(k, width - 1)
            rows = live[has_next]
            before[rows, k[has_next]] = i[has_next]
            p = before[live, i]
            p_in = np.maximum(p, 0)
            rank_i, made_i = self._look_up(new, np.where(has_next, sym[live, k_in], -1))
            rank_p, made_p = self._look_up(sym[live, p_in].clip(0), np.where(p >= 0, new, -1))
            merged[live, i] = made_i
            has_prev = p >= 0
            merged[live[has_prev], p[has_prev]] = made_p[has_prev]
            tree[live, width + j] = INF
            tree[live, width + i] = np.where(rank_i < INF, rank_i * width + i, INF)
            tree[live[has_prev], width + p[has_prev]] = np.where(rank_p < INF, rank_p * width + p, INF)[has_prev]
            up_i, up_j, up_p = (width + i) >> 1, (width + j) >> 1, (width + p_in) >> 1
            step = width // 2
            while step:
                for up in (up_p, up_i, up_j):
                    tree[live, up] = np.minimum(tree[live, 2 * up], tree[live, 2 * up + 1])
                up_i, up_j, up_p = up_i >> 1, up_j >> 1, up_p >> 1
                step //= 2
            live = live[tree[live, 1] < INF]
        keep = sym >= 0
        flat, ends = sym[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _encode_alone(self, word: bytes) -> tuple[int, ...]:
        """Encode one long word with a tree of Python integers."""
        n, width = len(word), 1
        while width < n:
            width *= 2
        far = (1 << 62) * width
        sym = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        size, pairs = self.size, self.pairs
        tree = [far] * (2 * width)
        for i in range(n - 1):
            hit = pairs.get(sym[i] * size + sym[i + 1])
            if hit:
                tree[width + i] = hit[0] * width + i
        for v in range(width - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            v = width + leaf
            tree[v] = value
            v >>= 1
            while v:
                a, b = tree[2 * v], tree[2 * v + 1]
                tree[v] = a if a < b else b
                v >>= 1

        while tree[1] < far:
            i = tree[1] % width
            j = after[i]
            k = after[j]
            sym[i] = pairs[sym[i] * size + sym[j]][1]
            sym[j] = -1
            after[i] = k
            put(j, far)
            hit = None
            if k < n:
                before[k] = i
                hit = pairs.get(sym[i] * size + sym[k])
            put(i, hit[0] * width + i if hit else far)
            p = before[i]
            if p >= 0:
                hit = pairs.get(sym[p] * size + sym[i])
                put(p, hit[0] * width + p if hit else far)
        return tuple(s for s in sym if s >= 0)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        raw = [w.encode() for w in words]
        out: list[tuple[int, ...]] = [()] * len(raw)
        by_width: dict[int, list[int]] = {}
        for at, w in enumerate(raw):
            if len(w) > ALONE:
                out[at] = self._encode_alone(w)
            else:
                by_width.setdefault(1 << max(len(w) - 1, 0).bit_length(), []).append(at)
        for width, own in by_width.items():
            step = max(1, (1 << 19) // width)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                for at, ids in zip(part, self._encode_rows([raw[x] for x in part], width)):
                    out[at] = ids
        return out

    def learn(self, words: set[str]) -> None:
        """Put the ids of new words into the cache."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(words)
        self.cache.update(zip(new, self.encode_words(new)))

    def pieces(self, text: str) -> list[str]:
        """The words and added tokens of a text, in order."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.split_added.split(text):
            out += [part] if part in self.added else self.words.findall(part)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the vocabulary's own library gives them without special tokens added."""
        words = self.pieces(text)
        self.learn(set(words) - self.added.keys())
        return [i for w in words for i in ((self.added[w],) if w in self.added else self.cache[w])]

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids`` (array of int) of every text; null counts as empty and has no ids."""

    def run(batches):
        bpe = load(vocab_path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and ``text`` of every array of ids; null gives the empty text."""

    def run(batches):
        bpe = load(vocab_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def bpe_round_trip(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", at_once: int = 4 << 20) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again.

    Only digests leave the worker, so a result is small whatever the text's length.  Null counts as empty
    (no tokens).  Texts are taken in groups of about ``at_once`` characters, each learnt at once.
    """

    def digests(bpe: Bpe, texts: list[str]) -> list[tuple[int, str, str]]:
        cut = [bpe.pieces(t) for t in texts]
        bpe.learn(set().union(*cut) - bpe.added.keys())
        cache, added = bpe.cache, bpe.added
        shown: dict[str, str] = {}
        spoken: dict[str, bytes] = {}
        for w in set().union(*cut):
            ids = (added[w],) if w in added else cache[w]
            shown[w] = ",".join(map(str, ids))
            spoken[w] = b"".join([bpe.bytes[i] for i in ids])  # decoding joins the tokens' bytes, so words can be joined as well
        out = []
        for words in cut:
            text_ids = ",".join([shown[w] for w in words])
            back = b"".join([spoken[w] for w in words]).decode("utf-8", errors="replace")
            out.append((text_ids.count(",") + 1 if words else 0, hashlib.sha256(text_ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        return out

    def run(batches):
        bpe = load(vocab_path)
        for b in batches:
            texts, rows, size, group = [t or "" for t in b.column(1).to_pylist()], [], 0, []
            for t in texts:
                group.append(t)
                size += len(t)
                if size >= at_once:
                    rows += digests(bpe, group)
                    size, group = 0, []
            rows += digests(bpe, group) if group else []
            n, x, y = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
