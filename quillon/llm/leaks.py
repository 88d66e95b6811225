"""Evaluation texts leaking into training text.

Each item gives windows: one as long as the item, or all of a passage's length. A window has a 64-bit SimHash of its pairs of
words, and an inverted index of four blocks of 16 bits holds each fingerprint under every value within a quarter of the radius of its own:
two fingerprints within the radius agree so closely in one block at least, so looking up the four blocks of a document's
window finds every item window within the radius. The exact weighted similarity of the windows' shingles
then verifies each candidate.

The items are the query set. They are indexed in groups whose index has a bounded number of entries, one pass over the
documents each; an index is broadcast only within that bound. Equal windows of several items are one window of the index.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import chunks, groups, token_hashes, windows

#: Words of a shingle in the similarity, and of the pairs that a fingerprint sums.
SHINGLE, PAIR = 5, 2
SIMILARITY = 0.8
#: Bits in which fingerprints of similar windows differ at most, and of equal passages.
RADIUS, BLOCKS = 11, 4
#: Words of a passage that counts as leaked by itself.
PASSAGE = 13
#: Entries of one broadcast index, 8 bytes each.
INDEX_ENTRIES = 4_000_000
_U = np.uint64


class Signs:
    """Sums of the signs of a chunk's word pairs, for windows of any length."""

    def __init__(self, h: np.ndarray):
        pairs, _ = windows(h, np.zeros(len(h), np.int64), PAIR)
        self.bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
        self.total: dict = {}

    def fingerprints(self, length: int) -> np.ndarray:
        """SimHash of each window of ``length`` words; sums wrap, which cancels in the difference of two."""
        per = length - PAIR + 1
        kind = np.uint8 if per < 256 else np.uint16 if per < 65_536 else np.uint32
        if kind not in self.total:
            self.total[kind] = np.zeros((len(self.bits) + 1, 64), kind)
            np.cumsum(self.bits, axis=0, dtype=kind, out=self.total[kind][1:])
        total = self.total[kind]
        n = max(0, len(total) - per)
        return np.packbits((total[per : per + n] - total[:n]) > per // 2, axis=1).view(_U).ravel()


def nearby(most: int) -> np.ndarray:
    """The 16-bit numbers with at most ``most`` bits set: what to turn to reach all values within that distance."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(16), k)], np.int64)


class Index:
    """Windows of one length by the blocks of their fingerprints."""

    def __init__(self, length: int, fp: np.ndarray, words: np.ndarray, shingles: np.ndarray, items: list[np.ndarray], radius: int):
        self.length, self.fp, self.words, self.shingles, self.radius = length, fp, words, shingles, radius
        self.first = np.concatenate(([0], np.cumsum([len(i) for i in items]))).astype(np.int64)
        self.items = np.concatenate(items) if items else np.zeros(0, np.int64)
        turned, self.blocks = nearby(radius // BLOCKS), []
        for b in range(BLOCKS):
            value = (self._block(fp, b)[:, None] ^ turned).ravel()
            order = np.argsort(value, kind="stable")
            at = np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << 16)))).astype(np.int32)
            self.blocks.append(((order // len(turned)).astype(np.int32), at))

    @staticmethod
    def _block(fp: np.ndarray, b: int) -> np.ndarray:
        return ((fp >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, index window) of all pairs within the radius."""
        found = []
        for b, (order, off) in enumerate(self.blocks):
            value = self._block(fp, b)
            n = off[value + 1] - off[value]
            here = np.flatnonzero(n)
            for lo in range(0, len(here), 200_000):
                part = here[lo : lo + 200_000]
                k = n[part]
                i = np.repeat(part, k)
                j = order[np.repeat(off[value[part]], k) + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)]
                close = np.bitwise_count(fp[i] ^ self.fp[j]) <= self.radius
                found.append(i[close] * len(self.fp) + j[close])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // max(1, len(self.fp)), pair % max(1, len(self.fp))


class Weights:
    """What a shingle weighs: 1 over the items that have it, 1 if none has."""

    def __init__(self, n_items: dict[int, int]):
        self.known = np.array(sorted(n_items), _U)
        self.weight = np.array([1.0 / n_items[int(k)] for k in self.known] + [1.0])

    def of(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, s)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == s[hit]
        return self.weight[np.where(hit, at, len(self.known))]

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the shingle sets in equal rows of ``a`` and ``b``."""
        out = np.zeros(len(a))
        step = max(1, 4_000_000 // max(1, a.shape[1] ** 2))
        for lo in range(0, len(a), step):
            x, y = a[lo : lo + step], b[lo : lo + step]
            once = lambda z: ~(np.tril(z[:, :, None] == z[:, None, :], -1)).any(2)
            wx, wy = self.of(x) * once(x), self.of(y) * once(y)
            both = (wx * (x[:, :, None] == y[:, None, :]).any(2)).sum(1)
            out[lo : lo + step] = both / (wx.sum(1) + wy.sum(1) - both)
        return out


def build(ids: list[int], texts: list[str], window: int | None, radius: int) -> list[Index]:
    """One index for each length of the items' windows."""
    by_length: dict[int, list] = {}
    for at, run in chunks(texts):
        h, doc = token_hashes(run, "word")
        first = np.searchsorted(doc, np.arange(len(run) + 1))
        for i in range(len(run)):
            own = h[first[i] : first[i + 1]]
            length = len(own) if window is None else window
            if SHINGLE <= length <= len(own):
                zeros = np.zeros(len(own), np.int64)
                w, s = windows(own, zeros, length)[0], windows(own, zeros, SHINGLE)[0]
                rows = np.arange(len(w))[:, None] + np.arange(length - SHINGLE + 1)
                by_length.setdefault(length, []).append((Signs(own).fingerprints(length), w, s[rows], np.full(len(w), ids[i + at], np.int64)))
    out = []
    for length, parts in sorted(by_length.items()):
        fp, w, s, item = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(w, kind="stable")
        _, first = groups(w[order])
        out.append(Index(length, fp[order[first]], w[order[first]], s[order[first]], [np.unique(x) for x in np.split(item[order], first[1:])], radius))
    return out


def _shingle_counts(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, texts in chunks(batch.column("text").to_pylist()):
                h, doc = token_hashes(texts, "word")
                s, whole = windows(h, doc, SHINGLE)
                pairs = np.unique(np.stack((doc[: len(s)][whole].astype(np.int64), s[whole].view(np.int64)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1])], ["s"])

    return items.select("text").mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n"))


def _window_count(items: DataFrame, window: int | None) -> int:
    """Windows of all items: one each, or all of a passage's length."""
    if window is None:
        return items.count()

    def run(batches):
        for batch in batches:
            total = 0
            for _, texts in chunks(batch.column("text").to_pylist()):
                total += int(windows(*token_hashes(texts, "word"), window)[1].sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["n"])

    return items.select("text").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def search(indexes: list[Index], weights: Weights, ids: np.ndarray, texts: list[str], similarity: float) -> tuple[np.ndarray, ...]:
    """(document, item, number of the document's windows, best similarity, verbatim) over a chunk of texts."""
    h, doc = token_hashes(texts, "word")
    s, _ = windows(h, doc, SHINGLE)
    signs, found = Signs(h), []
    for index in indexes:
        w, whole = windows(h, doc, index.length)
        if not whole.any():
            continue
        i, j = index.near(signs.fingerprints(index.length))
        i, j = i[whole[i]], j[whole[i]]
        like = weights.similarity(s[i[:, None] + np.arange(index.length - SHINGLE + 1)], index.shingles[j])
        good = like >= similarity
        i, j, like = i[good], j[good], like[good]
        n = index.first[j + 1] - index.first[j]  # a window's items
        k = np.repeat(np.arange(len(j)), n)
        item = index.items[np.repeat(index.first[j], n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)]
        found.append((doc[i[k]], item, i[k], like[k], (w[i] == index.words[j])[k]))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
    d, item, pos, like, same = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((pos, item, d))
    d, item, pos, like, same = d[order], item[order], pos[order], like[order], same[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])))[: len(d)]
    fresh = new | np.concatenate(([True], pos[1:] != pos[:-1]))[: len(d)]
    at = np.flatnonzero(new)
    if not len(at):
        return d, item, pos, like, same
    return ids[d[at]], item[at], np.add.reduceat(fresh.astype(np.int64), at), np.maximum.reduceat(like, at), np.logical_or.reduceat(same, at)


def leaks(documents: DataFrame, items: DataFrame, window: int | None = None, radius: int = RADIUS, similarity: float = SIMILARITY, index_entries: int = INDEX_ENTRIES) -> DataFrame:
    """(doc_id, item_id, n_windows, best_similarity, verbatim): documents that hold windows like an item's.

    ``window`` None compares each item as a whole with all windows of its length; a number compares passages of so many words.
    ``n_windows`` counts the document's windows that are similar to one of the item; ``verbatim``: one of them is
    equal in all its words. ``documents`` has (doc_id, text), ``items`` (item_id, text); rows without id or text, and texts
    with fewer words than a window or a shingle give nothing; repeated rows count once; other columns are ignored.
    """
    if not 0 <= radius < 64 or (window is not None and window < SHINGLE):
        raise ValueError("radius must lie in 0..63, and a window hold a shingle")
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    total = _window_count(items, window) * BLOCKS * len(nearby(radius // BLOCKS))
    n_groups = max(1, -(-2 * total // index_entries)) if total > index_entries else 1
    counts = _shingle_counts(items)
    out = None
    for g in range(n_groups):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == g)
        rows = part.collect()  # a group of items, bounded by index_entries
        s = _shingle_counts(part).select("s").join(counts, "s").collect()
        held = spark.sparkContext.broadcast((build([r[0] for r in rows], [r[1] for r in rows], window, radius), Weights({r[0] & (1 << 64) - 1: r[1] for r in s})))

        def run(batches, held=held):
            indexes, weights = held.value
            for batch in batches:
                ids = batch.column("doc_id").to_numpy()
                for at, texts in chunks(batch.column("text").to_pylist()):
                    found = search(indexes, weights, ids[at : at + len(texts)], texts, similarity)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["doc_id", "item_id", "n_windows", "best_similarity", "verbatim"])

        found = docs.mapInArrow(run, "doc_id bigint, item_id bigint, n_windows bigint, best_similarity double, verbatim boolean")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("best_similarity").alias("best_similarity"), F.max("verbatim").alias("verbatim"))
