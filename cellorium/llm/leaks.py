"""Evaluation passages inside a corpus: q-gram filter and banded alignment.

Two strings of length n within e edits share at least n + 1 - q(1 + e) q-grams,
and these lie on diagonals (corpus position minus passage position) that differ
by at most e.  Shared q-grams are counted in overlapping diagonal bands of each
(document, item); bands that reach the bound of the item's shortest window are
kept and verified by a local alignment that stays inside the band.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, MAX_EDITS, WORDS = 10, 1, 8
#: Items whose index is broadcast at once; more items are processed in further blocks.
BLOCK_ITEMS = 5_000
_DROP = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower case, without accents and invisible format characters."""
    if not text:
        return []
    return _WORD.findall(_DROP.sub("", unicodedata.normalize("NFD", text.lower())))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at every position where one begins."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            h = h * _BASE + c[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class PassageIndex:
    """q-gram positions of a block of items, with each item's shortest window and bound."""

    def __init__(self, ids: list, passages: list[str | None], q: int = Q, max_edits: int = MAX_EDITS, words: int = WORDS):
        self.ids, self.words, self.max_edits = ids, words, max_edits
        self.text, self.least, self.grams = [], [], []
        for p in passages:
            w = words_of(p)
            t = " ".join(w)
            self.text.append(_codes(t))
            span = [len(" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))]
            self.least.append(min(span) if w else 0)
            self.grams.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
        self.least = np.array(self.least, np.int64)
        usable = self.least[self.least > 0]
        self.q = int(min(q, usable.min())) if len(usable) else q
        self.need = np.maximum(1, self.least + 1 - self.q * (1 + max_edits))
        hs, item, pos = [], [], []
        for i, t in enumerate(self.text):
            h = qgram_hashes(t, self.q)
            hs.append(h)
            item.append(np.full(len(h), i))
            pos.append(np.arange(len(h)))
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.start = np.unique(h[order], return_index=True)
        self.stop = np.r_[self.start[1:], len(h)].astype(np.int64)
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.pos = (np.concatenate(pos) if pos else np.zeros(0, np.int64))[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def bands(self, doc_of: np.ndarray, local: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, lowest diagonal, passage range) of the bands that reach their item's bound.

        A band is two neighbouring halves of ``max_edits`` + 1 diagonals.  A half
        without neighbours is a band by itself; a band whose upper half is empty is
        part of the one below.  A region within the budget reaches at most ``q *
        max_edits + max_edits`` characters beyond its shared q-grams.
        """
        none = (np.zeros(0, np.int64),) * 5
        if not len(self.hash) or not len(h):
            return none
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        hit = self.hash[at] == h[maybe]
        maybe, at = maybe[hit], at[hit]
        if not len(at):
            return none
        many = self.stop[at] - self.start[at]
        src = np.repeat(np.arange(len(at)), many)
        post = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many) + self.start[at][src]
        pos = self.pos[post]
        half = self.max_edits + 1
        key = ((doc_of[maybe][src].astype(np.int64) * len(self.ids) + self.item[post]) << 31) | ((local[maybe][src] - pos + (1 << 30)) // half)
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        u, n = key[first], np.diff(np.r_[first, len(key)])
        lo, hi = np.minimum.reduceat(pos, first), np.maximum.reduceat(pos, first)
        follows = np.r_[u[1:] == u[:-1] + 1, False]
        both = np.flatnonzero(follows)
        n2, lo2, hi2 = n.copy(), lo.copy(), hi.copy()
        n2[both] += n[both + 1]
        lo2[both], hi2[both] = np.minimum(lo[both], lo[both + 1]), np.maximum(hi[both], hi[both + 1])
        item = (u >> 31) % len(self.ids)
        keep = (follows | ~np.r_[False, follows[:-1]]) & (n2 >= self.need[item])
        reach = self.q * (self.max_edits + 1) + self.max_edits
        return (u[keep] >> 31) // len(self.ids), item[keep], (u[keep] & ((1 << 31) - 1)) * half - (1 << 30), np.maximum(lo2[keep] - reach, 0), hi2[keep] + self.q + reach

    def align(self, docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray, low: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best local alignment of passage[p0:p1] inside the band: (score, first, last corpus position + 1); match 1, edit -PENALTY."""
        width = 2 * (self.max_edits + 1) + 2 * self.max_edits
        low = low - self.max_edits
        k = len(doc)
        best, b0, b1 = np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64)
        if not k:
            return best, b0, b1
        dl = np.array([len(docs[d]) for d in doc], np.int64)
        il = np.array([len(self.text[i]) for i in item], np.int64)
        size = np.minimum(p1, il) - p0
        d0 = np.clip(p0 + low, 0, dl)  # the stretch of the document that the band can touch
        dn = np.clip(p0 + size + low + width, 0, dl) - d0
        dflat = np.concatenate([docs[d][a : a + m] for d, a, m in zip(doc, d0, dn)] + [np.zeros(1, np.uint32)])
        iflat = np.concatenate([self.text[i][a : a + m] for i, a, m in zip(item, p0, size)] + [np.zeros(1, np.uint32)])
        doff, ioff = np.r_[0, np.cumsum(dn)[:-1]], np.r_[0, np.cumsum(size)[:-1]]
        score, first = np.zeros((k, width), np.float32), np.zeros((k, width), np.int64)
        diags = np.arange(width)
        base = (p0 + low - d0)[:, None] + diags  # position in the stretch for row 0
        pen, rows = np.float32(PENALTY), np.arange(k)
        for i in range(int(size.max())):
            j = base + i
            ok = (i < size)[:, None] & (j >= 0) & (j < dn[:, None])
            same = ok & (dflat[doff[:, None] + np.where(ok, j, 0)] == iflat[ioff + np.where(i < size, i, 0)][:, None])
            s = score + np.where(same, np.float32(1), -pen)
            f = np.where(score > 0, first, j)
            for left in (False, *[True] * self.max_edits):  # a passage character missing in the corpus; characters inserted there
                other = np.full((k, width), -1, np.float32)
                g = np.empty_like(f)
                if left:
                    other[:, 1:], g[:, 1:], g[:, 0] = s[:, :-1] - pen, f[:, :-1], 0
                else:
                    other[:, :-1], g[:, :-1], g[:, -1] = score[:, 1:] - pen, first[:, 1:], 0
                better = other > s
                s, f = np.where(better, other, s), np.where(better, g, f)
            s = np.where(ok, np.maximum(s, 0), np.float32(0))
            score, first = s, f
            at = s.argmax(1)
            top = s[rows, at]
            new = top > best
            if new.any():
                best[new] = top[new]
                b0[new], b1[new] = (f[rows, at] + d0)[new], (j[rows, at] + d0 + 1)[new]
        return best, b0, b1


#: Score lost by one edit in an alignment whose matches count 1.
PENALTY = 3


def _scan(index_b, kind: pa.DataType, chars: int = 400_000):
    def block(ids: list, texts: list) -> pa.RecordBatch:
        index: PassageIndex = index_b.value
        wl = [words_of(t) for t in texts]
        docs = [_codes(" ".join(w)) for w in wl]
        lens = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
        h = qgram_hashes(flat, index.q)
        doc_of = np.repeat(np.arange(len(docs)), lens)
        off = np.r_[0, np.cumsum(lens)[:-1]]
        local = np.arange(len(flat)) - off[doc_of]
        whole = np.flatnonzero(local[: len(h)] + index.q <= lens[doc_of[: len(h)]])
        rows: dict = {}
        d, it, low, r0, r1 = index.bands(doc_of[whole], local[whole], h[whole])
        by_size = np.argsort(r1 - r0, kind="stable")  # bands of like length together
        for s in range(0, len(d), 2048):
            e = by_size[s : s + 2048]
            score, b0, b1 = index.align(docs, d[e], it[e], low[e], r0[e], r1[e])
            bound = index.least[it[e]] - index.max_edits * (1 + PENALTY)
            for x, y, sc, p0, p1, bd in zip(d[e], it[e], score, b0, b1, bound):
                if sc >= bd and rows.get((x, y), (-1,))[0] < sc:
                    rows[x, y] = (sc, p0, p1)
        grams: dict = {}
        n = index.words
        out = []
        for (x, y), (sc, p0, p1) in rows.items():
            if x not in grams:
                w = wl[x]
                grams[x] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            out.append((ids[x], index.ids[y], float(sc), int(p0), int(p1), not grams[x].isdisjoint(index.grams[y])))
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (kind, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "eval_id", "score", "first_char", "end_char", "shares_run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held_i, held_t, n = b.column(0).to_pylist(), b.column(1).to_pylist(), [], [], 0
            for i, t in zip(ids, texts):
                held_i.append(i)
                held_t.append(t)
                n += len(t or "")
                if n >= chars:
                    yield block(held_i, held_t)
                    held_i, held_t, n = [], [], 0
            if held_i:
                yield block(held_i, held_t)

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", q: int = Q, max_edits: int = MAX_EDITS, words: int = WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, eval_id, score, first_char, end_char, shares_run): documents with a passage of an item.

    ``items``: eval_id BIGINT, passage.  A row is a document that holds some part of
    the passage at least as long as the item's shortest run of ``words`` words
    (the whole passage if it has fewer), within ``max_edits`` edits; positions
    refer to the normalised text.  ``shares_run``: at least ``words`` consecutive
    words are equal.  No pair with such a run is lost by the filter: it shares
    every q-gram of the run on one diagonal.  Null and empty texts and passages
    match nothing; repeated doc ids are reported per row; a passage under two
    items is reported for both.

    Documents are scanned whole where they are read; nothing is shuffled.  Items
    are broadcast in blocks of ``block_items``, each against all documents.
    """
    spark = docs.sparkSession
    got = items.select("eval_id", "passage").orderBy("eval_id").toLocalIterator(prefetchPartitions=False)
    kind = dict(docs.select(key).dtypes)[key]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    ddl = f"doc_id {kind}, eval_id long, score double, first_char long, end_char long, shares_run boolean"
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out, held = None, []

    def add(held):
        index = spark.sparkContext.broadcast(PassageIndex([r[0] for r in held], [r[1] for r in held], q, max_edits, words))
        part = rows.mapInArrow(_scan(index, arrow), ddl)
        return part if out is None else out.unionByName(part)

    for r in got:
        held.append(r)
        if len(held) >= block_items:
            out, held = add(held), []
    if held or out is None:
        out = add(held)
    return out
