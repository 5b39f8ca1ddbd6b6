"""Percentiles of numeric columns from dyadic Count-sketches.

A value is encoded as an integer of ``LEVELS`` bits.  For every binary resolution
one sketch holds the number of values below each dyadic node: resolutions with
few nodes keep exact counters, the others a signed Count-sketch (DEPTH rows of
WIDTH counters, median of the signed estimates).  A sketch is a plain vector of
counters, so sketches of partitions or days are added, and a deletion is the
addition of -1.  A percentile is found by descending from the root: at each node
the estimate of the left child decides the side.  The error can grow only below
the last exact resolution, so bounds never leave the exact node a rank lies in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellorium.operators.relational import finite
from cellorium.session import cut_lineage

LEVELS, WIDTH, DEPTH = 14, 256, 3
#: Distinct codes up to which a partial sketch travels as its not yet inserted codes.
BUFFER = 1024
#: Width of the error bounds in standard deviations of one row's estimates (the median of DEPTH rows errs less).
SIGMAS = 4.0
#: Rows a task gathers before it makes partial sketches of them; tasks over which the partial sketches of a key spread.
CHUNK, SALTS = 1_000_000, 64
#: Counting cells into which one round of :func:`exact_percentiles` cuts an interval; intervals up to which these are broadcast.
CELLS, BROADCAST_ROWS = 1024, 50_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of a multiplicative hash."""
    with np.errstate(over="ignore"):
        z = (x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(32))


class Layout:
    """Where the counters of each level lie, and where a node's counters are."""

    def __init__(self, levels: int = LEVELS, width: int = WIDTH, depth: int = DEPTH):
        self.levels, self.width, self.depth = levels, width, depth
        self.offset, self.exact, at = [], [], 0
        for lv in range(levels + 1):
            nodes = 1 << (levels - lv)
            exact = nodes <= width * depth
            self.offset.append(at)
            self.exact.append(exact)
            at += nodes if exact else width * depth
        self.size = at

    def cells(self, lv: int, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | int]]:
        """For each row of the level's sketch the counters and signs of the nodes."""
        if self.exact[lv]:
            return [(self.offset[lv] + node, 1)]
        out = []
        for r in range(self.depth):
            h = _mix(node, 1 + lv * self.depth + r)
            pos = (h & np.uint64(self.width - 1)).astype(np.int64)
            out.append((self.offset[lv] + r * self.width + pos, np.where(h >> np.uint64(63), 1, -1)))
        return out

    def insert(self, sketches: np.ndarray, row: np.ndarray, code: np.ndarray, count: np.ndarray) -> None:
        """Add ``count`` (negative: delete) of ``code`` to sketch ``row``."""
        flat = sketches.reshape(-1)
        for lv in range(self.levels + 1):
            for pos, sign in self.cells(lv, code >> lv):
                np.add.at(flat, row * self.size + pos, count * sign)

    def estimate(self, sketches: np.ndarray, row: np.ndarray, lv: int, node: np.ndarray) -> np.ndarray:
        got = [sketches[row, pos] * sign for pos, sign in self.cells(lv, node)]
        return got[0] if len(got) == 1 else np.median(np.stack(got), axis=0)

    def total(self, sketches: np.ndarray) -> np.ndarray:
        return sketches[:, self.offset[self.levels]]

    def level_error(self, sketches: np.ndarray, lv: int) -> np.ndarray:
        """Standard deviation of one row's estimates at a level: the root of F2 / WIDTH; 0 where counters are exact."""
        if self.exact[lv]:
            return np.zeros(len(sketches))
        a = self.offset[lv]
        c = sketches[:, a : a + self.width * self.depth].astype(float).reshape(len(sketches), self.depth, self.width)
        return np.sqrt(np.median((c**2).sum(2), axis=1) / self.width)

    def rank_error(self, sketches: np.ndarray) -> np.ndarray:
        """Standard deviation of a rank found by descent: the levels' variances added up."""
        return np.sqrt(sum(self.level_error(sketches, lv) ** 2 for lv in range(self.levels)))

    def quantile(self, sketches: np.ndarray, rank: np.ndarray, sigmas: float | None = None, upper: bool = False) -> np.ndarray:
        """The codes at 0-based ranks (one per sketch), or with ``sigmas`` a lower or ``upper`` bound of them.

        For a bound a side is taken only if the estimate leaves no doubt, by that
        many standard deviations; in doubt the descent turns to the bound's side,
        so it never leaves the exact node that holds the rank.
        """
        row = np.arange(len(sketches))
        node = np.zeros(len(sketches), np.int64)
        left_over = np.clip(rank, 0, np.maximum(self.total(sketches) - 1, 0)).astype(float)
        inside = self.total(sketches).astype(float)
        for lv in range(self.levels - 1, -1, -1):
            left = self.estimate(sketches, row, lv, node * 2).astype(float)
            if sigmas is None:
                left = np.clip(left, 0, inside)
                inside_left = left
            else:
                doubt = sigmas * self.level_error(sketches, lv)
                inside_left = left
                left = np.maximum(left - doubt if upper else left + doubt, 0)
            right = left_over >= left
            left_over = np.where(right, left_over - left, left_over)
            inside = np.where(right, inside - inside_left, inside_left)
            node = node * 2 + right
        return node


_PART = pa.schema([("skey", pa.string()), ("sub", pa.string()), ("salt", pa.int32()), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("dense", pa.binary())])
_PART_DDL = "skey string, sub string, salt int, codes array<int>, counts array<long>, dense binary"


def _condense(lay: Layout, buffer: int, k: int, group: np.ndarray, code: np.ndarray, count: np.ndarray, dense: dict[int, np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes | None]]:
    """(codes, counts, counters) of each of ``k`` groups; groups with many codes, or with counters in ``dense``, get counters."""
    u, inv = np.unique((group << (lay.levels + 1)) | code, return_inverse=True)
    cnt = np.bincount(inv, weights=count, minlength=len(u)).round().astype(np.int64)
    g, code = u >> (lay.levels + 1), u & ((1 << (lay.levels + 1)) - 1)
    cut = np.searchsorted(g, np.arange(k + 1))
    codes, counts, vecs = [], [], []
    for i, (s, e) in enumerate(zip(cut[:-1], cut[1:])):
        if e - s > buffer or i in dense:
            m = dense[i].reshape(1, -1).copy() if i in dense else np.zeros((1, lay.size), np.int64)
            lay.insert(m, np.zeros(e - s, np.int64), code[s:e], cnt[s:e])
            vecs.append(m.astype("<i8").tobytes())
            s = e
        else:
            vecs.append(None)
        codes.append(code[s:e])
        counts.append(cnt[s:e])
    return codes, counts, vecs


def _part_batch(skeys, subs, salts, codes, counts, vecs) -> pa.RecordBatch:
    offs = pa.array(np.r_[0, np.cumsum([len(c) for c in codes])].astype(np.int32))
    cat = lambda v, t: pa.array(np.concatenate(v).astype(t) if v else np.zeros(0, t))
    return pa.RecordBatch.from_arrays([
        pa.array(skeys, pa.string()), pa.array(subs, pa.string()), pa.array(salts, pa.int32()),
        pa.ListArray.from_arrays(offs, cat(codes, np.int32)), pa.ListArray.from_arrays(offs, cat(counts, np.int64)), pa.array(vecs, pa.binary()),
    ], schema=_PART)


def _partials(lay: Layout, buffer: int, chunk: int, salts: int):
    """Rows (skey, sub, code, weight, pid) to one partial sketch per key and chunk of the partition.

    Only whole numbers are gathered: a key's texts are kept once for a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        held: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        n = pid = 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(held)
            codes, counts, vecs = _condense(lay, buffer, len(names), x >> (lay.levels + 1), x & ((1 << (lay.levels + 1)) - 1), np.concatenate(weights), {})
            rows = np.bincount(x >> (lay.levels + 1), minlength=len(names))
            return _part_batch([k[0] for k in names], [k[1] for k in names], np.where(rows > buffer, pid % salts, 0), codes, counts, vecs)

        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column("pid")[0].as_py()
            ids, size = [], []
            for c in ("skey", "sub"):
                d = b.column(c).dictionary_encode()
                ids.append(d.indices.to_numpy(zero_copy_only=False).astype(np.int64))
                size.append(d.dictionary.to_pylist())
            pair, inv = np.unique(ids[0] * len(size[1]) + ids[1], return_inverse=True)
            at = np.array([names.setdefault((size[0][p // len(size[1])], size[1][p % len(size[1])]), len(names)) for p in pair.tolist()], np.int64)
            held.append((at[inv] << (lay.levels + 1)) | b.column("code").to_numpy().astype(np.int64))
            weights.append(b.column("weight").to_numpy().astype(np.int64))
            n += b.num_rows
            if n >= chunk:
                yield flush()
                names, held, weights, n = {}, [], [], 0
        if held:
            yield flush()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], codes_at_once: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += len(b.column(3).values) + b.num_rows + 64 * (b.num_rows - b.column(5).null_count)
            if n >= codes_at_once:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lists(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the not yet inserted codes of a table of partial sketches."""
    row = np.repeat(np.arange(len(t)), pc.list_value_length(t.column("codes")).to_numpy())
    return row, pc.list_flatten(t.column("codes")).to_numpy().astype(np.int64), pc.list_flatten(t.column("counts")).to_numpy()


def _merge(lay: Layout, buffer: int, codes_at_once: int = 500_000):
    """Partial sketches sorted by (skey, sub) to one per key; only the key a block ends in is carried to the next, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for t in _blocks(batches, codes_at_once):
            t = pa.concat_tables([carry, t]) if carry is not None else t
            differs = np.r_[True, np.zeros(len(t) - 1, bool)]
            for c in ("skey", "sub"):
                v = t.column(c).combine_chunks()
                differs[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
            key = np.cumsum(differs) - 1
            row, code, count = _lists(t)
            dense: dict[int, np.ndarray] = {}
            full = t.column("dense")
            for i in np.flatnonzero(pc.is_valid(full).to_numpy()):
                k = int(key[i])
                dense[k] = dense.get(k, 0) + np.frombuffer(full[i].as_py(), "<i8")
            codes, counts, vecs = _condense(lay, buffer, int(key[-1]) + 1, key[row], code, count, dense)
            first = np.flatnonzero(differs)
            names = t.select(["skey", "sub"]).take(first)
            out = _part_batch(names.column(0).to_pylist(), names.column(1).to_pylist(), np.zeros(len(first), np.int32), codes, counts, vecs)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            carry = pa.Table.from_batches([out.slice(out.num_rows - 1)])
        if carry is not None:
            yield from carry.to_batches()

    return run


def _answer_schema(probs: Sequence[float]) -> pa.Schema:
    cols = [("skey", pa.string()), ("sub", pa.string()), ("n", pa.int64())]
    for i in range(len(probs)):
        cols += [(f"q{i}{x}", pa.float64()) for x in ("", "_lo", "_hi", "_from", "_to")]
    return pa.schema(cols)


def _decode(code: np.ndarray, low: np.ndarray, high: np.ndarray, levels: int, log: bool) -> np.ndarray:
    """The value at which a code begins; fractions of a code lie inside it."""
    at = np.clip(code / float(1 << levels), 0.0, 1.0)
    return low + np.expm1(at * np.log1p(high - low)) if log else low + at * (high - low)


def _answers(lay: Layout, probs: Sequence[float], log: bool, keys_at_once: int = 256):
    """Merged sketches sorted by (skey, sub) to percentiles of each sub-key and, with sub null, of each key."""
    schema = _answer_schema(probs)

    def ask(skeys: list[str], subs: list, m: np.ndarray) -> pa.RecordBatch:
        n = lay.total(m)
        low, high = (np.array([float(k.split("\u0001")[i]) for k in skeys]) for i in (1, 2))
        value = lambda c: _decode(c, low, high, lay.levels, log)
        cols = [n]
        for q in probs:
            r = q * np.maximum(n - 1, 0)
            f = r - np.floor(r)
            below, above = np.floor(r), np.ceil(r)
            lo0, lo1 = (value(lay.quantile(m, x, SIGMAS) - 0.001) for x in (below, above))
            hi0, hi1 = (value(lay.quantile(m, x, SIGMAS, True) + 1.001) for x in (below, above))
            mid0, mid1 = (value(lay.quantile(m, x) + 0.5) for x in (below, above))
            cols += [(1 - f) * mid0 + f * mid1, (1 - f) * lo0 + f * lo1, (1 - f) * hi0 + f * hi1, lo0, hi1]
        return pa.RecordBatch.from_arrays([pa.array(skeys, pa.string()), pa.array(subs, pa.string()), *[pa.array(np.asarray(c), f.type) for c, f in zip(cols, list(schema)[2:])]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: tuple[str, np.ndarray] | None = None  # of the key that goes on in the next block
        for b in batches:
            for s in range(0, b.num_rows, keys_at_once):
                t = pa.Table.from_batches([b.slice(s, keys_at_once)])
                m = np.zeros((len(t), lay.size), np.int64)
                lay.insert(m, *_lists(t))
                for i in np.flatnonzero(pc.is_valid(t.column("dense")).to_numpy()):
                    m[i] += np.frombuffer(t.column("dense")[i].as_py(), "<i8")
                skeys = t.column("skey").to_pylist()
                yield ask(skeys, t.column("sub").to_pylist(), m)
                starts = [0, *(i for i in range(1, len(skeys)) if skeys[i] != skeys[i - 1])]
                sums = [(skeys[i], v) for i, v in zip(starts, np.add.reduceat(m, starts, axis=0))]
                if whole is not None:
                    sums = [(whole[0], whole[1] + sums[0][1]), *sums[1:]] if sums[0][0] == whole[0] else [whole, *sums]
                whole = sums.pop()
                if sums:
                    yield ask([k for k, _ in sums], [None] * len(sums), np.stack([v for _, v in sums]))
        if whole is not None:
            yield ask([whole[0]], [None], whole[1].reshape(1, -1))

    return run


def encode(x: Column, low: Column, high: Column, levels: int = LEVELS, log: bool = False) -> Column:
    """Order-preserving integer code of a value in [low, high], on a linear or a logarithmic scale."""
    share = F.log1p(x - low) / F.log1p(high - low) if log else (x - low) / (high - low)
    return F.least(F.floor(share * F.lit(float(1 << levels))), F.lit((1 << levels) - 1)).cast("int")


def percentile_sketches(
    df: DataFrame, key: str, sub: str, value: str, low: float | Column, high: float | Column, probs: Sequence[float] = (0.5, 0.9), weight: str | None = None,
    levels: int = LEVELS, width: int = WIDTH, depth: int = DEPTH, buffer: int = BUFFER, log_scale: bool = False, chunk: int = CHUNK, salts: int = SALTS,
) -> DataFrame:
    """Percentiles with error bounds of every (key, sub) and of every whole key.

    Columns: key, sub (null: the whole key, its sketch being the sum of the
    sketches of its sub-keys), n, and for each probability ``q<i>`` (interpolated
    between the values at the neighbouring ranks), ``q<i>_lo`` and ``q<i>_hi``
    (bounds of it that hold unless the sketch errs by more than SIGMAS standard
    deviations), ``q<i>_from`` and ``q<i>_to`` (bounds of the neighbouring values).
    Bounds are never wider than the nodes of the last exact resolution.

    Values that are null, NaN or outside [low, high) are left out by the caller
    or here (null and NaN); others outside are clipped.  ``log_scale`` codes
    log(1 + value - low), for columns whose values crowd near ``low``.  ``weight``
    of -1 deletes a value inserted elsewhere.  Null keys and sub-keys are kept
    apart from all others but a null sub-key is named ''.  Keys without usable
    values give no row; an empty table gives none.

    Each scan task first turns its rows into one partial sketch per key (codes
    not yet inserted while there are few, counters after that), so a key of any
    size leaves a task as one bounded row; keys with more than ``buffer`` rows in
    a chunk are salted and merged in two steps; all merging is streaming addition.
    The last step reads one merged sketch per sub-key.
    """
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    lay = Layout(levels, width, depth)
    v = F.col(value).cast("double")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    code = F.greatest(encode(v, lo, hi, levels, log_scale), F.lit(0))
    key_range = F.concat_ws("\u0001", lo.cast("string"), hi.cast("string"))
    rows = df.filter(finite(v)).select(
        F.concat(F.when(F.col(key).isNull(), "n").otherwise("k"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\u0001"), key_range).alias("skey"),
        F.coalesce(F.col(sub).cast("string"), F.lit("")).alias("sub"), code.alias("code"), w.alias("weight"), F.spark_partition_id().alias("pid"),
    )
    parts = rows.mapInArrow(_partials(lay, buffer, chunk, salts), _PART_DDL)
    merged = parts.repartition("skey", "sub", "salt").sortWithinPartitions("skey", "sub").mapInArrow(_merge(lay, buffer), _PART_DDL)
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long' if f.type == pa.int64() else 'double'}" for f in _answer_schema(probs))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answers(lay, list(probs), log_scale)(_merge(lay, buffer)(batches))

    got = merged.repartition("skey").sortWithinPartitions("skey", "sub").mapInArrow(finish, ddl)
    part = F.split("skey", "\u0001")
    return got.select(F.when(part[0].startswith("k"), F.substring(part[0], 2, 1 << 30)).alias(key), F.col("sub").alias(sub), "n", *[f.name for f in list(_answer_schema(probs))[3:]])


def exact_percentiles(df: DataFrame, wanted: DataFrame, cells: int = CELLS) -> DataFrame:
    """Exact interpolated percentiles by counting inside the intervals the sketches leave.

    ``df``: k, day, x.  ``wanted``: k, day (null: the whole key), i (any label of
    the percentile), q, n (usable values of that key and day), a and b (bounds of
    the values at the neighbouring ranks).  Result: k, day, i, value.

    A round counts the values below, above and in ``cells`` equal parts of each
    interval, with the least and greatest value of each part; the part that
    holds the rank is the next interval, and a part of one value ends the search.
    Bounds that do not hold lead to the part beside them.  Only counters are
    shuffled, at most ``cells`` + 2 for an interval and task, so a key of any size is safe.
    Null, NaN and infinite values do not count; nothing wanted gives no row.
    """
    r = F.col("q") * (F.col("n") - 1)
    two = F.explode(F.when(F.floor(r) == F.ceil(r), F.array(F.floor(r))).otherwise(F.array(F.floor(r), F.ceil(r))))
    open_ = cut_lineage(wanted.filter("n > 0").withColumn("f", r - F.floor(r)).select("k", "day", "i", "f", two.alias("rank"), "a", "b"))
    t = ["t_k", "t_day", "i", "f", "rank"]
    done = None
    while n_open := open_.count():
        named = open_.select(F.col("k").alias("t_k"), F.col("day").alias("t_day"), "i", "f", "rank", "a", "b")
        named = F.broadcast(named) if n_open <= BROADCAST_ROWS else named
        near = df.filter(finite(F.col("x"))).join(named, F.col("k").eqNullSafe(F.col("t_k")) & (F.col("t_day").isNull() | F.col("t_day").eqNullSafe(F.col("day"))))
        part = F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * cells)
        cell = F.when(F.col("x") < F.col("a"), -1).when(F.col("x") > F.col("b"), cells).when(F.col("a") == F.col("b"), 0).otherwise(F.least(part, F.lit(cells - 1)))
        counts = near.groupBy(*t, cell.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        w = Window.partitionBy(*t).orderBy("cell")
        upto = counts.withColumn("upto", F.sum("c").over(w))
        at = upto.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank"))).select(F.col("t_k").alias("k"), F.col("t_day").alias("day"), "i", "f", "rank", "a", "b")
        at = cut_lineage(at)
        found = at.filter("a = b")
        done = found if done is None else done.unionByName(found)
        open_ = at.filter("a < b")
    if done is None:
        return wanted.limit(0).select("k", "day", "i", F.lit(0.0).alias("value"))
    low, high = F.min_by("a", "rank"), F.max_by("a", "rank")
    return done.groupBy("k", "day", "i").agg(((1 - F.max("f")) * low + F.max("f") * high).alias("value"))
