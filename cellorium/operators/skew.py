"""Per-key results when a few keys hold most rows.

Rows are range partitioned on the composite (key, secondary order) with sampled
quantiles, so a heavy key is cut into as many partitions as its share asks for.
Inside a partition one streaming pass over the sorted rows builds the state of
each key; only the first and last key of a partition can continue elsewhere, and
only those states are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellorium.session import cut_lineage

#: Rows a task is meant to sort where ``partitions`` is not given.
ROWS_PER_TASK = 2_000_000

_STATE = "key_value string, pid int, n_rows long, n_values long, sum_value double, min_value double, max_value double, runs array<struct<sec:string,n:long>>, n_runs long, edge boolean"


def _runs(a: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal neighbours."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


class _Key:
    """State of one key: counts, sums, and its first, last and largest run of the secondary value."""

    __slots__ = ("key", "n", "nv", "s", "lo", "hi", "first", "last", "best", "runs")

    def __init__(self, key):
        self.key, self.n, self.nv, self.s, self.lo, self.hi = key, 0, 0, 0.0, np.inf, -np.inf
        self.first = self.last = self.best = None
        self.runs = 0

    def add_run(self, sec, n: int) -> None:
        if self.last is not None and self.last[0] == sec:
            self.last[1] += n
            return
        if self.last is not None:
            self._settle(self.last)
        self.runs += 1
        self.last = [sec, n]
        if self.first is None:
            self.first = self.last

    def _settle(self, run) -> None:
        if run is not self.first and (self.best is None or run[1] > self.best[1]):  # runs come in order: the smaller wins a tie
            self.best = list(run)

    def row(self, pid: int, edge: bool) -> tuple:
        runs = [self.first]
        if self.best is not None:
            runs.append(self.best)
        if self.last is not self.first:
            runs.append(self.last)
        none = self.nv == 0
        return (self.key, pid, self.n, self.nv, self.s, None if none else self.lo, None if none else self.hi, [{"sec": r[0], "n": r[1]} for r in runs], self.runs, edge)


_SCHEMA = pa.schema([
    ("key_value", pa.string()), ("pid", pa.int32()), ("n_rows", pa.int64()), ("n_values", pa.int64()), ("sum_value", pa.float64()),
    ("min_value", pa.float64()), ("max_value", pa.float64()), ("runs", pa.list_(pa.struct([("sec", pa.string()), ("n", pa.int64())]))),
    ("n_runs", pa.int64()), ("edge", pa.bool_()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _partition_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, sec, value, pid) to one state per key, in constant memory."""
    cur: _Key | None = None
    pid, is_first, out = 0, True, []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).dictionary_encode()
        sec = b.column(1).dictionary_encode()
        kd, sd = key.dictionary.to_pylist(), sec.dictionary.to_pylist()
        ki = key.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        si = sec.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        v = b.column(2).to_numpy(zero_copy_only=False).astype(float)
        pid = b.column(3)[0].as_py()
        ok = np.isfinite(v)
        starts = _runs(ki * (len(sd) + 2) + si)  # of one key and one secondary value
        cnt = np.diff(np.r_[starts, len(ki)])
        nv = np.add.reduceat(ok.astype(np.int64), starts)
        sm = np.add.reduceat(np.where(ok, v, 0.0), starts)
        lo = np.minimum.reduceat(np.where(ok, v, np.inf), starts)
        hi = np.maximum.reduceat(np.where(ok, v, -np.inf), starts)
        kk, ss = ki[starts], si[starts]
        for i in range(len(starts)):
            k = kd[kk[i]] if kk[i] >= 0 else None
            if cur is None or cur.key != k:
                if cur is not None:
                    out.append(cur.row(pid, is_first))
                    is_first = False
                cur = _Key(k)
            cur.n += int(cnt[i])
            cur.nv += int(nv[i])
            cur.s += float(sm[i])
            cur.lo, cur.hi = min(cur.lo, float(lo[i])), max(cur.hi, float(hi[i]))
            cur.add_run(sd[ss[i]] if ss[i] >= 0 else None, int(cnt[i]))
        if len(out) >= 20_000:
            yield _batch(out)
            out = []
    if cur is not None:
        out.append(cur.row(pid, True))
    yield _batch(out)


def balanced_key_stats(df: DataFrame, key: str, secondary: str, value: str | None = None, partitions: int | None = None) -> DataFrame:
    """Per key: rows, usable values, sum, min, max, distinct secondary values and the most frequent one.

    Columns: key_value, n_rows, n_values, sum_value, min_value, max_value,
    n_secondary, mode_secondary, mode_count.  Null keys give no row.  A null
    secondary value counts as one value of its own.  Null, NaN and infinite
    values are not usable; sums over none are 0 and minima null.  Equal
    frequencies: the smaller secondary value (null first).  Empty input gives no
    row.  Other columns are not read.

    Every task sorts about the same number of rows, at most about
    ``ROWS_PER_TASK``, whatever the key distribution and the size of the input: a key of a third of all rows spreads over a third of the
    partitions.  Rows equal in key and secondary value would stay together
    under plain range partitioning, so a hash of the row's position (the same when a
    lost task runs again) is the last sort key; runs cut by it are joined again when boundary states are stitched.  At most two
    states per partition are stitched.  The states, a row per key and partition, are
    written to the shared folder, so rows are sorted and read once.
    """
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))
    val = F.col(value).cast("double") if value else F.lit(None).cast("double")
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(secondary).cast("string").alias("s"), val.alias("v"), F.xxhash64(F.monotonically_increasing_id()).alias("r"))
    ranged = rows.repartitionByRange(n, "k", "s", "r").select("k", "s", "v").sortWithinPartitions("k", "s").withColumn("pid", F.spark_partition_id())
    states = cut_lineage(ranged.mapInArrow(_partition_states, _STATE))  # a row per key and partition: the rows are sorted and read once
    inner = states.filter(~F.col("edge")).select("key_value", "n_rows", "n_values", "sum_value", "min_value", "max_value", F.col("n_runs").alias("n_secondary"), "runs")
    edges = states.filter("edge")
    w = Window.partitionBy("key_value").orderBy("pid")
    last = F.element_at("runs", -1).getField("sec")
    joined = edges.withColumn("joins", F.coalesce(F.lag(last).over(w).eqNullSafe(F.col("runs")[0].getField("sec")) & F.lag("pid").over(w).isNotNull(), F.lit(False)).cast("long"))
    per_sec = joined.select("key_value", F.explode("runs").alias("x")).groupBy("key_value", F.col("x.sec").alias("sec")).agg(F.sum("x.n").alias("n"))
    modes = per_sec.withColumn("rn", F.row_number().over(Window.partitionBy("key_value").orderBy(F.desc("n"), F.asc_nulls_first("sec")))).filter("rn = 1")
    modes = modes.select("key_value", F.array(F.struct("sec", "n")).alias("runs"))
    stitched = joined.groupBy("key_value").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("sum_value").alias("sum_value"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), (F.sum("n_runs") - F.sum("joins")).alias("n_secondary"),
    ).join(modes, "key_value")
    everything = inner.unionByName(stitched)
    top = F.array_max(F.transform("runs", lambda x: x.getField("n")))
    mode = F.filter("runs", lambda x: x.getField("n") == top)[0]
    return everything.select("key_value", "n_rows", "n_values", "sum_value", "min_value", "max_value", "n_secondary", mode.getField("sec").alias("mode_secondary"), top.alias("mode_count"))
