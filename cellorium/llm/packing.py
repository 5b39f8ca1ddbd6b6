"""Fixed-capacity containers filled by multiway differencing (Karmarkar-Karp).

Items of a block are merged into k windows: each item starts as a partial
partition with one filled window; the two partial partitions with the largest
spread are merged so that the fullest windows of one meet the emptiest of the
other, until one is left.  If a window exceeds the capacity, k rises.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Items packed together; the last window of a block is the only one that may stay emptier.
BLOCK_ITEMS = 2048
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(texts: list[str | None], path: str = TOKENIZER) -> np.ndarray:
    """Tokens of each text; null and empty texts have none."""
    return np.array([len(x) for x in _tokenizer(path).encode([t or "" for t in texts], num_threads=1)], dtype=np.int64)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of item numbers with near-equal sums."""
    heap: list[tuple[int, int, list[int], list]] = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s], [i]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        p, q = len(sa), len(sb)
        over = p + q - k
        if over <= 0:
            s, n = sa + sb, na + nb
        else:  # slot i of the first meets slot k - 1 - i of the second
            s, n = sa[: k - q] + sb[: k - p], na[: k - q] + nb[: k - p]
            for i in range(k - q, p):
                j = k - 1 - i
                s.append(sa[i] + sb[j])
                n.append((na[i], nb[j]))
        order = sorted(range(len(s)), key=s.__getitem__, reverse=True)
        s, n = [s[i] for i in order], [n[i] for i in order]
        heapq.heappush(heap, (-(s[0] - (s[-1] if len(s) == k else 0)), serial, s, n))
        serial += 1
    out = []
    for tree in heap[0][3] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(items)
    return out


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of items none of which exceeds ``capacity`` in sum; each size is at most ``capacity``."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += max(1, k // 200)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, block: int = BLOCK_ITEMS) -> DataFrame:
    """Placement of every text: key, piece_no, start_token, n_tokens, text_tokens, container_id.

    A text larger than ``capacity`` is cut: its full pieces fill containers of
    their own and the rest is an item like any other; no other text is cut.
    Texts without tokens (null, empty) take no space: one row with container_id
    null.  Repeated keys are placed once per row.  An empty table gives no row.
    The order of rows only decides which texts are packed together.

    Blocks are packed where the rows are read: no shuffle, and no key can be
    hot.  A block wastes at most the rounding up of its last window plus what
    differencing leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        sizes: list[int] = []
        pid, serial = None, 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, keys, sizes
            rows, items, owner = [], [], []
            for i, (k, n) in enumerate(zip(keys, sizes)):
                if n == 0:
                    rows.append((k, 0, 0, 0, 0, None))
                    continue
                full, rest = divmod(n, capacity)
                for j in range(full):
                    rows.append((k, j, j * capacity, capacity, n, f"{pid}-{serial}"))
                    serial += 1
                if rest:
                    items.append(rest)
                    owner.append((k, full, full * capacity, n))
            for w in pack_block(items, capacity):
                rows += [(owner[i][0], owner[i][1], owner[i][2], items[i], owner[i][3], f"{pid}-{serial}") for i in w]
                serial += 1
            keys, sizes = [], []
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k", "piece_no", "start_token", "n_tokens", "text_tokens", "container_id"])

        for b in batches:
            if not b.num_rows:
                continue
            kind, pid = b.column(0).type, b.column(2)[0].as_py()
            keys += b.column(0).to_pylist()
            sizes += token_counts(b.column(1).to_pylist(), tokenizer).tolist()
            while len(keys) >= 2 * block:
                more = keys[block:], sizes[block:]
                keys, sizes = keys[:block], sizes[:block]
                yield flush()
                keys, sizes = more
        if keys:
            yield flush()

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.spark_partition_id().alias("pid"))
    return rows.mapInArrow(run, f"k {kind}, piece_no int, start_token long, n_tokens long, text_tokens long, container_id string").withColumnRenamed("k", key)
