"""NumPy kernels over Arrow columns, for distances of many vectors at once.

Only bounded things reach a kernel: a slice of vectors, a block of queries, or
centroids.  Distances are computed for as many queries at a time as keep the
matrix under ``CELLS`` numbers.  ``nearest_in_boxes`` finds the same neighbours as
``nearest`` and leaves out the vectors that are too far to be among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 4_000_000
#: Vectors of a box, and queries from which on boxes are worth their cost.
LEAF, FEW = 256, 64


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix; null vectors, null values and vectors of
    different lengths are errors, never shifted into the next row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype)
    if column.null_count:
        raise ValueError(f"{column.null_count} of {len(column)} vectors are null")
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} to {lengths['max']} values; one length expected")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a null value")
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), lengths["min"])


def distances(a: np.ndarray, b: np.ndarray, exact_int: bool) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``.

    Integers expand the square: products stay under 2**53, so doubles are exact.
    Floats subtract first, which loses nothing to cancellation.
    """
    if len(a) and len(b) and a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of {a.shape[1]} and of {b.shape[1]} values")
    if exact_int:
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    out = np.empty((len(a), len(b)))
    for k in range(len(b)):
        d = a - b[k]
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(refs: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray, k: int, exact_int: bool, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference row, distance) of the k nearest references of each
    query by (distance, id), queries in order."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, CELLS // max(1, len(refs)))
    for at in range(0, len(queries) if len(refs) else 0, step):
        d = distances(refs, queries[at : at + step], exact_int)
        if skip_self:
            d[ids[:, None] == qids[None, at : at + step]] = np.inf
        cut = np.partition(d, k - 1, axis=0)[k - 1] if len(refs) > k else np.full(d.shape[1], np.inf)
        row, col = np.nonzero((d <= cut) & (d < np.inf))
        order = np.lexsort((ids[row], d[row, col], col))
        row, col = row[order], col[order]
        first = np.searchsorted(col, col, side="left")
        keep = np.arange(len(col)) - first < k
        row, col = row[keep], col[keep]
        found.append((col + at, row, d[row, col]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _lowest_copies(refs: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Rows of the ``n`` lowest ids of each vector, in any order.

    Equal hashes stand side by side and are compared whole, so different vectors
    with one hash are at worst kept as more rows than needed."""
    odd = np.random.default_rng(0).integers(1, 2**62, refs.shape[1], dtype=np.int64) * 2 + 1
    order = np.lexsort((ids, (refs.astype(np.int64) * odd).sum(1)))
    sorted_refs = refs[order]
    first = np.append(True, (sorted_refs[1:] != sorted_refs[:-1]).any(1))
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < n]


def _boxes(refs: np.ndarray) -> list[np.ndarray]:
    """Rows of at most LEAF vectors that lie close: halves by the widest coordinate."""
    todo, out = [np.arange(len(refs))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        some = refs[rows]
        widest = int(np.argmax(some.max(0) - some.min(0)))
        half = len(rows) // 2
        cut = np.argpartition(some[:, widest], half)
        todo += [rows[cut[:half]], rows[cut[half:]]]
    return out


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A row for each box: no vector in it is closer to the query than this."""
    out = np.zeros((len(low), len(queries)))
    for i in range(queries.shape[1]):
        x = queries[None, :, i]
        gap = np.maximum(low[:, None, i] - x, x - high[:, None, i])
        np.maximum(gap, 0, out=gap)
        out += gap * gap
    return out


def nearest_in_boxes(refs: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray, k: int, skip_self: bool, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` of integers, of those at a distance of at most ``most`` (a number
    for each query).

    References lie in boxes.  A query looks into its two closest boxes first, then
    into all that are no farther than its k-th neighbour so far.  Of equal vectors
    only those with the k lowest ids can be neighbours."""
    most = np.full(len(queries), np.inf) if most is None else most
    if len(refs) <= 2 * LEAF or len(queries) < FEW:
        j, i, d = nearest(refs, ids, queries, qids, k, True, skip_self)
        near = d <= most[j]
        return j[near], i[near], d[near]
    if queries.shape[1] != refs.shape[1]:
        raise ValueError(f"vectors of {refs.shape[1]} and of {queries.shape[1]} values")
    kept = _lowest_copies(refs, ids, k + skip_self)
    boxes = [kept[rows] for rows in _boxes(refs[kept])]
    vectors = [refs[rows] for rows in boxes]
    low, high = np.stack([x.min(0) for x in vectors]), np.stack([x.max(0) for x in vectors])
    step, found = max(1, CELLS // max(LEAF, len(boxes))), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(queries), step):
        q, own = queries[at : at + step], qids[at : at + step]
        least = box_distances(q, low, high)
        best, kth = np.full((len(q), k), np.inf), most[at : at + step].astype(np.float64)
        seen: list[tuple[np.ndarray, ...]] = []

        def look(box: int, who: np.ndarray) -> None:
            d = distances(q[who], vectors[box], True)  # noqa: B023
            if skip_self:
                d[own[who][:, None] == ids[boxes[box]][None, :]] = np.inf  # noqa: B023
            few = np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d
            both = np.concatenate([best[who], few], axis=1)  # noqa: B023
            both.partition(k - 1, axis=1)
            best[who] = both[:, :k]  # noqa: B023
            kth[who] = np.minimum(kth[who], both[:, k - 1])  # noqa: B023
            a, b = np.nonzero((d <= kth[who][:, None]) & (d < np.inf))  # noqa: B023
            seen.append((who[a], boxes[box][b], d[a, b]))  # noqa: B023
            least[box, who] = np.inf  # noqa: B023

        for _ in range(2):
            first = least.argmin(0)
            open_ = np.flatnonzero(least[first, np.arange(len(q))] <= kth)
            open_ = open_[np.argsort(first[open_], kind="stable")]
            for who in np.split(open_, np.flatnonzero(np.diff(first[open_])) + 1):
                if len(who):
                    look(int(first[who[0]]), who)
        for box in range(len(boxes)):
            who = np.flatnonzero((least[box] <= kth) & (least[box] < np.inf))
            if len(who):
                look(box, who)
        if not seen:
            continue
        col, row, d = (np.concatenate(x) for x in zip(*seen, strict=True))
        near = d <= kth[col]
        col, row, d = col[near], row[near], d[near]
        order = np.lexsort((ids[row], d, col))
        col, row, d = col[order], row[order], d[order]
        keep = np.arange(len(col)) - np.searchsorted(col, col, side="left") < k
        found.append((col[keep] + at, row[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
