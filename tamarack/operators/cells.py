"""Adaptive decisions for many queries.

Equal queries have equal answers, so each distinct vector is asked once.  Of equal
vectors in a list only those with the k lowest ids can be neighbours, so a list
keeps those.  A long list is cut into cells of vectors that lie close, of which the
driver has the boxes.  A query meets the nearest cell of its fast lists first, and
then those that are no farther than its k-th neighbour there; where its fast count
is in the band, also such cells of the other lists.  All cells left out are too far
to have a neighbour, so the decisions are those of comparing all.

Where cells end is taken from some vectors of each list, which has no part in the
results: every vector is in a cell, and its box is that of all its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import approved
from .index import IvfIndex, quantize_matrix
from .kernels import CELLS, box_distances, distances, matrix, nearest_in_boxes

#: By estimate, vectors of a cell at most and queries that meet it in one task; vectors seen for a cell; cells, or up to twice as many.
ROWS, BLOCK, SEEN, MOST_CELLS = 32_768, 16_384, 64, 8192
_FOUND = "array<struct<d:long,crank:int,ref_id:long,label:int>>"
_FOUND_FIELDS = [("d", pa.int64()), ("crank", pa.int32()), ("ref_id", pa.int64()), ("label", pa.int32())]
_VECTOR = pa.list_(pa.int16())


def ranks(q: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, nearest first, ties by number."""
    out, step = [np.zeros((0, n), np.int64)], max(1, CELLS // len(centroids))
    for at in range(0, len(q), step):
        d = distances(q[at : at + step].astype(np.float64), centroids.astype(np.float64), True)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def vector_array(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).astype(np.int16)))


class Borders:
    """Cells of each list: halves by the widest coordinate of the vectors seen."""

    def __init__(self, cid: np.ndarray, v: np.ndarray, k: int, seen: int = SEEN) -> None:
        self.trees, self.n = [], 0
        for c in range(k):
            self.trees.append(self._cut(v[cid == c], seen))

    def _cut(self, v: np.ndarray, seen: int) -> int | tuple:
        """A cell's number, or (coordinate, the low half's largest value, low, high)."""
        wide = v.max(0) - v.min(0) if len(v) else np.zeros(1)
        if len(v) <= seen or not wide.max():
            self.n += 1
            return self.n - 1
        i = int(wide.argmax())
        x = v[:, i]
        at = np.partition(x, len(x) // 2)[len(x) // 2]
        at = at if at < x.max() else x[x < at].max()
        return i, at, self._cut(v[x <= at], seen), self._cut(v[x > at], seen)

    def of(self, cid: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.zeros(len(v), np.int32)
        todo = [(self.trees[c], np.flatnonzero(cid == c)) for c in np.unique(cid)]
        while todo:
            tree, rows = todo.pop()
            if isinstance(tree, int):
                out[rows] = tree
            elif len(rows):
                i, at, low, high = tree
                under = v[rows, i] <= at
                todo += [(low, rows[under]), (high, rows[~under])]
        return out


class Cells:
    """The lists' vectors by cell, at ``path``, and on the driver the cells' boxes."""

    def __init__(self, spark: SparkSession, index: IvfIndex, k: int, path: str, rows: int = ROWS) -> None:
        w = Window.partitionBy("cid", "v").orderBy("ref_id")
        lists = index.lists.select("cid", "ref_id", F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), "v")
        lists.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn").write.parquet(f"{path}/lists")
        lists = spark.read.schema("cid int, ref_id long, label int, v array<smallint>").parquet(f"{path}/lists")
        n = lists.count()
        every = max(1, max(rows, n // MOST_CELLS) // SEEN)
        seen = lists.where(F.pmod(F.xxhash64("ref_id"), F.lit(every)) == 0).select("cid", "v").toArrow()
        borders = Borders(seen.column("cid").to_numpy(), matrix(seen.column("v")), index.k)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = borders.of(b.column("cid").to_numpy(), matrix(b.column("v")))
                    yield b.append_column("cell", pa.array(cell))

        lists.mapInArrow(deal, "cid int, ref_id long, label int, v array<smallint>, cell int").write.parquet(f"{path}/cells")
        self.index, self.k = index, k
        self.vectors = spark.read.schema("cell int, cid int, ref_id long, label int, v array<smallint>").parquet(f"{path}/cells")
        self._boxes(borders.n, index.dim)

    def _boxes(self, n: int, dim: int) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, of = np.full((n, dim), np.inf), np.full((n, dim), -np.inf), np.full(n, -1)
            for b in batches:
                if b.num_rows:
                    x, cell = matrix(b.column("v")), b.column("cell").to_numpy()
                    np.minimum.at(low, cell, x)
                    np.maximum.at(high, cell, x)
                    of[cell] = b.column("cid").to_numpy()
            at = np.flatnonzero(of >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(of[at].astype(np.int32)), vector_array(low[at]), vector_array(high[at])], ["cell", "cid", "low", "high"])

        each = self.vectors.select("cell", "cid", "v").mapInArrow(run, "cell int, cid int, low array<smallint>, high array<smallint>")
        each = each.select("cell", "cid", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
        found = each.groupBy("cell", "cid", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).toArrow()
        self.low, self.high, self.cid = np.zeros((n, dim)), np.zeros((n, dim)), np.full(n, -1)
        cell, i = found.column("cell").to_numpy(), found.column("i").to_numpy()
        self.low[cell, i], self.high[cell, i] = found.column("low").to_numpy(), found.column("high").to_numpy()
        self.cid[cell] = found.column("cid").to_numpy()

    def pairs(self, queries: DataFrame, above: int, last: int, first: bool | None) -> DataFrame:
        """(cell, crank, qid, v, most) of queries (qid, v, most): cells of their lists
        with a crank over ``above`` up to ``last``, no farther than ``most``.

        ``first``: the nearest cell alone, or all but this one (None: all)."""
        low, high, centroids = self.low, self.high, self.index.centroids
        members = {c: np.flatnonzero(self.cid == c) for c in range(self.index.k)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = matrix(b.column("v"))
                rank, most = ranks(q, centroids, last), pc.fill_null(pc.cast(b.column("most"), pa.float64()), np.inf).to_numpy(zero_copy_only=False)
                nearest = (np.full(len(q), np.inf), np.zeros(len(q), np.int64), np.full(len(q), -1))
                found = [(np.zeros(0, np.int64),) * 3]
                for c, cells in members.items():
                    row, at = np.nonzero(rank[:, above:] == c)
                    if not len(row) or not len(cells):
                        continue
                    at, d = at + above + 1, box_distances(q[row], low[cells], high[cells])
                    if first is not None:
                        j = d.argmin(0)
                        closest = d[j, np.arange(len(row))]
                        better = (closest < nearest[0][row]) | (closest == nearest[0][row]) & ((nearest[2][row] < 0) | (at < nearest[1][row]))
                        for a, x in zip(nearest, (closest, at, cells[j]), strict=True):
                            a[row[better]] = x[better]
                    if not first:
                        i, j = np.nonzero(d <= most[row][None, :])
                        found.append((row[j], at[j], cells[i]))
                row, at, cell = (np.concatenate(x) for x in zip(*found, strict=True))
                if first:
                    row = np.flatnonzero(nearest[2] >= 0)
                    at, cell = nearest[1][row], nearest[2][row]
                elif first is not None:
                    other = cell != nearest[2][row]
                    row, at, cell = row[other], at[other], cell[other]
                some = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(at.astype(np.int32)), b.column("qid").take(some), vector_array(q[row]), b.column("most").take(some)], ["cell", "crank", "qid", "v", "most"]
                )

        return queries.select("qid", "v", F.col("most").cast("long").alias("most")).mapInArrow(run, "cell int, crank int, qid long, v array<smallint>, most long")

    def met(self, pairs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
        """(qid, v, found) for each of ``pairs``: the k nearest of its cell by
        (distance, id), of those at ``most`` at most.  ``path`` gets the pairs."""
        spark, k = pairs.sparkSession, self.k
        pairs.write.parquet(path)
        pairs = spark.read.schema(pairs.schema).parquet(path)
        asked = sorted((r.cell, r.n) for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect())  # one a cell
        blocks = [max(1, -(-n // block)) for _, n in asked]
        start = np.cumsum([0, *blocks])
        groups = int(start[-1])
        layout = F.broadcast(spark.createDataFrame([(c, n, int(g)) for (c, _), n, g in zip(asked, blocks, start, strict=False)], "cell int, blocks int, start int"))
        every = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("g")
        left = self.vectors.join(layout, "cell").select(every, "ref_id", "label", "v")
        right = pairs.join(layout, "cell").select((F.col("start") + F.pmod(F.xxhash64("qid"), "blocks")).cast("int").alias("g"), "crank", "qid", "v", "most")

        def meet(some: pa.Table, who: pa.Table) -> pa.Table:
            schema = pa.schema([("qid", pa.int64()), ("v", _VECTOR), ("found", pa.list_(pa.struct(_FOUND_FIELDS)))])
            if not some.num_rows or not who.num_rows:
                return schema.empty_table()
            ref, label, qid, rank = (t.column(c).to_numpy() for t, c in ((some, "ref_id"), (some, "label"), (who, "qid"), (who, "crank")))
            most = who.column("most").cast(pa.float64()).fill_null(np.inf).to_numpy()
            x = matrix(who.column("v"))
            # No query is skipped, so ids of queries have no part in it.
            j, i, d = nearest_in_boxes(matrix(some.column("v")), ref, x, qid, k, False, most)
            n = np.bincount(j, minlength=len(qid))
            row = np.flatnonzero(n)
            values = [pa.array(a, t) for a, (_, t) in zip((d.astype(np.int64), rank[j], ref[i], label[i]), _FOUND_FIELDS, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[row])).astype(np.int32)), pa.StructArray.from_arrays(values, names=[f for f, _ in _FOUND_FIELDS]))
            return pa.Table.from_arrays([pa.array(qid[row]), vector_array(x[row]), found], schema=schema)

        parts = min(max(1, groups), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        deal = lambda df: df.repartition(parts, "g").groupBy("g")
        return deal(left).cogroup(deal(right)).applyInArrow(meet, f"qid long, v array<smallint>, found {_FOUND}")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query by (distance, cluster rank, id)."""
    return found.groupBy("qid").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def decide(queries: DataFrame, index: IvfIndex, fast: int, full: int, band: tuple[int, ...], k: int, path: str, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """(qid, fast_count, n_fraud, approved) of queries (qid, v): see
    ``ivf.adaptive_decision``; tables between the scans are below ``path``."""
    spark, scale, dim = queries.sparkSession, index.scale, index.dim
    kind = queries.schema["qid"].dataType.simpleString()

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                if x.shape[1] != dim:
                    raise ValueError(f"queries of {x.shape[1]} values; the index has {dim}")
                yield pa.RecordBatch.from_arrays([b.column("qid"), vector_array(quantize_matrix(x, scale))], ["qid", "v"])

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    queries = kept(queries.select("qid", "v").mapInArrow(quantised, f"qid {kind}, v array<smallint>"), "queries")
    cells = Cells(spark, index, k, f"{path}/index", rows)
    votes = F.aggregate("found", F.lit(0), lambda n, x: n + x["label"])
    far = lambda less: F.when(F.size("found") >= k, F.element_at("found", -1)["d"] - less).alias("most")
    asked = queries.select("v").distinct().select(F.monotonically_increasing_id().alias("qid"), "v", F.lit(None).cast("long").alias("most"))
    first = kept(cells.met(cells.pairs(asked, 0, fast, True), f"{path}/first-pairs", block), "first")
    more = cells.met(cells.pairs(first.select("qid", "v", far(0)), 0, fast, False), f"{path}/more-pairs", block)
    near = kept(_best(first.unionByName(more), k).withColumn("fast_count", votes), "near")
    decided = near.select("qid", "v", "fast_count")
    if band:
        # Of equal distances the lower crank is nearer, so others must be closer than the k-th.
        unsure = near.where(F.col("fast_count").isin(*band))
        deep = cells.met(cells.pairs(unsure.select("qid", "v", far(1)), fast, full, None), f"{path}/deep-pairs", block)
        deep = _best(unsure.select("qid", "v", "found").unionByName(deep), k).select("qid", votes.alias("full_count"))
        decided = decided.join(deep, "qid", "left").select("v", "fast_count", F.coalesce("full_count", "fast_count").alias("n_fraud"))
    else:
        decided = decided.select("v", "fast_count", F.col("fast_count").alias("n_fraud"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("fast_count", "n_fraud")]
    return queries.join(decided, "v", "left").select("qid", *counts).withColumn("approved", approved(F.col("n_fraud")))
