"""The k most similar vectors of every vector, by a hash-prefix forest.

Each tree gives a vector a long hash string: the signs of 64 random projections. A tree is
the sorted array of these strings, which Spark range-partitions and sorts for all trees at
once, on (tree, string, n), so no tree and no group of equal strings is bound to one task.

A row descends in every tree to the rows that share the longest prefix with it. All trees
then ascend in step: the row's level is the longest prefix length at which the rows that
share it, taken over all trees, number `ROWS` a tree. The level follows how crowded each row's
surroundings are, and trees that match it deeper give it more rows. How many trees it takes
follows from the number of rows (`trees_for`). Rows meet the rows of their level as blocks of
a matrix product over vectors of one byte a number; ranges meet over their borders. What
passes is compared exactly.

The forest finds near neighbours (cosine `NEAR` or more). Rows in a crowd, whose level more than
`REACH` rows a tree share or which have twice as many near neighbours as wanted, are queried a
second time, as bytes do not tell these apart; so are rows with fewer than k near neighbours, if
far ones are wanted too: all rows are sorted into the cells of
a k-means on a bounded sample, and such a row is compared exactly with all rows of the cells
nearest to it. How many cells that takes is measured on each input: so many that they hold
`WANTED` of the true neighbours of a sample of rows, found by comparing it with all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarkash.sources.tables import checkpoint, stored

HASH_BITS = 64
#: Rows a tree that a row meets at its level.
ROWS = 1024
#: Levels looked at, from five above the usual one on: all bits at first, then ever fewer, down to whole strings.
STEPS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 22, 30, 42, HASH_BITS)
#: Of a prefix that more rows share, a row meets this many on either side in sorted order, and is queried a second time.
REACH = 8192
#: The share of neighbours at `NEAR` that the forest is laid out to find.
RECALL = 0.98
#: Rows of a range of the sorted arrays.
RANGE_ROWS = 400_000
#: How far a cosine of the byte vectors may lie from the true one.
SLACK = 0.03
#: Neighbours at or above this cosine are left to the forest.
NEAR = 0.9
#: Rows a cell and rows a tile (neighbouring cells, compared in one task) on average, and the most cells.
CELL_ROWS, TILE_ROWS, MOST_CELLS = 384, 8192, 4096
#: Rows from which the cells are made, rows compared with all others, and the share of their neighbours that the cells searched must hold.
CELL_SAMPLE, TRIED, WANTED = 40_000, 400, 0.97


def trees_for(rows: int) -> int:
    """Trees that find a neighbour at `NEAR` with a chance of `RECALL`, where a row meets `ROWS` rows a tree.

    Two vectors at that cosine share a bit with a chance of 1 - acos(NEAR) / pi, and evenly
    spread rows are `ROWS` to a prefix of log2(rows / ROWS) bits.
    """
    bit = 1 - math.acos(NEAR) / math.pi
    shared = bit ** max(1.0, math.log2(max(2, rows) / ROWS))
    return max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - shared)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float32)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-30)


def _plant(trees: int, seed: int, wide: bool):
    """(tree, string, n) for each vector and tree; `wide` adds its level and the bytes of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim = len(batch.column(1)[0])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((dim, trees * HASH_BITS)).astype(np.float32)
            unit = _unit(_matrix(batch.column(1), dim))
            strings = np.packbits(unit @ planes > 0, axis=1).view(">u8").astype(np.uint64)
            strings = (strings ^ np.uint64(1 << 63)).view(np.int64)  # signed order is that of the bits
            more, names = [], ["tree", "string", "n"]
            if wide:
                small = np.rint(unit * (127 / np.maximum(np.abs(unit).max(axis=1, keepdims=True), 1e-30))).astype(np.int8)
                more, names = [batch.column(2), pa.array([r.tobytes() for r in small], pa.binary())], [*names, "level", "packed"]
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(strings[:, t].copy()), batch.column(0), *more], names=names)

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The trees in a range of the sorted arrays."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        trees = table.column("tree").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(trees)) + 1), len(trees)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield int(trees[lo]), table.slice(lo, hi - lo)


def _bits(table: pa.Table) -> np.ndarray:
    return table.column("string").to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _crowds(levels: list[int]):
    """How many rows of a tree share the first bits with each row, for each number of bits in `levels`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _ranges(batches):
            bits = _bits(table)
            apart = bits[1:] ^ bits[:-1]
            out = [table.column("n").combine_chunks()]
            for level in levels:
                new = apart >> np.uint64(HASH_BITS - level) != 0 if level else np.zeros(len(apart), bool)
                group = np.concatenate(([0], np.cumsum(new)))
                out.append(pa.array(np.bincount(group)[group].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=["n", *(f"s{i}" for i in range(len(levels)))])

    return run


def _best(k: int, floor: float, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, others: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (ids) the others (names) at the floor, the 2k best where there are more."""
    score = rows @ others.T
    score[ids[:, None] == names[None, :]] = -2
    at, to = np.nonzero(score >= floor)
    if len(at) and np.bincount(at).max() > 2 * k:
        best = np.argpartition(-score, min(2 * k, score.shape[1]) - 1, axis=1)[:, : 2 * k]
        at, to = np.repeat(own, best.shape[1]), best.ravel()
        good = score[at, to] >= floor
        at, to = at[good], to[good]
    return ids[at], names[to]


def _meet(k: int, floor: float, edge: int, tile: int = 512):
    """Candidates (a, b) in each range of the sorted arrays, and the rows at its edges, for its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = (("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("right", pa.bool_()), ("packed", pa.binary()))

        def out(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds], names=[c for c, _ in kinds])

        for tree, table in _ranges(batches):
            bits, ids, packed = _bits(table), table.column("n").to_numpy(), table.column("packed").combine_chunks()
            unit = _unit(np.frombuffer(b"".join(packed.to_pylist()), np.int8).reshape(len(ids), -1))
            rest = np.uint64(HASH_BITS) - table.column("level").to_numpy().astype(np.uint64)
            low = np.where(rest < HASH_BITS, bits >> np.minimum(rest, 63) << np.minimum(rest, 63), 0).astype(np.uint64)
            high = np.where(rest < HASH_BITS, low + ((np.uint64(1) << np.minimum(rest, 63)) - np.uint64(1)), np.uint64((1 << 64) - 1))
            place = np.arange(len(ids))
            start = np.maximum(np.searchsorted(bits, low), place - REACH)
            end = np.minimum(np.searchsorted(bits, high, side="right"), place + REACH + 1)
            for at in range(0, len(ids), tile):
                mine = slice(at, min(at + tile, len(ids)))
                lo, hi = int(start[mine].min()), int(end[mine].max())
                a, b = _best(k, floor, np.arange(mine.stop - at), ids[mine], unit[mine], unit[lo:hi], ids[lo:hi])
                if len(a):
                    yield out(a=a, b=b)
            for right, some in ((True, slice(0, edge)), (False, slice(max(0, len(ids) - edge), len(ids)))):
                yield out(a=ids[some], border=np.full(len(ids[some]), ((part - right) << 20) + tree), right=np.full(len(ids[some]), right), packed=packed.take(pa.array(place[some])))

    return run


def _over_borders(k: int, floor: float):
    """Candidates of which one is at the end of a range and the other at the start of the next."""

    def run(table: pa.Table) -> pa.Table:
        unit = _unit(np.frombuffer(b"".join(table.column("packed").to_pylist()), np.int8).reshape(table.num_rows, -1))
        ids, right = table.column("a").to_numpy(), table.column("right").to_numpy(zero_copy_only=False)
        left = ~right
        pairs = [_best(k, floor, np.arange(int(x.sum())), ids[x], unit[x], unit[y], ids[y]) for x, y in ((left, right), (right, left)) if x.any() and y.any()]
        return pa.table({"a": pa.array(np.concatenate([p[0] for p in pairs] or [ids[:0]])), "b": pa.array(np.concatenate([p[1] for p in pairs] or [ids[:0]]))})

    return run


ORDER = ("tree", "string", "n")


def _ranged(lines: DataFrame, total: int, trees: int) -> DataFrame:
    """The sorted arrays of all trees, in ranges."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * trees / RANGE_ROWS))
    return lines.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)


def _levels(rows: DataFrame, total: int, trees: int | None, seed: int) -> DataFrame:
    """`n`, `level`, and whether more than `REACH` rows a tree share that level (`crowded`)."""
    trees = trees or trees_for(total)
    levels = sorted({min(HASH_BITS, max(0, int(math.log2(max(1, total / ROWS))) - 5) + step) for step in STEPS})
    lines = _ranged(rows.mapInArrow(_plant(trees, seed, False), "tree int, string bigint, n bigint"), total, trees)
    sizes = lines.mapInArrow(_crowds(levels), "n bigint, " + ", ".join(f"s{i} int" for i in range(len(levels))))
    sums = sizes.groupBy("n").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(levels))])
    chosen = lambda value: reduce(lambda c, i: c.when(F.col(f"s{i}") >= ROWS * trees, value(i)), range(len(levels) - 1, 0, -1), F.when(F.lit(False), value(0))).otherwise(value(0))
    return checkpoint(sums.select("n", chosen(lambda i: F.lit(levels[i])).alias("level"), (chosen(lambda i: F.col(f"s{i}")) > REACH * trees).alias("crowded")))


def _forest(rows: DataFrame, total: int, k: int, floor: float, trees: int | None, seed: int, placed: DataFrame | None = None) -> DataFrame:
    """`a`, `b` (a < b): candidate pairs of rows (n, v) of one length, whose levels are `placed`."""
    trees = trees or trees_for(total)
    placed = _levels(rows, total, trees, seed) if placed is None else placed
    planted = rows.join(placed, "n").select("n", "v", "level")
    arrays = _ranged(planted.mapInArrow(_plant(trees, seed, True), "tree int, string bigint, n bigint, level int, packed binary"), total, trees)
    met = checkpoint(arrays.mapInArrow(_meet(k, floor, ROWS), "a bigint, b bigint, border bigint, right boolean, packed binary"))
    across = met.where("border IS NOT NULL").groupBy("border").applyInArrow(_over_borders(k, floor), "a bigint, b bigint")  # at most 2 * ROWS rows a border
    both = met.where("border IS NULL").select("a", "b").unionByName(across)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _exact(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dim = len(batch.column(2)[0])
                u, v = (_matrix(batch.column(i), dim).astype(np.float64) for i in (2, 3))
                cosine = (u * v).sum(axis=1) / np.maximum(np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1)), 1e-30)
                good = pa.array(cosine >= floor)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(cosine).filter(good)], names=["a", "b", "similarity"])

    return run


def _centres(unit: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """`n` directions around which the unit vectors lie (k-means)."""
    n = max(1, min(n, len(unit)))
    centres = unit[np.random.default_rng(seed).choice(len(unit), n, replace=False)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        at, first = np.unique(own[order], return_index=True)
        centres = centres.copy()
        centres[at] = _unit(np.add.reduceat(unit[order], first, axis=0))
    return centres


def _all_scores(tried: np.ndarray, own: np.ndarray, centres: np.ndarray, k: int):
    """The k best rows of each batch for each tried vector: its place, the row's similarity and its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), tried.shape[1]))
            cell = (unit @ centres.T).argmax(axis=1)
            score = tried @ unit.T
            score[own[:, None] == batch.column(0).to_numpy()[None, :]] = -2
            best = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
            place = np.repeat(np.arange(len(tried)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(score[place, best.ravel()].astype(np.float64)), pa.array(cell[best.ravel()].astype(np.int32))], names=["place", "similarity", "cell"])

    return run


def _deal(centres: np.ndarray, tile_of: np.ndarray, salts: np.ndarray, probes: int):
    """Each row to a tile of its cell, and each query to all tiles of the cells nearest to it, with these cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate(([0], np.cumsum(salts)))
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(0).to_numpy()
            raw = _matrix(batch.column(1), centres.shape[1])
            score = _unit(raw) @ centres.T
            cell = score.argmax(axis=1)
            packed = [r.tobytes() for r in raw.astype(np.float32)]
            near = np.argpartition(-score, min(probes, len(centres)) - 1, axis=1)[:, :probes]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1), 1)
            tile, query, index, cells = [], [], [], []
            for i, (c, wanted) in enumerate(zip(cell.tolist(), batch.column(2).to_pylist(), strict=True)):
                tile.append(int(first[tile_of[c]] + n[i] % salts[tile_of[c]]))
                query.append(False)
                index.append(i)
                cells.append([c])
                if wanted:
                    groups = tile_of[near[i]]
                    for g in np.unique(groups).tolist():
                        mine = near[i][groups == g].tolist()
                        for t in range(first[g], first[g + 1]):
                            tile.append(int(t))
                            query.append(True)
                            index.append(i)
                            cells.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(query), pa.array(n[index]), pa.array([packed[i] for i in index], pa.binary()), pa.array(cells, pa.list_(pa.int32()))], names=["tile", "query", "n", "packed", "cells"])

    return run


def _compare(k: int, dim: int, floor: float):
    """The k best rows of a tile for each of its queries, among the rows of the query's cells; a tile's rows come before its queries."""

    def best(base: dict, query: tuple) -> Iterator[pa.RecordBatch]:
        raw, n, cells = query
        unit = _unit(raw)
        by_cell: dict[int, list[int]] = {}
        for i, cs in enumerate(cells):
            for c in cs:
                by_cell.setdefault(c, []).append(i)
        spans = [(by_cell[c], lo, hi) for c, (lo, hi) in base["cells"].items() if c in by_cell]
        if not spans:
            return
        columns = np.concatenate([np.arange(lo, hi) for _, lo, hi in spans])
        score, done = np.full((len(n), len(columns)), -2, np.float32), 0
        for rows, lo, hi in spans:
            score[rows, done : done + hi - lo] = unit[rows] @ base["unit"][lo:hi].T
            done += hi - lo
        score[n[:, None] == base["n"][columns][None, :]] = -2
        if score.shape[1] > k:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - 1e-5  # all that rounding may hide
        else:
            least = np.full(len(n), -1.5, np.float32)
        at, to = np.nonzero(score >= np.maximum(least, -1.5)[:, None])
        to = columns[to]
        u, v = raw[at].astype(np.float64), base["raw"][to].astype(np.float64)
        cosine = (u * v).sum(axis=1) / np.maximum(np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1)), 1e-30)
        good = cosine >= floor
        yield pa.RecordBatch.from_arrays([pa.array(n[at][good]), pa.array(base["n"][to][good]), pa.array(cosine[good])], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, base = None, [], None
        for batch in batches:
            tiles, queries = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(queries.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tiles)], strict=True):
                if hi == lo:
                    continue
                if tiles[lo] != tile:
                    tile, held, base = tiles[lo], [], None
                part = batch.slice(lo, hi - lo)
                raw = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float32).reshape(-1, dim)
                n, cells = part.column(2).to_numpy(), part.column(4).to_pylist()
                if not queries[lo]:
                    held.append((raw, n, np.array([c[0] for c in cells])))
                    continue
                if base is None and held:
                    own = np.concatenate([h[2] for h in held])
                    order = np.argsort(own, kind="stable")
                    raws = np.concatenate([h[0] for h in held])[order]
                    at, first = np.unique(own[order], return_index=True)
                    base = {"raw": raws, "unit": _unit(raws), "n": np.concatenate([h[1] for h in held])[order], "cells": dict(zip(at.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True), strict=True))}
                if base is not None:
                    for i in range(0, len(n), 256):
                        yield from best(base, (raw[i : i + 256], n[i : i + 256], cells[i : i + 256]))

    return run


def _far(rows: DataFrame, asked: DataFrame, k: int, floor: float, seed: int) -> DataFrame:
    """`a`, `b`, `similarity` of rows (n, v), for those `asked` with wanted: the k best (and ties) of each tile of the cells nearest to them."""
    spark = rows.sparkSession
    total = rows.count()
    picked = lambda m, salt: rows.where(F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, m / total)) + 1)  # noqa: E731  # about m rows
    sample = _unit(np.array([r.v for r in picked(CELL_SAMPLE, 11).select("v").limit(2 * CELL_SAMPLE).collect()], np.float32))
    centres = _centres(sample, min(MOST_CELLS, -(-total // CELL_ROWS)), seed)
    groups = _centres(centres, -(-total // TILE_ROWS), seed)
    tile_of = (centres @ groups.T).argmax(axis=1)
    tried = picked(TRIED, 13).select("n", "v").limit(2 * TRIED).collect()
    probes = len(centres)
    if tried:
        unit = _unit(np.array([r.v for r in tried], np.float32))
        found = rows.select("n", "v").mapInArrow(_all_scores(unit, np.array([r.n for r in tried]), centres, k), "place int, similarity double, cell int")
        top = Window.partitionBy("place").orderBy(F.desc("similarity"))
        found = found.withColumn("r", F.row_number().over(top)).where((F.col("r") <= k) & (F.col("similarity") >= max(floor, -1.5))).select("place", "cell").collect()  # k for each row tried
        rank = np.argsort(np.argsort(-(unit @ centres.T), axis=1), axis=1)
        needed = np.sort([rank[r.place, r.cell] for r in found])
        probes = int(needed[min(len(needed) - 1, int(np.ceil(WANTED * len(needed))))]) + 1 if len(needed) else 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array((_unit(_matrix(batch.column(0), centres.shape[1])) @ centres.T).argmax(axis=1).astype(np.int32))], names=["cell"])

    sizes = np.zeros(len(groups), np.int64)
    for r in rows.select("v").mapInArrow(cells, "cell int").groupBy("cell").count().collect():  # one row a cell
        sizes[tile_of[r.cell]] += r["count"]
    salts = np.maximum(1, -(-sizes // (4 * TILE_ROWS)))  # a crowded tile is several
    dealt = asked.mapInArrow(_deal(centres, tile_of, salts, probes), "tile int, query boolean, n bigint, packed binary, cells array<int>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(salts.sum()) // 4)
    dealt = dealt.repartition(parts, "tile").sortWithinPartitions("tile", "query", "cells")  # queries of the same cells together
    return dealt.mapInArrow(_compare(k, centres.shape[1], floor), "a bigint, b bigint, similarity double")


def _near(rows: DataFrame, total: int, k: int, floor: float, trees: int | None, seed: int, placed: DataFrame) -> DataFrame:
    """`n`, `other`, `similarity`, both ways: what rows (n, v) of one length find in the forest."""
    met = _forest(rows, total, k, floor - SLACK, trees, seed, placed)
    both = met.join(rows.select(F.col("n").alias("a"), F.col("v").alias("va")), "a").join(rows.select(F.col("n").alias("b"), F.col("v").alias("vb")), "b")
    links = both.select("a", "b", "va", "vb").mapInArrow(_exact(floor), "a bigint, b bigint, similarity double")
    ways = F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("other"), "similarity"), F.struct(F.col("b").alias("n"), F.col("a").alias("other"), "similarity"))
    return links.select(F.explode(ways).alias("w")).select("w.*")


def nearest(df: DataFrame, key: str, vector: str, *, k: int = 10, min_similarity: float = -1.0, trees: int | None = None, seed: int = 7, newest: str | None = "loaded_at") -> DataFrame:
    """`id`, `neighbour`, `similarity`, `rank`: of each key the k other keys of greatest cosine, at or above `min_similarity`.

    Where `min_similarity` is below `NEAR`, keys with fewer than k neighbours at `NEAR` are
    queried a second time among the cells nearest to them (`_far`), which hold about `WANTED`
    of their true neighbours; so are, whatever `min_similarity`, keys in a crowd too dense for the
    forest: more than `REACH` rows a tree at their level, or 2k neighbours at `NEAR` or more.
    Ties go to the smaller key. Of a repeated key the row loaded last counts; rows whose
    key or vector is NULL, or whose vector is empty, all zero or not finite, take no part.
    Vectors of different lengths are never compared; each length is searched on its own.
    Of keys with equal vectors only the k+1 smallest are searched: with ties going to the
    smaller key no other can be anyone's neighbour, and the others are given the k smallest
    of them, with similarity 1.
    """
    at = F.coalesce(F.col(newest).cast("timestamp"), F.timestamp_seconds(F.lit(0))) if newest else F.timestamp_seconds(F.lit(0))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), at.alias("at"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.groupBy("id").agg(F.max_by("v", "at").alias("v"))
    same = (F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    rows = stored(rows.select("id", "v", *same).withColumn("copy", F.row_number().over(copies)).withColumn("n", F.monotonically_increasing_id()))
    sizes = rows.where(F.col("copy") <= k + 1).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("m")).orderBy("d").collect()  # one row a length
    if not sizes:
        return df.sparkSession.createDataFrame([], f"id {kind}, neighbour {kind}, similarity double, rank int")
    names = rows.select("n", "id")
    found = None
    for d, total in sizes:
        shown = rows.where((F.col("copy") <= k + 1) & (F.size("v") == d)).select("n", "v")
        placed = _levels(shown, total, trees, seed)
        ways = _near(shown, total, k, max(min_similarity, NEAR), trees, seed, placed)
        best = Window.partitionBy("n").orderBy(F.desc("similarity"))
        ways = ways.withColumn("m", F.count("*").over(Window.partitionBy("n"))).withColumn("r", F.rank().over(best)).where(F.col("r") <= k)
        ways = checkpoint(ways.select("n", "other", "similarity", "m"))  # ties stay until the names are known
        dense = placed.where("crowded").select("n").unionByName(ways.where(F.col("m") >= 2 * k).select("n")).distinct()
        if min_similarity < NEAR or not dense.isEmpty():
            enough = ways.where(F.col("m") >= k).select("n").distinct() if min_similarity < NEAR else shown.select("n")
            enough = enough.join(dense, "n", "left_anti").withColumn("wanted", F.lit(False))
            asked = shown.join(enough, "n", "left").select("n", "v", F.coalesce("wanted", F.lit(True)).alias("wanted"))
            far = _far(shown, asked, k, min_similarity, seed).withColumnsRenamed({"a": "n", "b": "other"})
            far = far.withColumn("r", F.rank().over(best)).where(F.col("r") <= k).drop("r")
            ways = ways.drop("m").unionByName(far).groupBy("n", "other").agg(F.max("similarity").alias("similarity"))
        ways = ways.select("n", "other", "similarity")
        found = ways if found is None else found.unionByName(ways)
    named = found.join(names, "n").join(names.select(F.col("n").alias("other"), F.col("id").alias("neighbour")), "other")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    top = named.select("id", "neighbour", "similarity").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    crowds = rows.where(F.col("copy") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("first")).where(F.size("first") > k)  # at most k + 1 ids
    others = rows.where(F.col("copy") > k + 1).select("id", "h1", "h2").join(crowds, ["h1", "h2"]).select("id", F.posexplode(F.slice("first", 1, k)).alias("at", "neighbour"))
    return top.unionByName(others.select("id", "neighbour", F.lit(1.0).alias("similarity"), (F.col("at") + 1).alias("rank")))


def mutual(found: DataFrame) -> DataFrame:
    """`id_a`, `id_b` (smaller first): pairs of which each is a neighbour of the other."""
    pair = (F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
    return found.groupBy(*pair).agg(F.count("*").alias("n")).where("n = 2").select("id_a", "id_b")
