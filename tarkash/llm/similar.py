"""Near-duplicate records by a blocked sparse product of records and word n-grams.

The incidence matrix (records by hashed n-grams) is multiplied with its transpose in
blocks of columns: each block is one row group of packed postings. A record enters only
the columns that its size leaves necessary: with its n-grams ordered from rare to
frequent, a pair of sizes x and y needs an overlap of t/(1+t)*(x+y), so a first common
n-gram further back than the size allows rules the pair out. Any order of the n-grams
gives the exact result; the order by a counting sketch of the whole corpus makes the
columns short. Candidates are then compared word by word.

Equal texts form one class before anything else, so a text that a third of all rows
repeat is one record here. An n-gram that is frequent even among the rarest of many
records is split into tiles, so no group grows beyond `tile` records.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.sources.tables import checkpoint, spread

# letters and digits with the vowel signs and joiners of Indic scripts, without the danda
WORDS = re.compile(r"[^\W_][\w\u0900-\u0963\u0966-\u0dff\u200c\u200d]*").findall
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
CHUNK = 1 << 18
#: Tasks whose counters are added up in one group before the groups are.
SHARD = 256
#: The least and most counters of the sketch, as powers of two; one byte each reaches the driver and every executor.
LEAST_BITS, MOST_BITS = 18, 28
PARITY_BITS = 384
WORD_CACHE = 1_000_000


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(*texts: str | None) -> list[str]:
    """Lower-case words of the texts in a row; punctuation is ignored."""
    return WORDS(" ".join(t for t in texts if t).lower())


def shingle_hashes(word_lists: list[list[str]], n: int, known: _WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each list: the list's number and the hash, by number."""
    sizes = np.fromiter(map(len, word_lists), np.int64, len(word_lists))
    total = int(sizes.sum())
    flat = np.fromiter((h for ws in word_lists for h in map(known.__getitem__, ws)), np.uint64, total)
    if total < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(word_lists)), sizes)
    run = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        run += flat[i : total - n + 1 + i] * SEEDS[i % len(SEEDS)]
        run ^= run >> np.uint64(29)
    run *= SEEDS[0]
    run ^= run >> np.uint64(32)
    inside = doc[: total - n + 1] == doc[n - 1 :]
    doc, run = doc[: total - n + 1][inside], run[inside]
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], run[new]


def _columns(batch: pa.RecordBatch, first: int) -> list[list[str]]:
    texts = [c.to_pylist() for c in batch.columns[first:]]
    return [words_of(*row) for row in zip(*texts, strict=True)]


def bits_for(df: DataFrame, texts: list[str]) -> int:
    """Counters enough for about as many as there are n-grams: one to every eight bytes of text (or fewer, from 2**`MOST_BITS` on)."""
    size = df.agg(F.sum(sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0)))).first()[0]  # one number
    return max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(1, size or 0) / 8 + 1))))


def counting_sketch(df: DataFrame, key: str, texts: list[str], n: int, bits: int) -> tuple[np.ndarray, int]:
    """How often n-grams fall into each of 2**bits counters, on a log scale, and their total.

    One uint8 a counter: 16 MB at 24 bits. A level of 0 means that the counter was hit at
    most once, so its n-gram is in one row only. Counters are added up in a tree, `SHARD`
    tasks at a time.
    """
    width = 1 << bits

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() // SHARD
        known, counts, total = _WordHash(), np.zeros(width, np.uint32), 0
        for batch in batches:
            _, run = shingle_hashes(_columns(batch, 0), n, known)
            total += len(run)
            at, many = np.unique(run & np.uint64(width - 1), return_counts=True)
            counts[at.astype(np.int64)] += many.astype(np.uint32)
        if total:
            for i in range(0, width, CHUNK):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // CHUNK], pa.int32()), "shard": pa.array([shard], pa.int32()), "packed": [zlib.compress(counts[i : i + CHUNK].astype(np.uint64).tobytes(), 1)], "total": pa.array([0 if i else total], pa.int64())})

    def add(last: bool):
        def run(table: pa.Table) -> pa.Table:
            sums = np.zeros(min(CHUNK, width), np.uint64)
            for packed in table.column("packed"):
                sums += np.frombuffer(zlib.decompress(packed.as_py()), np.uint64)
            if last:
                sums = np.minimum(255, 8 * np.log2(np.maximum(sums, 1).astype(np.float64))).astype(np.uint8)
            return pa.table({"chunk": table.column("chunk")[:1], "shard": table.column("shard")[:1], "packed": [zlib.compress(sums.tobytes(), 1)], "total": pa.array([sum(table.column("total").to_pylist())], pa.int64())})

        return run

    schema = "chunk int, shard int, packed binary, total bigint"
    parts = spread(df.select(key, *texts), key).select(*texts).mapInArrow(part, schema)
    rows = parts.groupBy("chunk", "shard").applyInArrow(add(False), schema).groupBy("chunk").applyInArrow(add(True), schema).collect()  # 2**bits bytes at most
    levels = np.zeros(width, np.uint8)
    for r in rows:
        levels[r.chunk * CHUNK : r.chunk * CHUNK + CHUNK] = np.frombuffer(zlib.decompress(r.packed), np.uint8)
    return levels, sum(r.total for r in rows)


def _needed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its rarest n-grams a record must show: enough that any partner at the threshold shares one."""
    return sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1


def _parity(doc: np.ndarray, run: np.ndarray, docs: int) -> np.ndarray:
    """Of each record the parity of its n-grams in PARITY_BITS bins.

    The bins in which two records differ number at most the n-grams they do not share, so a
    pair that differs in more bins than the threshold leaves is no pair; none is lost.
    """
    where = doc * PARITY_BITS + (run >> np.uint64(8)).astype(np.int64) % PARITY_BITS
    odd = np.bincount(where, minlength=docs * PARITY_BITS).reshape(docs, PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)


def even_keys(spark, parts: int) -> np.ndarray:
    """For each of `parts` hash partitions an int that falls into it, so that keys taken from them fill the partitions evenly."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = spark.range(max(1000, 40 * parts)).groupBy(place.alias("p")).agg(F.min("id").alias("k")).collect()  # one row a partition
    keys = {r.p: r.k for r in found}
    return np.array([keys.get(p, p) for p in range(parts)], np.int32)


def _post(key: str, n: int, threshold: float, keys: np.ndarray, tile: int, levels):
    """Packed postings of each batch: per block the records, their sizes, and their n-grams with positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level_of = _WordHash(), levels.value
        mask, blocks = np.uint64(len(level_of) - 1), len(keys)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, run_ = shingle_hashes(_columns(batch, 1), n, known)
            if not len(run_):
                continue
            level = level_of[(run_ & mask).astype(np.int64)]
            order = np.lexsort((run_, level, doc))
            doc, run_, level = doc[order], run_[order], level[order]
            sizes = np.bincount(doc, minlength=len(ids))
            parity = _parity(doc, run_, len(ids))
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at = np.arange(len(doc)) - starts[doc]
            keep = (at < _needed(sizes, threshold)[doc]) & (level > 0)
            doc, run_, level, at = doc[keep], run_[keep], level[keep], at[keep]
            # tiles of a hot n-gram: a record of part u meets every part v in tile (u, v)
            parts = np.maximum(1, np.ceil(2.0 ** (level / 8.0) / tile)).astype(np.int64)
            if (parts > 1).any():
                hot = np.repeat(np.arange(len(doc)), parts)
                v = np.arange(len(hot)) - np.repeat(np.cumsum(parts) - parts, parts)
                m = parts[hot]
                u = ((ids[doc[hot]].astype(np.uint64) >> np.uint64(7)) % m.astype(np.uint64)).astype(np.int64)
                pair = np.minimum(u, v) * m + np.maximum(u, v)
                run_ = np.where(m > 1, run_[hot] + (pair.astype(np.uint64) + np.uint64(1)) * SEEDS[3] * (m > 1).astype(np.uint64), run_[hot])
                doc, at = doc[hot], at[hot]
            block = (run_ % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((doc, block))
            doc, run_, at, block = doc[order], run_[order], at[order], block[order]
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            out = {"block": [], "ids": [], "sizes": [], "parity": [], "many": [], "grams": [], "at": []}
            for b in np.flatnonzero(np.diff(cuts)):
                lo, hi = cuts[b], cuts[b + 1]
                own, many = np.unique(doc[lo:hi], return_counts=True)
                out["block"].append(int(keys[b]))
                out["ids"].append(ids[own].tobytes())
                out["sizes"].append(sizes[own].astype(np.uint32).tobytes())
                out["parity"].append(parity[own].tobytes())
                out["many"].append(many.astype(np.uint32).tobytes())
                out["grams"].append((run_[lo:hi] >> np.uint64(32)).astype(np.uint32).tobytes())
                out["at"].append(at[lo:hi].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int32())] + [(c, pa.binary()) for c in ("ids", "sizes", "parity", "many", "grams", "at")]))

    return run


def _multiply(threshold: float, step: int = 2_000_000):
    """Candidate pairs of one block: records that share a column and pass the bounds of size and position."""
    share = threshold / (1 + threshold)

    def run(table: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

        many = joined("many", np.uint32)
        parity = joined("parity", np.uint64).reshape(-1, PARITY_BITS // 64)
        row = np.repeat(np.arange(len(many)), many)
        ids = np.repeat(joined("ids", np.int64), many)
        size = np.repeat(joined("sizes", np.uint32), many).astype(np.int64)
        gram, at = joined("grams", np.uint32), joined("at", np.uint32).astype(np.int64)
        order = np.lexsort((size, gram))
        ids, row, size, gram, at = ids[order], row[order], size[order], gram[order], at[order]
        # each posting meets those after it in its column whose size is at most size / threshold
        wide = int(size.max()) + 1 if len(size) else 1
        column = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1]))) if len(gram) else gram.astype(np.int64)
        place = column * wide + size
        last = np.searchsorted(place, column * wide + np.minimum(wide - 1, np.floor(size / threshold + 1e-9).astype(np.int64)), side="right")
        meets = last - np.arange(len(ids)) - 1
        found: list[np.ndarray] = []
        lo, ends = 0, np.cumsum(meets)
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, side="right")))
            count = meets[lo:hi]
            a = np.repeat(np.arange(lo, hi), count)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            need = np.ceil(share * (size[a] + size[b]) - 1e-9)
            ok = (np.minimum(size[a] - at[a], size[b] - at[b]) >= need) & (ids[a] != ids[b])
            a, b, apart = a[ok], b[ok], (size[a] + size[b] - 2 * need)[ok]
            ok = np.bitwise_count(parity[row[a]] ^ parity[row[b]]).sum(axis=1) <= apart
            a, b = ids[a[ok]], ids[b[ok]]
            found.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
            lo = hi
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"ka": pa.array(pairs[:, 0]), "kb": pa.array(pairs[:, 1])})

    return run


def _compare(n: int, threshold: float):
    """Exact overlap of the n-gram sets of both texts, word by word."""

    def grams(*texts: str | None) -> frozenset:
        w = words_of(*texts)
        return frozenset(zip(*(w[i:] for i in range(n)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb, *texts = (c.to_pylist() for c in batch.columns)
            half = len(texts) // 2
            rows, last, left = [], None, frozenset()
            for a, b, *t in zip(ka, kb, *texts, strict=True):
                if a != last:
                    last, left = a, grams(*t[:half])
                right = grams(*t[half:])
                shared = len(left & right)
                either = len(left) + len(right) - shared
                if either and shared >= threshold * either - 1e-9:
                    rows.append((a, b, shared / either))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["ka", "kb", "similarity"])

    return run


def _classes(df: DataFrame, key: str, texts: list[str], newest: str | None) -> tuple[DataFrame, DataFrame]:
    """(`key`, `class`) of each record, and (`class`, `rep`, `copies`, texts): records with equal texts form a class."""
    own = [f"_t{i}" for i in range(len(texts))]
    at = F.col(newest) if newest else F.lit(None).cast("timestamp")
    at = F.coalesce(at.cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = df.select(F.col(key).alias("_id"), at.alias("_at"), *[F.col(t).cast("string").alias(o) for t, o in zip(texts, own, strict=True)]).where("_id IS NOT NULL")
    rows = rows.withColumn("class", F.xxhash64(*own, *[F.length(o) for o in own]))
    members = rows.groupBy("_id").agg(F.max_by("class", "_at").alias("class"))
    live = members.groupBy("class").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"))
    one = rows.groupBy("class").agg(*[F.first(o).alias(o) for o in own])
    return members, one.join(live, "class")


def similar_classes(df: DataFrame, key: str, texts: list[str], *, n: int = 3, threshold: float = 0.6, newest: str | None = "loaded_at", sketch_bits: int | None = None, tile: int = 20_000, block_grams: int = 1_500_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): the classes of equal texts and all pairs of classes at or above the threshold.

    members: `_id`, `class`; classes: `class`, `rep` (least id), `copies`; links: `ka`, `kb`
    (classes), `similarity` (Jaccard of the distinct n-grams of the lower-case words of the
    texts taken together). Of a repeated key the row loaded last counts; rows without a key
    are left out; NULL texts count as empty; texts of fewer than n words have no n-gram and
    so no partner but their copies.
    """
    spark = df.sparkSession
    levels, total = counting_sketch(df, key, texts, n, sketch_bits or bits_for(df, texts))
    members, classes = _classes(df, key, texts, newest)
    own = [f"_t{i}" for i in range(len(texts))]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (1 - threshold) / block_grams))
    post = _post("class", n, threshold, even_keys(spark, parts), tile, spark.sparkContext.broadcast(levels))
    kept = "block int, ids binary, sizes binary, parity binary, many binary, grams binary, at binary"
    candidates = classes.select("class", *own).mapInArrow(post, kept).repartition(parts, "block").groupBy("block").applyInArrow(_multiply(threshold), "ka bigint, kb bigint").distinct()
    left = classes.select(F.col("class").alias("ka"), *[F.col(o).alias(f"l{o}") for o in own])
    right = classes.select(F.col("class").alias("kb"), *[F.col(o).alias(f"r{o}") for o in own])
    both = candidates.join(left, "ka").join(right, "kb").select("ka", "kb", *[f"l{o}" for o in own], *[f"r{o}" for o in own])
    links = both.mapInArrow(_compare(n, threshold), "ka bigint, kb bigint, similarity double")
    return members, classes.drop(*own), links


def similar_pairs(df: DataFrame, key: str, texts: list[str], *, expand: int = 50, **options) -> DataFrame:
    """`id_a`, `id_b`: pairs of different keys (smaller first) whose texts reach the threshold.

    Classes of up to `expand` equal texts are written out in full. A larger class stands by
    its representative (the least id): each copy is paired with it, and partners of other
    classes are paired with it alone; `similar_groups` gives every copy's group.
    """
    members, classes, links = similar_classes(df, key, texts, **options)
    links = links.select("ka", "kb")
    shown = members.join(classes, "class").where((F.col("copies") <= expand) | (F.col("_id") == F.col("rep"))).select("class", "_id")
    across = links.join(shown.select(F.col("class").alias("ka"), F.col("_id").alias("a")), "ka").join(shown.select(F.col("class").alias("kb"), F.col("_id").alias("b")), "kb").select("a", "b")
    many = members.join(classes.where("copies > 1"), "class")
    small = many.where(F.col("copies") <= expand).groupBy("class").agg(F.array_sort(F.collect_list("_id")).alias("ids"))
    inside = small.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b"))
    stars = many.where((F.col("copies") > expand) & (F.col("_id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("_id").alias("b"))
    return across.unionByName(inside).unionByName(stars).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(`node`, `group`): connected components of `edges` (a, b), named by the least node.

    Alternating large-star and small-star steps, each a groupBy whose result is cut from its
    lineage by a checkpoint; the number of steps is logarithmic in the size of a component.
    """
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    top = edges.groupBy("a").agg(F.min("b").alias("group")).select(F.col("a").alias("node"), "group")
    return top.union(edges.select(F.col("b").alias("node"), F.col("b").alias("group")).join(top.select("node"), "node", "left_anti").distinct())


def similar_groups(df: DataFrame, key: str, texts: list[str], **options) -> DataFrame:
    """One row per record: `id`, `class` (least id with the same texts), `group` (least id of all records that links join), `links` (linked classes)."""
    members, classes, links = similar_classes(df, key, texts, **options)
    links = checkpoint(links.select("ka", "kb"))
    reps = classes.select("class", "rep")
    named = links.join(reps.select(F.col("class").alias("ka"), F.col("rep").alias("a")), "ka").join(reps.select(F.col("class").alias("kb"), F.col("rep").alias("b")), "kb").select("a", "b")
    groups = components(named)
    degree = named.select("a").union(named.select("b")).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "rep")
    out = members.join(reps, "class").join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select(F.col("_id").alias("id"), F.col("rep").alias("class"), F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
