"""Mixing sources to target weights by raking.

Tokens are counted per document with a public tokenizer. Iterative proportional fitting
rakes the weights of the cells source x language x topic: each source to its target, and
languages and topics to their shares in the pool, with no weight above the source's cap on
repeats; the sources come last in every round and are met exactly. Documents are then
sampled with their cell's weight as expected number of uses, within buckets of a source, so
that no task gets a whole source: along a bucket's documents, ordered by cell, tokens owed
are carried on and a document is used once more when it pays half of itself; what is left
at the end is settled by the documents that fit it best.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.llm import bpe
from tarkash.sources.tables import checkpoint, newest_per_key, spread

#: Languages and topics below this share of the pool's documents are raked together, so
#: there are at most 1 / LEAST_SHARE of either.
LEAST_SHARE = 0.005


def topic_of(subject) -> F.Column:
    """A subject without names and numbers: `Delay in Narkera project` is `delay in project`."""
    plain = F.regexp_replace(F.trim(subject), r"(?<=\s)(?:\p{Lu}\S*|\S*\d\S*)", "")
    return F.coalesce(F.nullif(F.lower(F.trim(F.regexp_replace(plain, r"\s+", " "))), F.lit("")), F.lit("none"))


def _grouped(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with rare values of a column as `other`."""
    n = rows.count()
    shares = rows.groupBy(column).count().where(F.col("count") >= LEAST_SHARE * n).select(F.col(column).alias("_kept"))
    joined = rows.join(F.broadcast(shares), rows[column] == F.col("_kept"), "left")  # at most 1 / LEAST_SHARE rows
    return joined.withColumn(column, F.coalesce("_kept", F.lit("other"))).drop("_kept")


def rake(cells: dict[tuple, float], caps: dict[str, float], shares: dict[str, float], margins: tuple[int, ...] = (1, 2), rounds: int = 60) -> tuple[dict[tuple, float], float]:
    """Weights of the cells (source first) and the total that they reach.

    The total is the largest at which every source that has tokens can reach its target
    without a weight above its cap; targets of sources without tokens go to the others.
    """
    have: dict[str, float] = defaultdict(float)
    for cell, tokens in cells.items():
        have[cell[0]] += tokens
    live = {s: x for s, x in shares.items() if x > 0 and have.get(s, 0) > 0 and caps.get(s, 0) > 0}
    if not live:
        return {}, 0.0
    whole = sum(live.values())
    live = {s: x / whole for s, x in live.items()}
    total = min(caps[s] * have[s] / x for s, x in live.items())
    pool = {c: t for c, t in cells.items() if c[0] in live and t > 0}
    size = sum(pool.values())
    goals = []
    for axis in margins:
        goal: dict = defaultdict(float)
        for cell, tokens in pool.items():
            goal[cell[axis]] += tokens * total / size
        goals.append((axis, goal))
    weight = {c: total * live[c[0]] / have[c[0]] for c in pool}
    for _ in range(rounds):
        for axis, goal in goals:
            now: dict = defaultdict(float)
            for c, w in weight.items():
                now[c[axis]] += w * pool[c]
            weight = {c: min(caps[c[0]], w * goal[c[axis]] / now[c[axis]]) if now[c[axis]] else w for c, w in weight.items()}
        for source, share in live.items():  # exactly, the capped cells staying at the cap
            own = [c for c in weight if c[0] == source]
            free, need = set(own), total * share
            while free:
                held = sum(weight[c] * pool[c] for c in own if c not in free)
                now = sum(weight[c] * pool[c] for c in free)
                factor = max(0.0, need - held) / now if now else 0.0
                over = {c for c in free if weight[c] * factor > caps[source] * (1 + 1e-12)}
                for c in over or free:
                    weight[c] = caps[source] if over else min(caps[source], weight[c] * factor)
                if not over:
                    break
                free -= over
    return weight, total


def pool_of(documents: DataFrame, targets: DataFrame, topics: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """`doc_id`, `source`, `lang`, `topic`, `tokens` of one document for each different text of a listed source.

    Of documents with the same text the one with the least id stands for all, so that no
    text is used more often than its source allows. NULL and blank texts, documents without
    an id and unlisted sources take no part.
    """
    listed = targets.where("source IS NOT NULL").select("source").distinct()
    rows = documents.where("doc_id IS NOT NULL AND trim(text) <> ''").select("doc_id", "text", "source", F.coalesce("lang", F.lit("none")).alias("lang"), "doc_key")
    rows = spread(rows, "doc_id").join(F.broadcast(listed), "source")  # the targets: one row a source
    counted = bpe.count_tokens(rows.withColumn("same", F.xxhash64("text", F.length("text"))), ["doc_id", "source", "lang", "doc_key", "same"], vocabulary=vocabulary)
    one = counted.groupBy("same").agg(F.min_by(F.struct("doc_id", "source", "lang", "doc_key", "tokens"), "doc_id").alias("d")).select("d.*")
    named = newest_per_key(topics.select("doc_key", "subject", "loaded_at").where("doc_key IS NOT NULL"), ["doc_key"]).select("doc_key", topic_of(F.col("subject")).alias("topic"))
    return one.where("tokens > 0").join(named, "doc_key", "left").select("doc_id", "source", "lang", F.coalesce("topic", F.lit("none")).alias("topic"), "tokens")


def deal(tokens: np.ndarray, weight: np.ndarray, most_turns: int = 50) -> np.ndarray:
    """Uses of documents in order: each its weight, rounded down or up, so that the tokens used come as near to those owed as whole documents can."""
    uses = np.floor(weight + 1e-9).astype(np.int64)
    part = np.maximum(0.0, weight - uses)
    part[part < 1e-9] = 0
    owed, more = 0.0, np.zeros(len(uses), bool)
    for i in np.flatnonzero(part):
        owed += part[i] * tokens[i]
        if owed >= tokens[i] / 2:
            more[i] = True
            owed -= tokens[i]
    free = np.flatnonzero(part)
    for _ in range(most_turns if len(free) else 0):
        left = np.abs(owed + np.where(more[free], tokens[free], -tokens[free]))
        best = int(left.argmin())
        if left[best] >= abs(owed):
            break
        i = free[best]
        owed += tokens[i] if more[i] else -tokens[i]
        more[i] = not more[i]
    return uses + more


def _dealt(table: pa.Table) -> pa.Table:
    table = table.sort_by([("lang", "ascending"), ("topic", "ascending"), ("draw", "ascending"), ("doc_id", "ascending")])
    uses = deal(table.column("tokens").to_numpy().astype(np.float64), table.column("weight").to_numpy())
    return table.select(["doc_id", "source", "lang", "topic", "tokens", "weight"]).append_column("repeats", pa.array(uses.astype(np.int32)))


def weigh(documents: DataFrame, targets: DataFrame, topics: DataFrame, vocabulary: str = bpe.VOCABULARY) -> tuple[DataFrame, dict[str, int]]:
    """The pool with the `weight` of each document, and how many documents each source has in it."""
    spark = documents.sparkSession
    pool = checkpoint(pool_of(documents, targets, topics, vocabulary))
    pool = _grouped(_grouped(pool, "lang"), "topic")
    cells = pool.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()  # at most sources / LEAST_SHARE^2 rows
    goals = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()  # one row a source
    weight, _ = rake({(c.source, c.lang, c.topic): float(c.tokens) for c in cells}, {g.source: float(g.cap or 0) for g in goals}, {g.source: float(g.share or 0) for g in goals})
    table = spark.createDataFrame([(*c, w) for c, w in weight.items()], "source string, lang string, topic string, weight double")
    sizes: dict[str, int] = defaultdict(int)
    for c in cells:
        sizes[c.source] += c.n
    return pool.join(F.broadcast(table), ["source", "lang", "topic"]), sizes


def mix(documents: DataFrame, targets: DataFrame, topics: DataFrame, *, bucket: int = 2000, seed: int = 17, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """`doc_id`, `source`, `lang`, `topic`, `tokens`, `weight`, `repeats` of each document that is used.

    `lang` and `topic` are as they were raked: values below `LEAST_SHARE` are `other`.
    """
    rows, sizes = weigh(documents, targets, topics, vocabulary)
    parts = documents.sparkSession.createDataFrame([(s, max(1, n // bucket)) for s, n in sizes.items()], "source string, parts int")
    rows = rows.join(F.broadcast(parts), "source").withColumn("draw", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod("draw", F.col("parts")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    chosen = rows.select("doc_id", "source", "lang", "topic", F.col("tokens").cast("bigint").alias("tokens"), "weight", "draw", "part").groupBy("source", "part").applyInArrow(_dealt, f"doc_id {kind}, source string, lang string, topic string, tokens bigint, weight double, repeats int")  # about `bucket` rows
    return chosen.where("repeats > 0")


def axis_shares(documents: DataFrame, mixed: DataFrame, targets: DataFrame, topics: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """`axis` (lang, topic), `value`, `pool_share`, `actual_share`: the pool's share of tokens that each language and topic was raked to, and the share reached."""
    pool, _ = weigh(documents, targets, topics, vocabulary)
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in ("lang", "topic")])

    def part(rows: DataFrame, tokens, name: str) -> DataFrame:
        sums = rows.select(F.explode(axes).alias("x"), tokens.alias("t")).groupBy("x.axis", "x.value").agg(F.sum("t").alias("t"))
        return sums.join(F.broadcast(sums.groupBy("axis").agg(F.sum("t").alias("all"))), "axis").select("axis", "value", (F.col("t") / F.col("all")).alias(name))

    rows = part(pool, F.col("tokens"), "pool_share").join(part(mixed, F.col("tokens") * F.col("repeats"), "actual_share"), ["axis", "value"], "left")
    return rows.select("axis", "value", "pool_share", F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """`source`, `target_share`, `documents`, `uses`, `tokens`, `actual_share` of each listed source, used or not."""
    used = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("repeats").alias("uses"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    goals = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = F.lit(0).cast("bigint")
    rows = goals.join(used, "source", "left").select("source", "target_share", *[F.coalesce(c, zero).alias(c) for c in ("documents", "uses", "tokens")])
    total = rows.agg(F.sum("tokens").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("source", "target_share", "documents", "uses", "tokens", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0).alias("actual_share"))
