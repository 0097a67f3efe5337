"""A dictionary of entities and their aliases, and where it occurs in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.text import normalise, slug


def build(names: DataFrame, name: str, kind: str, order: Column) -> DataFrame:
    """`entity_id`, `kind`, `alias`: normalised aliases, each owned by the first entity by `order` that claims it."""
    rows = names.where(F.trim(name) != "").select(slug(F.col(name)).alias("entity_id"), F.lit(kind).alias("kind"), normalise(F.col(name)).alias("alias"), order.alias("_order"))
    first = rows.groupBy("alias").agg(F.min_by(F.struct("entity_id", "kind"), F.struct("_order", "entity_id")).alias("e"))
    return first.select("e.entity_id", "e.kind", "alias")


def merge_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both dictionaries' aliases; an alias that `old` owns stays with its entity."""
    return old.unionByName(new.join(old.select("alias"), "alias", "left_anti").select(*old.columns))


def words_of(text: Column) -> Column:
    """Words of the normalised text; brackets, commas and the like part them."""
    return F.filter(F.split(F.regexp_replace(normalise(text), r"[^\p{L}\p{M}\p{N}&'-]+", " "), " "), lambda w: w != "")


def match(rows: DataFrame, key: str, text: str, dictionary: DataFrame, most_words: int = 4) -> DataFrame:
    """`key`, `entity_id`, `alias`, `at` (word from 0): the dictionary's aliases in the text.

    Runs of up to `most_words` words are joined with the aliases, so the dictionary may be
    of any size. Of overlapping aliases the one of most letters wins, then the leftmost;
    each entity counts once a row, at its first place. NULL and blank texts have none.
    """
    words = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: i + n <= F.size("w")), lambda i: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("alias")))))
    found = words.select("_k", F.explode(spans).alias("s")).select("_k", "s.*").join(dictionary.select("alias", "entity_id"), "alias")
    one = F.struct((-F.length("alias")).alias("size"), "at", "n", "alias", "entity_id")
    listed = found.groupBy("_k").agg(F.array_sort(F.collect_list(one)).alias("c"))  # spans of one row's text
    clear = lambda kept, x: ~F.exists(kept, lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"]))
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    rows = listed.select("_k", F.explode(kept).alias("m")).select(F.col("_k").alias(key), "m.entity_id", "m.alias", "m.at")
    first = Window.partitionBy(key, "entity_id").orderBy("at")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def links(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Entities of each item with where they occur: `question`, `answer` or `both`."""
    both = questions.select(key, "entity_id", F.lit("question").alias("s")).unionByName(answers.select(key, "entity_id", F.lit("answer").alias("s")))
    return both.groupBy(key, "entity_id").agg(F.count_distinct("s").alias("n"), F.min("s").alias("s")).select(key, "entity_id", F.when(F.col("n") > 1, "both").otherwise(F.col("s")).alias("provenance"))


def repoint(linked: DataFrame, merges: DataFrame) -> DataFrame:
    """Links with merged entities replaced by their survivors, each link once. merges: `entity_id`, `survivor`."""
    moved = linked.join(merges, "entity_id", "left")
    rest = [c for c in linked.columns if c != "entity_id"]
    return moved.select(*rest, F.coalesce("survivor", "entity_id").alias("entity_id")).distinct()


def abbreviations(rows: DataFrame, text: str) -> DataFrame:
    """`abbreviation`, `full`, `n`: `Full Name (ABBR)` where the letters are the initials of the words before."""
    found = rows.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(text, F.lit(r"((?:[A-Z][A-Za-z]+\s+){1,7}\([A-Z]{2,8}\))"), 1)).alias("m"))
    parts = found.select(F.regexp_extract("m", r"\(([A-Z]+)\)", 1).alias("abbreviation"), F.split(F.trim(F.regexp_extract("m", r"^([^(]+)", 1)), r"\s+").alias("w"))
    last = parts.select("abbreviation", F.slice("w", F.greatest(F.lit(1), F.size("w") - F.length("abbreviation") + 1), F.length("abbreviation")).alias("w"))
    initials = F.array_join(F.transform("w", lambda w: F.substring(w, 1, 1)), "")
    return last.where(initials == F.col("abbreviation")).select("abbreviation", F.array_join("w", " ").alias("full")).groupBy("abbreviation", "full").agg(F.count("*").alias("n"))


def longest_hits(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, most_words: int = 4) -> DataFrame:
    """`key`, `hit`: the names that a text holds as whole words, without those that another hit of the text contains."""
    words = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: i + n <= F.size("w")), lambda i: F.array_join(F.slice("w", i + 1, n), " "))))
    found = words.select("_k", F.explode(F.array_distinct(runs)).alias("hit")).join(names.select(F.col(name).alias("hit")).distinct(), "hit")
    listed = found.groupBy("_k").agg(F.collect_set("hit").alias("h"))  # the names of one text
    kept = F.filter("h", lambda x: ~F.exists("h", lambda y: (y != x) & y.contains(x)))
    return listed.select(F.col("_k").alias(key), F.explode(kept).alias("hit"))


def canonical(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """`key`, `text`: the normalised words of a text with each alias that `match` finds replaced by its entity's id."""
    found = match(rows, key, text, dictionary).groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("at", F.size(F.split("alias", " ")).alias("n"), "entity_id")).alias("m"))  # spans of one row's text
    words = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), words_of(F.col(text)).alias("w")).join(found, "_k", "left")
    at = lambda i: F.get(F.filter("m", lambda x: (x["at"] <= i) & (i < x["at"] + x["n"])), F.lit(0))
    word = F.transform("w", lambda w, i: F.when(at(i).isNull(), w).when(at(i)["at"] == i, at(i)["entity_id"]))
    return words.select(F.col("_k").alias(key), F.array_join(F.filter(word, lambda w: w.isNotNull()), " ").alias("text"))


def settle(rows: DataFrame, entity: str, name: str, confidence: str, review: str) -> DataFrame:
    """One row an entity: the smallest name that claimed it, the best confidence (high, medium, low) ever given, and a review only if every load asks for one."""
    rank = F.when(F.col(confidence) == "high", 3).when(F.col(confidence) == "medium", 2).when(F.col(confidence) == "low", 1).otherwise(0)
    best = rows.groupBy(entity).agg(F.min(name).alias(name), F.max(rank).alias("_c"), F.bool_and(review).alias(review))
    return best.select(entity, name, F.when(F.col("_c") > 0, F.get(F.lit(["low", "medium", "high"]), F.col("_c") - 1)).alias(confidence), review)


def seeds(values: DataFrame, column: str, kind: str) -> DataFrame:
    """`entity_id`, `kind`, `alias` of a list of known names, each once; blank ones are left out."""
    return build(values.select(column).distinct(), column, kind, F.col(column))
