"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every source has a target of words. Each of its documents is taken as often as the target
covers the whole source; the rest of the target is filled by the documents whose hash lies
below the source's threshold. The threshold is found without sorting documents: words are
summed by source and hash bucket, the bucket that crosses the budget is found from those
sums, and only that bucket is split into finer buckets, level by level, down to one hash
value. Thresholds nest, so a larger target only ever adds documents.

Definitions: a document's size is its number of words (null text: 0). Sources rank by code
point, null last. A source whose share would exceed ``max_repeats`` times its size stops
there and the excess is shared again by weight. The document at the threshold is taken if
that brings the source nearer to its target. Documents hash by their id, so reruns agree;
rows that repeat an id are taken or left together. Documents without words take nothing. Whole
texts are counted, however long. An empty table gives an empty result.

Sources may be as many as hosts: they are ranked by a distributed sort, the level at which shares
settle is found from sums over all of them, and sources that hold many documents are joined apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._shared import WORD, broadcast_if_small, free_name, join_on, save

#: The hash has 60 bits, refined 12 bits at a time.
BITS, STEP = 60, 12


def words(column) -> F.Column:
    """The number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(column) -> F.Column:
    """60 bits of MD5 over an id written as text; null hashes as the empty string."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def source_key(column) -> F.Column:
    """A source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _ranked(sizes: DataFrame, weights) -> DataFrame:
    """``sizes`` with each source's weight, by its place in the order of sources.

    A distributed sort is written with a number that holds the partition and the place in it; the
    partitions' row counts, a row each, turn that into a place among all.
    """
    turned = save(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("turn", F.monotonically_increasing_id()), "mix-order")
    counts = turned.groupBy(F.shiftright("turn", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    starts, upto = [], 0
    for r in counts:
        starts.append((r["part"], upto))
        upto += r["n"]
    offsets = sizes.sparkSession.createDataFrame(starts, "part long, start long")
    placed = turned.join(broadcast_if_small(offsets), F.shiftright("turn", 33) == F.col("part"))
    place = F.col("start") + F.col("turn").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return placed.select("source", "key", "source_size", weight.alias("weight"))


def targets(sizes: DataFrame, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, key, source_size, target) from a saved (source, key, source_size), one row a source.

    What a source's weight asks for at a level is its weight times the level. Sources that reach their
    cap at the level of equal shares stop there; what they leave raises the level, until no other
    reaches its cap. Each round is one sum over all sources.
    """
    named = save(_ranked(sizes, weights).withColumn("cap", F.col("source_size") * max_repeats), "mix-ranked")
    level, full = None, -1
    while True:
        open_ = F.lit(True) if level is None else F.col("cap") > level * F.col("weight")
        row = named.agg(F.sum("source_size").alias("total"), F.sum(F.when(~open_, F.col("cap"))).alias("capped"), F.sum(F.when(open_, F.col("weight"))).alias("rest"), F.count(F.when(~open_, 1)).alias("full")).first()
        if not row["rest"] or row["full"] == full:
            break
        level, full = float(row["total"] - (row["capped"] or 0)) / row["rest"], row["full"]
    level = F.lit(level or 0.0)
    target = F.when(F.col("cap") <= level * F.col("weight"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return named.select("source", "key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per source, a saved (source, key, source_size, target, documents, whole, cut, at_cut); whole: complete passes.

    Documents whose hash is below ``cut`` are taken once more, and those at it if ``at_cut``.
    ``rows`` is a saved (source, key, size, hash).
    """
    sizes = save(rows.groupBy("key").agg(F.any_value("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("documents")), "mix-sources")
    counts = sizes.select("key", F.col("documents").alias("n"))
    goal = save(targets(sizes.select("source", "key", "source_size"), weights, max_repeats), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.select("key", whole.alias("whole"), F.lit(0).cast("long").alias("prefix"), (F.col("target") - whole * F.col("source_size")).alias("left"))
    for down in range(BITS - STEP, -1, -STEP):
        inside = join_on(rows, save(state.select("key", "prefix", "left", "whole"), "mix-state"), "key", counts).where(F.shiftright("hash", down + STEP) == F.col("prefix"))
        sums = inside.groupBy("key", F.shiftright("hash", down).alias("bucket")).agg(F.sum("size").alias("n"), F.first("left").alias("left"), F.first("whole").alias("whole"))
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("bucket"))  # 4096 buckets a source at most
        crossed = sums.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        state = crossed.select("key", "whole", F.col("bucket").alias("prefix"), (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"), "n")
    cut = save(state.select("key", "whole", F.col("prefix").alias("cut"), (F.col("left") * 2 >= F.col("n")).alias("at_cut")), "mix-state")
    out = goal.join(sizes.select("key", "documents"), "key").join(broadcast_if_small(cut), "key", "left")
    return save(out.select("source", "key", "source_size", "target", "documents", F.coalesce("whole", F.lit(0)).alias("whole"), "cut", "at_cut"), "mix-cuts")


def taken(size, hashed) -> F.Column:
    """Words taken of a document, repeats counted, beside its source's threshold columns."""
    extra = (hashed < F.col("cut")) | ((hashed == F.col("cut")) & F.col("at_cut"))
    return size * (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"))


def _sizes(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """A saved (id, source, key, size, hash) of each document."""
    own = F.col(f"`{source}`")
    return save(docs.select(F.col(f"`{id_col}`").alias("id"), own.alias("source"), source_key(own).alias("key"), words(F.col(f"`{text}`")).alias("size"), unit_hash(F.col(f"`{id_col}`")).alias("hash")), "mix-sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every document."""
    rows = _sizes(docs, id_col, text, source)
    cuts = thresholds(rows, weights, max_repeats)
    joined = join_on(rows, cuts.drop("source", "documents"), "key", cuts.select("key", F.col("documents").alias("n")))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", taken(F.col("size"), F.col("hash")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The documents of the mix, all columns kept: each as many times as it is taken."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    cuts = thresholds(_sizes(docs, id_col, text, source), weights, max_repeats)
    key, hashed, whole, cut, at_cut, copies = (free_name(docs, f"mix_{x}") for x in ("key", "hash", "whole", "cut", "at_cut", "copy"))
    full = docs.withColumns({hashed: unit_hash(F.col(f"`{id_col}`")), key: source_key(F.col(f"`{source}`"))})
    own = cuts.select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("cut").alias(cut), F.col("at_cut").alias(at_cut))
    joined = join_on(full, own, key, cuts.select(F.col("key").alias(key), F.col("documents").alias("n")))
    times = F.col(whole) + F.coalesce((F.col(hashed) < F.col(cut)) | ((F.col(hashed) == F.col(cut)) & F.col(at_cut)), F.lit(False)).cast("long")
    picked = joined.withColumn(copies, times).where((F.col(copies) > 0) & (words(F.col(f"`{text}`")) > 0))
    return picked.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*cols)
