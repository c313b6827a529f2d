"""Mixing sources to target weights (DataFrame functions only).

Each source has a target number of words.  Whole epochs of the source come first; the rest is an
Efraimidis-Spirakis sample: a document's key is ``-ln(u) / quality``, with ``u`` taken from a hash of its
id and a seed (reruns agree), documents are taken in the order of their keys, and the
prefix sum of their sizes is held against the rest of the target.  The document that crosses the target
is taken if that brings the sum nearer to it, so a source misses its target by half a document at most.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words; none gets more than twice its own words, and the excess is shared again by weight, which ends at the
water-filling level ``least(cap, level * weight)``.

Scale: a source can hold a third of all rows, so its rows fall into bins by the distribution function of their keys (a mixture over classes of the
quality weight, about ``sqrt(n)`` bins of equal numbers of rows each, whatever the weights are).  Bin totals are prefix-summed per source; whole
bins are taken up to the one in which the target is reached, and only that bin is sorted.  Only ids and sizes are shuffled, never texts
(``mixed_rows``, which repeats rows, moves each row once).  The targets need an order of all sources: one row a source, in one task.

Defined results: a null text has no words; texts of any length are counted whole; an empty source has target 0; documents with
equal keys come in the order of id and size; a row without an id
shares the key of the other rows without id of its source; rows that repeat an id are rows of their own; an empty table
gives an empty table; other columns, whatever their names, are not read by ``mix`` and are kept by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WS_CLASS, stage, text_of

WEIGHTS, SHARE, CAP, SEED, CLASSES = (5, 2, 1), 1.5, 2, 7, 32

#: Characters that prose rarely has; their share lowers a document's quality weight.
SYMBOLS = "!#$%&*|~^=+<>{}"


def word_count(text: Column) -> Column:
    """Number of words, from the places where one starts."""
    return F.size(F.array_remove(F.split(text, WS_CLASS + "+"), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the share of characters that are not symbols."""
    n = F.char_length(text)
    return F.when(n == 0, F.lit(0.05)).otherwise(F.greatest(F.lit(0.05), 1 - (n - F.char_length(F.translate(text, SYMBOLS, ""))) / n))


def sample_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """``-ln(u) / weight`` with ``u`` from 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: (source, source_size), one row per source.  Adds its target."""
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    marked = sizes.withColumn("__pos", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("__pos") % len(WEIGHTS) + 1).cast("int"))
    marked = marked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * float(CAP))
    rising = Window.orderBy(F.col("__cap") / F.col("__w"), "__pos").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(rising), F.lit(0.0))) / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(rising), F.lit(0.0)))
    marked = marked.withColumn("__level", level)
    free = F.when(F.col("__level") * F.col("__w") < F.col("__cap"), F.col("__level"))
    marked = marked.withColumn("__top", F.max(free).over(everything))
    return marked.select("source", "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__top") * F.col("__w"), F.col("__cap"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, rows_per_bin: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, epochs (and ``carry``).

    ``rows_per_bin``: about how many rows a bin gets; the square root of the source's rows if None."""
    text = text_of(df[text_col])
    kept = [df[c].alias(f"__c_{c}") for c in carry]
    base = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), word_count(text).alias("size"), quality_weight(text).alias("w"), *kept)
    base = stage(base.withColumn("key", sample_key(F.col("doc_id"), F.col("w"), seed)), "sizes")
    same = F.col("source").eqNullSafe(F.col("s"))

    classes = base.groupBy("source", F.floor(F.col("w") * CLASSES).alias("class")).agg(F.avg("w").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    per_source = classes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("class", "w", "n"))).alias("classes"))
    wanted = targets(per_source.select("source", "source_size")).withColumnRenamed("source", "s")
    per_source = per_source.select("source", "n", "classes").join(wanted, same).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    bins = F.ceil(F.sqrt("n") if rows_per_bin is None else F.col("n") / rows_per_bin)
    per_source = stage(per_source.select(F.col("source").alias("s"), "n", "classes", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"), bins.alias("bins")), "targets")

    below = F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + c["n"] * (1 - F.exp(-F.col("key") * c["w"])))  # rows expected below a key
    placed = base.join(per_source, same).withColumn("bin", F.least(F.col("bins") - 1, F.floor(below / F.col("n") * F.col("bins")))).drop("s", "n", "classes", "bins", "w")
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bin").agg(F.sum("size").alias("inside"), F.max("rest").alias("rest")).withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0)))
    crossing = sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("inside") >= F.col("rest"))).select(F.col("source").alias("s"), F.col("bin").alias("cross"), "before")
    crossing = stage(crossing, "crossing")  # one row a source, none where the epochs are all

    met = placed.join(crossing, same, "left")
    clear = met.filter(F.col("cross").isNull() | (F.col("bin") != F.col("cross"))).withColumn("more", (F.col("rest") > 0) & (F.col("size") > 0) & (F.col("cross").isNull() | (F.col("bin") < F.col("cross"))))
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = met.filter(F.col("bin") == F.col("cross")).withColumn("place", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    sorted_ = sorted_.withColumn("more", (F.col("place") + F.col("size") / 2.0 <= F.col("rest")) & (F.col("size") > 0)).drop("place")
    out = clear.unionByName(sorted_).withColumn("epochs", F.col("whole") + F.col("more").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"), "epochs", *[F.col(f"__c_{c}").alias(c) for c in carry])


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken (not at all, once or twice)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(F.coalesce(df[id_col].cast("string"), F.lit("")).alias("__id"), df[id_col].isNull().alias("__none"), F.xxhash64(text_of(df[text_col]), df[source_col]).alias("__h"), F.struct(*[df[c].alias(n) for c, n in zip(df.columns, names)]).alias("row"))
    keyed = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[source_col].alias("source"), F.xxhash64(text_of(df[text_col]), df[source_col]).alias("h"))
    plan = mix(keyed, "id", "text", "source", seed, carry=("h",))
    times = plan.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("epochs")).alias("times")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("t_id"), F.col("doc_id").isNull().alias("t_none"), F.col("h").alias("t_h"), "times")
    # rows that repeat id, text and source share a list of as many numbers
    # plain equalities, so that the join's partitioning serves the window
    met = rows.join(times, (F.col("__id") == F.col("t_id")) & (F.col("__none") == F.col("t_none")) & (F.col("__h") == F.col("t_h")))
    one = F.row_number().over(Window.partitionBy("__h", "__id", "__none").orderBy(F.lit(0)))
    out = met.withColumn("__k", one).select("row", F.explode(F.array_repeat(F.lit(0), F.get("times", F.col("__k") - 1).cast("int"))))
    return out.select(*[F.col(f"row.{n}").alias(c) for c, n in zip(df.columns, names)])
