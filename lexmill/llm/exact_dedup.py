"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Texts are equal when they are identical without their white space (the six characters of
``WS``); the SHA-256 of that normalised text stands for it.  Of equal texts the row with the most
code points in its original text stays, then the one with the smallest id (a null id comes last).

Method: Spark's ``freqItems``, a Misra-Gries counter table that is merged over partitions, names at most
``1 / support`` digests that can be frequent.  A second look counts them exactly, which leaves the
verified ones with their winners; that table has at most ``1 / support`` rows, whatever the input's
size, so it is broadcast, and copies of frequent texts are settled on the map side.
The other digests go through an ordinary shuffle with partial aggregation.

Defined results: null text counts as empty; rows that repeat an id are rows of their own in
``assign`` (exactly one row of a group has ``kept``), and ``dedup`` keeps one of them; an empty table
gives an empty table; texts of any length are read whole, as one digest; ties in length and id go to the least hash of the other columns (``dedup``) or
to the first row read (``assign``); other columns are carried by ``dedup`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WS, stage, text_of, tie_hash

#: A digest is frequent from this share of all rows; bounds the broadcast table to 1 / SUPPORT rows.
SUPPORT = 0.001


def _digest(text):
    return F.unhex(F.sha2(F.translate(text, WS, ""), 256))


def _order(n, doc_id, tie):
    """Sorts a group: its least value is the row that stays."""
    return F.struct((-n).alias("neg_n"), doc_id.isNull().alias("no_id"), doc_id.alias("id"), tie.alias("tie"))


def _winners(digests: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """``digests``: staged rows (digest, ord).  Returns the verified frequent winners (at most
    1 / support rows, staged) and the digests' rows that are left."""
    rows = digests.count()
    if not rows:
        return digests.select("digest", F.lit(1).cast("long").alias("size"), F.col("ord").alias("win")), digests
    found = digests.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).distinct()
    counted = digests.join(F.broadcast(found), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("win"))
    heavy = stage(counted.filter(F.col("size") >= max(2.0, support * rows)), "heavy")
    return heavy, digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_of(df[text_col])
    base = df.select(df[id_col].alias("doc_id"), _digest(text).alias("digest"), F.char_length(text).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    base = stage(base, "digests").select("digest", _order(F.col("n"), F.col("doc_id"), F.col("row")).alias("ord"))
    heavy, light = _winners(base, support)
    frequent = base.join(F.broadcast(heavy), "digest")
    grouped = light.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("win"))
    rare = light.join(grouped, "digest")
    return frequent.unionByName(rare).select(
        F.col("ord.id").alias("doc_id"),
        F.col("win.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("ord.tie") == F.col("win.tie")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Losing copies of frequent texts are removed before the shuffle; what is left is shuffled once by
    its digest, where it meets the winners.
    """
    text = text_of(df[text_col])
    tie = tie_hash(df, text_col)
    key, order = _digest(text), _order(F.char_length(text).cast("long"), df[id_col], tie)
    names = [f"c{i}" for i in range(len(df.columns))]
    base = stage(df.select(key.alias("digest"), order.alias("ord")), "digests")
    heavy, light = _winners(base, support)
    winners = heavy.select("digest", "win").unionByName(light.groupBy("digest").agg(F.min("ord").alias("win")))
    rows = df.select(key.alias("digest"), order.alias("ord"), F.struct(*[df[c].alias(n) for c, n in zip(df.columns, names)]).alias("row"))
    first = rows.join(F.broadcast(heavy.select("digest", F.col("win").alias("hot"))), "digest", "left")
    first = first.filter(F.col("hot").isNull() | (F.col("hot") == F.col("ord"))).drop("hot")
    # grouped by the join's own keys, so that texts aren't shuffled again
    won = winners.select(F.col("digest").alias("won"), "win")
    last = first.join(won, (F.col("digest") == F.col("won")) & (F.col("ord") == F.col("win")))
    one = last.groupBy("won", "win").agg(F.first("row").alias("row"))
    return one.select(*[F.col(f"row.{n}").alias(c) for c, n in zip(df.columns, names)])
