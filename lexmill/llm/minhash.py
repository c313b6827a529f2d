"""One-permutation MinHash fingerprints (DataFrame functions only).

Words are runs of non-white-space, unchanged; shingles are ``WIDTH`` = 5 consecutive words (a shorter text is one
shingle, an empty one the empty shingle).  Each shingle is hashed once (chained XXH64); the top nine bits name
one of ``BINS`` = 512 bins, and a bin keeps its least hash.  An empty bin is filled by optimal
densification: it probes bins in an order that depends on its own number alone and takes the first that was
not empty; after ``PROBES`` misses it takes the non-empty bin of least priority, which is the same rule
without an end.  The four low bits of each bin, a hex digit, make up the fingerprint (a string of 512 digits).

Likeness of two fingerprints: with a share ``p`` of equal digits, ``(p - 1/16) / (1 - 1/16)``, which takes out the digits
that are equal by chance, cut to 0..1.

Everything about a text happens within its row, so nothing is exploded: the hashes are sorted as an array, and the
first of each bin is kept.

``edited_next`` pairs every document with the next one in descending order of ids.  Only ids and fingerprints are sorted;
texts move once by their key, and of the next text only the prefix that is needed.

Defined results: null text counts as empty; a null id comes last in descending order; rows that repeat
an id come in the order of a hash of their texts, and rows that repeat both share their neighbour; a table
of one row is its own neighbour; an empty table gives an empty table; texts of any length are read whole, within their row; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WS_CLASS, stage, text_of

WIDTH, BINS, BITS, PROBES = 5, 512, 4, 24
_SHIFT = 64 - (BINS.bit_length() - 1)


def probe(bin_: Column, attempt: int) -> Column:
    """The bin that an empty bin looks into at its n-th attempt."""
    return F.pmod(F.xxhash64(bin_, F.lit(attempt)), F.lit(BINS)).cast("int")


def let(value: Column, then) -> Column:
    """Evaluates ``value`` once and hands it on as a lambda variable."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _bin(h: Column) -> Column:
    return F.shiftright(h, _SHIFT) + BINS // 2


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    words = F.array_remove(F.split(text, WS_CLASS + "+"), "")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(many)

    return let(words, hashes)


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """The fingerprint of a text that is not null."""
    def least(s: Column) -> Column:  # of sorted hashes the first of each bin
        return F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)))

    def laid_out(m: Column) -> Column:  # one place for each bin, null if it is empty
        none = F.lit(None).cast("long")
        gaps = F.transform(m, lambda h, i: F.concat(F.array_repeat(none, (_bin(h) - F.coalesce(_bin(F.get(m, i - 1)), F.lit(-1)) - 1).cast("int")), F.array(h)))
        return F.concat(F.flatten(gaps), F.array_repeat(none, (BINS - 1 - _bin(F.element_at(m, -1))).cast("int")))

    def digits(m: Column) -> Column:
        def fill(v: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                rest = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("p"), x.alias("x"))))["x"]
                value = F.coalesce(h, *[F.get(v, probe(i, t)) for t in range(PROBES)], rest)
                return F.hex(value.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))

            return F.array_join(F.transform(v, one), "")

        return let(laid_out(m), fill)

    return F.lower(let(let(F.sort_array(shingle_hashes(text, width)), least), digits))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""
    return packed_likeness(F.unhex(a), F.unhex(b))


def packed_likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints as binary, 16 bins a time."""
    ones = F.lit(0x1111111111111111).cast("long")
    unequal = F.lit(0)
    for k in range(BINS // 16):
        x, y = (F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long") for c in (a, b))
        d = x.bitwiseXOR(y)
        any_ = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        unequal = unequal + F.bit_count(any_.bitwiseAND(ones))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((1 - unequal / float(BINS)) - chance) / (1 - chance)))


def _same(a: str, b: str):
    return F.col(f"{a}_id").eqNullSafe(F.col(f"{b}_id")) & (F.col(f"{a}_h") == F.col(f"{b}_h"))


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys``: distinct (id, h).  Adds (next_id, next_h): the next key in descending order, and the first after the last."""
    up = [F.col("id").asc_nulls_first(), F.col("h").asc()]
    dealt = stage(keys.repartitionByRange(*up).withColumn("part", F.spark_partition_id()), "ranges")
    before = F.lag(F.struct("id", "h")).over(Window.partitionBy("part").orderBy(*up))
    inner = dealt.select("id", "h", "part", before.alias("next"))
    last = dealt.groupBy("part").agg(F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "h")).alias("top")).select("part", F.struct("top.id", "top.h").alias("top"))
    whole = Window.orderBy("part")  # a row for each partition
    edge = last.select("part", F.coalesce(F.lag("top").over(whole), F.last("top").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    out = inner.join(F.broadcast(edge), "part").select("id", "h", F.coalesce("next", "edge").alias("next"))
    return out.select("id", "h", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def edited_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last ``n_chars // 3`` code points replaced by as many of the next document's first."""
    text = text_of(df[text_col])
    docs = df.select(df[id_col].alias("self_id"), F.xxhash64(text).alias("self_h"), text.alias("text"))
    # fingerprints travel packed, half the size of their digits
    prints = stage(docs.select("self_id", "self_h", F.char_length("text").alias("n"), F.unhex(fingerprint(F.col("text"), width)).alias("fp")), "fingerprints")
    keys = prints.groupBy(F.col("self_id").alias("id"), F.col("self_h").alias("h")).agg(F.first("n").alias("n"), F.first("fp").alias("fp"))
    pairs = stage(neighbours(prints.select(F.col("self_id").alias("id"), F.col("self_h").alias("h")).distinct()).select(F.col("id").alias("key_id"), F.col("h").alias("key_h"), "next_id", "next_h"), "neighbours")
    own = keys.select(F.col("id").alias("own_id"), F.col("h").alias("own_h"), "n", "fp")
    other = keys.select(F.col("id").alias("other_id"), F.col("h").alias("other_h"), F.col("fp").alias("next_fp"))
    known = pairs.join(other, _same("next", "other")).join(own, _same("key", "own")).select("key_id", "key_h", "next_id", "next_h", (F.col("n") / 3).cast("int").alias("m"), "n", "fp", packed_likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
    known = stage(known, "pairs")
    # the prefix of every text that the document before it needs
    wanted = docs.join(known.select("key_id", "key_h", "next_id", "next_h", "m"), _same("self", "next"))
    prefix = wanted.select(F.col("key_id").alias("for_id"), F.col("key_h").alias("for_h"), F.substring("text", F.lit(1), F.col("m")).alias("prefix"))
    if not prints.groupBy("self_id", "self_h").count().filter("count > 1").isEmpty():
        prefix = prefix.groupBy("for_id", "for_h").agg(F.first("prefix").alias("prefix"))
    met = docs.join(prefix, _same("self", "for")).join(known.select("key_id", "key_h", "m", "n", "fp", "near_next"), _same("self", "key"))
    edited = met.select("self_id", "n", "fp", "near_next", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("m")), "prefix").alias("edited"))
    out = edited.select("self_id", "n", "fp", "near_next", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), width).alias("edited_fp"))
    return out.select(F.col("self_id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), packed_likeness(F.col("fp"), F.unhex("edited_fp")).alias("near_edited"), "near_next")
