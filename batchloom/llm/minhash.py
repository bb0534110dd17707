"""One-permutation MinHash fingerprints, in DataFrame functions only.

Each shingle is hashed once. The hash's top bits name one of ``BINS`` bins, the rest is the value
whose minimum the bin keeps. An empty bin borrows from a non-empty one that a hash of the bin's
number picks (optimal densification: the choice depends on the bin and on which bins are empty,
not on a neighbour). The low ``LOW`` bits of the bins are packed; agreement by chance, 2^-LOW, is
taken out of the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import let

SHINGLE, BINS, LOW, PROBES = 5, 128, 8, 8
VALUE_BITS = 56  # 63 bits less the 7 that name the bin
_SPACE = "[\\x20\\x09-\\x0D]+"
_EMPTY = (1 << VALUE_BITS) - 1


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """A 63-bit hash for each ``width`` words; a shorter text is one shingle, and one without words too."""
    words = F.array_remove(F.split(F.lower(text), _SPACE), "")
    last = lambda w: F.greatest(F.size(w) - width, F.lit(0))
    one = lambda w: lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]).bitwiseAND(F.lit((1 << 63) - 1))
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), last(w)), one(w)))


def _minima(hashes: Column) -> Column:
    """The least value of each bin, null for an empty one: sorted with one sentinel a bin, firsts kept."""
    step = F.lit(1 << VALUE_BITS)
    sentinels = F.sequence(F.lit(_EMPTY), F.lit((1 << 63) - 1), step)
    first = lambda s: lambda x, i: F.coalesce(F.get(s, i - 1).bitwiseXOR(x) >= step, F.lit(True))
    firsts = let(F.sort_array(F.concat(hashes, sentinels)), lambda s: F.filter(s, first(s)))
    return F.transform(firsts, lambda x: F.nullif(x.bitwiseAND(F.lit(_EMPTY)), F.lit(_EMPTY)))


def _densified(minima: Column) -> Column:
    def full(v: Column) -> Column:
        def fill(x: Column, j: Column) -> Column:
            probes = [F.get(v, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            # all probes missed: the non-empty bin of the least hash, the same law without an end
            rest = F.array_min(F.transform(v, lambda y, b: F.when(y.isNotNull(), F.struct(F.xxhash64(j, b, F.lit(PROBES)).alias("p"), y.alias("y")))))
            return F.coalesce(x, *probes, rest.getField("y"))

        return F.transform(v, fill)

    return let(minima, full)


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """``BINS`` bytes: the packed low bits of the densified bins. A null text counts as empty."""
    low = F.transform(_densified(_minima(shingle_hashes(F.coalesce(text, F.lit("")), width))), lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << LOW) - 1))), LOW // 4, "0"))
    return F.unhex(F.array_join(low, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, chance agreement taken out."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), 1).otherwise(0))
    chance = 2.0**-LOW
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance))


def with_next(docs: DataFrame, order: str, columns: list[str], tie: str) -> DataFrame:
    """``docs`` and, as next_<c>, each of ``columns`` of the row that follows in ascending ``order``.

    The last row is followed by the first. Nulls come first; equal keys stand in the order of
    ``tie``. Rows go into ranges of the key, bounded by keys that occur, and each range also gets
    a copy of the first row of the next range, so no task sees more than its range and the rows
    are moved once.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    seen = docs.agg(F.percentile_approx(order, shares, 100 * parts).alias("cuts"), F.min(order).alias("least"), F.count("*").alias("n"), F.count(order).alias("named")).first()
    cuts = sorted(set(seen["cuts"] or []) - {seen["least"]})
    first = None if seen["named"] < seen["n"] else seen["least"]
    key, side = F.col(order), max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))  # noqa: E731  two levels: a key is held against few bounds
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    if rows:
        row = below(longs([r[0] for r in rows]))
        at = F.when(key.isNull() | (row == 0), 0).otherwise((row - 1) * side + below(F.element_at(F.array(*map(longs, rows)), F.greatest(row, F.lit(1)))))
    else:
        at = F.lit(0)
    spot = lambda range_, late: F.struct(range_.cast("int").alias("range"), F.lit(late).alias("late"))
    opens = F.array_contains(longs(cuts), key) if cuts else F.lit(False)
    spots = F.concat(F.array(spot(at, 0)), F.when(F.coalesce(opens, F.lit(False)), F.array(spot(at - 1, 1))).otherwise(F.array().cast("array<struct<range:int,late:int>>")), F.when(key.eqNullSafe(F.lit(first).cast("bigint")), F.array(spot(F.lit(len(cuts)), 2))).otherwise(F.array().cast("array<struct<range:int,late:int>>")))
    placed = docs.withColumn("_spot", F.explode(spots))
    window = Window.partitionBy("_spot.range").orderBy("_spot.late", F.col(order).asc_nulls_first(), tie)
    ahead = placed.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return ahead.where(F.col("_spot.late") == 0).drop("_spot")


def edited_fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row's whole text and of its edited text.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many (or
    all) of the next row's in ascending doc_id. Null texts count as empty. A null doc_id comes
    first, equal ids stand in the order of their texts, a lone row is its own successor and an
    empty table gives no rows. Only doc_id and text are read.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("print", fingerprint(F.col("text"), width))
    ahead = with_next(base, "doc_id", ["text", "print"], "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = ahead.select("doc_id", n.cast("bigint").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    rows = rows.withColumn("edited_print", fingerprint(F.col("edited"), width))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
