"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate that brings its share of the characters to its target
weight. A hash of (seed, doc_id) is turned into a count by inverting the Poisson distribution of
that mean; the document is repeated so often, and all copies are shuffled by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import given_back, numbered

SEED = 17
#: Sources whose table of rates is broadcast; more are joined by salted keys.
BROADCAST_SOURCES, SALTS = 10_000, 64
#: Largest mean that is inverted at once: exp(-500) is far from underflow. Larger means are sums.
PIECE = 500.0


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float = 1.0) -> DataFrame:
    """(source, rate): rate = weight * total * characters / characters of the source.

    ``weights`` are made to sum to one; None means equal weights. A source that is not named gets
    rate 0; one without characters 1 if its weight is positive. A null source is one of its own.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")).alias("chars"))
    whole = sizes.agg(F.sum("chars").alias("all_chars"), F.count("*").alias("n_sources"))
    both = sizes.crossJoin(F.broadcast(whole))  # one row
    if weights is None:
        weight = 1 / F.col("n_sources")
    else:
        if not weights or min(weights.values()) < 0 or not math.isfinite(sum(weights.values())) or sum(weights.values()) <= 0:
            raise ValueError("weights must be finite, not negative, and not all zero")
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), value / sum(weights.values())).otherwise(weight)
    rate = F.when(F.col("chars") > 0, weight * total * F.col("all_chars") / F.col("chars")).otherwise(F.when(weight > 0, 1.0).otherwise(0.0))
    return both.select("source", rate.cast("double").alias("rate"))


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below the resolution of ``unit``."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")

    def step(s: Column, k: Column) -> Column:
        p = s.p * rate / k
        return F.struct(p.alias("p"), F.concat(s.cdf, F.array(F.element_at(s.cdf, -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s.cdf)


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, total: float = 1.0) -> DataFrame:
    """``docs`` repeated by Poisson counts, with copy (1, 2, ...) and mix_key, in the order of mix_key.

    Rows with one doc_id and source get one count; a null doc_id counts as one id. Null texts have
    no characters. An empty table gives no rows. Input columns named copy or mix_key become
    input_copy and input_mix_key; other columns pass through, whatever their names.
    """
    table = rates(docs, weights, total).withColumn("_pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    table = table.select(F.col("source").alias("_source"), "_pieces", _cdf(F.col("rate") / F.col("_pieces")).alias("_cdf"))
    rows, names = numbered(docs)
    doc_id, source = F.col(names["doc_id"]), F.col(names["source"])
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), source.eqNullSafe(F.col("_source")))
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_at", F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, source.eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))
    draw = lambda j: F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    first = joined.withColumn("_u", unit(F.lit(seed), F.lit(1), doc_id)).withColumn("_n", draw(1))
    more = F.aggregate(F.sequence(F.lit(2), F.col("_pieces")), F.lit(0), lambda n, j: n + F.size(F.filter("_cdf", lambda c: c <= unit(F.lit(seed), j, doc_id))))
    counted = first.withColumn("_n", F.col("_n") + F.when(F.col("_pieces") > 1, more).otherwise(0)).where("_n > 0")
    copies = counted.select(*names.values(), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n").cast("bigint"))).alias("_copy"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("shuffle"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.col("_copy").cast("string")))
    mixed = copies.withColumn("_key", key).orderBy("_key", doc_id, "_copy")
    return mixed.select(*given_back(names, ("copy", "mix_key")), F.col("_copy").alias("copy"), F.col("_key").alias("mix_key"))


#: DuckDB's form of ``replicate`` over documents with equal weights and means up to PIECE.
ORACLE = f"""
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN chars > 0 THEN (1::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) * 1.0E0 * (SELECT sum(chars) FROM sizes)::DOUBLE / chars::DOUBLE ELSE 1.0E0 END AS rate FROM sizes),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1)::DOUBLE, c + p * rate / (k + 1)::DOUBLE FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
drawn AS (SELECT d.*, ('0x' || substr(md5('{SEED}:1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0E0 AS u FROM documents d),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*)::BIGINT AS n
  FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, r.copy::BIGINT AS copy, md5('{SEED}:shuffle:' || coalesce(doc_id::VARCHAR, 'null') || ':' || r.copy::VARCHAR) AS mix_key
FROM counted, unnest(generate_series(1, n)) AS r(copy)
"""
