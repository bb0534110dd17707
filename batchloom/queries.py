"""One query for each operator over the driver's tables, with its form in DuckDB's SQL.

Random orders come from md5 of (seed, epoch, purpose, key) on both sides, so results are equal row
by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators import metrics as M
from batchloom.operators import transforms as X
from batchloom.operators.aligned import AlignedTable
from batchloom.operators.encode import encode_labels, fit_encoder, task_dimensions
from batchloom.operators.models import linear_logits, multitask_loss, predict, softmax
from batchloom.operators.split import first_n, split_by_group, split_random, split_stratified
from batchloom.operators.strategy import BlockShuffle, ClassBalanced, Sequential, Strategy, Weighted
from batchloom.operators.weights import class_inverse_frequency, class_weights, combination_weights, value_counts, weight_stats
from batchloom.plans.layout import layout, length, rank_and_world, seed_of
from batchloom.plans.ordinal import with_ordinal
from batchloom.plans.tuning import row_bytes, sample_size, suggest_parameters
from batchloom.sources.files import read_results, scan_files, scan_ids, scratch_path, strategy_config, write_results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 7


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return with_ordinal(table(spark, sf_dir, "events").select("event_id", *columns), "event_id")


def out(plan: DataFrame, base: DataFrame, key: str = "event_id", **columns: str) -> DataFrame:
    """Key and named columns of a plan joined to its base."""
    named = {k: F.col(v) for k, v in columns.items()} or {"pos": F.col("_pos")}
    return plan.join(base.select("_idx", key), "_idx").select(key, *[c.alias(n) for n, c in named.items()])


LAYOUT = {"pos": "_pos", "fetch": "_fetch", "lpos": "_lpos", "batch": "_batch", "slot": "_slot", "rank": "_rank", "worker": "_worker"}


# ---- pieces of SQL ----


def h(purpose: str, *keys: str, epoch: int = 0, seed: int = SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', '{epoch}', '{purpose}', {', '.join(f'({k})::VARCHAR' for k in keys)}))"


def u60(purpose: str, key: str) -> str:
    return f"('0x' || substr({h(purpose, key)}, 1, 15))::BIGINT"


E = "ev AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events)"


def blocks(rows: str, b: int, epoch: int = 0) -> str:
    """CTE p (idx, pos) from ``rows`` (idx, s)."""
    return f"""bl AS (SELECT s // {b} AS blk, count(*) AS sz FROM {rows} GROUP BY 1),
pl AS (SELECT blk, sum(sz) OVER (ORDER BY {h('b', 'blk', epoch=epoch)}, blk) - sz AS start FROM bl),
p AS (SELECT r.idx, (pl.start + r.s % {b})::BIGINT AS pos FROM {rows} r JOIN pl ON r.s // {b} = pl.blk)"""


def laid(bs: int, ff: int, order: str = "idx, pos", world: int = 1, workers: int = 1, drop: bool = False) -> str:
    """CTE l from p."""
    f = bs * ff
    mine = f"((nf - ft % {world} + {world - 1}) // {world})"
    q, m, k = f"({mine} // {workers})", f"({mine} % {workers})", f"(ft // {world})"
    cut = f"WHERE lpos < least({f}, n - ft * {f}) - least({f}, n - ft * {f}) % {bs}" if drop else ""
    return f"""l0 AS (SELECT *, pos // {f} AS ft, (SELECT count(*) FROM p) AS n, ((SELECT count(*) FROM p) + {f - 1}) // {f} AS nf FROM p),
l1 AS (SELECT *, row_number() OVER (PARTITION BY ft ORDER BY {order}) - 1 AS lpos FROM l0),
l AS (SELECT idx, pos, ft::BIGINT AS "fetch", lpos::BIGINT AS lpos, (ft * {ff} + lpos // {bs})::BIGINT AS batch, (lpos % {bs})::BIGINT AS slot, (ft % {world})::BIGINT AS rank,
  (CASE WHEN {k} < {m} * ({q} + 1) THEN {k} // ({q} + 1) ELSE {m} + ({k} - {m} * ({q} + 1)) // greatest({q}, 1) END)::BIGINT AS worker FROM l1 {cut})"""


SHUFFLED = h("f", "pos") + ", pos"
POS = "SELECT event_id, pos FROM p JOIN ev USING (idx)"
ROWS = "SELECT event_id, pos, \"fetch\", lpos, batch, slot, rank, worker FROM l JOIN ev USING (idx)"
ALL = "r AS (SELECT idx, idx AS s FROM ev)"
SUB = "r AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS s FROM ev WHERE idx % 3 = 1)"


def third(base: DataFrame) -> DataFrame:
    return base.where(F.col("_idx") % 3 == 1).select("_idx")


def planned(base: DataFrame, s: Strategy, epoch: int = 0) -> DataFrame:
    return s.plan(base, SEED, epoch)


def spread(base: DataFrame, s: Strategy, bs: int, ff: int, epoch: int = 0, **kwargs) -> DataFrame:
    return layout(planned(base, s, epoch), s.length(base), bs, ff, shuffle=s.shuffles_fetch, seed=SEED, epoch=epoch, **kwargs)


# ---- A, B: sources and sinks ----


@query(f"WITH {E}, {ALL}, {blocks('r', 16)}, {laid(64, 4)} SELECT event_id, user_id, event_type, value, \"fetch\", lpos FROM l JOIN ev USING (idx)")
def a1_scan_positional(spark, sf):
    base = events(spark, sf, "user_id", "event_type", "value")
    plan = layout(planned(base, BlockShuffle(16)), BlockShuffle(16).length(base), 64, 4)
    return plan.join(base, "_idx").select("event_id", "user_id", "event_type", "value", F.col("_fetch").alias("fetch"), F.col("_lpos").alias("lpos"))


@query(f"WITH {E}, {ALL}, {blocks('r', 16)}, {laid(64, 4)} SELECT \"fetch\", count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id, max(event_id)::BIGINT AS last_id FROM l JOIN ev USING (idx) GROUP BY 1")
def a2_scan_callback(spark, sf):
    import pandas as pd

    rows = a1_scan_positional(spark, sf).select("fetch", "event_id")
    one = lambda pdf: pd.DataFrame({"fetch": [pdf["fetch"].iloc[0]], "n": [len(pdf)], "first_id": [pdf["event_id"].min()], "last_id": [pdf["event_id"].max()]})
    return X.per_group(rows, "fetch", one, "fetch bigint, n bigint, first_id bigint, last_id bigint")


@query("SELECT c_custkey AS key, c_nationkey AS nation, 0::BIGINT AS source_file FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 1 FROM supplier")
def a4_scan_multi_file(spark, sf):
    both = scan_files(spark, [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"])
    return both.select(F.coalesce("c_custkey", "s_suppkey").alias("key"), F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "source_file")


@query("SELECT doc_id, lang FROM documents")
def a5_scan_columns(spark, sf):
    return scan_files(spark, [f"{sf}/documents.parquet"], ["doc_id", "lang"]).drop("source_file")


@query(f"WITH {E} SELECT event_id, idx::BIGINT AS idx FROM ev WHERE idx >= 10 AND idx < 500 AND (idx - 10) % 7 = 0 UNION ALL SELECT event_id, idx FROM ev JOIN (VALUES (3), (3), (42)) v(i) ON idx = i")
def a6_scan_ids(spark, sf):
    base = events(spark, sf)
    return scan_ids(base, slice(10, 500, 7)).unionByName(scan_ids(base, [3, 3, 42]).select(base.columns)).select("event_id", F.col("_idx").alias("idx"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def a8_b2_results_csv(spark, sf):
    found = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    path = scratch_path(spark, "results")
    write_results(found, path)
    return read_results(spark, path, "event_type string, n bigint, mean_value double")


@query("SELECT event_type, min(event_id)::BIGINT AS first_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def b3_results_json(spark, sf):
    found = table(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
    path = scratch_path(spark, "results")
    write_results(found, path, "json")
    return read_results(spark, path, "event_type string, first_id bigint, n bigint", "json")


@query(f"WITH {E}, {ALL}, {blocks('r', 16)}, {laid(64, 4, SHUFFLED, 2, 2)} SELECT rank, worker, batch, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def b1_sink_batches(spark, sf):
    from batchloom.sources.files import write_shards

    base = events(spark, sf)
    path = scratch_path(spark, "shards")
    write_shards(spread(base, BlockShuffle(16), 64, 4, world_size=2, num_workers=2).join(base, "_idx"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("_rank").cast("bigint").alias("rank"), F.col("_worker").cast("bigint").alias("worker"), F.col("_batch").alias("batch")).agg(F.count("*").alias("n"))


# ---- C: strategies ----


def strategy(name: str, make: Callable[[DataFrame], Strategy], sql: str, columns: tuple[str, ...] = (), epoch: int = 0, n_sql: str = "SELECT count(*) FROM p") -> None:
    def run(spark, sf):
        base = events(spark, sf, *columns)
        return out(planned(base, make(base), epoch), base)

    run.__name__ = name
    query(f"{sql} {POS}")(run)


strategy("c1_seq_scan", lambda b: Sequential(), f"WITH {E}, p AS (SELECT idx, idx::BIGINT AS pos FROM ev)")
strategy("c2_seq_subset", lambda b: Sequential(third(b)), f"WITH {E}, {SUB}, p AS (SELECT idx, s::BIGINT AS pos FROM r)")
strategy("c2_seq_repeats", lambda b: Sequential([5, 5, 9, 12]), f"WITH {E}, p AS (SELECT * FROM (VALUES (5, 0::BIGINT), (5, 1), (9, 2), (12, 3)) v(idx, pos))")
strategy("c4_block_shuffle", lambda b: BlockShuffle(24), f"WITH {E}, {ALL}, {blocks('r', 24)}")
strategy("c4_block_subset", lambda b: BlockShuffle(10, third(b)), f"WITH {E}, {SUB}, {blocks('r', 10)}")
strategy("c6_random_shuffle", lambda b: BlockShuffle(1), f"WITH {E}, {ALL}, {blocks('r', 1)}")
strategy("d9_epoch_shuffle", lambda b: BlockShuffle(24), f"WITH {E}, {ALL}, {blocks('r', 24, epoch=3)}", epoch=3)
_DROP = f"""r0 AS (SELECT idx, s, row_number() OVER (ORDER BY {h('d', 's')}, s) - 1 AS o, (SELECT count(*) FROM q) AS n FROM q),
r AS (SELECT idx, row_number() OVER (ORDER BY s) - 1 AS s FROM r0 WHERE o >= n % 17)"""
strategy("c5_block_shuffle_drop", lambda b: BlockShuffle(17, third(b), drop_last=True), f"WITH {E}, {SUB.replace('r AS', 'q AS', 1)}, {_DROP}, {blocks('r', 17)}")


@query(f"WITH {E}, p AS (SELECT idx, idx AS pos FROM ev), {laid(32, 4, SHUFFLED)} {ROWS}")
def c3_seq_buffer_shuffle(spark, sf):
    base = events(spark, sf)
    return out(spread(base, Sequential(shuffle=True), 32, 4), base, **LAYOUT)


SCALE = 1 << 40


def cdf(rows: str, total: str) -> str:
    """CTE r (idx, s): draws from ``rows`` (idx, w), ranked. The weights become whole numbers in proportion to the greatest."""
    bits = f"greatest(12, least(40, 50 - length(bin((SELECT count(*) FROM {rows})))))"
    return f"""m AS (SELECT idx, greatest(floor(w / (SELECT max(w) FROM {rows}) * pow(2, {bits})::DOUBLE), 1)::BIGINT AS m FROM {rows} WHERE w > 0),
c AS (SELECT idx, m, (sum(m) OVER (ORDER BY idx))::BIGINT - m AS lo FROM m),
d AS (SELECT i AS draw, {u60('w', 'i')} % (SELECT sum(m)::BIGINT FROM m) AS u FROM range({total}) x(i)),
r AS (SELECT idx, row_number() OVER (ORDER BY idx, draw) - 1 AS s FROM (SELECT c.idx, d.draw FROM d ASOF JOIN c ON d.u >= c.lo) z)"""


WT = "w AS (SELECT idx, (1 + idx % 5)::DOUBLE AS w FROM ev)"


def _weight(base: DataFrame):
    return (1 + F.col("_idx") % 5).cast("double")


strategy("c7_weighted_replace", lambda b: Weighted(8, weights=_weight(b)), f"WITH {E}, {WT}, {cdf('w', '(SELECT count(*) FROM ev)')}, {blocks('r', 8)}")
strategy("c7_weighted_total", lambda b: Weighted(8, weights=_weight(b), total_size=777), f"WITH {E}, {WT}, {cdf('w', '777')}, {blocks('r', 8)}")
strategy("c9_weighted_subset_local", lambda b: Weighted(16, third(b), weights=third(b).withColumn("w", _weight(b))), f"WITH {E}, w AS (SELECT idx, (1 + idx % 5)::DOUBLE AS w FROM ev WHERE idx % 3 = 1), {cdf('w', '(SELECT count(*) FROM w)')}, {blocks('r', 16)}")
strategy("c10_weighted_subset_global", lambda b: Weighted(16, third(b), weights=_weight(b)), f"WITH {E}, w AS (SELECT idx, (1 + idx % 5)::DOUBLE AS w FROM ev WHERE idx % 3 = 1), {cdf('w', '(SELECT count(*) FROM w)')}, {blocks('r', 16)}")


def _round(r: int, k: int) -> str:
    u = f"(('0x' || substr({h(f'r{r}', 'idx')}, 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE"
    return f"(SELECT idx, {r} AS draw FROM w WHERE w > 0 ORDER BY -ln({u}) / w, idx LIMIT {k})"


strategy("c8_weighted_rounds", lambda b: Weighted(8, weights=_weight(b), total_size=250, replace=False, sampling_size=100), f"WITH {E}, {WT}, dr AS ({' UNION ALL '.join(_round(r, k) for r, k in enumerate((100, 100, 50)))}), r AS (SELECT idx, row_number() OVER (ORDER BY idx, draw) - 1 AS s FROM dr), {blocks('r', 8)}")


def _classes(chosen: str, mass: str, total: str) -> str:
    return f"""ch AS ({chosen}), cl AS (SELECT g, n, {mass} AS m FROM (SELECT g, count(*) AS n FROM ch GROUP BY 1) x),
cc AS (SELECT g, n, (sum(m) OVER (ORDER BY g))::BIGINT - m AS lo, m FROM cl),
d AS (SELECT i AS draw, {u60('g', 'i')} % (SELECT sum(m)::BIGINT FROM cl) AS u, {u60('m', 'i')} AS v FROM range({total}) x(i)),
rn AS (SELECT idx, g, row_number() OVER (PARTITION BY g ORDER BY idx) - 1 AS k FROM ch),
dd AS (SELECT d.draw, cc.g, d.v % cc.n AS k FROM d ASOF JOIN cc ON d.u >= cc.lo),
r AS (SELECT idx, row_number() OVER (ORDER BY idx, draw) - 1 AS s FROM dd JOIN rn USING (g, k))"""


_UNEVEN = "CASE WHEN event_id % 10 < 7 THEN 'A' WHEN event_id % 10 < 9 THEN 'B' ELSE 'C' END"


def uneven(b: DataFrame) -> DataFrame:
    return b.withColumn("g", F.when(F.col("event_id") % 10 < 7, "A").when(F.col("event_id") % 10 < 9, "B").otherwise("C"))


def balanced(name: str, make, sql: str) -> None:
    def run(spark, sf):
        base = uneven(events(spark, sf))
        return out(planned(base, make(base)), base)

    run.__name__ = name
    query(f"WITH {E}, {sql}, {blocks('r', 8)} {POS}")(run)


balanced("c11_class_balanced", lambda b: ClassBalanced("g", 8), _classes(f"SELECT idx, {_UNEVEN} AS g FROM ev", f"{SCALE}::BIGINT", "(SELECT count(*) FROM ev)"))
balanced("c12_class_balanced_local", lambda b: ClassBalanced("g", 8, third(b), 900), _classes(f"SELECT idx, {_UNEVEN} AS g FROM ev WHERE idx % 3 = 1 ", f"{SCALE}::BIGINT", "900"))
balanced("c13_class_balanced_global", lambda b: ClassBalanced("g", 8, b.where("_idx % 20 < 10 OR g = 'C'").select("_idx"), 900, scope="global"), _classes(f"SELECT idx, {_UNEVEN} AS g FROM ev WHERE idx % 20 < 10 OR {_UNEVEN} = 'C'", f"floor({SCALE}::DOUBLE * n / (SELECT count(*) FROM ev WHERE {_UNEVEN} = g))::BIGINT", "900"))


@query("SELECT (SELECT count(*) FROM events)::BIGINT AS seq, (SELECT count(*) FILTER (event_id % 3 = 1) FROM events)::BIGINT AS subset, ((SELECT count(*) FROM events) // 17 * 17)::BIGINT AS dropped, 777::BIGINT AS weighted")
def c14_strategy_len(spark, sf):
    base = events(spark, sf)
    some = base.where(F.col("event_id") % 3 == 1).select("_idx")
    row = (Sequential().length(base), Sequential(some).length(base), BlockShuffle(17, drop_last=True).length(base), Weighted(total_size=777).length(base))
    return spark.createDataFrame([row], "seq bigint, subset bigint, dropped bigint, weighted bigint")


class Reversed(Strategy):
    """A user's strategy: the collection backwards."""

    def plan(self, base, seed=0, epoch=0):
        n = self.length(base)
        return self.ranked(base).select("_idx", (F.lit(n) - 1 - F.col("_s")).alias("_pos"))


strategy("c15_custom_strategy", lambda b: Reversed(), f"WITH {E}, p AS (SELECT idx, ((SELECT count(*) FROM ev) - 1 - idx)::BIGINT AS pos FROM ev)")

_COMBO = """n AS (SELECT count(*)::DOUBLE AS n FROM orders), k AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS c, 1.0E0 / (count(*) + 1000.0E0) AS raw FROM orders GROUP BY ALL),
cw AS (SELECT a, b, c, raw * (SELECT sum(c) FROM k)::DOUBLE / (SELECT sum(c * raw) FROM k) AS w FROM k)"""


@query(f"WITH {_COMBO} SELECT o_orderkey, round(w, 6) AS weight FROM orders JOIN cw ON a = o_orderpriority AND b = o_orderstatus")
def f2_combo_weights(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return combination_weights(rows, "o_orderpriority", "o_orderstatus").select("o_orderkey", F.round("weight", 6).alias("weight"))


@query(
    f"WITH ev AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders), {_COMBO}, w AS (SELECT idx, round(w * 1000) / 1000 AS w FROM ev JOIN cw ON a = o_orderpriority AND b = o_orderstatus), {cdf('w', '5000')}, {blocks('r', 16)} SELECT o_orderkey, pos FROM p JOIN ev USING (idx)"
)
def c16_combo_weighted(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    base = with_ordinal(combination_weights(rows, "o_orderpriority", "o_orderstatus"), "o_orderkey")
    # thousandths: the two engines' weights may differ in the last bit
    return out(planned(base, Weighted(16, weights=F.round(F.col("weight") * 1000) / 1000, total_size=5000)), base, "o_orderkey")


# ---- D: layout ----


def laid_query(name: str, make: Callable[[DataFrame], Strategy], plan_sql: str, bs: int, ff: int, order: str, **kwargs) -> None:
    def run(spark, sf):
        base = events(spark, sf)
        return out(spread(base, make(base), bs, ff, **kwargs), base, **LAYOUT)

    run.__name__ = name
    sql = laid(bs, ff, order, kwargs.get("world_size", 1), kwargs.get("num_workers", 1), kwargs.get("drop_last", False))
    query(f"WITH {E}, {plan_sql}, {sql} {ROWS}")(run)


_SEQ = "p AS (SELECT idx, idx AS pos FROM ev)"
laid_query("d1_fetch_assign", lambda b: Sequential(), _SEQ, 64, 16, "idx, pos")
laid_query("d3_fetch_shuffle", lambda b: BlockShuffle(24), f"{ALL}, {blocks('r', 24)}", 32, 4, SHUFFLED)
laid_query("d5_batch_drop_last", lambda b: BlockShuffle(24), f"{ALL}, {blocks('r', 24)}", 48, 4, SHUFFLED, drop_last=True)
laid_query("d6_d7_shard", lambda b: BlockShuffle(16), f"{ALL}, {blocks('r', 16)}", 32, 2, SHUFFLED, world_size=3, num_workers=4)
laid_query("d13_single_loader", lambda b: BlockShuffle(16), f"{ALL}, {blocks('r', 16)}", 64, 8, SHUFFLED, world_size=1, num_workers=3)


@query(f"WITH {E}, {ALL}, {blocks('r', 24)}, {laid(32, 4)} SELECT event_id, \"fetch\", lpos, batch, slot FROM l JOIN ev USING (idx)")
def d2_d4_fetch_sort(spark, sf):
    base = events(spark, sf)
    s = BlockShuffle(24)
    plan = layout(planned(base, s), s.length(base), 32, 4)
    return out(plan, base, fetch="_fetch", lpos="_lpos", batch="_batch", slot="_slot")


@query(f"WITH {E}, {_SEQ}, {laid(48, 4, 'idx, pos', 3)} SELECT rank, count(DISTINCT batch)::BIGINT AS n_batches FROM l GROUP BY 1")
def d8_len_batches(spark, sf):
    n = table(spark, sf, "events").count()
    return spark.createDataFrame([(r, length(n, 48, 4, rank=r, world_size=3)) for r in range(3)], "rank bigint, n_batches bigint")


@query(f"WITH {E}, {ALL}, {blocks('r', 24, epoch=2)}, {laid(32, 4, h('f', 'pos', epoch=2) + ', pos')} SELECT event_id, batch, slot FROM l JOIN ev USING (idx)")
def d12_resume_epoch(spark, sf):
    base = events(spark, sf)
    return out(spread(base, BlockShuffle(24), 32, 4, epoch=2), base, batch="_batch", slot="_slot")


@query(f"WITH {E}, {ALL}, {blocks('r', 24).replace("'7'", "'20260101'")} {POS}")
def d10_seed_init(spark, sf):
    """A given seed is used as it is (without one, one is chosen on the driver for all ranks)."""
    base = events(spark, sf)
    return out(BlockShuffle(24).plan(base, seed_of(20260101)), base)


@query("SELECT r.r::BIGINT AS rank, 3::BIGINT AS world_size FROM range(3) r(r) UNION ALL SELECT 0, 1")
def d11_ddp_detect(spark, sf):
    """Rank and world size as given; without a process group rank 0 of 1."""
    return spark.createDataFrame([*(rank_and_world(r, 3) for r in range(3)), rank_and_world()], "rank bigint, world_size bigint")


@query("SELECT * FROM (VALUES ('batch_size', 128), ('block_size', 16), ('epochs', 2), ('seed', 42)) v(name, value)")
def a7_i6_config(spark, sf):
    """Command line over file over defaults; an override of the block size beats the strategy's own."""
    merged = strategy_config({"batch_size": 128, "seed": None}, {"batch_size": 64, "seed": 42}, {"epochs": 2, "batch_size": 32}, {"block_size": 16})
    return spark.createDataFrame(sorted(merged.items()), "name string, value int")


# ---- E: transforms ----


def vectors(spark, sf):
    return with_ordinal(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")


@query("SELECT vec_id, label, embedding[1] AS x0, embedding[64] AS x63 FROM embeddings")
def e5_to_aligned(spark, sf):
    base = vectors(spark, sf)
    both = AlignedTable(x=base.select("_idx", "vec_id", "embedding"), obs=base.select("_idx", "label"))
    wide = both.rows(F.col("_idx") >= 0).wide()
    return wide.select("x.vec_id", "obs.label", F.get("x.embedding", F.lit(0)).alias("x0"), F.get("x.embedding", F.lit(63)).alias("x63"))


_SPARSE = "s AS (SELECT l_orderkey, l_linenumber AS id, sum(l_quantity)::FLOAT AS v FROM lineitem GROUP BY ALL)"


def sparse(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("float").alias("v"))
    rows = sums.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "v"))).alias("e"))
    return rows.select("l_orderkey", F.col("e.l_linenumber").alias("ids"), F.col("e.v").alias("vs"))


@query(f"WITH {_SPARSE}, g AS (SELECT l_orderkey, i, coalesce(max(v) FILTER (id = i), 0)::FLOAT AS v FROM s, range(0, 10) t(i) GROUP BY ALL) SELECT l_orderkey, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY i) AS x FROM g GROUP BY 1")
def e6_sparse_to_dense(spark, sf):
    dense = sparse(spark, sf).select("l_orderkey", X.sparse_to_dense("ids", "vs", 10).alias("x"))
    return dense.select("l_orderkey", F.array_join(F.transform("x", lambda v: v.cast("bigint").cast("string")), ",").alias("x"))


@query(f"WITH {_SPARSE}, g AS (SELECT l_orderkey, i, coalesce(max(v) FILTER (id = i), 0)::FLOAT AS v FROM s, range(0, 10) t(i) GROUP BY ALL) SELECT l_orderkey, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY i) AS x FROM g GROUP BY 1")
def e6_densify_wide(spark, sf):
    dense = X.densify(sparse(spark, sf), "ids", "vs", 10)
    return dense.select("l_orderkey", F.array_join(F.transform("x", lambda v: v.cast("bigint").cast("string")), ",").alias("x"))


@query(f"WITH {E}, {ALL}, {blocks('r', 16)}, {laid(64, 4, SHUFFLED)} SELECT event_id, round((value - avg(value) OVER (PARTITION BY batch)) / stddev_pop(value) OVER (PARTITION BY batch), 6) AS z FROM l JOIN ev USING (idx)")
def e7_normalize_batch(spark, sf):
    base = events(spark, sf, "value")
    rows = spread(base, BlockShuffle(16), 64, 4).join(base, "_idx")
    return rows.select("event_id", F.round(X.normalise_batch("value"), 6).alias("z"))


def _features(std: str) -> str:
    return f"""WITH b AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch, embedding FROM embeddings),
f AS (SELECT vec_id, batch, i, embedding[i + 1]::DOUBLE AS x FROM b, range(0, 64) t(i)),
z AS (SELECT vec_id, i, (x - avg(x) OVER w) / (coalesce({std}(x) OVER w, 0) + 1e-8) AS z FROM f WINDOW w AS (PARTITION BY batch, i))
SELECT vec_id, round(max(z) FILTER (i = 0), 5) AS z0, round(max(z) FILTER (i = 63), 5) AS z63, round(sum(z * z), 4) AS energy FROM z GROUP BY 1"""


def _standardised(spark, sf, sample):
    rows = vectors(spark, sf).withColumn("_batch", F.floor(F.col("_idx") / 32)).withColumn("embedding", F.col("embedding").cast("array<double>"))
    done = X.standardise_features(rows, "embedding", sample=sample)
    energy = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return done.select("vec_id", F.round(F.get("embedding", F.lit(0)), 5).alias("z0"), F.round(F.get("embedding", F.lit(63)), 5).alias("z63"), F.round(energy, 4).alias("energy"))


@query(_features("stddev_pop"))
def e8_standardize_features(spark, sf):
    return _standardised(spark, sf, False)


@query(_features("stddev_samp"))
def e8_standardize_features_sample(spark, sf):
    return _standardised(spark, sf, True)


@query("SELECT vec_id, round(ln(1 + abs(embedding[1]::DOUBLE)), 9) AS y0, round(ln(1 + abs(embedding[64]::DOUBLE)), 9) AS y63 FROM embeddings")
def e9_log1p(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("x"))
    y = rows.select("vec_id", X.log1p("x").alias("y"))
    return y.select("vec_id", F.round(F.get("y", F.lit(0)), 9).alias("y0"), F.round(F.get("y", F.lit(63)), 9).alias("y63"))


@query("SELECT vec_id, round((embedding[1]::DOUBLE - m) / (s + 1e-8), 6) AS z0, round((embedding[64]::DOUBLE - m) / (s + 1e-8), 6) AS z63 FROM (SELECT e.vec_id, any_value(e.embedding) AS embedding, avg(x::DOUBLE) AS m, stddev_samp(x::DOUBLE) AS s FROM embeddings e, unnest(e.embedding) t(x) GROUP BY 1) y")
def e10_normalize_sample(spark, sf):
    z = table(spark, sf, "embeddings").select("vec_id", X.normalise_sample("embedding").alias("z"))
    return z.select("vec_id", F.round(F.get("z", F.lit(0)), 6).alias("z0"), F.round(F.get("z", F.lit(63)), 6).alias("z63"))


@query(f"SELECT vec_id, sum(CASE WHEN (('0x' || substr({h('p', 'vec_id', 'i')}, 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE > 0.25 THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM embeddings, range(0, 64) t(i) GROUP BY 1")
def e11_augment_dropout(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.lit(1.0)).alias("x"))
    kept = rows.select("vec_id", X.dropout("x", 0.25, SEED, "vec_id").alias("x"))
    return kept.select("vec_id", F.aggregate("x", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_kept"))


@query(f"SELECT vec_id, round(embedding[1]::DOUBLE + 0.1 * sqrt(-2 * ln((('0x' || substr({h('n1', 'vec_id', '0')}, 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE)) * cos(2 * pi() * ((('0x' || substr({h('n2', 'vec_id', '0')}, 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE)), 7) AS x0 FROM embeddings")
def e11_augment_noise(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return rows.select("vec_id", X.noise("x", 0.1, SEED, "vec_id").alias("x")).select("vec_id", F.round(F.get("x", F.lit(0)), 7).alias("x0"))


@query(f"WITH {E}, {_SEQ}, {laid(32, 4)} SELECT batch, string_agg(event_id::VARCHAR, ',' ORDER BY slot) AS ids, count(*)::BIGINT AS n FROM l JOIN ev USING (idx) GROUP BY 1")
def e12_collate(spark, sf):
    base = events(spark, sf, "event_type")
    lists = X.collate(spread(base, Sequential(), 32, 4).join(base, "_idx"), "event_id", "event_type")
    return lists.select(F.col("_batch").alias("batch"), F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("ids"), F.size("event_type").cast("bigint").alias("n"))


@query("SELECT event_id, (value::FLOAT * 2 + 1)::FLOAT AS y FROM events")
def e13_cast_float32(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("value").cast("float") * F.lit(2.0).cast("float") + F.lit(1.0).cast("float")).alias("y"))


@query(f"WITH {E}, {_SEQ}, {laid(32, 4)} SELECT batch, sum(2 * idx + 1)::BIGINT AS total FROM l GROUP BY 1")
def e1_e4_hooks(spark, sf):
    base = events(spark, sf)
    rows = spread(base, Sequential(), 32, 4).select("_fetch", "_lpos", "_batch", "_slot", F.col("_idx").alias("x"))
    schema = "_fetch bigint, _lpos bigint, _batch bigint, _slot bigint, x bigint"
    done = X.hooks(rows, fetch_transform=(lambda p: p.assign(x=p["x"] * 2), schema), batch_transform=(lambda p: p.assign(x=p["x"] + 1), schema))
    return done.groupBy(F.col("_batch").alias("batch")).agg(F.sum("x").alias("total"))


@query(f"WITH {E}, {_SEQ}, {laid(32, 4)} SELECT batch, count(*)::BIGINT AS n, sum(idx * (slot + 1))::BIGINT AS checksum FROM l GROUP BY 1")
def e2_batch_callback(spark, sf):
    """A user function of each batch's rows in the order of their slots."""
    rows = spread(events(spark, sf), Sequential(), 32, 4).select("_batch", "_slot", F.col("_idx").alias("x"))

    def summed(p):
        return p.iloc[:1][["_batch"]].assign(n=len(p), checksum=int((p["x"] * (p["_slot"] + 1)).sum()))

    return X.hooks(rows, batch_callback=(summed, "_batch bigint, n bigint, checksum bigint")).withColumnRenamed("_batch", "batch")


# ---- F: weights, encoders, metrics ----


@query("SELECT doc_id, 1.0E0 / count(*) OVER (PARTITION BY quality) AS weight FROM labels")
def f1_class_inv_freq(spark, sf):
    return class_inverse_frequency(table(spark, sf, "labels"), "quality").select("doc_id", "weight")


@query("WITH c AS (SELECT quality, count(*) AS c FROM labels GROUP BY 1) SELECT doc_id, round((SELECT sum(c) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * c.c), 9) AS weight FROM labels JOIN c USING (quality)")
def f3_class_weights(spark, sf):
    return class_weights(table(spark, sf, "labels"), "quality").select("doc_id", F.round("weight", 9).alias("weight"))


@query(f"WITH {_COMBO}, w AS (SELECT w FROM orders JOIN cw ON a = o_orderpriority AND b = o_orderstatus) SELECT round(min(w), 6) AS min_weight, round(max(w), 6) AS max_weight, round(avg(w), 6) AS mean_weight FROM w")
def f4_weight_stats(spark, sf):
    stats = weight_stats(combination_weights(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


@query("SELECT event_type, count(*)::BIGINT AS count, (row_number() OVER (ORDER BY event_type) - 1)::BIGINT AS code FROM events GROUP BY 1")
def f5_value_counts(spark, sf):
    return value_counts(table(spark, sf, "events"), "event_type")


@query("SELECT c_custkey, n_name AS nation, n_regionkey AS region_id, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def f6_label_encode(spark, sf):
    t = lambda n: table(spark, sf, n)
    maps = [("c_nationkey", t("nation"), "n_nationkey", "n_name", "nation"), ("c_nationkey", t("nation"), "n_nationkey", "n_regionkey", "region_id"), ("region_id", t("region"), "r_regionkey", "r_name", "region")]
    return encode_labels(t("customer"), maps).select("c_custkey", "nation", "region_id", "region")


@query("SELECT (SELECT count(DISTINCT n_name) FROM nation)::BIGINT AS nations, (SELECT count(DISTINCT r_name) FROM region)::BIGINT AS regions, (SELECT count(DISTINCT p_type) FROM part)::BIGINT AS types")
def f7_task_dims(spark, sf):
    t = lambda n: table(spark, sf, n)
    return task_dimensions(nations=(t("nation"), "n_name"), regions=(t("region"), "r_name"), types=(t("part"), "p_type"))


@query("SELECT p_type, (row_number() OVER (ORDER BY p_type) - 1)::BIGINT AS code FROM (SELECT DISTINCT p_type FROM part) x")
def f8_fit_label_encoder(spark, sf):
    return fit_encoder(table(spark, sf, "part"), "p_type")


TYPED = "ev AS (SELECT *, row_number() OVER (ORDER BY event_type, event_id) - 1 AS idx FROM events)"


def _entropy(b: int, ff: int) -> tuple[Query, str]:
    def run(spark, sf):
        base = with_ordinal(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id")
        rows = spread(base, BlockShuffle(b), 32, ff).join(base, "_idx")
        found = M.entropy_summary(rows, "event_type")
        return found.select(F.round("avg_batch_entropy", 6).alias("avg_batch_entropy"), F.round("std_batch_entropy", 6).alias("std_batch_entropy"), "n_batches")

    sql = f"""WITH {TYPED}, {ALL}, {blocks('r', b)}, {laid(32, ff, SHUFFLED)}, c AS (SELECT batch, event_type, count(*) AS c FROM l JOIN ev USING (idx) GROUP BY ALL),
e AS (SELECT batch, sum(c) AS n, abs(log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS h FROM c GROUP BY 1 HAVING sum(c) > 1)
SELECT round(avg(h), 6) AS avg_batch_entropy, round(stddev_pop(h), 6) AS std_batch_entropy, count(*)::BIGINT AS n_batches FROM e"""
    return run, sql


for _b, _ff in ((1, 4), (24, 4), (64, 16), (256, 1)):
    _run, _sql = _entropy(_b, _ff)
    _run.__name__ = f"f9_entropy_b{_b}_ff{_ff}"
    query(_sql)(_run)

_PRED = "pr AS (SELECT toxic AS t, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 11 = 0 THEN 2 ELSE 0 END AS p FROM labels)"


def predicted(spark, sf):
    guess = F.when(F.col("doc_id") % 7 == 0, 1).when(F.col("doc_id") % 11 == 0, 2).otherwise(0)
    return table(spark, sf, "labels").select(F.col("toxic").alias("t"), guess.alias("p"))


@query(f"WITH {_PRED} SELECT round(avg((t = p)::INT), 9) AS accuracy FROM pr")
def f11_accuracy(spark, sf):
    return predicted(spark, sf).agg(F.round(M.accuracy(predicted(spark, sf), "t", "p"), 9).alias("accuracy"))


@query(
    f"WITH {_PRED}, c AS (SELECT DISTINCT t AS c FROM pr UNION SELECT DISTINCT p FROM pr), s AS (SELECT c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (p = c) AS pp, count(*) FILTER (t = c) AS sup FROM c, pr GROUP BY 1), f AS (SELECT *, CASE WHEN pp + sup > 0 THEN 2.0E0 * tp / (pp + sup) ELSE 0 END AS f1 FROM s) SELECT round(sum(tp) / sum(sup), 9) AS accuracy, round(avg(f1), 9) AS f1_macro, round(sum(f1 * sup) / sum(sup), 9) AS f1_weighted FROM f"
)
def f12_f1(spark, sf):
    scores = M.f1_scores(predicted(spark, sf), "t", "p")
    return scores.select(*[F.round(c, 9).alias(c) for c in scores.columns])


def run_results(spark, sf):
    """A long table of results: priorities are methods, statuses tasks, years runs."""
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("task"), F.year("o_orderdate").alias("run")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


_RUNS = "runs AS (SELECT o_orderpriority AS method, o_orderstatus AS task, year(o_orderdate) AS run, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY ALL)"


@query(f"WITH {_RUNS} SELECT task, method, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, count(*)::BIGINT AS n_runs FROM runs GROUP BY ALL")
def f13_multi_run_summary(spark, sf):
    found = M.run_summary(run_results(spark, sf), "task", "method")
    return found.select("task", "method", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n_runs")


@query(f"WITH {_RUNS}, s AS (SELECT task, method, round(avg(value), 4) AS v FROM runs GROUP BY ALL) SELECT method, max(v) FILTER (task = 'F') AS F, max(v) FILTER (task = 'O') AS O, max(v) FILTER (task = 'P') AS P FROM s GROUP BY 1")
def f14_pivot_results(spark, sf):
    return M.pivot_results(f13_multi_run_summary(spark, sf), "method", "task", "mean", ["F", "O", "P"])


@query(f"WITH {_RUNS}, s AS (SELECT task, method, round(avg(value), 4) AS mean FROM runs GROUP BY ALL) SELECT task, method, mean FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY mean DESC, method) = 1")
def f15_best_per_task(spark, sf):
    return M.best_per_task(f13_multi_run_summary(spark, sf).select("task", "method", "mean"), "task", "method", "mean")


@query(f"WITH {_RUNS}, s AS (SELECT task, method, round(avg(value), 4) AS v FROM runs GROUP BY ALL) SELECT method, task, coalesce(max(v), 0) AS value FROM (SELECT m.method, t.task, s.v FROM (SELECT DISTINCT method FROM s) m CROSS JOIN (VALUES ('F'), ('O'), ('P')) t(task) LEFT JOIN s ON s.method = m.method AND s.task = t.task) x GROUP BY ALL")
def f16_melt_metrics(spark, sf):
    return M.melt(f14_pivot_results(spark, sf), ["method"], ["F", "O", "P"], "task", "value")


@query("SELECT event_type, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS elapsed FROM events GROUP BY 1")
def f17_time_comparison(spark, sf):
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("event_type").agg((F.max(ts) - F.min(ts)).cast("bigint").alias("elapsed"))


@query("SELECT round(greatest(min(value) - (max(value) - min(value)) * 0.05, 0), 6) AS axis_low, round(least(max(value) + (max(value) - min(value)) * 0.05, 100), 6) AS axis_high FROM events")
def f18_axis_limits(spark, sf):
    found = M.axis_limits(table(spark, sf, "events"), "value", high=100.0)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# ---- G: subsets ----


@query("SELECT doc_id, quality, 2 * doc_id < (SELECT max(doc_id) FROM documents) AS is_train FROM documents JOIN labels USING (doc_id)")
def g1_split_subset(spark, sf):
    """Both halves of a split by position, labelled."""
    docs = table(spark, sf, "documents").select("doc_id")
    last = docs.agg(F.max("doc_id")).first()[0]
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").withColumn("is_train", 2 * F.col("doc_id") < F.lit(last))


@query("SELECT doc_id, lang, source FROM documents")
def g5_project_obs(spark, sf):
    """The observation columns alone: the scan reads no text."""
    return scan_files(spark, [f"{sf}/documents.parquet"], ["doc_id", "lang", "source"]).select("doc_id", "lang", "source")


@query(f"WITH {E} SELECT event_id, (row_number() OVER (ORDER BY {h('o', 'idx')}, idx) * 0 + row_number() OVER (ORDER BY idx) - 1)::BIGINT AS pos FROM ev WHERE idx % 7 < 3")
def g7_sort_indices(spark, sf):
    """Ids given in a random order are used in ascending order."""
    base = events(spark, sf)
    ids = base.where(F.col("_idx") % 7 < 3).select("_idx").orderBy(F.md5(F.col("_idx").cast("string")))
    return out(Sequential(ids).plan(base), base)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {h('split', 'o_orderkey')}, o_orderkey) - 1 < ceil(0.2E0 * count(*) OVER ()) AS is_test FROM orders")
def g2_split_random(spark, sf):
    return split_random(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2, SEED)


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h('split', 'o_orderkey')}, o_orderkey) - 1 < ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2E0) AS is_test FROM orders")
def g2_split_stratified(spark, sf):
    return split_stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2, SEED).select("o_orderkey", "is_test")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100")
def g3_limit_first_n(spark, sf):
    return first_n(table(spark, sf, "conversations").select("conv_id", "turn", "role"), 100, "conv_id", "turn")


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'train' ELSE 'test' END AS split FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src19')")
def g4_split_by_group(spark, sf):
    return split_by_group(table(spark, sf, "documents").select("doc_id", "source"), F.col("source"), ["src0", "src1", "src2"], ["src19"]).select("doc_id", "split")


@query("SELECT DISTINCT p_size FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_partkey <= 3) AND p_retailprice > 100")
def g6_result_filter(spark, sf):
    part = table(spark, sf, "part")
    chosen = part.where("p_partkey <= 3").select("p_type").distinct()
    return part.where("p_retailprice > 100").join(chosen, "p_type", "left_semi").select("p_size").distinct().orderBy("p_size")


@query(f"WITH {E}, {ALL}, {blocks('r', 16)}, {laid(64, 4, SHUFFLED)} SELECT event_id, batch, slot FROM l JOIN ev USING (idx) WHERE batch < 5")
def g8_head_batches(spark, sf):
    base = events(spark, sf)
    return out(spread(base, BlockShuffle(16), 64, 4).where("_batch < 5"), base, batch="_batch", slot="_slot")


# ---- H, I: sizes and models ----


@query("SELECT doc_id, (8 + strlen(text) + strlen(lang))::BIGINT AS n_bytes FROM documents")
def h1_deep_sizeof(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", row_bytes(docs).alias("n_bytes"))


@query("SELECT floor(avg(8 + strlen(text)))::BIGINT AS sample_bytes FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 16) x")
def h2_estimate_sample_size(spark, sf):
    docs = with_ordinal(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return sample_size(docs, "_idx", "doc_id", "text")


@query("SELECT * FROM (VALUES ('block_size_aggressive', 512.0::DOUBLE), ('block_size_balanced', 256.0), ('block_size_conservative', 128.0), ('fetch_factor', 256.0), ('memory_per_worker_mb', 62.5), ('num_workers', 4.0), ('prefetch_factor', 257.0), ('total_memory_mb', 250.0)) v(name, value)")
def h3_suggest_parameters(spark, sf):
    found = suggest_parameters(2000, 64, memory=16 << 30, cpus=8)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(found.items())], "name string, value double")


_W = [[0.5, -0.25, 1.0], [-1.0, 0.75, 0.25], [0.0, 0.5, -0.5]]
_L = "lg AS (SELECT vec_id, label % 3 AS y, " + ", ".join(f"({' + '.join(f'embedding[{i + 1}]::DOUBLE * ({w})' for i, w in enumerate(ws))} + ({b}))::DOUBLE AS l{k}" for k, (ws, b) in enumerate(zip(_W, (0.1, 0.0, -0.1), strict=True))) + " FROM embeddings)"


def heads(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("y"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("x"))
    return rows.select("vec_id", "y", linear_logits("x", _W, [0.1, 0.0, -0.1]).alias("logits"))


@query(f"WITH {_L} SELECT vec_id, (CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END)::BIGINT AS predicted, round(exp(l0 - greatest(l0, l1, l2)) / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 7) AS p0 FROM lg")
def i2_predict_softmax(spark, sf):
    rows = heads(spark, sf)
    return rows.select("vec_id", predict("logits").alias("predicted"), F.round(F.get(softmax("logits"), F.lit(0)), 7).alias("p0"))


@query(f"WITH {_L} SELECT round(avg(ln(exp(l0) + exp(l1) + exp(l2)) - CASE y WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END), 7) AS loss_a, round(2 * avg(ln(exp(l0) + exp(l1) + exp(l2)) - CASE y WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END), 7) AS loss FROM lg")
def i3_multitask_loss(spark, sf):
    rows = heads(spark, sf).select("y", softmax("logits").alias("p"))
    loss = multitask_loss(rows, {"a": ("y", "p", 2.0)})
    return loss.select(*[F.round(c, 7).alias(c) for c in loss.columns])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-mix entropy of block-shuffled minibatches."""
    return QUERIES["f9_entropy_b24_ff4"](spark, sf_dir)
