"""Sampling strategies: which rows, in what order. Each plans a DataFrame (_idx, _pos).

``_idx`` is the row's ordinal in the collection, ``_pos`` its position in the sample (unique, also
where a row is drawn twice). All work on narrow columns; payload is joined afterwards.
"""

from __future__ import annotations

import math
import warnings
from abc import ABC, abstractmethod
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.functions.rng import hash_hex, hash_u60, hash_unit
from batchloom.plans.ordinal import looked_up, place, rank_by_hash, running_sum, with_ordinal

#: Mass of a class in integer units; bits of all rows' masses together, far below 60 so that u % mass is fair.
SCALE, MASS_BITS = 1 << 40, 50
#: Distinct weights or classes that are looked up in a literal table; more go through a join.
LITERAL_GROUPS = 256
#: Expected candidates of all rounds of draws up to which they are found once and held in the plan.
FEW_PICKED = 200_000
#: Draws of one row that are listed at a time.
PIECE = 1 << 16


def as_indices(spark: SparkSession, indices, *, stacklevel: int = 3) -> DataFrame | None:
    """None, a DataFrame with _idx, or a sequence of ids (sorted with a warning if it isn't)."""
    if indices is None or isinstance(indices, DataFrame):
        return indices
    ids = [int(i) for i in indices]
    if any(a > b for a, b in zip(ids, ids[1:])):
        warnings.warn("indices were not sorted; they are used in ascending order", UserWarning, stacklevel=stacklevel)
    return spark.createDataFrame([(i,) for i in sorted(ids)], "_idx bigint")


class Strategy(ABC):
    """A plan over ``base`` (a DataFrame with _idx) and its length."""

    #: Whether rows are permuted inside a fetch.
    shuffles_fetch = False

    def __init__(self, indices=None):
        self.indices = indices

    @abstractmethod
    def plan(self, base: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame: ...

    def length(self, base: DataFrame) -> int:
        return self.selected(base).count()

    def selected(self, base: DataFrame) -> DataFrame:
        """The selected multiset of ``base``'s rows (repeated ids stay repeated)."""
        ids = as_indices(base.sparkSession, self.indices)
        return base if ids is None else ids.join(base, "_idx")

    def ranked(self, base: DataFrame) -> DataFrame:
        """(_idx, _s): selected rows and their rank among them."""
        rows = self.selected(base).select("_idx")
        if self.indices is None:
            return rows.withColumn("_s", F.col("_idx"))
        return with_ordinal(rows, "_idx", name="_s")


class Sequential(Strategy):
    """Rows in the order of the collection; with ``shuffle`` permuted inside each fetch."""

    def __init__(self, indices=None, shuffle: bool = False):
        super().__init__(indices)
        self.shuffles_fetch = shuffle

    def plan(self, base, seed=0, epoch=0):
        return self.ranked(base).select("_idx", F.col("_s").alias("_pos"))


def block_order(rows: DataFrame, n: int, block_size: int, seed: int, epoch: int) -> DataFrame:
    """(_idx, _s) to (_idx, _pos): blocks of the rank permuted as wholes, a short last block among them.

    All blocks but the last have one size, so a block's start follows from its rank by hash alone.
    """
    last, rest = divmod(n, block_size)
    # the blocks follow from n: no shuffle of the rows is needed to list them
    blocks = rows.sparkSession.range(last + bool(rest)).select(F.col("id").alias("_blk"))
    placed = rank_by_hash(blocks, hash_hex(seed, epoch, "b", "_blk"), "_blk", "_at", last + 1)
    if rest:
        short = placed.where(F.col("_blk") == last).select(F.col("_at").alias("_short"))
        placed = placed.crossJoin(F.broadcast(short))  # one row
        start = F.col("_at") * block_size - F.when(F.col("_at") > F.col("_short"), block_size - rest).otherwise(0)
    else:
        start = F.col("_at") * block_size
    placed = placed.select("_blk", start.cast("bigint").alias("_start"))
    cut = rows.withColumn("_blk", F.floor(F.col("_s") / F.lit(block_size)).cast("bigint"))
    return cut.join(placed, "_blk").select("_idx", (F.col("_start") + F.col("_s") % block_size).alias("_pos"))


class BlockShuffle(Strategy):
    """Contiguous blocks in random order; block_size 1 is a full shuffle.

    ``drop_last`` leaves out n mod block_size uniformly random rows (of repeated ids, single rows).
    """

    shuffles_fetch = True

    def __init__(self, block_size: int = 8, indices=None, drop_last: bool = False):
        super().__init__(indices)
        if block_size <= 0:
            raise ValueError("block_size must be positive")
        self.block_size, self.drop_last = block_size, drop_last

    def length(self, base):
        n = super().length(base)
        return n - n % self.block_size if self.drop_last else n

    def plan(self, base, seed=0, epoch=0):
        rows, n = self.ranked(base), Strategy.length(self, base)
        left_out = n % self.block_size if self.drop_last else 0
        if left_out:
            # the rows of least hash: fewer than a block, so they are listed and the ranks close up over them
            gone = rows.select("_s").orderBy(hash_hex(seed, epoch, "d", "_s"), "_s").limit(left_out)
            ranks = sorted(r["_s"] for r in gone.collect())
            kept = rows.join(F.broadcast(gone), "_s", "left_anti")
            rows = kept.select("_idx", (F.col("_s") - place(F.col("_s"), ranks, lambda x: F.lit(x).cast("bigint"))).cast("bigint").alias("_s"))
        return block_order(rows, n - left_out, self.block_size, seed, epoch)


class Weighted(Strategy):
    """Draws with probability in proportion to a weight column, then a block shuffle of the draws.

    ``weights``: None (equal), a column of the base, or a DataFrame (_idx, weight) aligned with the
    whole collection; with ``indices`` its rows are taken and made to sum to one again. With
    ``replace`` (default) ``total_size`` draws (default: as many as are selected); else rounds of
    ``sampling_size`` draws without replacement in each, until there are ``total_size``.
    """

    shuffles_fetch = True

    def __init__(self, block_size: int = 8, indices=None, weights: str | Column | DataFrame | None = None, total_size: int | None = None, replace: bool = True, sampling_size: int | None = None):
        super().__init__(indices)
        if block_size <= 0:
            raise ValueError("block_size must be positive")
        if not replace and sampling_size is None:
            raise ValueError("sampling_size is needed to draw without replacement")
        if replace and sampling_size is not None:
            warnings.warn("sampling_size has no effect with replacement", UserWarning, stacklevel=2)
        if sampling_size is not None and sampling_size <= 0 or total_size is not None and total_size < 0:
            raise ValueError("sizes must be positive")
        self.block_size, self.weights, self.total_size, self.replace, self.sampling_size = block_size, weights, total_size, replace, sampling_size

    def length(self, base):
        return self.total_size if self.total_size is not None else super().length(base)

    def weighted(self, base: DataFrame) -> DataFrame:
        """(_idx, _w double) of the selected rows, checked."""
        if isinstance(self.weights, DataFrame):
            names = [c for c in self.weights.columns if c != "_idx"]
            side = self.weights.select("_idx", F.col(names[0]).cast("double").alias("_w"))
            rows = self.selected(base).select("_idx")
            out = rows.join(side, "_idx", "left")
        else:
            w = F.lit(1.0) if self.weights is None else F.col(self.weights) if isinstance(self.weights, str) else self.weights
            out = self.selected(base.withColumn("_w", w.cast("double"))).select("_idx", "_w")
        odd = F.col("_w").isNull() | F.isnan("_w") | F.col("_w").isin(float("inf"), float("-inf"))
        stats = out.agg(F.min("_w").alias("least"), F.max("_w").alias("most"), F.count("*").alias("n"), F.count("_w").alias("held"), F.sum(odd.cast("int")).alias("odd"), F.max("_idx").alias("last")).first()
        if isinstance(self.weights, DataFrame) and stats["held"] < stats["n"]:
            raise ValueError("weights do not cover all selected rows")
        if stats["odd"]:
            raise ValueError("weights must be finite numbers")
        if stats["least"] is not None and stats["least"] < 0:
            raise ValueError("weights must not be negative")
        if not stats["most"]:
            raise ValueError("weights must not sum to zero")
        self._most, self._rows, self._last = stats["most"], stats["n"], stats["last"]
        return out

    def masses(self, base: DataFrame) -> DataFrame:
        """(_idx, _m bigint > 0): the weights as whole numbers in proportion to the greatest.

        Nothing is summed before it is whole, so the same masses come out whatever the
        partitioning. Their resolution falls with the number of rows, to 12 bits at least.
        """
        rows = self.weighted(base)
        unit = float(1 << max(12, min(40, MASS_BITS - self._rows.bit_length())))
        return rows.where("_w > 0").select("_idx", F.greatest(F.floor(F.col("_w") / F.lit(self._most) * unit), F.lit(1)).cast("bigint").alias("_m"))

    def draws(self, base: DataFrame, total: int, seed: int, epoch: int) -> DataFrame:
        """(_idx, _draw) of ``total`` draws with replacement by an integer CDF."""
        return self._drawn(base, total, seed, epoch).select("_idx", "_draw")

    def _drawn(self, base: DataFrame, total: int, seed: int, epoch: int) -> DataFrame:
        """``draws`` with _s, their rank by _idx (draws of one row are alike).

        The CDF is cut into ranges at every so many rows and at every so much mass: none has more
        than its share of rows or of draws, whatever the weights. Inside a range a window carries
        the row a draw falls on to it. A row that spans several ranges stands in each. The rows'
        own order cuts them, so they are not ranked again, and ranges of the CDF are in their order
        too, so neither are the draws: the masses are read twice, once for the sums.
        """
        parts = max(2, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        masses = self.masses(base)
        if self.indices is not None:
            masses = masses.groupBy("_idx").agg(F.sum("_m").alias("_m"))  # a row that is selected often is one step of the CDF
        width = self._last // parts + 1
        ranged = masses.withColumn("_range", F.floor(F.col("_idx") / F.lit(width)).cast("int"))
        sums = {r["_range"]: r["m"] for r in ranged.groupBy("_range").agg(F.sum("_m").alias("m")).collect()}  # ``parts`` at most
        starts = list(accumulate((sums.get(i, 0) for i in range(parts)), initial=0))
        mass = starts[-1]
        inside = F.sum("_m").over(Window.partitionBy("_range").orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cdf = ranged.withColumn("_lo", inside - F.col("_m") + looked_up(starts, F.col("_range")))
        cuts = sorted({*starts[:-1], *(mass * k // parts for k in range(parts))})
        range_of = lambda u: place(u, cuts, lambda x: F.lit(x).cast("bigint"))
        spans = cdf.select("_idx", "_lo", F.explode(F.sequence(range_of(F.col("_lo")), range_of(F.col("_lo") + F.col("_m") - 1))).alias("_bk"))
        spans = spans.select("_bk", F.col("_lo").alias("_u"), "_idx", F.lit(None).cast("bigint").alias("_draw"))
        thrown = base.sparkSession.range(total).select(F.col("id").alias("_draw"), (hash_u60(seed, epoch, "w", "id") % mass).alias("_u"))
        thrown = thrown.select(range_of(F.col("_u")).alias("_bk"), "_u", F.lit(None).cast("bigint").alias("_idx"), "_draw")
        held = {r["_bk"]: r["count"] for r in thrown.groupBy("_bk").count().collect()}  # one row a range
        before = list(accumulate((held.get(i, 0) for i in range(len(cuts) + 1)), initial=0))
        so_far = Window.partitionBy("_bk").orderBy("_u", F.col("_draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = spans.withColumn("_idx", F.col("_idx").cast("bigint")).unionByName(thrown)
        both = both.select("_bk", "_draw", F.last("_idx", ignorenulls=True).over(so_far).alias("_idx"), (F.count("_draw").over(so_far) - 1).alias("_s"))
        return both.where(F.col("_draw").isNotNull()).select("_idx", "_draw", (F.col("_s") + looked_up(before, F.col("_bk"))).alias("_s"))

    def rounds(self, base: DataFrame, total: int, seed: int, epoch: int) -> DataFrame:
        """(_idx, _draw) of rounds without replacement: the least keys -ln(u)/w of each round.

        One pass over the rows gives all rounds: a row goes on to a round only if its key is below
        a bound that more than enough rows are expected to be under; ranks are taken of those.
        """
        rows = self.weighted(base).where("_w > 0")
        k = min(self.sampling_size, total) if total else 0
        n_rounds = -(-total // self.sampling_size)
        if not n_rounds:
            return rows.select("_idx", F.lit(0).cast("bigint").alias("_draw")).limit(0)
        level = F.floor(F.log2("_w")).cast("int")
        levels = [(2.0 ** r["level"], r["count"]) for r in rows.groupBy(level.alias("level")).count().collect()]  # one row a doubling
        if sum(c for _, c in levels) < k:
            raise ValueError("fewer rows of positive weight than a round draws")
        wanted = k + 8 * math.sqrt(k) + 32
        bound = 2.0**-60
        while sum(c * -math.expm1(-w * bound) for w, c in levels) < wanted and bound < 2.0**1000:
            bound *= 2
        every = sum(c for _, c in levels) <= wanted
        parts = lambda r: F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.concat(F.lit("r"), r.cast("string")), F.col("_idx").cast("string"))
        unit = lambda r: (F.conv(F.substr(F.md5(parts(r)), F.lit(1), F.lit(13)), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        keyed = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n_rounds - 1).cast("bigint")), lambda r: F.struct(r.alias("round"), (-F.log(unit(r)) / F.col("_w")).alias("key")))
        size = F.when(F.col("_draw") == n_rounds - 1, total - (n_rounds - 1) * self.sampling_size).otherwise(self.sampling_size)
        while True:
            some = keyed if every else F.filter(keyed, lambda s: s.key < bound)  # noqa: B023
            picked = rows.select("_idx", F.explode(some).alias("s")).select("_idx", F.col("s.round").alias("_draw"), F.col("s.key").alias("_key"))
            most = n_rounds * sum(c * -math.expm1(-2 * w * bound) for w, c in levels)  # expected under the bound, at most
            if not every and most <= FEW_PICKED:
                few = picked.collect()
                picked, held = base.sparkSession.createDataFrame(few, picked.schema), Counter(r["_draw"] for r in few)
                if len(held) == n_rounds and min(held.values()) >= k:
                    break
            elif every or picked.groupBy("_draw").count().where(F.col("count") >= k).count() == n_rounds:
                break
            bound, every = 2 * bound, bound > 2.0**1000
        rank = F.row_number().over(Window.partitionBy("_draw").orderBy("_key", "_idx"))
        return picked.withColumn("_rank", rank).where(F.col("_rank") <= size).select("_idx", "_draw")

    def plan(self, base, seed=0, epoch=0):
        total = self.length(base)
        if self.replace:
            rows = self._drawn(base, total, seed, epoch)
        else:
            rows = with_ordinal(self.rounds(base, total, seed, epoch), "_idx", "_draw", name="_s", n=total)
        return block_order(rows.select("_idx", "_s"), total, self.block_size, seed, epoch)


class ClassBalanced(Weighted):
    """Every class equally likely, every row of a class too.

    ``label`` is a column of the base; ``scope`` "local" counts classes among the selected rows,
    "global" in the whole collection (a selection may then look unbalanced, on purpose). Rows
    without a label are not drawn. Two stages: a class by its mass, then a row of the class.
    """

    def __init__(self, label: str, block_size: int = 8, indices=None, total_size=None, replace=True, sampling_size=None, scope: str = "local"):
        super().__init__(block_size, indices, None, total_size, replace, sampling_size)
        if scope not in ("local", "global"):
            raise ValueError("scope is 'local' or 'global'")
        self.label, self.scope = label, scope

    def weighted(self, base):
        counted = (base if self.scope == "global" else self.selected(base)).where(F.col(self.label).isNotNull()).groupBy(self.label).agg((1.0 / F.count("*")).alias("_w"))
        rows = self.selected(base).select("_idx", self.label).join(counted, self.label).select("_idx", "_w")
        stats = rows.agg(F.max("_w").alias("most"), F.count("*").alias("n")).first()
        if not stats["most"]:
            raise ValueError("no labels")
        self._most, self._rows = stats["most"], stats["n"]
        return rows

    def draws(self, base, total, seed, epoch):
        wanted, rows = self._wanted(base, total, seed, epoch)
        return wanted.join(rows, "_row").select("_idx", "_draw")

    def _drawn(self, base, total, seed, epoch):
        """(_idx, _s) of the draws: they are counted by row, and a row stands as often as it was drawn.

        Draws of one row are alike, so they need no order among themselves, and a row that is drawn
        very often is one row until it is listed, in pieces.
        """
        wanted, rows = self._wanted(base, total, seed, epoch)
        often = wanted.groupBy("_row").agg(F.count("*").alias("_c")).join(rows, "_row").select("_idx", "_c")
        if self.indices is not None:
            often = often.groupBy("_idx").agg(F.sum("_c").alias("_c"))  # a row that is selected often is one row
        placed = running_sum(often, "_idx", "_c", "_first", base.count())
        pieces = placed.select("_idx", "_first", "_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1, F.lit(PIECE).cast("bigint"))).alias("_from"))
        listed = pieces.select("_idx", "_first", F.explode(F.sequence("_from", F.least(F.col("_from") + PIECE, "_c") - 1)).alias("_k"))
        return listed.select("_idx", (F.col("_first") + F.col("_k")).alias("_s"))

    def _wanted(self, base: DataFrame, total: int, seed: int, epoch: int) -> tuple[DataFrame, DataFrame]:
        """(_draw, _row) of the draws and (_row, _idx): the labelled rows in the order of class and _idx."""
        chosen = self.selected(base).where(F.col(self.label).isNotNull()).select("_idx", F.col(self.label).alias("_g"))
        sizes = chosen.groupBy("_g").agg(F.count("*").alias("_n"))
        if self.scope == "global":
            whole = base.where(F.col(self.label).isNotNull()).groupBy(F.col(self.label).alias("_g")).agg(F.count("*").alias("_all"))
            sizes = sizes.join(whole, "_g").withColumn("_m", F.floor(F.lit(SCALE) * F.col("_n") / F.col("_all")).cast("bigint"))
        else:
            sizes = sizes.withColumn("_m", F.lit(SCALE).cast("bigint"))
        # few classes are a literal CDF, many a table; both give the same draws
        classes = sizes.orderBy("_g").limit(LITERAL_GROUPS + 1).collect()
        if not classes:
            raise ValueError("no labels")
        if len(classes) > LITERAL_GROUPS:
            return self._of_many(base, chosen, sizes, total, seed, epoch)
        ends, sum_ = [], 0
        for r in classes:
            sum_ += r["_m"]
            ends.append(sum_)
        starts, seen = [], 0
        for r in classes:
            starts.append(seen)
            seen += r["_n"]
        u = F.col("_u")
        thrown = base.sparkSession.range(total).select(F.col("id").alias("_draw"), (hash_u60(seed, epoch, "g", "id") % sum_).alias("_u"), hash_u60(seed, epoch, "m", "id").alias("_v"))
        thrown = thrown.withColumn("_c", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= u)) + 1)
        of = lambda xs: F.element_at(F.array(*[F.lit(x).cast("bigint") for x in xs]), F.col("_c"))
        wanted = thrown.select("_draw", (of(starts) + F.col("_v") % of([r["_n"] for r in classes])).alias("_row"))
        return wanted, with_ordinal(chosen, "_g", "_idx", name="_row", n=seen).select("_idx", "_row")

    def _of_many(self, base: DataFrame, chosen: DataFrame, sizes: DataFrame, total: int, seed: int, epoch: int) -> tuple[DataFrame, DataFrame]:
        """The same from a table of classes: each class is a row of the CDF, each of its rows an equal share."""
        ranked = with_ordinal(sizes, "_g", name="_c")
        n = ranked.count()
        table = running_sum(running_sum(ranked, "_c", "_m", "_lo", n), "_c", "_n", "_first", n)
        mass = table.agg(F.sum("_m").alias("m")).first()["m"]
        width = max(1, mass // n)  # classes are of like mass: a bucket holds few
        cut = table.select("_lo", "_m", "_n", "_first", F.explode(F.sequence(F.floor(F.col("_lo") / F.lit(width)), F.floor((F.col("_lo") + F.col("_m") - 1) / F.lit(width)))).alias("_bk"))
        thrown = base.sparkSession.range(total).select(F.col("id").alias("_draw"), (hash_u60(seed, epoch, "g", "id") % mass).alias("_u"), hash_u60(seed, epoch, "m", "id").alias("_v"))
        hit = thrown.withColumn("_bk", F.floor(F.col("_u") / F.lit(width))).join(cut, "_bk").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_lo") + F.col("_m")))
        wanted = hit.select("_draw", (F.col("_first") + F.col("_v") % F.col("_n")).alias("_row"))
        return wanted, with_ordinal(chosen, "_g", "_idx", name="_row").select("_idx", "_row")
