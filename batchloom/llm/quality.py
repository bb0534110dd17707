"""A quality classifier: interpolated modified Kneser-Ney over characters, for each language.

The unit is the character (four in a row), which needs no tokenizer, covers unseen words and keeps
the count tables far smaller than the text. Counts are gathered over all trusted documents but a
held-out fifth; discounts, context weights and interpolated probabilities come from joins of the
count tables on their keys. A document's mean log loss is held against that of the held-out trusted
documents of its language: the shorter a text, the farther it may lie from their median, by one
smooth function of its length and one rule whatever the number of documents. The documents that the
model was fitted on are known to it and are held against one another instead.

An n-gram is packed into 64 bits, 16 a character; 0 stands before the text's start, 0xFFFF for
characters beyond the basic plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm.common import Scratch, given_back, numbered
from batchloom.llm.segments import chunks

ORDER = 4
#: Quantiles of the held-out trusted documents' deviation; kept is what lies within them and ``SLACK`` times their distance beyond.
LOW_Q, HIGH_Q, SLACK = 0.1, 0.9, 1.0
#: A mean over n characters strays by the root of 1/n, and a document from its language by that of 1/``DOC_CHARS``.
DOC_CHARS = 4000
#: The least distance of the quantiles, in the same unit, for languages with hardly any held-out document.
LEAST_SPREAD = 1.5
#: Model rows that are broadcast at once; a larger model is scored shard by shard.
SHARD_ROWS = 3_000_000
#: Trusted ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of texts that are scored at once, and how much more where the model has several shards.
CHUNK_BYTES, SHARDED = 8_000_000, 8
_SLICE = 1 << 21


def codes(text: str) -> np.ndarray:
    """16-bit characters of a text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((raw == 0) | (raw > 0xFFFE), 0xFFFF, raw).astype(np.uint64)


def packed(chars: np.ndarray) -> np.ndarray:
    """The key of each character with the three before it."""
    padded = np.concatenate((np.zeros(ORDER - 1, np.uint64), chars))
    n = len(chars)
    key = np.zeros(n, np.uint64)
    for k in range(ORDER):
        key |= padded[k : k + n] << np.uint64(16 * (ORDER - 1 - k))
    return key


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[str | None, int] = {}

    def merge(lang):
        keys, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        held[lang] = [(keys, np.bincount(at, counts).astype(np.int64))]
        size[lang] = len(keys)

    for batch in batches:
        waiting: dict[str | None, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            chars = packed(codes(text.as_py() or ""))
            for at in range(0, len(chars), _SLICE):
                waiting.setdefault(lang, []).append(chars[at : at + _SLICE])
                if sum(map(len, waiting[lang])) >= _SLICE:
                    held.setdefault(lang, []).append(np.unique(np.concatenate(waiting.pop(lang)), return_counts=True))
                    size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
        for lang, parts in waiting.items():
            held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
            size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
        for lang in list(held):
            if len(held[lang]) > 8:
                merge(lang)
            if size[lang] > 4 * _SLICE:  # bounded memory: hand on what there is
                yield from _rows(lang, *held.pop(lang)[0])
                size[lang] = 0
    for lang in list(held):
        merge(lang)
        yield from _rows(lang, *held[lang][0])


def _rows(lang, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 100_000):
        some = keys[at : at + 100_000].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[at : at + 100_000].astype(np.int64))], ["lang", "gram", "n"])


def _mask(order: int) -> Column:
    mask = (1 << (16 * order)) - 1
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def counts(trusted: DataFrame) -> dict[int, DataFrame]:
    """Occurrences of the longest n-grams and, below, in how many longer types each n-gram ends."""
    top = trusted.select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    out = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        out[order] = out[order + 1].groupBy("lang", F.col("gram").bitwiseAND(_mask(order)).alias("gram")).agg(F.count("*").alias("n"))
    return out


def _discounts(table: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of one order from the counts of counts; plain values where those are too few."""
    n = lambda k: F.sum(F.when(F.col("n") == k, 1.0).otherwise(0.0))
    c = table.groupBy("lang").agg(*[n(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = lambda k: F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1 * k)), F.lit(k * 0.95))).otherwise(0.5 * k)
    return c.select("lang", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def model(trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, kind, gram, value): kind n > 0 is the log probability of an n-gram, kind -n the log
    weight of the order below after a context of n - 1 characters; kind 0 an unseen character."""
    tables = {order: scratch.save(t, f"count{order}") for order, t in [(ORDER, counts(trusted)[ORDER])]}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = scratch.save(tables[order + 1].groupBy("lang", F.col("gram").bitwiseAND(_mask(order)).alias("gram")).agg(F.count("*").alias("n")), f"count{order}")
    below, out = None, []
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[f"_{c}"]) for c in cols]
    named = lambda df, *cols: df.select(*[F.col(c).alias(f"_{c}") if c in cols else F.col(c) for c in df.columns])
    for order in range(1, ORDER + 1):
        table = tables[order]
        cut = named(_discounts(table), "lang")  # one row a language
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = table.join(F.broadcast(cut), table["lang"].eqNullSafe(cut["_lang"])).select("lang", "gram", "n", taken.alias("taken"), F.shiftrightunsigned("gram", 16).alias("context"))
        contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("rest"), F.count("*").alias("types"))
        both = named(contexts, "lang", "context")
        rows = grams.join(both, (grams["lang"].eqNullSafe(both["_lang"])) & (grams["context"] == both["_context"])).select("lang", "gram", ((F.col("n") - F.col("taken")) / F.col("total")).alias("own"), "rest", "types")
        if order == 1:
            rows = rows.select("lang", "gram", (F.col("own") + F.col("rest") / (F.col("types") + 1)).alias("p"))
            out.append(contexts.select("lang", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("gram"), F.log(F.col("rest") / (F.col("types") + 1)).alias("value")))
        else:
            short = below.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("low"))
            rows = rows.join(short, rows["lang"].eqNullSafe(short["_lang"]) & (rows["gram"].bitwiseAND(_mask(order - 1)) == short["_gram"])).select("lang", "gram", (F.col("own") + F.col("rest") * F.col("low")).alias("p"))
            out.append(contexts.select("lang", F.lit(-order).alias("kind"), F.col("context").alias("gram"), F.log("rest").alias("value")))
        below = scratch.save(rows, f"p{order}")
        out.append(below.select("lang", F.lit(order).alias("kind"), "gram", F.log("p").alias("value")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return scratch.save(whole, "model")


class Lookup:
    """Open addressing over packed keys, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan, np.float32)
        left, at = np.arange(len(keys)), self._at(keys)
        owner = np.full(1 << bits, -1, np.int64)
        while len(left):
            free = owner[at] < 0
            owner[at[free]] = left[free]
            lost = owner[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask
        placed = owner >= 0
        self.keys[placed], self.values[placed] = keys[owner[placed]], values[owner[placed]]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is missing."""
        at, out = self._at(keys), np.full(len(keys), np.nan, np.float32)
        here = self.values[at]
        hit = self.keys[at] == keys
        out[hit] = here[hit]
        left = np.flatnonzero(~hit & ~np.isnan(here))
        while len(left):
            at_left = (at[left] + 1) & self.mask
            at[left] = at_left
            here, hit = self.values[at_left], self.keys[at_left] == keys[left]
            out[left[hit]] = here[hit]
            left = left[~hit & ~np.isnan(here)]
        return out


class Scorer:
    """Log probabilities of texts under one shard of the model."""

    def __init__(self, rows: dict[str | None, dict[int, tuple[np.ndarray, np.ndarray]]], shard: int, shards: int):
        self.shard, self.shards = shard, shards
        self.tables = {lang: {kind: Lookup(*kv) for kind, kv in kinds.items()} for lang, kinds in rows.items()}

    def logs(self, lang: str | None, keys: np.ndarray) -> np.ndarray:
        tables = self.tables[lang]
        empty = Lookup(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        of = lambda kind: tables.get(kind, empty)
        total, left, order = np.zeros(len(keys)), np.arange(len(keys)), ORDER
        while order and len(left):
            some = keys[left] & np.uint64((1 << (16 * order)) - 1)
            got = of(order)(some)
            miss = np.isnan(got)
            total[left[~miss]] += got[~miss]
            left, some = left[miss], some[miss]
            if order > 1:
                total[left] += np.nan_to_num(of(-order)(some >> np.uint64(16)))  # an unseen context leaves all to the order below
            order -= 1
        if len(left):
            total[left] += of(0)(np.zeros(len(left), np.uint64))
        return total

    def __call__(self, lang: str | None, chars: np.ndarray) -> float:
        if lang not in self.tables:
            return 0.0
        keys = packed(chars)
        if self.shards > 1:
            keys = keys[shard_of(keys, self.shards) == self.shard]
        return float(sum(-self.logs(lang, keys[at : at + _SLICE]).sum() for at in range(0, len(keys), _SLICE)))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two characters before the last: all n-grams and contexts that a position needs share them."""
    return ((keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % shards


def _shard(kind: Column, gram: Column, shards: int) -> Column:
    two = F.when(kind > 0, F.shiftrightunsigned(gram, 16)).otherwise(gram).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.when(F.abs(kind) <= 2, -1).otherwise(F.pmod(two, F.lit(shards)))


def _scores(scorer: Scorer, langs: list[str | None], texts: pa.Array) -> np.ndarray:
    """Minus the log probability of each text under one shard; texts of a language are looked up together."""
    sums = np.zeros(len(langs))
    waiting: dict[str | None, list[tuple[int, np.ndarray]]] = {}

    def flush(lang):
        rows = waiting.pop(lang)
        if len(rows) == 1 or scorer.shards > 1 or lang not in scorer.tables:
            for i, chars in rows:
                sums[i] += scorer(lang, chars)
            return
        logs = scorer.logs(lang, np.concatenate([packed(chars) for _, chars in rows]))
        ends = np.cumsum([len(chars) for _, chars in rows])
        for (i, _), total in zip(rows, np.diff(np.concatenate(([0.0], np.cumsum(logs)))[np.concatenate(([0], ends))]), strict=True):
            sums[i] -= total

    for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        chars = codes(text.as_py() or "")
        if not len(chars):
            continue
        waiting.setdefault(lang, []).append((i, chars))
        if sum(len(c) for _, c in waiting[lang]) >= _SLICE // 4:
            flush(lang)
    for lang in list(waiting):
        flush(lang)
    return sums


def _score_with(shared, lang_at: int, text_at: int):
    kept = []  # a model of one shard is made once a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, text_at, CHUNK_BYTES * (1 if len(shared) == 1 else SHARDED)):
            langs, texts = table.column(lang_at).to_pylist(), table.column(text_at).combine_chunks()
            sums = np.zeros(table.num_rows)
            for piece in shared:
                if len(shared) > 1 or not kept:
                    kept[:] = [Scorer(*piece.value)]
                sums += _scores(kept[0], langs, texts)
            yield from table.append_column("_loss", pa.array(sums)).combine_chunks().to_batches()

    return run


def with_log_loss(docs: DataFrame, fitted: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` and ``_loss``, minus the log probability of the text in the column ``text`` under its language's model.

    A model over ``shard_rows`` is broadcast in shards; a task holds one of them at a time and
    scores its rows by all, so texts are read once however many shards there are.
    """
    spark, shared = docs.sparkSession, []
    shards = max(1, -(-fitted.count() // shard_rows))
    for shard in range(shards):
        mine = fitted if shards == 1 else fitted.where(_shard(F.col("kind"), F.col("gram"), shards).isin(-1, shard))
        rows: dict = {}
        got = mine.toArrow()
        langs, kinds = got["lang"].to_pandas().astype(object).where(lambda s: s.notna(), None), got["kind"].to_numpy()
        grams, values = got["gram"].to_numpy().view(np.uint64), got["value"].to_numpy().astype(np.float32)
        for name in set(langs.tolist()):
            at = (langs.isna() if name is None else langs == name).to_numpy()
            rows[name] = {int(k): (grams[at & (kinds == k)], values[at & (kinds == k)]) for k in set(kinds[at].tolist())}
        shared.append(spark.sparkContext.broadcast((rows, shard, shards)))
    schema = T.StructType([*docs.schema.fields, T.StructField("_loss", T.DoubleType())])
    return docs.mapInArrow(_score_with(shared, docs.columns.index(lang), docs.columns.index(text)), schema)


def _width(n: Column) -> Column:
    return F.sqrt(1 / F.greatest(n, F.lit(1)) + F.lit(1 / DOC_CHARS))


def bounds(shown: DataFrame) -> DataFrame:
    """(_lang, _fit, _middle, _below, _above) from (lang, fit, n, bits) of trusted documents.

    Kept are mean log losses from _middle + _below x width(n) to _middle + _above x width(n).
    """
    middle = shown.groupBy("lang", "fit").agg(F.percentile_approx("bits", 0.5, 10000).alias("_middle")).withColumnsRenamed({"lang": "_lang", "fit": "_fit"})
    strayed = shown.join(F.broadcast(middle), shown["lang"].eqNullSafe(F.col("_lang")) & (F.col("fit") == F.col("_fit"))).withColumn("_u", (F.col("bits") - F.col("_middle")) / _width(F.col("n")))
    q = strayed.groupBy("_lang", "_fit", "_middle").agg(F.percentile_approx("_u", [LOW_Q, HIGH_Q], 10000).alias("q"))
    low, high = F.element_at("q", 1), F.element_at("q", 2)
    spread = F.greatest(high - low, F.lit(LEAST_SPREAD))
    return q.select("_lang", "_fit", "_middle", (low - SLACK * spread).alias("_below"), (high + SLACK * spread).alias("_above"))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with _perplexity, _low, _high and _keep.

    Trusted are the documents whose id has quality 1 in ``labels`` (doc_id, quality). A text
    without characters (or null) has no perplexity and is not kept. A language (a null one is one
    of its own) without held-out trusted text has no bounds: nothing is known of it, and its other
    documents are kept. Rows with equal ids stay separate rows and an empty table gives none; other
    columns pass through, whatever their names (those named like a result as input_<name>).
    """
    plain, names = numbered(docs, "lang", "text")
    doc_id, text = (F.col(names[c]) for c in ("doc_id", "text"))
    ids = labels.where(F.col("quality") == 1).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    known_id = F.broadcast(ids) if few else ids
    trusted = plain.join(known_id, doc_id.cast("bigint") == F.col("_id"), "left_semi").select(doc_id.cast("bigint").alias("doc_id"), F.col(names["lang"]).alias("lang"), text.alias("text"))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(9)), F.lit(5)) == 0
    held_out = part(F.col("doc_id"))
    fitted = model(trusted.where(~held_out), scratch)
    shown_n = F.char_length("text")
    loss = with_log_loss(trusted, fitted, scratch, shard_rows).where(shown_n > 0)
    shown = scratch.save(loss.select("lang", (~held_out).alias("fit"), shown_n.alias("n"), (F.col("_loss") / shown_n).alias("bits")), "shown")
    cuts = scratch.save(bounds(shown), "cuts")  # two rows a language
    scored = with_log_loss(plain, fitted, scratch, shard_rows, names["lang"], names["text"])
    scored = scored.join(known_id, doc_id.cast("bigint") == F.col("_id"), "left").withColumn("_in", F.col("_id").isNotNull() & F.coalesce(~part(F.col("_id")), F.lit(False)))
    scored = scored.join(F.broadcast(cuts), F.col(names["lang"]).eqNullSafe(F.col("_lang")) & (F.col("_in") == F.col("_fit")), "left")
    n = F.coalesce(F.char_length(text), F.lit(0))
    ppl = F.when(F.col("_middle").isNotNull() & (n > 0), F.exp(F.col("_loss") / n))
    width = _width(n)
    low, high = F.exp(F.col("_middle") + F.col("_below") * width), F.exp(F.col("_middle") + F.col("_above") * width)
    keep = F.when(n == 0, False).otherwise(F.coalesce((ppl >= low) & (ppl <= high), F.lit(True)))
    own = ("_perplexity", "_low", "_high", "_keep")
    return scored.select(*given_back(names, own), *[c.alias(o) for c, o in zip((ppl, low, high, keep), own, strict=True)])
