"""What the reviewer's findings of the second round named, each on a small table."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from batchloom.llm import common, near_copies, simhash, surrogates

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def scratch(spark):
    return common.Scratch(spark)


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


# ---- pipeline, pii: the driver's memory ----


@pytest.mark.parametrize("numbered", [0, 900])
def test_the_plan_of_the_surrogates_stays_small(spark, scratch, monkeypatch, numbered):
    """The driver holds the plan several times over; its lists of names, and the map of numbers, stand in it as one literal each."""
    if numbered:
        monkeypatch.setattr(surrogates, "_email", lambda c, h: F.lit("x@y.example"))
    texts = [f"Mail a{i}@b.example.com" for i in range(numbered + 1)] + ["Mr John Smith of 10.1.2.3"]
    out = surrogates.pseudonymise(docs(spark, texts), scratch)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 250_000
    new = [r["text"] for r in out.collect()]
    assert len(set(new)) == len(texts) and not any("Smith" in t or "@b." in t for t in new)
    if numbered:  # the map is folded: no row reads it again
        assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()


# ---- F1, pipeline: near-duplicates by SimHash ----


def brute_fingerprint(hashes, words):
    """Word by word, bit by bit."""
    out = []
    for word in range(words):
        mixed = [int(h) for h in hashes]
        if word:
            mask = (1 << 64) - 1
            for i, x in enumerate(mixed):
                x = (x + word * 0x9E3779B97F4A7C15) & mask
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
                x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
                mixed[i] = x ^ x >> 31
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def test_wide_fingerprint_against_brute_force():
    rng = random.Random(8)
    for n in (0, 1, 2, 4, 255, 256, 700):
        text = " ".join(f"w{i}" for i in rng.sample(range(10**6), n + 4 if n else 0))
        some = near_copies.shingles(text)
        print_ = simhash.majority(some, near_copies.WORDS).tolist()
        assert len(some) == n and print_ == brute_fingerprint(some, near_copies.WORDS) and print_[0] == simhash.simhash(text, 5)


def test_pairs_at_the_bound_share_a_block_and_unrelated_ones_are_let_go():
    rng, sets = np.random.default_rng(9), []
    for i in range(400):  # pairs of similarity 0.8 or just above, of many sizes, the least ones first
        n = (4, 8, 9, 13, 45, 90, 450)[i % 7] if i else 4
        pool = rng.integers(0, 1 << 63, 2 * n + 2, np.uint64)
        one = 1 if n == 4 else n // 9  # of n each, all but these are shared; 4 stand in 5
        sets += [pool[:n], pool[: n + 1] if n == 4 else np.concatenate((pool[one:n], pool[n : n + one])) if one else pool[: n + 2]]
    sets = [np.unique(x) for x in sets]
    assert all(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True))
    prints = pa.array([simhash.majority(x, near_copies.WORDS).tobytes() for x in sets], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), prints, pa.array([near_copies.fours(x) for x in sets], pa.list_(pa.int64()))], ["fp", "print", "fours"])
    for large, parts in (([], []), (np.unique(near_copies.cut(batch)[:, 0]), 3)):  # buckets whole, or cut into cells of each pair of three parts
        large = np.array(large, np.uint64)
        rows = near_copies.celled(near_copies.cut(batch), large, np.full(len(large), parts or 1))
        found = {}
        for k, fp in zip(*near_copies.groups(rows), strict=True):
            found.setdefault(int(k), set()).add(int(fp))
        assert {tuple(sorted(x)) for x in found.values()} == {(i, i + 1) for i in range(0, len(sets), 2)}


def test_buckets_of_any_size_give_the_same_pairs():
    rng = np.random.default_rng(10)
    words = rng.integers(0, 1 << 63, (3, 700), np.uint64)
    words[:, 350:] = words[:, :350] ^ np.uint64(5)
    for starts in ([0, 700], [0, 3, 340, 353, 700], list(range(0, 701, 50))):
        got = {(int(a), int(b)) for a, b in zip(*near_copies.meeting(np.array(starts), words), strict=True)}
        ends = np.searchsorted(starts, np.arange(700), "right")
        assert got == {(i, i + 350) for i in range(350) if ends[i] == ends[i + 350]}


def test_the_stage_drops_texts_of_four_and_five_shingles(spark):
    texts = [" ".join(f"v{i}x{j}" for j in range(n)) for i in range(60) for n in (8, 9)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(spark, texts), "").collect()}
    assert kept == set(range(0, 120, 2))


# ---- F1, pipeline: rows of the near-duplicate stage do not follow the blocks that sets share ----


def near_copies_of(rng, n, words, changed):
    """``n`` texts of ``words`` words, ``changed`` of each put into the same text by chance."""
    base, texts = [f"b{rng.randrange(10**9)}" for _ in range(words)], []
    for i in range(n):
        own = list(base)
        for j in rng.sample(range(words), changed):
            own[j] = f"c{i}x{j}"
        texts.append(" ".join(own))
    return texts


def batch_of(sets):
    prints = pa.array([simhash.majority(x, near_copies.WORDS).tobytes() for x in sets], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), prints, pa.array([near_copies.fours(x) for x in sets], pa.list_(pa.int64()))], ["fp", "print", "fours"])


def test_sets_that_share_many_blocks_are_in_one_group_once():
    sets = [near_copies.shingles(t) for t in near_copies_of(random.Random(11), 40, 300, 2)]
    rows = near_copies.celled(near_copies.cut(batch_of(sets)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    k, fp = near_copies.groups(rows)
    assert fp.tolist() == list(range(40)) and set(k.tolist()) == {0}


def test_all_bits_let_no_pair_at_the_bound_go_and_tell_less_like_ones_apart():
    rng = np.random.default_rng(12)
    for both, one, two in ((4, 0, 1), (5, 0, 1), (12, 0, 3), (8, 1, 1), (20, 1, 4), (60, 1, 14), (400, 40, 60)):  # similarity 0.8 or just above; the most differing bits among them
        pools = [rng.integers(0, 1 << 63, both + one + two, np.uint64) for _ in range(60)]
        sets = [np.unique(x) for p in pools for x in (p[: both + one], np.concatenate((p[:both], p[both + one :])))]
        prints = np.array([simhash.majority(x, near_copies.WORDS) for x in sets])
        a, b = near_copies.near(prints, np.array([len(x) in (4, 5) for x in sets]))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) >= {(i, i + 1) for i in range(0, 120, 2)}
        if both > 5:  # a pair and no other
            assert len(a) == 60
    pools = [rng.integers(0, 1 << 63, 900, np.uint64) for _ in range(60)]  # 0.45, near on the first words alone
    prints = np.array([simhash.majority(np.unique(x), near_copies.WORDS) for p in pools for x in (p[:650], p[250:])])
    assert not len(near_copies.near(prints, np.zeros(120, bool))[0])
    assert near_copies.FAR_ALL < 0.25 * 64 * near_copies.WORDS


@pytest.mark.parametrize("group", [1024, 16])
def test_shingles_of_a_set_move_once_however_many_blocks_it_shares(spark, scratch, monkeypatch, group):
    texts = near_copies_of(random.Random(13), 60, 300, 2) + near_copies_of(random.Random(14), 60, 300, 9)
    moved, cells = [], near_copies.in_cells
    monkeypatch.setattr(near_copies, "in_cells", lambda members, most: moved.append(cells(members, most).count()) or cells(members, most))
    _, names = near_copies.grouped(docs(spark, texts), scratch, group=group)
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    root = list(range(120))  # brute force
    for i in range(120):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    want = {near_copies.name(near_copies.shingles(t)): r for t, r in zip(texts, root, strict=True)}
    assert {r["fp"] % 2**64: r["component_id"] for r in names.collect()} == want
    assert moved[1] <= 120 if group == 1024 else moved[1] <= 120 * 8  # one row a set, or one for each cell of two parts


def kept(spark, rows):
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS), "")
    return out, sorted((r["doc_id"], r["text"]) for r in out.collect())


@pytest.mark.parametrize("most", [simhash.GONE, 0])
def test_what_stays_is_not_shuffled_and_shuffle_files_go_with_their_table(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GONE", most)
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag, None)
    with common.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out, rows = kept(spark, [(i, f"only these {i // 2} words and no others") for i in range(20)])
        assert [i for i, _ in rows] == list(range(0, 20, 2))
        if most:  # the rows stay where they are, however many there are
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(flag, None) == before


def test_an_id_that_is_first_in_one_group_and_not_in_another(spark):
    a, b = "the first text of these five words", "quite another one that none of them is like"
    assert kept(spark, [(3, a), (5, a), (5, b)])[1] == [(3, a), (5, b)]
