"""What the reviewer's findings of the first round named, each on a small table."""

import random

import pytest

import corpus_pipeline
from batchloom.llm import common, near_copies, quality

SF = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def scratch(spark):
    return common.Scratch(spark)


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


# ---- pipeline: near-duplicates ----


def test_stage_drops_edited_copies(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(150, 400))) for _ in range(60)]
    edited, near = [], set()
    for i, text in enumerate(texts):
        words = text.split()
        for at in rng.sample(range(len(words)), len(words) * (1 + i % 6) // 100):
            words[at] = "edited"
        edited.append(" ".join(words))
        if jaccard(text, edited[-1]) >= 0.8:
            near.add(len(texts) + i)
    assert 15 < len(near) < 60
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(spark, texts + edited), "").collect()}
    assert kept == set(range(120)) - near


@pytest.mark.parametrize("group", [1024, 7])
def test_groups_are_what_exact_links_connect(spark, scratch, group):
    rng = random.Random(4)
    base = [f"b{rng.randrange(900)}" for _ in range(200)]
    texts = [None, "", "one two", "One  two", *(" ".join([*base[:at], f"x{at}", *base[at + 1 :]]) for at in range(0, 200, 5)), *(" ".join(base[at : at + 120]) for at in range(0, 80, 9))]
    prints, names = near_copies.grouped(docs(spark, texts), scratch, group=group)
    got = {r["doc_id"]: r["component_id"] for r in prints.join(names, "fp").collect()}
    want = {}
    for i in range(len(texts)):
        ahead = [] if i in want else [i]
        while ahead:
            at = ahead.pop()
            if at not in want:
                want[at] = i
                ahead += [j for j in range(len(texts)) if j not in want and jaccard(texts[at] or "", texts[j] or "") >= 0.8]
    assert got == want


# ---- 9: quality ----


def test_labelled_junk_goes(spark, scratch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels, scratch).join(labels, "doc_id").collect()
    kept = lambda q: [r["_keep"] for r in found if r["quality"] == q]
    assert sum(kept(0)) <= 0.05 * len(kept(0)) and sum(kept(1)) >= 0.97 * len(kept(1))


def test_bounds_do_not_depend_on_the_number_of_documents(spark):
    rng = random.Random(6)
    rows = [("en", fit, n, 1.5 + rng.gauss(0, 1) * (1 / n + 1 / 4000) ** 0.5) for fit in (True, False) for n in (rng.randrange(5, 9000) for _ in range(40))]
    shown = spark.createDataFrame(rows, "lang string, fit boolean, n int, bits double")
    cuts = lambda df: sorted(tuple(r) for r in quality.bounds(df).collect())
    assert cuts(shown) == cuts(shown.crossJoin(spark.range(100).select()))
    assert not hasattr(quality, "CLASS_DOCS") and not hasattr(quality, "SMALL_SAMPLE")
