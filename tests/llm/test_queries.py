"""The registered queries over whole tables against SQL, brute force or a round trip, and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from batchloom.llm import secrets, simhash, surrogates
from batchloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def run(spark, name):
    return QUERIES[name](spark, SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = run(spark, name)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_op1(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op1_secret_scan").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = secrets.base_spans(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in base) for j in range(3)]


def test_op2(spark, texts):
    for r in run(spark, "op2_pii_surrogates").collect():
        old = texts[r["doc_id"]]
        kinds = surrogates.KINDS
        assert (r["text"] == old) == (sum(r[f"n_{k}"] for k in kinds) == 0) and r["n_chars"] == len(r["text"])
        assert len(r["text"].split()) == len(old.split())
        assert not set(re.findall(r"\S+@\S+\.\w+", old)) & set(re.findall(r"\S+@\S+\.\w+", r["text"]))


def test_op3(spark, texts):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [[x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]] for i in range(max(1, len(w) - 4))}
    ids, errors = sorted(texts), []
    for r in run(spark, "op3_minhash").collect():
        t, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        errors += [r["near_edited"] - len(a & b) / len(a | b), r["near_next"] - len(a & c) / len(a | c)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and len(errors) == 2 * len(texts)


def test_op4(spark, duck, tmp_path):
    """The whole table with near copies planted among its rows: links and classes against brute force."""
    rows = duck.execute("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    rng = np.random.default_rng(4)
    for k in range(60):
        i, v, label = rows[7 * k % 400]
        v = np.array(v)
        rows.append((10_000 + k, (v + rng.normal(size=len(v)) * np.abs(v).mean() * rng.choice([0.0, 0.05, 0.3, 0.6])).tolist(), label))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, ids = x @ x.T >= 0.9, np.array([i for i, _, _ in rows])
    label = ids.copy()
    for _ in range(len(ids)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in QUERIES["op4_vector_graph"](spark, str(tmp_path)).collect()}
    assert near.sum() > len(ids) + 60 and len(got) == len(ids)
    assert {int(i): int(n) - 1 for i, n in zip(ids, near.sum(axis=1))} == {i: r["n_links"] for i, r in got.items()}
    assert dict(zip(ids.tolist(), label.tolist())) == {i: r["component_id"] for i, r in got.items()} and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_op5(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = run(spark, "op5_pieces").collect()
    assert len(got) == len(texts) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: library.encode(t or "") for i, t in texts.items()}


def test_op8(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op8_simhash").collect()}
    prints = {i: simhash.simhash(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    seen = {}
    for i in sorted(prints):
        if i in seen:
            continue
        ahead = [i]
        while ahead:
            at = ahead.pop()
            if at not in seen:
                seen[at] = i
                ahead += [j for j in prints if j not in seen and (prints[at] ^ prints[j]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == seen


def test_op9(spark, texts, duck):
    got = run(spark, "op9_quality").collect()
    good = {i for (i,) in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    assert len(got) == len(texts) and sum(r["keep"] for r in got if r["doc_id"] in good) >= 0.9 * len(good)


def test_op10(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op10_token_files").collect()}
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline(spark, texts, duck):
    """Each stage against what it may do to the rows before it, and the ids against the library."""
    import sentencepiece

    from batchloom.llm import near_copies
    from batchloom.llm.common import Scratch

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    scratch, docs, kept = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for (i,) in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    assert len(good & set(ids["quality"])) >= 0.9 * len(good) and all(texts[i] for i in ids["quality"])
    sets = {i: set(near_copies.shingles(texts[i]).tolist()) for i in ids["quality"]}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = set(ids["near_duplicates"])
    assert all(any(like(i, j) for j in sets if j != i) for i in set(sets) - stay) and not any(like(i, j) for i in stay for j in stay if i < j)
    assert sorted(ids["pii"]) == sorted(stay)
    hidden = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert not any(re.search(r"\S+@\S+\.\w+", t) and hidden[i] == t for i, t in texts.items() if i in hidden) and surrogates.KEY
    assert set(ids["mixing"]) <= stay and all(r["text"] == hidden[r["doc_id"]] for r in kept["mixing"])
    out = corpus_pipeline.pieces(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(ids["mixing"]) and all(list(r["ids"]) == library.encode(hidden[r["doc_id"]]) for r in out)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in whole) == sorted((r["doc_id"], tuple(r["ids"])) for r in out)


ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "no id here at all", None, None, 17), (3, "same text of five words", "en", "b", 23), (3, "same text of five words", "en", "b", 23), (4, "long " * 20_000, "xx", "b", 100_000), (5, "Mr John Smith, a@b.example.com", "en", "a", 30)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_small_tables(spark, name):
    stage, empty = dict(corpus_pipeline.STAGES)[name], spark.createDataFrame([], ROWS)
    assert stage(spark, empty, SF).count() == 0
    rows = spark.createDataFrame(SMALL, ROWS).withColumn("_keep", F.lit("own")).withColumn("chunk", F.lit(1))
    out = stage(spark, rows, SF).collect()
    ids = Counter(r["doc_id"] for r in out)
    if name == "quality":  # texts without characters go; languages without trusted texts stay
        assert 1 not in ids and 2 not in ids and ids[4] == 1
    elif name == "near_duplicates":  # equal texts (and texts without words) leave one row
        assert ids == Counter([1, None, 3, 4, 5]) and {r["_keep"] for r in out} == {"own"}
    elif name == "pii":
        assert ids == Counter(r[0] for r in SMALL) and not any("Smith" in (r["text"] or "") for r in out)
    elif name == "mixing":
        assert set(ids) <= {r[0] for r in SMALL} and ids[3] % 2 == 0
    else:
        assert ids == Counter(r[0] for r in SMALL) and all((r["ids"] == []) == (r["doc_id"] in (1, 2)) for r in out)
