"""Latent terms against a plain decomposition; many queries against few."""

import functools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import latent, vector
from gneiss.plans import queries
from tests.compare import FOLDER

TOPICS = ("harbour crane vessel cargo dock tide", "orchard blossom harvest cider graft pruning", "furnace alloy ingot rolling slag casting")


def corpus(n=60, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(TOPICS[i % 3].split(), 20)) + f" odd{i}" for i in range(n)]


def plain_rows(texts):
    """Rows of length one of (1 + log count) times log((1 + rows) / (1 + rows with the bucket)), as a dense matrix."""
    counts = [Counter() for _ in texts]
    for own, text in zip(counts, texts, strict=True):
        for word in latent._WORD.findall((text or "").lower()):
            if word not in latent.STOP_WORDS:
                own[latent.zlib.crc32(word.removesuffix("s").encode()) % latent.BUCKETS] += 1
    buckets = sorted(set().union(*counts))
    within = Counter(b for own in counts for b in own)
    dense = np.array([[(1 + np.log(own[b])) * np.log((1 + len(texts)) / (1 + within[b])) if own[b] else 0.0 for b in buckets] for own in counts])
    return dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)


def table(spark, texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(3)


def test_fit_is_the_plain_decomposition(spark):
    texts = [*corpus(), None, "", "the and"]
    fitted = latent.fit(table(spark, texts), dimensions=3)
    left, values, right = np.linalg.svd(plain_rows(texts), full_matrices=False)
    assert fitted.strength == pytest.approx(values[:3], rel=1e-6)
    found = fitted.embed(texts).astype(np.float64)
    assert found @ found.T == pytest.approx((left[:, :3] * values[:3] ** 2) @ left[:, :3].T, abs=1e-5)
    assert not found[-3:].any()


def test_texts_of_a_topic_are_near(spark):
    fitted = latent.fit(table(spark, corpus()), dimensions=3)
    a, b, c = vector.unit_rows(latent.pa.array(fitted.embed(["vessels tide", "cargo crane", "slag alloy"]).tolist()))
    assert a @ b > 0.95 and abs(a @ c) < 0.2


def test_a_sample_counts_all_rows_and_fits_some(spark):
    texts = corpus(600)
    df = table(spark, texts)
    some = latent.fit(df, dimensions=3, sample=150)
    assert some.rarity == pytest.approx(latent.fit(df, dimensions=3).rarity)
    assert 0.3 < some.strength[0] ** 2 / np.linalg.svd(plain_rows(texts))[1][0] ** 2 * 4 < 1.7
    a, b, c = vector.unit_rows(latent.pa.array(some.embed(["vessels tide", "cargo crane", "slag alloy"]).tolist()))
    assert a @ b > 0.95 and abs(a @ c) < 0.2


@pytest.mark.parametrize("texts", [[], [None], [""], ["harbour crane"], ["harbour"] * 5, ["x " * 50_000 + "harbour crane " * 20_000, "orchard"]])
def test_odd_tables(spark, texts):
    fitted = latent.fit(table(spark, texts))
    found = fitted.embed([*texts, None, "never seen"])
    assert found.shape == (len(texts) + 2, latent.DIMENSIONS) and np.isfinite(found).all() and not found[-2:].any()


def test_saved_and_loaded(spark, tmp_path):
    texts = corpus()
    for rows in (texts, []):
        fitted = latent.fit(table(spark, rows), dimensions=4)
        fitted.save(spark, f"file://{tmp_path}/latent{len(rows)}")
        again = latent.LatentTerms.load(spark, f"file://{tmp_path}/latent{len(rows)}")
        assert again.embed([*texts, None])[:, :3] == pytest.approx(fitted.embed([*texts, None])[:, :3])
    assert again.strength.shape == (latent.DIMENSIONS,)


def test_halves_of_a_text_find_each_other_more_often_than_by_hashed_terms(spark):
    words, half = F.split("text", " "), F.floor(F.size(F.split("text", " ")) / 2).cast("int")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("size(split(text, ' ')) >= 40").select("doc_id", "text")
    first = docs.select(F.col("doc_id").cast("string").alias("qid"), F.array_join(F.slice(words, 1, half), " ").alias("question"))
    second = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("corpus_pos"), F.array_join(F.slice(words, half + 1, F.size(words)), " ").alias("text"))

    def found(embedder):
        return vector.nearest(vector.embed(first, embedder, "question"), vector.embed(second, embedder), 1).where("qid = chunk_id").count() / docs.count()

    fitted, hashed = found(latent.fit(docs, "doc_id")), found(vector.HashedTerms(latent.DIMENSIONS))
    assert fitted > 0.6 and fitted > 2 * hashed


def test_texts_are_embedded_some_at_a_time(spark):
    class Counts:
        def embed(self, texts):
            return np.array([[len(texts), len(t)] for t in texts], np.float32)

    rows = spark.range(1500).selectExpr("id", "if(id % 7 = 0, null, repeat('x', int(id % 50))) AS text").coalesce(1)
    found = {r.id: r.embedding for r in vector.embed(rows, Counts()).collect()}
    assert len(found) == 1500 and max(n for n, _ in found.values()) <= vector.EMBED_ROWS
    assert all(length == (0 if i % 7 == 0 else i % 50) for i, (_, length) in found.items())
    assert vector.embed(rows.limit(0), Counts()).collect() == []


def test_registered_neighbours_are_those_of_the_vectors(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").toPandas()
    fitted = latent.fit(spark.createDataFrame(docs), "doc_id")
    rows = fitted.embed(docs.text.tolist()).astype(np.float64)
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in queries.latent_neighbours(spark, FOLDER).collect():
        got.setdefault(int(r.qid), {})[r.vec_rank] = (int(r.chunk_id), r.distance)
    assert sorted(got) == [i for i in docs.doc_id if i % 100 == 0]
    place = {d: i for i, d in enumerate(docs.doc_id)}
    for qid, near in got.items():
        far = 1 - unit @ unit[place[qid]]
        assert [near[k][1] for k in range(1, 11)] == pytest.approx(np.sort(far)[:10], abs=2e-4)
        assert all(far[place[c]] == pytest.approx(d, abs=2e-4) for c, d in near.values())


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("bounds", [{"most_rows": 7}, {"most_bytes": 600}])
def test_many_queries_are_met_in_groups(spark, scoped, bounds):
    """Groups and shares give the candidates that sending all queries gives; most rows are of one scope."""
    rng = np.random.default_rng(5)
    of = lambda name, n: [(f"{name}{i}", i, "A" if i % 3 else "B", rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(n)]
    rows = spark.createDataFrame(of("c", 200), "chunk_id string, corpus_pos long, scope string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(of("q", 40), "qid string, corpus_pos long, scope string, embedding array<double>").drop("corpus_pos").repartition(3)
    ready = functools.partial(vector._cosine, scoped)

    def best(found):
        out = {}
        for r in sorted(found.collect(), key=lambda r: (r.qid, r.distance, r.corpus_pos)):
            out.setdefault(r.qid, []).append((r.chunk_id, r.distance))
        return {q: near[:4] for q, near in out.items()}

    few = vector.compared(asked, rows, ready, 4)
    many = vector.compared(asked, rows, ready, 4, **bounds)
    assert [("pass_by" in f._jdf.queryExecution().toString()) for f in (few, many)] == [False, True]
    assert best(many) == best(few) and len(best(few)) == 40
    assert best(vector.compared(asked.limit(0), rows, ready, 4)) == {} and best(vector.compared(asked, rows.limit(0), ready, 4, **bounds)) == {}
