"""The store's versions, files and inverted index against plain scans of the same chunks."""

import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import coded, index, lexical, postings, vector
from gneiss.plans import api, store_queries
from gneiss.schemas import CHUNK
from gneiss.sources import store as S
from gneiss.sources.snapshots import Conflict
from gneiss.sources.store import Store, companies, stats, table_counts
from tests.compare import FOLDER


def rows_of(spark, *rows):
    """(id, ticker, form, accession, section, text), in this order."""
    full = [(c, 0, "table" if "tab" in x else "text", "", t, f, "d", "p", a, s, x, "u", "n", i) for i, (c, t, f, a, s, x) in enumerate(rows)]
    return spark.createDataFrame(full, CHUNK + ", seq int")


WORDS = [f"word{i}" for i in range(60)] + ["aaaa", "bbbb", "market", "risks", "tab"]


def corpus(seed, n, tickers=("AAAA", "BBBB", "CC.C"), first=0):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(WORDS[: rng.choice([5, 65])]) for _ in range(k))
    return [(f"c{first + i}", rng.choice(tickers), rng.choice(["10-K", "8-K"]), f"acc{(first + i) // 4}", pick(2), pick(rng.randrange(1, 40))) for i in range(n)]


def asked(spark, scoped, *texts):
    rows = [(f"q{i}", text, ticker) for i, text in enumerate(texts) for ticker in (("AAAA",) if scoped else ("",))]
    return api.asked(spark.createDataFrame(rows, "qid string, question string, ticker string"), scoped)


def scores(rows):
    return sorted((r.qid, r.chunk_id, r.relevance, r.gate, round(r.coverage, 9), r.lex_rank) for r in rows.collect())


QUESTIONS = ("word3 word59 market", "risks", "aaaa word1 word2 word3 word4 word0", "nothing known", "tab market risks word33")


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """A store after commits that add, replace (texts, companies, filings) and repeat chunks."""
    store = Store(spark, str(tmp_path_factory.mktemp("store") / "s"), buckets=4)
    store.upsert(rows_of(spark, *corpus(1, 120)))
    store.upsert(rows_of(spark, *corpus(2, 40, first=60), *corpus(3, 30, ("DDDD",), first=300)))
    moved = [(c, "AAAA", f, a, s, x) for c, _, f, a, s, x in corpus(4, 12, first=100)]
    store.upsert(rows_of(spark, *moved, ("c0", "BBBB", "8-K", "acc0", "market", "market word0 tab")), replace_filings=True)
    return store


def test_counts_of_commits_add_up_to_a_full_count(spark, grown):
    chunks = grown.scan()
    found = grown.index()
    df = found.differences.groupBy("ticker", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    want = index.document_frequency(index.postings(chunks))
    assert {tuple(r) for r in df.select("ticker", "term", "df").collect()} == {tuple(r) for r in want.collect()}
    totals = found.totals.groupBy("ticker").agg(F.sum("n_docs").alias("n"), F.sum("total_len").alias("len")).where("n <> 0")
    full = chunks.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("len"))
    assert {tuple(r) for r in totals.collect()} == {tuple(r) for r in full.collect()}


def test_counts_of_files_are_those_of_the_rows(grown):
    chunks = grown.scan()
    assert grown.count() == chunks.count()
    assert sorted(map(repr, grown.companies().collect())) == sorted(map(repr, companies(chunks).collect()))
    assert grown.stats().first() == stats(chunks).first() and grown.table_counts().first() == table_counts(chunks).first()
    plan = grown.stats()._jdf.queryExecution().toString()
    assert "/chunks/" not in plan
    assert grown.is_indexed("dddd") and not grown.is_indexed("NOPE")


@pytest.mark.parametrize("scoped", [True, False])
def test_scores_are_those_of_a_scan(spark, grown, scoped):
    batch = asked(spark, scoped, *QUESTIONS)
    scan = index.build(grown.scan(), "ticker" if scoped else None)
    want = lexical.score(batch, scan)
    assert scores(lexical.score(batch, grown.index(scoped))) == scores(want) != []
    for limit in (1, 3, 10):
        assert scores(lexical.retrieve(batch, grown.index(scoped), limit)) == scores(lexical.retrieve(batch, scan, limit))
    asked_in_blocks = grown.index(scoped).product(batch, 3)
    assert scores(grown.index(scoped).named(asked_in_blocks)) == scores(grown.index(scoped).named(grown.index(scoped).top(batch, 3)))
    assert grown.index(scoped).dead is not None


def test_products_of_many_questions(spark, grown, monkeypatch):
    for name, value in (("QUESTIONS", 7), ("DENSE", 4), ("STEP", 5)):
        monkeypatch.setattr(postings, name, value)
    rng = random.Random(9)
    batch = asked(spark, True, *(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) for _ in range(60)))
    found = grown.index()
    assert scores(found.named(found.product(batch, 2))) == scores(lexical.score(batch, index.build(grown.scan())).where("lex_rank <= 2")) != []
    assert found.product(batch.limit(0)).collect() == []


def test_products_pack_questions_and_meet_them_in_groups(spark, tmp_path, monkeypatch):
    """No row of a question or of a posting goes with a block and a window; the best of groups and shares are the best."""
    for name, value in (("WINDOW", 16), ("QUESTIONS", 5), ("HELD", 3), ("LEAST_WINDOWS", 2)):
        monkeypatch.setattr(postings, name, value)
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.upsert(rows_of(spark, *corpus(11, 130)))
    store.upsert(rows_of(spark, *corpus(12, 30, first=20)))
    rng = random.Random(9)
    texts = [" ".join(rng.choice([*WORDS, "aaaa", "bbbb"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    for scoped in (True, False):
        batch, found = asked(spark, scoped, *texts), store.index(scoped)
        best = found.product(batch, 3)
        plan = best._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" not in plan and "data" in plan
        want = lexical.score(batch, index.build(store.scan(), "ticker" if scoped else None)).where("lex_rank <= 3")
        assert scores(found.named(best)) == scores(want) != []


def test_scores_in_small_windows_and_of_large_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "WINDOW", 8)
    monkeypatch.setattr(postings, "PROBED", 1)
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.upsert(rows_of(spark, *corpus(7, 150, ("AAAA",))))
    store.upsert(rows_of(spark, *corpus(8, 30, ("AAAA",), first=20)))
    batch, scan = asked(spark, True, *QUESTIONS), index.build(store.scan())
    assert scores(lexical.retrieve(batch, store.index(), 3)) == scores(lexical.retrieve(batch, scan, 3))
    for module in (postings, lexical):
        monkeypatch.setattr(module, "if_small", lambda df, *bounds: None)
    assert scores(lexical.retrieve(batch, store.index(), 3)) == scores(lexical.retrieve(batch, scan, 3))
    assert scores(lexical.score(batch, store.index())) == scores(lexical.score(batch, scan))


def rows_read(df, table):
    """Rows that came out of the scans of a table as the plan ran."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value() if f"/{table}" in node.toString() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_questions_read_the_buckets_of_their_terms_and_no_window_that_cannot_win(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "WINDOW", 16)
    store = Store(spark, str(tmp_path / "s"), buckets=32)
    dull = [(f"d{i}", "AAAA", "10-K", "x", "plain", "market " + " ".join(f"other{i}x{k}" for k in range(30))) for i in range(600)]
    dull[400] = ("best", "AAAA", "10-K", "x", "market", "market risks market")
    store.upsert(rows_of(spark, *dull))
    batch, found = asked(spark, True, "market risks"), store.index()
    everything = found.blocks.count()
    assert rows_read(found.relevances(batch), "postings") < everything / 8
    top = found.top(batch, 1)
    assert [found.named(top).first().chunk_id] == ["best"]
    bounds = {r.window: r.bound for r in found.bounds(batch).collect()}
    exact = {}
    for r in found.relevances(batch).collect():
        exact[r.corpus_pos // 16] = max(exact.get(r.corpus_pos // 16, 0), r.relevance)
    assert bounds.keys() == exact.keys() and all(bounds[w] >= exact[w] for w in exact)
    best = max(exact.values())
    assert sum(b >= best for b in bounds.values()) == 1  # one window of 38 is left when the best score is known


def test_versions_stay_as_they_were(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, ("a", "AAAA", "8-K", "x", "s", "one"), ("b", "AAAA", "8-K", "x", "s", "two"), ("a", "AAAA", "8-K", "x", "s", "three")))
    opened = store.scan()
    assert [(r.chunk_id, r.text) for r in opened.orderBy("corpus_pos").collect()] == [("a", "three"), ("b", "two")]
    store.upsert(rows_of(spark, ("b", "BBBB", "8-K", "y", "s", "moved"), ("c", "AAAA", "8-K", "x", "s", "new")))
    assert [(r.chunk_id, r.text) for r in opened.orderBy("corpus_pos").collect()] == [("a", "three"), ("b", "two")]
    assert [(r.chunk_id, r.ticker, r.text) for r in store.scan().orderBy("corpus_pos").collect()] == [("a", "AAAA", "three"), ("b", "BBBB", "moved"), ("c", "AAAA", "new")]
    assert {r.text for r in store.scan(version=1).collect()} == {"three", "two"}
    with pytest.raises(ValueError):
        store.scan(version=9)
    before = [tuple(r) for r in store.scan().orderBy("corpus_pos").collect()]
    assert store.compact() == 3 and store.manifest().version == 3 and store.index().dead is None
    assert store.vacuum() > 0 and [tuple(r) for r in store.scan().orderBy("corpus_pos").collect()] == before
    assert {r.term for r in store.index().blocks.collect()} == {"three", "moved", "new"} and store.vacuum() == 0
    with pytest.raises(ValueError):
        store.scan(version=1)


def test_a_commit_without_rows_has_no_part_and_a_lost_part_is_no_empty_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.upsert(rows_of(spark, *corpus(1, 20)))
    assert store.upsert(rows_of(spark, *corpus(1, 20)).where("false")) == 20 and len(store.manifest().parts) == 1
    store.upsert(rows_of(spark, *corpus(2, 5, first=40)))
    assert store.is_whole(3) and not store.is_whole(4)
    assert store.index().totals.agg(F.sum("n_docs")).first()[0] == store.stats().first().chunks == 25
    lost = store.manifest().parts[1].name
    store.versions.delete(f"totals/part={lost}"), store.versions.delete(f"filings/part={lost}")
    assert not store.is_whole(3)
    for read in (lambda: store.index().totals.collect(), lambda: store.companies().collect()):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            read()


def test_only_spaces_of_any_width_are_no_text(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    texts = [" ", "\u00a0", "\u3000 \u2003", "", "\t", "x", "\u00a0x"]  # as DuckDB's trim has them
    assert store.upsert(rows_of(spark, *((f"c{i}", "AAAA", "8-K", "", "", x) for i, x in enumerate(texts)))) == 3


def _slow_store(monkeypatch):
    """Stores that write down their upserts; all are slow and the first is stopped in its second one."""
    done = []

    def upsert(self, rows):
        time.sleep(0.2)
        done.append(self.path)
        if len(done) == 2:
            raise KeyboardInterrupt
        self.versions.commit(replace(self.manifest(), version=self.manifest().version + 1))

    monkeypatch.setattr(Store, "upsert", upsert)
    monkeypatch.setattr(store_queries, "stored_chunks", lambda spark, folder: spark.range(1).selectExpr("id as seq", "'x' as text"))
    return done


def test_the_registered_store_is_never_built_on_what_a_stopped_query_left(spark, monkeypatch):
    done = _slow_store(monkeypatch)
    with pytest.raises(KeyboardInterrupt):
        store_queries.made_store(spark, "stopped")
    store = store_queries.made_store(spark, "stopped")
    assert done == [done[0]] * 2 + [store.path] * 3 and store.path != done[0] and store.is_whole(3)


def test_queries_that_ask_at_once_make_one_store(spark, monkeypatch):
    done = _slow_store(monkeypatch)
    done += [""] * 2
    with ThreadPoolExecutor(4) as threads:
        made = list(threads.map(lambda _: store_queries.made_store(spark, "at once"), range(4)))
    assert len({id(x) for x in made}) == 1 and done[2:] == [made[0].path] * 3


def test_the_registered_store_is_made_again_when_its_folder_was_cleared(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 40").write.parquet(str(tmp_path / "documents.parquet"))
    asked = (store_queries.stored_companies, store_queries.stored_frequency, store_queries.stored_order, store_queries.stored_stats, store_queries.stored_totals)
    rows = lambda: [sorted(map(str, query(spark, str(tmp_path)).collect())) for query in (*asked, store_queries.indexed_rank)]
    before = rows()
    assert all(before)
    store_queries.made_store(spark, str(tmp_path)).versions.delete()
    assert rows() == before


def test_a_writer_that_fails_leaves_the_store_whole(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, ("a", "AAAA", "8-K", "x", "s", "one")))
    for step in ("_describe", "_index"):
        with monkeypatch.context() as broken:
            broken.setattr(Store, step, lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                store.upsert(rows_of(spark, ("a", "AAAA", "8-K", "x", "s", "half"), ("b", "AAAA", "8-K", "x", "s", "way")))
        assert [(r.chunk_id, r.text) for r in store.scan().collect()] == [("a", "one")] and store.count() == 1
        assert [r.term for r in store.index().blocks.collect()] == ["one"]
    assert store.vacuum() > 0 and store.upsert(rows_of(spark, ("b", "AAAA", "8-K", "x", "s", "two"))) == 2


def test_of_two_writers_the_second_merges_anew_or_is_told(spark, tmp_path, monkeypatch):
    first, second = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    first.upsert(rows_of(spark, ("a", "AAAA", "8-K", "x", "s", "one")))
    with pytest.raises(Conflict):
        first.versions.commit(replace(first.manifest(), next_position=77))
    assert first.manifest().next_position == 1
    merge, raced = Store._merge, []

    def late(self, *args):  # another writer commits while this one has its base already
        if not raced:
            raced.append(1)
            base = self.manifest()
            first.upsert(rows_of(spark, ("b", "AAAA", "8-K", "x", "s", "two")))
            monkeypatch.setattr(self, "manifest", lambda version=None: base)
            try:
                return merge(self, *args)
            finally:
                monkeypatch.undo()
        return merge(self, *args)

    monkeypatch.setattr(Store, "_merge", late)
    assert second.upsert(rows_of(spark, ("a", "AAAA", "8-K", "x", "s", "three"), ("c", "AAAA", "8-K", "x", "s", "four"))) == 3
    assert [(r.chunk_id, r.text) for r in first.scan().orderBy("corpus_pos").collect()] == [("a", "three"), ("b", "two"), ("c", "four")]


def test_an_upsert_reads_the_files_that_may_hold_its_ids(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    for k in range(3):
        store.upsert(rows_of(spark, *[(f"{k}:{i}", f"T{k}", "8-K", f"x{k}", "s", f"text {i}") for i in range(40)]))
    read, chunks = [], Store._chunks
    monkeypatch.setattr(Store, "_chunks", lambda self, files, *rest: read.append(list(files)) or chunks(self, files, *rest))
    store.upsert(rows_of(spark, ("1:7", "T1", "8-K", "x1", "s", "changed")))
    assert read and all("ticker=T1" in file for files in read for file in files)
    kept = {f.path for f in store.manifest().files}
    assert len(kept) == 3 and store.count() == 120
    monkeypatch.setattr(S, "if_small", lambda *args: None)  # a batch with too many ids to send
    assert store.upsert(rows_of(spark, ("2:3", "T2", "8-K", "x2", "s", "changed"), ("n", "T2", "8-K", "x2", "s", "new"))) == 121
    assert {r.text for r in store.scan("T2").where("chunk_id in ('2:3', 'n')").collect()} == {"changed", "new"}


def test_filters_hold_all_their_ids_and_few_others():
    rng = np.random.default_rng(0)
    ids, others = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (0, 1))
    bits = S.id_filter(ids)
    assert all(S.may_hold(bits, ids[i : i + 1]) for i in range(0, 5000, 7))
    assert sum(S.may_hold(bits, others[i : i + 1]) for i in range(1000)) < 40
    assert not S.may_hold(S.id_filter(ids[:0]), ids) and not S.may_hold(bits, ids[:0])


def test_postings_are_made_where_the_chunks_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "WINDOW", 8)
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.upsert(rows_of(spark, *corpus(5, 90)))
    made = postings.blocks(store.scan(), 2, 1)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    shuffled = postings.blocks(store.scan().repartition(5), 2, 1)  # a window in several tasks, and out of order
    for rows in (made, shuffled):
        found = {(r.term, r.ticker, p.corpus_pos): (p.tf, p.len, p.head) for r in rows.collect() for p in r.postings}
        want = {}
        for c in store.scan().collect():
            heads = set(c.section.split())
            for term in set(c.terms) | heads:
                want[term, c.ticker, c.corpus_pos] = (c.terms.count(term), len(c.terms), term in heads)
        assert found == want
        for r in rows.collect():
            assert {p.corpus_pos // 8 for p in r.postings} == {r.window} and r.n_text == sum(p.tf > 0 for p in r.postings)
            assert (r.max_tf, r.min_len) == (max(p.tf for p in r.postings), min((p.len for p in r.postings if p.tf), default=0))


def test_replaced_chunks_are_told_by_bits_sent_out_or_joined(spark, tmp_path, monkeypatch):
    batches = [corpus(6, 50), corpus(7, 30, first=20)]
    kept = []
    for most in (S.MARKED_BYTES, 0):
        monkeypatch.setattr(S, "MARKED_BYTES", most)
        store = Store(spark, f"{tmp_path}/{most}", buckets=2)
        for batch in batches:
            store.upsert(rows_of(spark, *batch))
        kept.append(sorted((r.chunk_id, r.corpus_pos, r.text) for r in store.scan().collect()))
    ended = spark.createDataFrame([(p, 1) for p in (0, 7, 8, 32_767, 32_768, 70_001)], "corpus_pos long, version int")
    rows = spark.range(70_100).withColumnRenamed("id", "corpus_pos")
    found = rows.join(S.marks(ended, 70_100), F.col("_mark") == S.place_of_mark(), "left").where(S.is_marked())
    assert sorted(r.corpus_pos for r in found.collect()) == [0, 7, 8, 32_767, 32_768, 70_001]
    text = {c: x for batch in batches for c, *_, x in batch}
    assert kept[0] == kept[1] and {c: x for c, _, x in kept[0]} == text and sorted(p for _, p, _ in kept[0]) == list(range(50))


# -- codes of vectors ----------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(str(i), i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "chunk_id string, corpus_pos long, embedding array<float>")


@pytest.mark.parametrize(("clusters", "probes"), [(0, None), (20, 8)])
def test_codes_find_nine_of_ten_neighbours_and_read_few_vectors(spark, tmp_path, clusters, probes):
    rng = np.random.default_rng(clusters)
    rows = rng.normal(size=(3000, 24))
    if clusters:  # of vectors in clusters few coarse cells need be read
        rows = rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 3000)] * 3 + rows * 0.3
    base = vectors_of(spark, rows)
    queries = base.where("corpus_pos % 100 = 0").selectExpr("chunk_id as qid", "embedding")
    codes = coded.CodedVectors.build(base, str(tmp_path / "codes"))
    want = {(r.qid, r.chunk_id): r.distance for r in vector.nearest(queries, base, 10).collect()}
    got = {(r.qid, r.chunk_id): r.distance for r in codes.nearest(queries, 10, probes).collect()}
    assert len(want.keys() & got.keys()) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want.keys() & got.keys())
    compared = codes.found(queries, 100, probes).groupBy("qid").count().agg(F.max("count")).first()[0]
    assert compared <= 3000 / 5
    every = {(r.qid, r.chunk_id) for r in codes.nearest(queries, 10, candidates=3000).collect()}
    assert every == want.keys()  # with all as candidates it is the exact way


def test_codes_of_odd_tables(spark, tmp_path):
    base = vectors_of(spark, [[1, 0], None, [0, 1], [1, 0], [-1, 0]])
    codes = coded.CodedVectors.build(base, str(tmp_path / "a"))
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("none", None)], "qid string, embedding array<float>")
    found = codes.nearest(queries, 3).orderBy("vec_rank").collect()
    assert [(r.qid, r.chunk_id, r.distance) for r in found] == [("q", "0", 0.0), ("q", "3", 0.0), ("q", "2", 1.0)]
    assert codes.nearest(queries.limit(0), 3).collect() == []
    assert coded.CodedVectors.build(base.where("embedding is null"), str(tmp_path / "b")) is None
