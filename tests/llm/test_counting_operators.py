"""Token counts, filter interactions and whitening against libraries and brute force."""

import itertools
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import filter_audit, queries, token_counts, whitening
from gneiss.llm.token_counts import ShortcutCounter, count_tokens
from tests.compare import FOLDER

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


# -- token counts --------------------------------------------------------------------------


def test_look_up_holds_only_what_encodes_alone():
    counter = token_counts.Counter.load(MODEL)
    assert isinstance(counter, ShortcutCounter) and len(counter.whole) > 20_000
    for word in sorted(counter.whole)[::97]:
        assert len(LIBRARY.encode("\n" + word)) == len(LIBRARY.encode("\n")) + 1, word


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abthe ▁\n\t\r\0é漢🙂<s>/'.,ﬁÅ", max_size=40) | st.text(max_size=40))
def test_counts_are_the_librarys(text):
    (n, whole), = token_counts.Counter.load(MODEL).counts([text])
    assert n == len(LIBRARY.encode(text)) and whole <= n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, LIBRARY.get_piece_size() - 1), max_size=12))
def test_counts_of_joined_pieces(ids):
    text = "".join(LIBRARY.id_to_piece(i).replace("▁", " ") for i in ids)
    assert token_counts.Counter.load(MODEL).counts([text])[0][0] == len(LIBRARY.encode(text))


def test_memory_is_bounded_and_long_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 50)
    counter = token_counts._model_counter(MODEL)
    texts = [f"qx{i}zj wq{i}kk {'zq' * 100}" for i in range(400)]
    for at in range(0, 400, 20):
        assert [n for n, _ in counter.counts(texts[at : at + 20])] == [len(x) for x in LIBRARY.encode(texts[at : at + 20])]
        assert len(counter.memory) <= 50 and all(len(word) <= token_counts.MEMORABLE for word in counter.memory)


def test_files_that_allow_no_cuts_are_counted_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), ["", "Hello  there\n", "a<|endoftext|>b"]
    counter = token_counts.Counter.load(path)
    assert not isinstance(counter, ShortcutCounter)
    assert counter.counts(texts) == [(len(library.encode(t, add_special_tokens=False).ids), 0) for t in texts]


def test_token_counts_of_odd_tables(spark):
    long = "the cat qqzzk " * 60_000
    texts = [None, "", " ", "the", long, "the", "x" * 5000, "漢字"]
    rows = spark.createDataFrame([(None if t == "漢字" else i, t, 5, 6) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int, n_bytes int")
    found = {r.doc_id: r for r in count_tokens(rows, MODEL, 4096).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        r = found[None if text == "漢字" else i]
        n = len(LIBRARY.encode(text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 4096)
    assert count_tokens(rows.limit(0), MODEL, 9).collect() == []
    with pytest.raises(TypeError):
        count_tokens(rows.selectExpr("string(doc_id) as doc_id", "text"), MODEL, 9)


def test_query_of_token_counts(spark):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.op12_token_counts(spark, FOLDER).collect()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in found.items()} == {i: (len(t.encode()), len(LIBRARY.encode(t))) for i, t in documents.items()}
    assert sum(r.n_whole for r in found.values()) > 0


# -- filter interactions -------------------------------------------------------------------


def failures(docs):
    """The filters that each document fails, by the contract's words."""
    out = []
    for doc_id, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({
            name for name, fails in {
                "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": re.search(r"[#$%&*|]", text), "E": any(o[0] is not None and doc_id is not None and o[0] < doc_id and (o[1] or "") == text for o in docs),
            }.items() if fails
        })
    return out


def brute(docs, labels):
    found, fails = {}, failures(docs)
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        total, rows = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                out = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                total[name] += len(out)
                rows["".join(order), step] = (
                    len(left), len(out), sum(name in f for _, f in own) - len(out), sum(f == {name} for _, f in own),
                    sum(i in good for i, _ in out), sum(i in toxic for i, _ in out),
                )
        for (order, step), row in rows.items():
            found[part, order, step] = (*row, total[order[step - 1]])
    return found


def test_audit_of_odd_tables(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)] + ["ABC", "D#", "e|f", "é"]
    docs = [(1, None, None), (2, "", "en"), (3, " \n ", "en"), (None, "same", "de"), (7, "same", "de"), (7, "same", None), (8, "same", "en"), (9, "same ", "en")]
    for i in range(60):
        size = int(rng.choice([30, 250, 400]))
        words = rng.choice(vocabulary[: int(rng.choice([20, 504]))], size)
        docs.append((20 + i, " ".join(words) + rng.choice(["", " LOUD" * 20, " $"]), rng.choice(["en", "de", "xx"])))
    docs += [(200 + i, docs[-1 - i][1], "en") for i in range(9)]
    docs.append((300, "word other " * 40_000, "en"))
    docs = [(None if d[0] is None else int(d[0]), None if d[1] is None else str(d[1]), None if d[2] is None else str(d[2])) for d in docs]
    labels = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 90)] + [(21, 1, 0), (21, 0, 1), (None, 1, 1), (22, None, None), (9999, 1, 1)]
    docs_df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, lang string, part string, E int, good int")
    labels_df = spark.createDataFrame([(*l, "y") for l in labels], "doc_id long, quality int, toxic int, text string")
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_documents(docs_df, labels_df).collect()}
    assert found == brute(docs, labels)
    assert filter_audit.audit_documents(docs_df.limit(0), labels_df).collect() == []
    bare = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_documents(docs_df, labels_df.limit(0)).collect()}
    assert bare == brute(docs, [])
    with pytest.raises(TypeError):
        filter_audit.audit_documents(docs_df.selectExpr("string(doc_id) as doc_id", "text", "lang"), labels_df)


def test_a_node_is_made_once_for_each_set_of_filters(spark):
    rows = spark.createDataFrame([("p", True, False, i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(30)], "part string, good boolean, toxic boolean, X boolean, Y boolean, Z boolean")
    told = []
    filter_audit.walk(rows, "XYZ", lambda edges: told.append({(r.done, r.filter): (r.present, r.removed) for r in edges.collect()}))
    assert len(told) == 7 and sum(map(len, told)) == 12
    assert {d for edges in told for d, _ in edges} == set(range(7))
    every = {k: v for edges in told for k, v in edges.items()}
    assert every[0, 0] == (30, 15) and every[0b11, 2] == (10, 2)
    assert len({r.filter_order for r in filter_audit.audit(rows, "XYZ").collect()}) == 6
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# -- whitening -----------------------------------------------------------------------------


def whitened(vectors, k=4):
    """n, exact deviations, whitened rows up to sign, explained shares."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    mean = np.array([float(Fraction(s, n)) for s in total])
    centred = np.array(fit, float) - mean
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, deviations, (np.array(x, float) - mean) @ basis / np.sqrt(values), values / (centred**2).sum() * n


def check(found, vectors, k=4):
    n, deviations, white, explained = whitened(vectors, k)
    rows = {}
    for r in found:
        rows.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for i, vector in rows.items():
        assert sorted(vector) == list(range(1, k + 1))
        for c, r in vector.items():
            assert (r.n, r.deviation) == (n, deviations[i])
            assert abs(r.explained - explained[c - 1]) <= 1e-9 and r.identity_error <= 1e-9
            want = white[i][c - 1]
            assert abs(abs(r.whitened) - abs(want)) < 1e-8
            if abs(want) > 1e-6:
                assert signs.setdefault(c, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
    assert len(rows) == len(vectors)


@pytest.mark.parametrize(("dimensions", "tile", "square", "rows"), [(5, 2, 1, 3), (7, 3, 2, 1000), (6, 32, 32, 4)])
def test_tiles_of_any_size_give_the_covariance(spark, monkeypatch, dimensions, tile, square, rows):
    for name, value in (("TILE", tile), ("SQUARE", square), ("ROWS", rows)):
        monkeypatch.setattr(whitening, name, value)
    rng = np.random.default_rng(dimensions)
    vectors = (rng.normal(size=(60, dimensions)) * np.arange(1, dimensions + 1) * 40).tolist()
    vectors += vectors[:9] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    check(whitening.whiten(df).collect(), vectors)


def test_whitening_of_odd_tables(spark):
    vectors = [[0.1, 2.5], [-0.0, 1.0], [3.25, -7.5], [0.1, 2.5], [0.1001, 2.5]]
    odd = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [1e300, 0.0], [1.0, 2.0, 3.0]]
    schema = "vec_id int, embedding array<double>, x string, dims int, n int"
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in enumerate(vectors + odd)], schema)
    check(whitening.whiten(df).collect(), vectors, 2)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id between 5 and 9")).collect() == []
    one, = [whitening.whiten(df.where("vec_id = 0"), components=1).collect()]
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, 1, 1, 0, None, 0.0, None)]
    flat = [[float(i), 1.0, 2.0 * i] for i in range(5)]  # one component has all the variance
    found = whitening.whiten(spark.createDataFrame(list(enumerate(flat)), "vec_id long, embedding array<float>")).collect()
    assert {(r.component, r.whitened is None, r.explained > 0.999) for r in found} == {(1, False, True), (2, True, False), (3, True, False)}
    large = [[2.0**50, 1.0], [-(2.0**50), 0.5], [0.0, 3.0]]  # deviations past 64 bits are null, the rest holds
    found = whitening.whiten(spark.createDataFrame(list(enumerate(large)), "vec_id long, embedding array<double>"), 1).collect()
    n, deviations, white, _ = whitened(large, 1)
    assert {r.vec_id: r.deviation for r in found} == {i: d if d < 1 << 63 else None for i, d in enumerate(deviations)}
    assert np.allclose(sorted(abs(r.whitened) for r in found), sorted(np.abs(white[:, 0])))


def test_packed_rows_are_equal_where_the_vectors_are():
    x = np.array([[1, -2, 3], [1, -2, 40_000], [1 << 40, 0, -1], [-32768, 32767, 0], [-32769, 0, 0], [-(1 << 63), 0, 0]], np.int64)
    packed = whitening._packed(x)
    assert [len(p) for p in packed] == [7, 13, 25, 7, 13, 25]
    assert (whitening._unpacked(packed, 3) == x).all() and len(set(packed)) == len(x)


def test_query_of_whitening(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    assert sorted(vectors) == list(range(len(vectors)))
    check(queries.op13_embedding_whitening(spark, FOLDER).collect(), [vectors[i] for i in range(len(vectors))])
