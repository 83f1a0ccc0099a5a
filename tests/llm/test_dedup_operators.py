"""Exact, line, passage and near duplicates and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import bloom, common, exact_dedup, language_id, line_dedup, ngram_join, passage_dedup, secret_scan
from gneiss.llm.components import components, forest
from gneiss.llm.packing import WordTokenizer
from gneiss.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed=3):
    """Copies, near copies in a chain, shared passages and lines, short, blank, null and repeated rows."""
    rng = random.Random(seed)
    texts = [None, "", " ", "\n", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    base = [words(rng, 120, 10_000) for _ in range(12)]
    texts += base + [base[0]] * 9 + [base[1].replace(" ", "\t", 3)] * 4
    for i in range(40):  # a large group whose members differ from each other more or less
        w = base[2].split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"n{i}"
        texts.append(" ".join(w))
    line = "this long line stands in very many of the documents here"
    passage = ". ".join(words(rng, 14, 10_000).capitalize() for _ in range(5)) + "."
    for _ in range(9):
        texts.append(words(rng, 60, 10_000) + "\n" + line + "\n" + words(rng, 30, 10_000))
        texts.append(words(rng, 40, 10_000) + ". " + passage + " " + words(rng, 40, 10_000))
    texts.append(words(rng, 20_000, 10_000))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + rows[:3]


# -- parts ---------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_forest(edges):
    parent = list(range(13))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    u, v = forest(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: find(x) for x in range(13) if find(x) != x}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(50)] + [(7, 7)]
    random.Random(1).shuffle(path)
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 551)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filter_finds_every_repeat(spark):
    rng = np.random.default_rng(2)
    once, twice = rng.integers(0, 1 << 62, 500), rng.integers(0, 1 << 62, 50)
    rows = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h long").repartition(5)
    found = bloom.repeated_filter(rows, ["h"], lambda b: b.column(0).to_numpy().astype(np.uint64), bloom.LEAST_BITS)
    assert bloom.contains(found, twice.astype(np.uint64)).all() and bloom.contains(found, once.astype(np.uint64)).mean() < 0.05
    assert bloom.filter_bits(0) == bloom.LEAST_BITS and bloom.filter_bits(1e18) == bloom.MOST_BITS


def plain_shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\tÉé ", max_size=40)), max_size=8))
def test_shingles_are_hashed_one_to_one(texts):
    seen = {}
    for text, hashes in zip(texts, shingle_sets(texts), strict=True):
        plain = plain_shingles(text)
        assert len(hashes) == len(plain)
        key = tuple(sorted(hashes.tolist()))
        assert seen.setdefault(key, plain) == plain


def test_long_texts_are_hashed_in_slices():
    rng = random.Random(5)
    text = words(rng, 250_000, 10_000)
    (hashes,) = shingle_sets([text])
    assert len(hashes) == len(plain_shingles(text))


# -- exact ---------------------------------------------------------------------------------


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(own), len(own), hashlib.sha256(k.encode()).hexdigest()) for k, own in groups.items() for i in own}


def test_exact_groups(spark):
    rows = corpus()
    found = exact_dedup.duplicate_groups(frame(spark, rows).withColumn("digest", F.lit("x")).repartition(6)).collect()
    want = plain_exact(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.keep_id, r.group_size, r.digest.hex()) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.keep_first(frame(spark, rows).repartition(6))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for k, *_ in want.values()})
    clash = {c: F.lit(1) for c in ("digest", "first_digest", "first_id", "keep_id", "group_size", "kept", "_digest")}
    kept = exact_dedup.keep_first(frame(spark, rows).withColumns(clash))
    assert kept.columns[-7:] == list(clash) and kept.count() == len({k for k, *_ in want.values()})
    assert exact_dedup.duplicate_groups(frame(spark, [])).collect() == [] == exact_dedup.keep_first(frame(spark, [])).collect()


def test_exact_groups_without_ids(spark):
    rows = [(None, "x"), (None, "x"), (5, "y"), (None, "y"), (3, "y")]
    found = sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in exact_dedup.duplicate_groups(frame(spark, rows)).collect())
    assert found == [(0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True), (5, 3, False)]
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep_first(frame(spark, rows)).collect()) == [(0, "x"), (3, "y")]


# -- lines ---------------------------------------------------------------------------------


def plain_lines(rows, least_chars=40, least_docs=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append(i)
    stays = {k: max(own) for k, own in holders.items() if len(own) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if stays.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rows = corpus()
    line = "É" * 39 + "x"
    extra = [(900 + i, f"a{i}\n\t {line if i % 2 else line.replace('x', 'X')} \r\n{'y' * 39}\n{line}") for i in range(6)]
    rows += extra
    found = line_dedup.drop_repeated_lines(frame(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found) == sorted(plain_lines(rows))
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in found)
    assert "text" not in line_dedup.drop_repeated_lines(frame(spark, []), with_text=False).columns
    assert line_dedup.drop_repeated_lines(frame(spark, [])).collect() == []


# -- passages ------------------------------------------------------------------------------


WHITE = " \t\n\x0b\f\r"


def plain_passages(rows, least=20):
    """Spans that go, from the definition alone: every stretch of sentences is tried, none is hashed."""
    places = defaultdict(list)  # unit -> (doc_id, line, first, last) in order
    cut = {}
    for i, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or "")):
        at = 0
        for number, line in enumerate((text or "").split("\n")):
            found, begin = [], 0
            ends = [k + 1 for k, c in enumerate(line) if c in ".!?" and line[k + 1 : k + 2] and line[k + 1] in WHITE or c in "。！？" and line[k + 1 : k + 2] not in tuple("。！？")]
            for end in [*ends, len(line)]:
                body = line[begin:end].strip(WHITE)
                if body:
                    first = at + line.index(body, begin)
                    form = " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.split(f"[{WHITE}]+", body))
                    n = len(re.findall(f"[{passage_dedup.DENSE}]|[^ {passage_dedup.DENSE}]+", form))
                    found.append((first, first + len(body), form, n))
                begin = end
            cut[i, text, number] = found
            at += len(line) + 1
            total = lambda a, b: sum(s[3] for s in found[a : b + 1])  # noqa: B023, E731
            for a in range(len(found)):
                for b in range(a, len(found)):
                    if total(a, b) >= least and (b == a or total(a, b - 1) < least or total(a + 1, b) < least):
                        places[" ".join(s[2] for s in found[a : b + 1])].append((i, text, number, a, b))
    gone = defaultdict(dict)
    for own in places.values():
        for i, text, number, a, b in own:
            same = [p for p in own if p[:2] == (i, text)][0]
            if own[0][0] < i or number > same[2] or number == same[2] and a > same[4]:
                for k in range(a, b + 1):
                    gone[i, text, number][k] = min(own[0][0], gone[i, text, number].get(k, i))
    out = set()
    for (i, text, number), lost in gone.items():
        for k in sorted(lost):
            if k - 1 not in lost:
                last = k
                while last + 1 in lost:
                    last += 1
                s = cut[i, text, number]
                out.add((i, text[s[k][0] : s[last][1]], s[k][0], sum(x[3] for x in s[k : last + 1]), min(lost[x] for x in range(k, last + 1))))
    return out


def passages(spark, rows, **how):
    found = passage_dedup.repeated_passages(frame(spark, rows).withColumns({c: F.lit(1) for c in ("digest", "keeper", "lost")}).repartition(4), **how).collect()
    assert all(r.span_end - r.span_start == len(r.passage) for r in found)
    got = [(r.doc_id, r.passage, r.span_start, r.n_words, r.keep_id) for r in found]
    assert len(got) == len(set(got))
    return set(got)


def test_passages(spark):
    rng = random.Random(8)
    rows = corpus()
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "d.", "e!", "f?!", "é.", "。"]) for _ in range(n))
    many = [text(60) for _ in range(12)]
    rows += [(3000 + k, f"{rng.choice(many)}\n{text(9)} {rng.choice(many)}\t{text(4)}\n\n{rng.choice(many)}") for k in range(40)]
    rows += [(None, many[0]), (3000, many[1]), (4000, "x. " * 90), (4001, many[2] * 8)]
    want = plain_passages(rows)
    assert passages(spark, rows) == want and len(want) > 60
    assert passages(spark, rows[:80], least_words=3) == plain_passages(rows[:80], 3)
    assert passages(spark, []) == set() == passages(spark, [(None, many[0]), (None, many[0]), (1, None), (2, ""), (3, None)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12), st.integers(1, 15))
def test_paragraphs(words, least):
    n = len(words)
    enough = [(a, b) for a in range(n) for b in range(a, n) if sum(words[a : b + 1]) >= least]
    want = {(a, min(y for x, y in enough if x == a)) for a, _ in enough} | {(max(x for x, y in enough if y == b), b) for _, b in enough}
    assert passage_dedup.paragraphs(words, least) == sorted(want)


def test_passages_inside_lines_go_whole(spark):
    """A passage of whole sentences within other text, which no hash of whole lines finds; short lines stay."""
    rng = random.Random(12)
    say = lambda *sizes: " ".join(words(rng, n, 10_000).capitalize() + "." for n in sizes)
    shared, line = say(3, 14, 2, 30, 9, 1), "All rights reserved"
    rows = [(k, f"{say(12, 3)} {shared} {say(30)}\n{line}\n{say(25)}") for k in (5, 3, 9)]
    assert {(r[0], r[1], r[3], r[4]) for r in passages(spark, rows)} == {(5, shared, 59, 3), (9, shared, 59, 3)}


def test_passages_without_spaces_and_of_short_sentences(spark):
    short = " ".join(f"W{i}!!" for i in range(25))
    dense = "人人生而自由在尊严和权利上一律平等。他们赋有理性和良心并应以兄弟关系的精神相对待。"
    rows = [(1, f"Own a.\n{short}\n{dense}"), (2, f"Other b.\n{short}\nMine c."), (3, f"{dense}另有一句话在这里。\nEnd d.")]
    assert {(r[0], r[1], r[3], r[4]) for r in passages(spark, rows)} == {(2, short, 25, 1), (3, dense, len(dense), 1)}


def test_passages_of_a_document_that_repeats_itself(spark):
    line = " ".join(f"v{i}" for i in range(30))
    rows = [(1, f"{line}\nown one\n{line}"), (2, f"{line}\nyours two"), (3, f"Alone\n{line} z\n{line} Z")]
    assert {(r[0], r[2], r[4]) for r in passages(spark, rows)} == {(1, len(line) + 9, 1), (2, 0, 1), (3, len(line) + 9, 3)}
    long = " ".join(f"u{i}" for i in range(200_000))
    assert {(r[0], r[3]) for r in passages(spark, [(1, long), (2, long), (3, f"x. {long}")])} == {(2, 200_000), (3, 200_000)}


# -- near duplicates -----------------------------------------------------------------------


def plain_near(rows):
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("rows_a_block", [256, 4])
def test_near_duplicates(spark, rows_a_block):
    rows = corpus()
    found = ngram_join.near_duplicates(frame(spark, rows).withColumn("node", F.lit(1)).repartition(5), rows_a_block=rows_a_block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == plain_near(rows)


def test_near_duplicates_at_the_threshold(spark):
    # Sets of 7 shingles each, 6 of them shared: 6 of 8, exactly 75 in 100; and one fewer.
    w = [f"t{i}" for i in range(11)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:10], "z"])), (3, " ".join([*w[:9], "y", "x"])), (4, "")]
    found = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_near(rows)
    assert {r.doc_id: r.component_id for r in found}[2] == 1 and {r.doc_id: r.component_id for r in found}[3] == 3
    assert ngram_join.near_duplicates(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=9))
def test_product_links(sets):
    sizes = np.array([len(s) for s in sets])
    nodes = np.arange(len(sets))
    u, v = ngram_join.product_links(nodes, sizes, [np.array(sorted(s), np.uint64) for s in sets], 75, 100)
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    x, y = forest(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == dict(zip(x.tolist(), y.tolist(), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 13), min_size=2, max_size=14, unique=True), max_size=30))
def test_overlaps(columns):
    pairs = [(r, c) for c, rows in enumerate(columns) for r in rows]
    got = ngram_join.overlaps(np.array([r for r, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int64), 14)
    want = [[sum(a in rows and b in rows for rows in columns) for b in range(14)] for a in range(14)]
    assert all(got[a][b] == want[a][b] for a in range(14) for b in range(14) if a != b)


def test_sizes_within_the_bound_are_of_neighbouring_levels(spark):
    n = np.arange(1, 20_000)
    level = ngram_join._level(n)
    assert (level[ngram_join.need(n) - 1] >= level - 1).all() and level[-1] > 30
    column = spark.range(1, 20_000, 7).select(ngram_join._level(F.col("id")).alias("level")).collect()
    assert [r.level for r in column] == level[::7].tolist()


def test_names_that_sets_share_are_given_to_none(spark):
    rows = corpus()
    nodes = frame(spark, rows)
    taken = frozenset(r.node for r in ngram_join._linked(nodes, 75, 100, 128, "doc_id", "text")[1].collect() if r.node % 2)
    docs, again, linked, after = ngram_join._linked(nodes, 75, 100, 128, "doc_id", "text", taken)
    assert after == taken and not taken & {r.node for r in again.collect()}
    root = {r.node: r.root for r in linked.collect()}
    groups = defaultdict(set)
    for r in docs.where("node is not null").collect():
        groups[root.get(r.node, r.node)].add(r.doc_id)
    plain = defaultdict(set)
    for i, n, c in plain_near(rows):
        if n:
            plain[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_a_cluster_of_many_sizes_and_strangers(spark):
    """Rows chained by shared passages, most of them not linked, in blocks of few rows."""
    rng = random.Random(14)
    shared = [words(rng, 60, 10_000) for _ in range(3)]
    rows = [(i, f"{shared[i % 3]} {words(rng, 2 + i, 10_000)} {shared[(i + 1) % 3] if i % 2 else ''}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " z" * (i % 3)) for i in range(0, 60, 2)]
    found = ngram_join.near_duplicates(frame(spark, rows).repartition(5), rows_a_block=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == plain_near(rows)


def test_block_pairs_go_in_rounds(spark, monkeypatch):
    """However many pairs of blocks there are, a round sends no more shingles than the clusters have (here: about)."""
    rng, sent = random.Random(14), []
    shared = [words(rng, 60, 10_000) for _ in range(3)]
    rows = [(i, f"{shared[i % 3]} {words(rng, 2 + i, 10_000)} {shared[(i + 1) % 3] if i % 2 else ''}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " z" * (i % 3)) for i in range(0, 60, 2)]
    links = ngram_join._links

    def seen(part, keys, *rest):
        sent.append((keys[-1], part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
        return links(part, keys, *rest)

    monkeypatch.setattr(ngram_join, "_links", seen)
    monkeypatch.setattr(ngram_join, "LEAST_ROUND", 1)
    found = ngram_join.near_duplicates(frame(spark, rows), rows_a_block=2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == plain_near(rows)
    rounds = [n for key, n in sent if key == "y"]
    assert len(rounds) > 1 and max(rounds) < 2 * sum(rounds) / len(rounds)


@pytest.mark.parametrize("passes", [1, 3])
def test_own_shingles_are_counted_in_parts_of_their_range(spark, monkeypatch, passes):
    df = frame(spark, corpus()).repartition(3)
    monkeypatch.setattr(ngram_join, "PASSES", passes)
    texts = {x for _, x in corpus() if x and x.split()}
    sets = {x: ngram_join.shingle_sets([x])[0] for x in texts}
    holders, nodes = defaultdict(set), {}
    for hashes in sets.values():
        node = nodes[len(nodes)] = ngram_join._node(ngram_join._digest(hashes), frozenset())
        for h in hashes.tolist():
            holders[h].add(node)
    for k in range(passes):
        low, high = ((24 << 58) * e // passes for e in (k, k + 1))
        want = Counter(next(iter(own)) for h, own in holders.items() if len(own) == 1 and low <= h < high)
        assert {r.node: r.alone for r in ngram_join._alone(df, "text", frozenset(), k, 3).collect()} == dict(want)


def test_what_a_written_table_shuffled_is_gone_with_the_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before, kept = blocks(), spark.conf.get(common._CLEANUP, None)
    rows = common.durable(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(9).withColumnRenamed("id", "k").hint("merge"), "k"))
    assert not blocks() - before and rows.count() == 7 and spark.conf.get(common._CLEANUP, None) == kept


def test_links_are_written_before_they_are_put_together(spark, monkeypatch):
    rng, plans = random.Random(5), []
    base = words(rng, 300).split()
    rows = [(i, " ".join([*base[: 200 + i % 80], f"x{i}"])) for i in range(60)]

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(ngram_join, "components", seen)
    ngram_join.near_duplicates(frame(spark, rows), rows_a_block=4).collect()
    assert len(plans) == 3 and not any("MapInArrow" in p for p in plans)



def test_representatives_stay(spark):
    rows = [r for r in corpus() if r[1] is not None]
    kept = ngram_join.keep_representatives(frame(spark, rows).withColumns({c: F.lit(1) for c in ("gone", "node", "component_id")})).drop("gone", "node", "component_id")
    want = {c for _, _, c in plain_near(rows)}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_row_of_a_group_stays_with_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (words(rng, 60, 10_000) for _ in range(4))
    rows = [(1, a), (2, a + " x"), (2, b), (None, c), (None, c + " x"), (7, d), (7, d + " x"), (7, d), (None, ""), (2, ""), (2, "")]
    kept = sorted((r.doc_id or 0, r.text[:-2] if r.text.endswith(" x") else r.text) for r in ngram_join.keep_representatives(frame(spark, rows)).collect())
    assert kept == sorted([(1, a), (2, b), (0, c), (7, d), (0, ""), (2, ""), (2, "")])


# -- pipeline ------------------------------------------------------------------------------


def test_stages_are_the_five_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "secret_scan", "packing"]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = corpus(4) + [(2000, "12 34"), (2001, "key password=abcdefghijkl0123 end of text here now")]
    rows = list({i: (i, t) for i, t in rows}.values())
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    rng.shuffle(rows)
    rows = [(i, t) for i, t in rows if language_id.has_letter(t or "")]
    exact = plain_exact(rows)
    rows = [(i, t) for i, t in rows if exact[i][0] == i]
    keep = {c for _, _, c in plain_near(rows)}
    tokens = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), 1000)
    want = {i: len(tokens.encode(secret_scan.redact(t))) + 1 for i, t in rows if i in keep}
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id] += r.length
    assert dict(pieces) == want


# -- odd tables ----------------------------------------------------------------------------


ODD = "doc_id long, text string, lang string, source string, n_chars long, digest int, node int, gone int, lost int, keeper int, tier int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4, 5, 6) for i, t in rows], ODD)


def odd_rows():
    long = " ".join(f"v{i % 5000}" for i in range(150_000))
    return [(None, None), (None, "the ship and the thing"), (1, None), (1, ""), (2, "  \n\n "), (2, "12 34"), (3, long), (3, long), (4, long + " x"), (5, "the ship and the thing")]


def test_operators_on_odd_tables(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing columns; each against its plain form."""
    rows = odd_rows()
    df = odd(spark, rows).repartition(3)
    found = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in exact_dedup.duplicate_groups(df).collect())
    assert found == [(0, 1, 3), (0, 5, 2), (1, 1, 3), (1, 1, 3), (2, 2, 1), (2, 2, 1), (3, 3, 2), (3, 3, 2), (4, 4, 1), (5, 5, 2)]
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(df).collect()) == [
        (0, 0, 0), (0, 1, 5), (1, 0, 1), (1, 0, 1), (2, 0, 2), (2, 1, 2), (3, 5000, 3), (3, 5000, 3), (4, 5001, 3), (5, 1, 5),
    ]
    lines = line_dedup.drop_repeated_lines(df, least_docs=2).collect()
    long = rows[6][1]
    # The line that 3 and 4 would share differs by a word; that of 3 is held by one document alone.
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped, len(r.text)) for r in lines) == sorted((i or 0, (t or "").count("\n") + 1, 0, len(t or "")) for i, t in rows)
    same = line_dedup.drop_repeated_lines(odd(spark, [(3, long), (3, long), (4, long), (None, long)]), least_docs=2).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in same) == [(0, 0), (3, 1), (3, 1), (4, 0)]
    assert {(r[0], r[2], r[3], r[4]) for r in passages(spark, [*rows, (6, long)])} == {(6, 0, 150_000, 3)}
    assert secret_scan.redact_documents(df).columns == df.columns and secret_scan.redact_documents(df).count() == len(rows)
    spans = secret_scan.scan_documents(odd(spark, [(None, long + " token=abcdefghijkl"), (1, None)])).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in spans) == [(0, 1), (1, 0)]
    for name, kept in (("exact", exact_dedup.keep_first(df)), ("near", ngram_join.keep_representatives(df))):
        assert kept.columns == df.columns
        texts = sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect())
        if name == "exact":  # of null and empty texts that of document 1 stays, once
            assert texts == sorted([(1, 0), (2, 5), (2, 5), (3, len(long)), (4, len(long) + 2), (5, 22)])
        else:  # texts without words are near nothing
            assert texts == sorted([(0, 0), (1, 0), (1, 0), (2, 5), (2, 5), (3, len(long)), (5, 22)])


def test_operators_on_empty_tables(spark):
    none = odd(spark, [])
    for made in (
        exact_dedup.duplicate_groups(none), exact_dedup.keep_first(none), line_dedup.drop_repeated_lines(none), passage_dedup.repeated_passages(none),
        ngram_join.near_duplicates(none), ngram_join.keep_representatives(none), secret_scan.scan_documents(none), secret_scan.redact_documents(none),
        language_id.keep_identified(none, language_id.fit(none)), language_id.predict(none, language_id.fit(none)),
    ):
        assert made.collect() == []


def test_ids_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    for operator in (line_dedup.drop_repeated_lines, passage_dedup.repeated_passages, ngram_join.near_duplicates, lambda d: language_id.predict(d, language_id.learn([], np.zeros((2, 0, 1)))), secret_scan.scan_documents):
        with pytest.raises(TypeError, match="doc_id"):
            operator(df)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    odd(spark, odd_rows()).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    tokens = defaultdict(int)
    for r in pieces:
        tokens[r.doc_id] += r.length
    # Without a language to learn all texts with a letter stay; 5 and its copy without id are one, 3 and 4 are near.
    assert set(tokens) == {3, 5} and tokens[5] == 6
    odd(spark, []).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []


# -- intermediate tables -------------------------------------------------------------------


def test_tables_go_when_nothing_reads_them(spark):
    @common.tidy
    def work(df):
        first = common.durable(df)
        second = common.durable(first.where("id > 2"))
        return second.join(common.durable(first.selectExpr("id + 1 AS id")), "id")

    before = set(common._written())
    found = work(spark.range(10))
    kept = set(common._written()) - before
    assert len(kept) == 2 and sorted(r.id for r in found.collect()) == list(range(3, 10))

    @common.tidy
    def fails(df):
        common.durable(df)
        raise ValueError

    with pytest.raises(ValueError):
        fails(spark.range(3))
    assert set(common._written()) - before == kept

    @common.tidy
    def outer(df):
        return common.durable(work(df).select("id")).collect()

    assert len(outer(spark.range(10))) == 7 and set(common._written()) - before == kept


class Session:
    """As much of a session as tells of its folders."""

    def __init__(self, master, **conf):
        self.sparkContext, self.conf = self, self
        self.master, self.applicationId, self.get = master, "app", lambda key, default: conf.get(key.replace(".", "_"), default)


def test_a_shared_folder_is_wanted_off_one_machine():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Session("spark://host:7077"))
    assert common.shared_folder(Session("spark://host:7077", spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    assert common.shared_folder(Session("local[3]")).startswith("file:///")
