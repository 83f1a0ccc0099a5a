"""Every registered query against its SQL, on the smallest tables."""

import hashlib
import re
from html import unescape

import pytest

from gneiss.plans import queries, store_queries
from gneiss.plans.oracle import ORACLE_SQL
from tests.compare import FOLDER, assert_same

QUERIES = queries.QUERIES | store_queries.QUERIES
#: Tested by their rows elsewhere: real pages are parsed, and no SQL parses HTML; approximate neighbours are held against exact ones, latent ones against a plain decomposition.
WITHOUT_SQL = {"html_leaf_blocks", "chunk_filings", "knn_coded", "latent_neighbours"}


def test_every_query_has_sql_but_those_that_none_can_tell():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


def plain_blocks(html):
    """(tag, text) of leaf blocks, from a tree that a loop over the markup's pieces builds."""
    void, blocks = set("area base br col embed hr img input link meta param source track wbr".split()), set("h1 h2 h3 p div li td th".split())
    html = re.sub(r"(?s)<(script|style)\b[^>]*>.*?</\1>", "", html)
    root = node = {"tag": "", "in": [], "up": None}
    for piece in re.findall(r"(?s)<!--.*?-->|<[^>]*>|[^<]+", html):
        if name := re.match(r"</([a-z0-9]+)", piece):
            up = node
            while up["up"] and up["tag"] != name[1]:
                up = up["up"]
            node = up["up"] if up["tag"] == name[1] else node
        elif name := re.match(r"<([a-z0-9]+)", piece):
            child = {"tag": name[1], "in": [], "up": node}
            node["in"].append(child)
            node = node if name[1] in void else child
        elif piece[0] != "<":
            node["in"].append(unescape(piece))

    def every(n):
        for x in n["in"]:
            yield x
            if isinstance(x, dict):
                yield from every(x)

    for n in every(root):
        if isinstance(n, dict) and n["tag"] in blocks and not any(isinstance(x, dict) and x["tag"] in blocks for x in every(n)):
            if text := " ".join(" ".join(x.strip() for x in every(n) if isinstance(x, str) and x.strip()).split()):
                yield n["tag"], text


def test_leaf_blocks_of_real_pages(spark):
    found = {}
    for r in QUERIES["html_leaf_blocks"](spark, FOLDER).collect():
        found.setdefault(r.page_id, []).append((r.seq, r.kind, r.tag, r.text_md5))
    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        want = [(i, "block", tag, hashlib.md5(text.encode()).hexdigest()) for i, (tag, text) in enumerate(plain_blocks(page.html))]
        assert sorted(found[page.page_id]) == want


def test_chunks_of_real_pages_are_their_text(spark):
    """Pages without Item headings: what stands under headings in capitals, or else all of the text in windows."""
    pages = {str(r.page_id): r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    chunks = {}
    for r in QUERIES["chunk_filings"](spark, FOLDER).collect():
        assert r.chunk_type == "text"
        chunks.setdefault(r.chunk_id.split(":")[0], []).append((r.chunk_index, r.section, r.n_chars))
    for page_id, html in pages.items():
        own = sorted(chunks[page_id])
        if {section for _, section, _ in own} == {"Document"}:
            text = re.sub("(?is)<script.*?</script>|<style.*?</style>|<[^>]+>", " ", html)
            length = len(" ".join(text.split()))
            assert [n for n, *_ in own] == list(range(len(own)))
            assert sum(n for *_, n in own) + len(own) - 1 <= length + len(own) and sum(n for *_, n in own) >= length - len(own) + 1 and all(n <= 3000 for *_, n in own)
        else:
            assert all(section.upper() == section for _, section, _ in own)


def test_coded_neighbours_are_nearly_the_exact_ones(spark):
    exact = {(r.qid, r.chunk_id): r.distance for r in QUERIES["knn_exact"](spark, FOLDER).collect()}
    found = {(r.qid, r.chunk_id): r.distance for r in QUERIES["knn_coded"](spark, FOLDER).collect()}
    assert len(found) == len(exact) and len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(found[k] - exact[k]) < 2e-6 for k in found.keys() & exact.keys())
