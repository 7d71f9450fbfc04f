"""Main text of pages, and the pipeline as a whole."""

import html as entities
import re

import numpy as np
import pytest

import corpus_pipeline
from polytrace.llm import common, html, pii, spans
from polytrace.llm.queries import QUERIES

from .test_shingles import brute

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_blocks():
    page = "<body><nav class='Top menu'><a href='x'>Home</a></nav><p>One <b>two</b><br>three &amp; four<p>five<ul><li>a<li>b</ul><script>var x='<p>no</p>'</script><!-- <p>no</p> --><div>end"
    blocks = html.blocks_of(page)
    assert [b.text for b in blocks] == ["Home", "One two three & four", "five", "a", "b", "end"]
    assert blocks[0].path[-1] == "nav .top .menu" and blocks[0].linked > 0.9 and blocks[1].linked == 0
    assert html.blocks_of("") == [] and [b.text for b in html.blocks_of("<p>cut <b")] == ["cut <b"]
    assert len(html.blocks_of("<div>" * 2000 + "deep")) == 1


def test_labeller_on_pages_it_has_not_seen():
    held = html.training_pages(120, seed=1234)
    p = html.fitted().predict(html.Inputs([b for b, _ in held], {}))
    y = np.concatenate([y for _, y in held]) > 0
    assert ((p >= 0.5) == y).mean() > 0.985


def test_labeller_gradients():
    m = html.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    blocks, y = html.training_pages(6, seed=5)[0]
    x = html.Inputs([blocks, blocks[:2]], {})
    y = np.concatenate([y, y[:2]])
    grad = {k: np.zeros_like(v) for k, v in m.w.items()}
    m.step(x, y, grad)
    empty = {k: np.zeros_like(v) for k, v in m.w.items()}
    for name in ("fh", "bx", "out"):
        flat = grad[name].ravel()
        k = int(np.abs(flat).argmax())
        cell = m.w[name].reshape(-1)
        was = cell[k]
        cell[k] = was + 1e-3
        up = m.step(x, y, dict(empty))
        cell[k] = was - 1e-3
        down = m.step(x, y, dict(empty))
        cell[k] = was
        assert np.isclose((up - down) / 2e-3, flat[k], rtol=2e-2, atol=1e-5)


def test_main_text_of_the_table(spark):
    """Pages of the table hold their text in one article; a plain reading of that element must agree."""
    pages = spark.read.parquet(PAGES)
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_main_text_edge_cases(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<article><p>" + "word " * 50_000 + "</p></article>", "x"), (3, "u", "plain text only", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:4] == [(0, 0), (1, 0), (1, 0), (2, 249_999)]
    assert html.main_text(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d, out = "/root/testdata/sf0.001", {}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        made = stage(spark, docs, d)
        assert k == len(corpus_pipeline.STAGES) - 1 or made.columns == docs.columns
        made.write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_stage_decisions(spark, stages):
    docs, kept = stages["simhash near-dedup"]
    assert {r.doc_id for r in kept.collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])  # 5-word shingles, similarity 0.8 or more
    docs, cut = stages["substring dedup"]
    gone = {r.doc_id for r in spans.drop_repeats(docs).where("emptied").collect()}
    assert {r.doc_id for r in cut.collect()} == {r.doc_id for r in docs.collect()} - gone
    before, after = stages["pii"]
    old = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == pii.masked(old[r.doc_id]) and r.n_chars == len(r.text) for r in after.collect())
    last, packed = stages["packing"]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in last.collect()}


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    want = stages["packing"][1]
    key = lambda df: sorted(df.groupBy("doc_id").agg({"length": "sum"}).collect())
    assert key(got) == key(want)
    held = len(common.tables(spark))
    assert common.discard(spark, keep=tuple(common.tables(spark)[:-1])) == 1 and len(common.tables(spark)) == held - 1


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
