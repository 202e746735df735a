"""Cases that the operators once left out."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm import docs  # noqa: F401
from tidemark.errors import ConfigError
from tidemark.llm import html_extract, jaccard_join


# ---- 2 Jaccard join -----------------------------------------------------------------------------------


def test_rows_without_id_link_near_copies(docs):  # noqa: F811
    w, v = [f"w{k}" for k in range(60)], [f"v{k}" for k in range(60)]
    rows = [(5, " ".join(w[8:])), (None, " ".join(w)), (None, " ".join(w)), (9, " ".join(w[:-8]))]  # 5 and 9 link by it only
    rows += [(20, " ".join(v)), (None, " ".join(v[1:])), (None, " ".join(f"x{k}" for k in range(60))), (None, " ".join(f"x{k}" for k in range(59)))]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.jaccard_components(docs([(i, t, "s") for i, t in rows])).collect())
    assert got == [(0, 55, 0), (0, 55, 20), (0, 56, 0), (0, 56, 5), (0, 56, 5), (5, 48, 5), (9, 48, 5), (20, 56, 20)]


def test_no_links_of_less_than_75_percent(docs):  # noqa: F811
    with pytest.raises(ConfigError):
        jaccard_join.jaccard_components(docs([(1, "a", "s")]), percent=74)


# ---- 6 pages ------------------------------------------------------------------------------------------


def test_template_text_in_the_content_goes(spark):
    notice = "<p>Subscribe <b>now</b></p><div><p>This site uses a great many biscuits to serve you better every day</div>"
    rows = [(i, "http://a.example/x", f"<body><article><h1>H {i}</h1>{notice}<p>one {i}</p><ul><li>two {i}</ul></article></body>") for i in range(8)]
    rows += [(20 + i, "http://b.example/x", f"<body><ul><li>home</ul><div class=story>{notice}<p>{'long text ' * 40}{i}</div></body>") for i in range(8)]
    rows += [(40 + i, "http://c.example/x", "<body><article><p>a copy</p></article></body>") for i in range(8)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(d).collect()}
    assert got[3] == "H 3\none 3\ntwo 3" and got[23] == "long text " * 40 + "3" and got[41] == "a copy"


def test_marks_of_loose_and_inline_elements():
    read = lambda x: html_extract.main_text(f"<body><article>{x}</article></body>", None)
    assert read("<p class=ad>buy<p>one<p class='notice'>we <i>use</i></p>two") == "one\ntwo"
    assert read("<ul><li class=promo>x <p>y</p> z<li>one</ul>two") == "one\ntwo"
    assert read("<table><tr><td class=sponsored>x<td>one<tr><th class=header>two</table>") == "one\ntwo"
    assert read("<p>one <span class=ad>x <span>y</span> z</span>two <a class='share'>s</a>three</p>") == "one two three"
    assert read("<p><span class=ad>x<p>one</p><div>two</div><pre>a <span class='hljs-comment'>b</span></pre>") == "one\ntwo\na b"


# ---- pipeline -----------------------------------------------------------------------------------------


def test_the_pipeline_gives_the_ids_of_its_digests(spark, tmp_path, monkeypatch, docs):  # noqa: F811
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    docs([(1, "hello there", "s"), (2, "", "s"), (3, None, "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    got = {r["doc_id"]: hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in corpus_pipeline.token_ids(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 3
