"""Pages against another parser; nearest neighbours by recall; classifiers by held-out accuracy; the pipeline by its parts."""

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from corpusmill.llm import html, jaccard, language, lines, neighbours, toxicity

SF = "/root/testdata/sf0.01"


class Words(HTMLParser):
    """Text outside scripts, styles and titles; blocks and breaks part words."""

    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        self.out.append(" " * (tag in html.BLOCKS or tag == "br"))

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        self.out.append(" " * (tag in html.BLOCKS))

    def handle_data(self, data):
        self.out.append(data * (not self.off))


def test_html_words(spark):
    for r in html.texts(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        p = Words()
        p.feed(r.html)
        p.close()
        assert re.sub(r"(?m)^\s*(- |\d+\. )", "", r.text).split() == "".join(p.out).split()


def test_html_layout():
    page = """<title>x</title><p>One<p>Two <b>b</b> &amp; c<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><tr><td>aa<td>b<tr><td>c<td>dddd</table><pre>
 a
   b</pre>x<br>y<div style="display: none">no</div><p hidden>no</p><h1>T</h1>3 < 4"""
    assert html.extract(page) == "One\n\nTwo b & c\n\n- a\n- b\n  3. x\n  4. y\n- c\n\naa  b\nc   dddd\n\n a\n   b\n\nx\ny\n\nT\n\n3 < 4"
    assert html.extract(None) is None and html.extract("") == ""
    assert html.extract("<div>" * 50_000 + "x" + "</p></x>" * 1000).strip() == "x"
    assert html.extract("<a b='>" * 1001 + "<a " * 5000).count("<a") == 5000


def test_neighbours_recall(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), float)
    got = {}
    for r in neighbours.nearest(spark.read.parquet(f"{SF}/embeddings.parquet")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        best = np.lexsort((ids, -s))[:20]
        found = got[ids[i]]
        assert sorted(found) == list(range(1, 21))
        hit += len(set(ids[best]) & {v for v, _ in found.values()})
    assert hit >= 0.9 * 20 * len(got)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [1.0]), (9, [-1.0, 5.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 2.0), (3, 9, -1.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", "fr"), (4, "日本", None), (5, "the " * 400_000, "en")], "doc_id long, text string, lang string")
    pred = {r.doc_id: r.lang_pred for r in language.predict(odd).collect()}
    assert [pred[i] for i in (1, 2, 3)] == ["und"] * 3 and pred[5] != "und" and pred[4] != "und"
    assert {r.lang_pred for r in language.predict(odd.withColumn("lang", odd.lang.substr(9, 1)).where("doc_id = 4")).collect()} == {"und"}
    assert language.predict(docs.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic == 1 for r in got)
    assert right >= 0.9 * sum(r.toxic for r in got) and sum(r.predicted for r in got) <= 1.05 * right
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, labels).collect())
    assert toxicity.score(odd.limit(0), labels.limit(0)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, sf).toArrow())
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
    groups = jaccard.similar(kept)
    assert groups.where("n_similar > 0").count() == 0
    assert lines.repeated(kept).count() == 0
    last = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in kept.collect())
    assert all(r.n_tokens == len(r.token_ids) for r in last)


def test_toxicity_examples_in_parts(spark):
    # one part with all of them did not fit the driver
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(8), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.examples(docs, labels)
    assert len(got.inputFiles()) >= 6
    drawn = {r.doc_id for r in labels.where("toxic IN (0, 1)").collect()}
    assert 0 < got.count() <= len(drawn)
