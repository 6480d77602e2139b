"""The pipeline against a brute-force version of its decisions."""

from pyspark.sql import functions as F

import corpus_pipeline
from tritloom.llm import bpe, langid, pii, simhash

from .test_documents import brute_components, brute_mark
from .test_search_and_text import brute_hits

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    scorer = langid.Scorer(langid.fit(docs))
    left = {i for i, r in rows.items() if not scorer(r.text)[2]}
    marks = {i: brute_mark(rows[i].text) for i in left}
    roots = brute_components(set(marks.values()))
    first = {}
    for i in sorted(left):
        first.setdefault(roots[marks[i]], i)
    left = set(first.values())
    left = {i for i in left if not brute_hits(rows[i].text, items)[4]}
    spark.conf.set(pii.SETTING, "a key")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == left and len(left) > 100
    new = {r.doc_id: r.text for r in pii.pseudonymise(docs).collect()}
    spark.conf.unset(pii.SETTING)
    coder = bpe.coder(*bpe.vocabulary())
    for i, r in got.items():
        assert r.text == new[i] and r.n_tokens == len(coder.encode(new[i])) // 4 and r.lang == rows[i].lang and r.n_chars == len(new[i])


def test_stages_on_odd_rows(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", None, "s", 0), (9002, "the and of the and of", "en", "s", 21), (9002, "the and of the and of", "en", "s", 21), (None, "the and of the", "en", "s", 14)], base.schema)
    docs = base.unionByName(odd).withColumn("n_tokens", F.lit("clash")).withColumn("mark", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        if name != "tokenise":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(9002) <= 1 and 9001 not in ids


def test_near_dedup_keeps_every_text_that_has_no_near_copy(spark):
    """Repeated and null ids with equal and different texts: one row of each component stays, and no component is lost."""
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    w, x, y, z = (" ".join(words[k::4] * 2) for k in range(4))
    rows = [(3, w), (5, w), (5, y), (5, z), (None, x), (None, x), (None, z + " and more"), (7, ""), (8, None), (9, w)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("mark", F.lit("clash"))
    marks = {t: brute_mark(t) for _, t in rows}
    roots = brute_components(set(marks.values()))
    want = {}
    for i, t in rows:
        root = roots[marks[t]]
        want[root] = min(want.get(root, (True, 0)), (i is None, i or 0))
    for bound in (simhash.BROADCAST, 0):
        out = simhash.deduplicated(docs, broadcast=bound)
        assert out.columns == docs.columns
        got = {roots[marks[r.text]]: (r.doc_id is None, r.doc_id or 0) for r in out.collect()}
        assert got == want and out.count() == len(want)
    assert {(r.doc_id, r.text) for r in out.collect()} >= {(3, w), (5, y), (5, z), (None, x)}
