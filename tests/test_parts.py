"""What a task holds of a table doesn't grow with the table."""

from collections import Counter

from tritloom import shared
from tritloom.operators.entropy import ngram_counts


def test_ngrams_are_counted_in_parts_of_a_bounded_size(spark, tmp_path, monkeypatch):
    path, texts = str(tmp_path / "documents"), [f"a b w{i % 40} a  b" for i in range(400)] + ["", None, "one"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id int, text string").repartition(2).write.parquet(path)
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(shared, "PART", size // 9)
    cut = shared.cut(df, "text")
    assert cut.columns == ["text"] and cut.rdd.getNumPartitions() >= 9
    want = Counter(" ".join(g) for x in texts if x for w in [[y for y in x.split(" ") if y]] for g in zip(w, w[1:], strict=False))
    assert {r.gram: r.n for r in ngram_counts(cut, "text", 2).collect()} == want
    monkeypatch.setattr(shared, "PART", size)
    assert shared.cut(df, "text").rdd.getNumPartitions() <= 4
