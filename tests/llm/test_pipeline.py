"""The pipeline's stages on a small table, with columns whose names clash with the operators' own."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from canopy.plans.materialize import stage_table


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1)).unionByName(spark.createDataFrame([(None, None, None, None, None, "mine", -1)], "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int"))
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir))
        assert docs.columns == columns and docs.where("kept <> 'mine' OR n_words <> -1").isEmpty()
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] > 0
    assert docs.where("n_chars <> length(text)").isEmpty()
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage_table(stage(spark, docs, sf_dir))
    assert docs.count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    a, b, c = text(), text(), text()
    near = c.replace(c.split()[-1], "other")
    rows = [(1, a), (1, b), (2, c), (3, near), (3, "x " + b[:40]), (4, b), (4, b), (5, text()), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    # Of the two rows 1 both stay; 3 keeps the text that is no copy; of 1 (b) and 4 (b, b) one stays.
    kept_b = [i for i, t in got if t == b]
    assert len(kept_b) == 1 and kept_b[0] in (1, 4)
    assert [x for x in got if x[1] != b] == sorted([(1, a), (2, c), (3, "x " + b[:40]), (5, rows[7][1]), (None, a), (None, None)], key=str)


def test_texts_surely_kept_are_counted_once(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    odd = "# $ | " * 40
    groups = [("en", "web"), ("en", None), (None, "en"), (None, None), ("", "web")]
    rows = [(i, text(60), *groups[i % 5]) for i in range(300)]
    same = rows[0][1]
    # Short texts, repeats and an outlier are rejected; rows that repeat an id, or equal a row of another group, have verdicts of their own.
    rows += [(1, text(5), "en", "web"), (2, "again and " * 40, None, "en"), (3, odd + text(30), "en", None), (4, None, None, None), (None, None, "en", "web"), (None, same, None, "en"), (5, same, "en", None), (5, same, "en", None), (6, "", "en", "web")]
    docs = stage_table(spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    want = sorted(map(str, pipeline.quality_rules.judge(docs, columns).where("kept").select(columns).collect()))
    counted, real = [], pipeline.quality_rules.text_counts
    monkeypatch.setattr(pipeline.quality_rules, "text_counts", lambda documents, keep=(): (counted.append(documents.count()), real(documents, keep))[1])
    got = sorted(map(str, pipeline.quality(spark, docs, "").select(columns).collect()))
    assert got == want and len(rows) - 9 <= len(got) < len(rows) - 5
    # The first reading takes every row, the second only those it rejected and what a Bloom filter may add.
    assert counted[0] == len(rows) and len(rows) - len(got) <= counted[1] < len(rows) // 10
