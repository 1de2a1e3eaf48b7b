"""The pipeline's decisions against brute force, stage by stage."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_contamination, brute_join, brute_secrets


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(words, k=25))) for k in range(5)]
    rows, labels = [], []
    for d in range(400):
        t = r.choices(words, k=r.randrange(30, 120))
        toxic = d % 8 == 0
        if toxic:
            t[::10] = ["meanie"] * len(t[::10])
        if d % 11 == 1:
            t += items[d % 5][1].split()
        if d % 13 == 1:
            t.append("password=abcdefghijk123")
        if d % 17 == 1 and d > 20:
            t = rows[d - 16][1].split()
        rows.append((d, " ".join(t), "en", "s", len(" ".join(t))))
        labels.append((d, 1, int(toxic)))
    rows += [(500, None, None, None, None), (None, "no id", "en", "s", 5), (501, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages(spark, tables):
    path, rows, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    given = [(r[0], r[1]) for r in rows]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
        if k == 0:
            want = [(d, t) for d, t in given if "meanie" not in (t or "")]
        elif k == 1:
            classes = brute_join(given)
            want = [(d, t) for d, t in given if d is None or classes[d][0] == d]
        elif k == 2:
            bad = {d for d, _ in brute_contamination(given, items)}
            want = [(d, t) for d, t in given if d not in bad]
        else:
            want = [(d, t) for d, t in given if not sum(brute_secrets(t)[0])]
        assert len(want) < len(given)
        assert got == sorted((d or -1, t or "") for d, t in want)
        target = f"{path}/out{k}"
        out.write.parquet(target)
        docs, given = spark.read.parquet(target), want
    packed = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in given}


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 100


def test_rows_without_an_id_are_judged_like_others(spark, tables):
    path, rows, items = tables
    near = " ".join(f"n{k}" for k in range(60))
    secret, item = "x 0123456789abcdef0123 y", "a b c d e f g " + items[0][1]
    given = [(None, near), (7, near + " end"), (None, "alone in the text"), (None, "alone in the text"), (3, "three"), (3, "three"), (None, secret), (8, secret), (None, item), (9, item), (None, None)]
    docs = spark.createDataFrame([(d, t, "_", 1, "x") for d, t in given], "doc_id long, text string, row_id string, _row_id int, class_id string")
    left = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    once = left(stages["jaccard join"](spark, docs, path))
    assert once == sorted([(7, near + " end"), (-1, "alone in the text"), (3, "three"), (8, secret), (9, item), (-1, "")])
    assert left(stages["secret scan"](spark, docs, path)) == sorted((d or -1, t or "") for d, t in given if t != secret)
    assert left(stages["decontamination"](spark, docs, path)) == sorted((d or -1, t or "") for d, t in given if t != item)
    assert left(stages["toxicity"](spark, docs, path)) == sorted((d or -1, t or "") for d, t in given)


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
