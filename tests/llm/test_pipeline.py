import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_near_dedup import brute as groups_of
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import base
from tests.llm.test_secret_scan import PLANTED


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        after = {r.doc_id: r.asDict() for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality_rules":
            assert all(not base(r["text"])[-1] for r in after.values())
        if name == "near_dedup":
            want = groups_of([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        if name == "secret_scan":
            assert set(after) == set(before)
            assert not any(PLANTED.search(r["text"]) for r in after.values())
            assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])
        else:
            assert all(after[i] == before[i] for i in after)
        seen[name] = len(after)
        docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in after.values()], docs.schema)
    assert len(set(seen.values())) > 1
    rows = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    check(rows, 2048)
    assert set(Counter(r.doc_id for r in rows)) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_clean_labelled_documents_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    ruled = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    kept = {r.doc_id for r in ruled.select("doc_id").collect()}
    passing = {r.doc_id for r in docs.select("doc_id", "text").collect() if not base(r.text)[-1]}
    assert len(clean & passing & kept) >= 0.99 * len(clean & passing)
    judged = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, ruled, sf_dir).select("doc_id").collect()}
    assert len(clean & kept & judged) >= 0.99 * len(clean & kept)


def test_stages_do_not_hide_import_errors():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"\bexcept\b", source)


def test_hard_rows_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing columns; then empty tables."""
    import random

    made = random.Random(2)
    prose = lambda n: " ".join("".join(made.choice("etaoinshrdlu") for _ in range(made.randint(2, 8))) for _ in range(n)) + "."
    text, other = prose(120), prose(90)
    rows = [
        (1, text, "en", "s", 1, 1, 2), (2, text, None, None, None, 1, 2), (3, None, "en", "s", 0, 1, 2), (4, "", "", "", 0, 1, 2), (None, other, "en", "s", 1, 1, 2), (None, None, None, None, None, None, None),
        (5, prose(200_000), "en", "s", 1, 1, 2), (6, prose(80), "en", "s", 1, 1, 2), (6, prose(80), "en", "s", 1, 1, 2), (7, other, "fr", "t", 1, 1, 2), (8, prose(70), "en", "s", 1, 1, 2), (8, " ".join(["one two three"] * 60), "en", "s", 1, 1, 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id int, component_id int"
    docs = spark.createDataFrame([*rows, rows[0]], schema).repartition(3)
    spark.createDataFrame([(1, 1), (3, 0), (None, 1), (1, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(out.collect(), schema)
        if name == "near_dedup":
            ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect())
            assert ids == [1, 5, 6, 6, 7, 8], ids
    assert sorted({r.doc_id for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()}) == [1, 5, 6, 7, 8]
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
