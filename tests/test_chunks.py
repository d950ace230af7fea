"""The packing helpers against their rules, and the chunkers' invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import text as T
from tarnflow.operators import batching, catalog, merge, quality
from tarnflow.operators import chunks as C
from tarnflow.operators import lines as L

from tarnflow.sources import files


def random_units(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    sentence = lambda: word().capitalize() + " " + " ".join(word() for _ in range(rng.randint(1, 30))) + rng.choice(".!?")
    paragraph = lambda: " ".join(sentence() for _ in range(rng.randint(1, 12)))
    return [C.Piece(rng.choice([None, "A", "B"]), "\n\n".join(paragraph() for _ in range(rng.randint(1, 9))), (f"u{i}",) if rng.random() < 0.3 else ()) for i in range(rng.randint(1, 8))]


def pairs(units):
    return [(u.heading, u.content) for u in units]


def pieces(*units):
    return [C.Piece(*u) for u in units]


def plain(units):
    return "".join("".join(u.content for u in units).split())


@pytest.mark.parametrize("seed", range(40))
def test_packing_keeps_all_text(seed):
    units = random_units(random.Random(seed))
    assert plain(C.split_oversized(units, 120)) == plain(units)
    assert plain(C.merge_small(units)) == plain(units)
    assert plain(C.merge_small_into_previous(units)) == plain(units)
    for u in C.split_oversized(units, 120):
        assert C.chars4(u.content) <= 120 + len(u.content.split("\n\n")) or "\n\n" not in u.content
    for rule in (lambda x: C.split_oversized(x, 120), C.merge_small):
        assert sorted(i for u in rule(units) for i in u.images) == sorted(i for u in units for i in u.images)


@pytest.mark.parametrize("seed", range(20))
def test_sentences_overlap_by_two(seed):
    for unit in [u for u in random_units(random.Random(seed)) if C.words13(u.content) > 100]:
        heading, found = unit.heading, pairs(C.pack_sentences([unit], 100, 60))
        for (_, a), (name, b) in zip(found, found[1:], strict=False):
            assert a.split("\n")[-2:] == b.split("\n")[: len(a.split("\n")[-2:])]
            assert name in (None, f"{heading} (continued)")


def test_merges_by_hand():
    small, tiny, big = "x" * 200, "y" * 100, "z" * 400
    merged = lambda *units: pairs(C.merge_small(pieces(*units)))
    assert merged(("A", small), ("A", big)) == [("A", f"{small}\n\n{big}")]
    assert merged(("A", small), ("B", big)) == [("A", small), ("B", big)]
    assert merged(("A", tiny), ("B", small)) == [("A", f"{tiny}\n\n{small}")]
    assert merged(("A", big), ("B", tiny)) == [("A", f"{big}\n\n{tiny}")]
    assert C.combine_small_sections(pieces(("A", "a " * 100), ("B", "b " * 440), ("C", "c " * 300)))[0].content.startswith("a ")
    assert len(C.combine_small_sections(pieces(("A", "a " * 200), ("B", "b " * 300)))) == 2
    assert len(C.segment_steps(pieces((None, "i" * 20), *[(f"Step {i}: x", "b" * 50) for i in range(12)]))) == 3


def test_greedy_batches(spark):
    """Row by row: a batch ends where the next row would be one too many or come over the size; an oversized row is alone."""
    sizes = {1: [5, 5, 5, 90, 1, 120, 3], 2: [1] * 10}
    rows = spark.createDataFrame([(f, i, 10 * f + i, n) for f, v in sizes.items() for i, n in enumerate(v)], "family_id int, position int, chunk_id int, words int").repartition(3)
    got = {r.chunk_id: r.batch_no for r in batching.pack_embedding_batches(rows, 4, 100, "words").collect()}
    assert [got[10 + i] for i in range(7)] == [0, 0, 0, 1, 1, 2, 3]
    assert [got[20 + i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert batching.pack_embedding_batches(rows.limit(0), 4, 100, "words").collect() == []


def test_blank_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "# T\n\nSome words that stay here.\n")], "doc_id long, raw_content string")
    for mode in ("light", "universal", "guide", "final"):
        assert {r.doc_id for r in C.chunk_documents(docs, mode).collect()} <= {3}
    assert C.chunk_documents(docs.limit(0)).collect() == []


def test_manual_lines(spark):
    text = "Table of Contents\nSetup ..... 4\n1. Start\nPage 3\nThe pump is\nready to run.\n\n\nCopyright 2024\nurl: x\nA040W374\nTorque to 25\nTIGHTEN THE BOLTS\nÉtat"
    lines = L.lines_of(spark.createDataFrame([(1, text)], "doc_id long, raw_content string"))
    assert [r.line for r in L.drop_noise_lines(lines).orderBy("line_no").collect()] == [x for x in text.split("\n") if x not in ("Page 3", "Copyright 2024")]
    assert "Torque to 25" not in [r.line for r in L.drop_toc_lines(lines).collect()]
    assert [r.line for r in L.drop_toc_sections(lines).orderBy("line_no").collect()][0] == "1. Start"
    assert "The pump is ready to run." in [r.line for r in L.merge_wrapped_lines(lines).collect()]
    junked = [r.line for r in L.drop_junk_lines(lines).orderBy("line_no").collect()]
    assert junked == ["Table of Contents", "Setup ..... 4", "1. Start", "The pump is", "ready to run.", "", "Torque to 25", "TIGHTEN THE BOLTS", "État"]
    marked = {r.line: r.is_heading for r in L.detect_headings(lines).collect()}
    assert marked["TIGHTEN THE BOLTS"] and marked["1. Start"] and not marked["The pump is"]


def test_guide_step_numbers(spark):
    text = "# Fix it\nintro\n## 2. Open\na\n## Close\nb\n## 7. Test\nc\n## More\n# not a title\n"
    rows = L.guide_steps(L.lines_of(spark.createDataFrame([(1, text)], "doc_id long, raw_content string"))).filter("line <> ''").orderBy("line_no").collect()
    assert [(r.line, r.step, r.title) for r in rows] == [("intro", 0, "Fix it"), ("a", 2, "Fix it"), ("b", 3, "Fix it"), ("c", 7, "Fix it"), ("# not a title", 8, "Fix it")]


def test_table_blocks_and_sentences(spark):
    rows = [("Item Qty\nbolt\n4\nnut\n5", True), ("a b\nc d\ne f\ng h", False), ("a\nb\n3\nd\ne\n6\ng\nh\n9", True), ("one\ntwo\nthree\nfour four", True), ("x", False)]
    df = spark.createDataFrame(rows, "c string, want boolean")
    assert all(r.want == r.got for r in df.select("want", T.is_table_block(F.col("c")).alias("got")).collect())
    s = spark.createDataFrame([("One. Two? three. Four\n\n- a\n- b. C",)], "c string").select(T.split_sentences(F.col("c")).alias("s")).first().s
    assert s == ["One.", "Two? three.", "Four", "- a", "- b. C"]


def test_upserts_are_idempotent(spark):
    target = spark.createDataFrame([(1, "f", "t", None, {"a": "1"}), (2, "g", "u", "d", None)], "model_id long, family_id string, title string, description string, metadata map<string,string>")
    updates = spark.createDataFrame([(1, 1, "h", None, "x", {"a": "2", "b": "3"}), (3, 1, "h", "n", None, {"z": "1"}), (3, 2, "i", None, "y", {"z": "2"})], "model_id long, seq int, family_id string, title string, description string, metadata map<string,string>")
    once = merge.upsert_models(target, updates)
    twice = merge.upsert_models(once, updates)
    show = lambda df: sorted((r.model_id, r.family_id, r.title, r.description, tuple(sorted((r.metadata or {}).items()))) for r in df.collect())
    assert show(once) == show(twice) == [(1, "f", "t", "x", (("a", "2"), ("b", "3"))), (2, "g", "u", "d", ()), (3, "i", "n", "y", (("z", "2"),))]


@pytest.mark.parametrize(("size", "guides_per_task"), [(2_000_000, 10_000), (6, 2)])
def test_matching_in_shards(spark, monkeypatch, size, guides_per_task):
    """Categories of any length in one automaton and in several, against the plain test; names hold parts, cases and no names."""
    monkeypatch.setattr(catalog, "AUTOMATON_BYTES", size)
    monkeypatch.setattr(catalog, "GUIDES_PER_TASK", guides_per_task)
    rng = random.Random(6)
    kinds = [" Red ", "", "none", "b/x", "é", "a", "x1", "RED PUMP", "\u00e9\u00e9x", None, "   ", "am", "a/b/x3"]
    guides = [(i, rng.choice(kinds)) for i in range(60)]
    devices = [(i, rng.choice(["Fam", None, "ééX"]), f"a/b/x{i % 12}", rng.choice(["Red pump", "blue", None]), rng.choice([i, 3])) for i in range(40)]
    found = catalog.match_guides_to_devices(spark.createDataFrame(guides, "guide_id long, category string"), spark.createDataFrame(devices, "model_id long, family_name string, path string, title string, position long"))
    want = []
    for guide, kind in guides:
        g = (kind or "").strip(" ").lower()
        own = {}
        for model, family, path, title, position in devices:
            if g and any(g in (x or "").lower() for x in (family, path, title)):
                own[path] = min(own.get(path, (position, model)), (position, model))
        want += [(guide, path, m, p, (p, m) == min(own.values())) for path, (p, m) in own.items()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("size", [2_000_000, 6])
def test_counts_of_a_category_make_no_pairs(spark, monkeypatch, size):
    """400 guides of one category and 300 devices: the counts of all pairs, and no operator that makes them; a repeated guide counts twice."""
    monkeypatch.setattr(catalog, "AUTOMATON_BYTES", size)
    monkeypatch.setattr(catalog, "DEVICES_PER_TASK", 7, raising=False)
    guides = spark.range(400).selectExpr("id % 399 AS guide_id", "CASE WHEN id = 5 THEN 'none' WHEN id = 399 THEN 'x2' ELSE ' Pump' END AS category")
    devices = spark.range(300).selectExpr("id AS model_id", "'f' AS family_name", "concat('a/x', id) AS path", "'pump' AS title", "300 - id AS position")
    pairs = catalog.match_guides_to_devices(guides, devices)
    assert pairs.count() == 398 * 300 + 111
    found = catalog.guide_device_counts(guides, devices)
    want = pairs.groupBy("guide_id").agg(F.count("*").alias("devices"), F.min(F.when(F.col("is_primary"), F.struct("position", "model_id")))["model_id"].alias("primary_model"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == rows(want) and len(rows(found)) == 398


def test_trees_of_any_depth_in_one_plan(spark):
    deep = None
    for i in reversed(range(30)):
        deep = {f"n{i}": deep, f"leaf{i}": None}
    trees = spark.createDataFrame([(1, json.dumps(deep)), (2, None), (3, "{}"), (4, '{"a": {}, "b": "text", "c": {"d": null}}')], "tree_id long, tree string")
    jobs_before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    flat = catalog.flatten_category_tree(trees)
    everything = catalog.flatten_category_tree(trees, with_categories=True)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(jobs_before)
    got = sorted((r.tree_id, r.depth, r.path, r.title) for r in flat.collect())
    want = [(1, i, "/".join([f"n{j}" for j in range(i)] + [f"leaf{i}"]), f"leaf{i}") for i in range(30)] + [(1, 29, "/".join(f"n{j}" for j in range(30)), "n29"), (4, 1, "c/d", "d")]
    assert got == sorted(want)
    assert sorted((r.path, r.is_device) for r in everything.filter("tree_id = 4").collect()) == [("a", False), ("b", False), ("c", False), ("c/d", True)]


def test_issue_summary_totals(spark):
    families = spark.createDataFrame([("a", "A"), ("b", " ")], "family_id string, family_name string")
    models = spark.createDataFrame([(1, "a", "t"), (2, "zz", None)], "model_id long, family_id string, title string")
    sources = spark.createDataFrame([(1, "s", "x", 1, "{}"), (2, "", None, 9, "{")], "source_id long, title string, raw_content string, model_id long, metadata string")
    issues = quality.validation_issues(families, models, sources)
    total = {(r.section, r.type): r.n for r in quality.validation_summary(issues).collect()}
    assert total[(None, None)] == issues.count() == 9


def test_tables_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    files.write_table(rows, f"{tmp_path}/t")
    files.write_table(rows, f"{tmp_path}/t", "append")
    assert sorted((r.id, r.text or "") for r in files.read_table(spark, f"{tmp_path}/t").collect()) == [(1, "a"), (1, "a"), (2, ""), (2, "")]
