import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import site_quality


def test_held_out_accuracy(spark):
    """Trained on labels of even ids, judged on those of odd ids."""
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = site_quality.score_documents(docs, labels.filter("doc_id % 2 = 0"))
    held = scored.join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in held}
    good, bad = n.get((1, True), 0) / sum(v for (q, _), v in n.items() if q), n.get((0, False), 0) / sum(v for (q, _), v in n.items() if not q)
    assert good > 0.985, n
    assert bad > 0.9, n


def brute(rows, label):
    """``rows(doc_id, host, path, evidence)`` -> ``(host quality, path quality, posterior)`` of each, by plain loops."""
    known = [(1.0, label[r[0]]) if r[0] in label else ((2 * r[3] - 1) ** 2, r[3]) for r in rows]  # weight and quality

    def sums(values):
        return [sum(w * k**i for w, k in values) for i in range(3)]

    def strength(groups, mean_of):
        extra = spread = 0.0
        for key, values in groups.items():
            (n, good, squares), mean = sums(values), mean_of(key)
            if n > 1:
                chance = max(squares - n * (good / n) ** 2, 0.0) / (n * (n - 1))
                extra += n * ((good / n - mean) ** 2 - chance)
                spread += n * mean * (1 - mean)
        return site_quality.MOST_STRENGTH if extra <= 0 or not spread else min(site_quality.MOST_STRENGTH, max(site_quality.LEAST_STRENGTH, spread / extra - 1))

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for (_, host, path, _), k in zip(rows, known, strict=True):
        hosts[host].append(k)
        paths[host, path].append(k)
    n, good, _ = sums(known)
    mean = good / n
    of_hosts = strength(hosts, lambda _: mean)
    quality = {h: (sums(v)[1] + of_hosts * mean) / (sums(v)[0] + of_hosts) for h, v in hosts.items()}
    of_paths = strength(paths, lambda key: quality[key[0]])
    out = []
    for (_, host, path, p), (w, k) in zip(rows, known, strict=True):
        n, good, _ = sums(paths[host, path])
        q = min(max((good - w * k + of_paths * quality[host]) / (n - w + of_paths), 0.001), 0.999)
        odds = min(20.0, max(-20.0, math.log(p / (1 - p)))) + math.log(q / (1 - q)) - math.log(mean / (1 - mean))
        out.append((quality[host], q, 1 / (1 + math.exp(-odds))))
    return out


@pytest.mark.parametrize("groups", [200_000, 3])
def test_every_posterior_against_brute_force(spark, groups, monkeypatch):
    """On the test tables, whose hosts hardly differ, and with few groups broadcast."""
    monkeypatch.setattr(site_quality, "BROADCAST_GROUPS", groups)
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in site_quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.source, r.lang, got[r.doc_id].evidence) for r in docs.collect()]
    for (i, *_), want in zip(rows, brute(rows, label), strict=True):
        assert np.allclose(want, (got[i].host_quality, got[i].path_quality, got[i].posterior), atol=1e-6)
        assert got[i].kept == (got[i].posterior >= 0.5)


def test_evidence_against_newton(spark):
    """The classifier's probabilities are those of a logistic model with the same penalty, fitted by Newton's method."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect()}
    rows = site_quality.featured(docs, docs["source"], docs["lang"]).collect()
    x = np.array([[r[c] for c in site_quality.FEATURES] for r in rows])
    fitted = np.array([r.doc_id in label for r in rows])
    y = np.array([label[r.doc_id] for r in rows if r.doc_id in label], float)
    scale = x[fitted].std(axis=0, ddof=1)
    design = np.c_[x / np.where(scale > 0, scale, 1.0), np.ones(len(x))]
    weights, penalty = np.zeros(design.shape[1]), np.r_[np.where(scale > 0, 1e-3, 1e3), 0.0]
    a = design[fitted]
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ weights))
        weights -= np.linalg.solve((a.T * (p * (1 - p))) @ a / len(a) + np.diag(penalty), a.T @ (p - y) / len(a) + penalty * weights)
    want = 1 / (1 + np.exp(-np.clip(design @ weights, -20, 20)))
    got = {r.doc_id: r.evidence for r in site_quality.score_documents(docs, labels).collect()}
    assert np.abs(want - [got[r.doc_id] for r in rows]).max() < 0.02


def test_verdicts_that_the_sites_change(spark):
    """Texts of doubtful evidence: what the labels of their host and path say decides, and is right."""
    import random

    made = random.Random(3)
    word = lambda: "".join(made.choice("abcdefghij") for _ in range(made.randint(2, 8)))
    rows, labels, truth = [], [], {}
    for i in range(600):
        host = f"h{i % 6}.example"
        good = made.random() < (0.97 if i % 6 < 4 else 0.03)  # two hosts of bad documents
        noise = made.randint(0, 9) + (0 if good else 4)  # symbols tell a little
        rows.append((i, " ".join(word() + ("#" if j < noise else "") for j in range(80)), f"https://{host}/a/{i}", 1))
        truth[i] = int(good)
        if i // 6 % 2:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string, host int")
    held = [r for r in site_quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect() if r.doc_id // 6 % 2 == 0]
    alone = sum((r.evidence >= 0.5) == truth[r.doc_id] for r in held)
    both = sum(r.kept == truth[r.doc_id] for r in held)
    changed = [r for r in held if r.kept != (r.evidence >= 0.5)]
    assert len(changed) >= 20 and sum(r.kept == truth[r.doc_id] for r in changed) >= 0.8 * len(changed)
    assert both > 0.93 * len(held) > alone


def test_sparse_groups_shrink(spark):
    """With the same evidence, a document on a host of bad documents scores lower, one alone on its host near the whole."""
    junk, fine = "&&& ### $$$ %%% " * 40, "plain words that say something of use about pumps and valves in a calm way " * 6
    rows = [(i, junk if i % 10 else fine, "bad.example", "x") for i in range(100)] + [(1000 + i, fine if i % 10 else junk, "good.example", "x") for i in range(100)] + [(5000, fine, "lone.example", None), (5001, None, None, None), (5001, None, None, None), (5002, "word " * 60_000, "lone.example", "x"), (None, "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("p", F.lit(1))
    labels = spark.createDataFrame([(i, 0 if i % 10 else 1) for i in range(60)] + [(1000 + i, 1 if i % 10 else 0) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality.score_documents(docs, labels).collect()}
    assert got[0].path_quality < 0.35 < got[5000].path_quality < 0.85 < got[1001].path_quality
    assert got[0].posterior < got[5000].posterior < got[1001].posterior
    kept = site_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert 1001 in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("labels", [[], [(1, 1)]])
def test_without_both_labels_all_stay(spark, labels):
    docs = spark.createDataFrame([(1, "a", "s", "l"), (2, "", "s", "l")], "doc_id long, text string, source string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    assert site_quality.keep_good(docs, table).count() == 2
    assert site_quality.score_documents(docs.limit(0), table).collect() == []


def test_registered_query(spark, sf_dir):
    out = site_quality.op2_site_quality(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
