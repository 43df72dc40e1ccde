"""Queries over every row: labels of any characters, common tokens, similar vectors, long chains; each against brute force."""

import hashlib
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from sievework.functions.labels import FILLER, GREEK
from sievework.operators.metrics import cluster_bootstrap
from sievework.operators.vectors import components, similar_pairs
from sievework.plans import audits
from sievework.plans.cascade import consolidate_vectors

LABELS = [
    ("Tissue", "Cörtex"), ("Tissue", " cörtex\t"), ("Tissue", "liver–biopsy"), ("Tissue", "liver biopsy"), ("Tissue", "HeLa α"), ("Condition", "anemia"), ("Condition", "Anémia (n = 5)"),
    ("Condition", "fever type 1"), ("Condition", "type 1 fever"), ("Condition", "细胞"), ("Tissue", "donor 3 lung\nleft"),
]


def run(spark, folder, name):
    return [r.asDict() for r in entry.queries()[name](spark, str(folder)).collect()]


def canon(raw):
    s = raw.strip().lower()
    for g, a in GREEK.items():
        s = s.replace(g, a)
    for p in (r"\b(gsm|gse|srs|srr|srx|prjna)\d+\b", r"\bn\s*=\s*\d+\b", r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", r"\b(rep(licate)?|donor|subject|patient|sample)[ _-]?\d+\b", r"[^a-z0-9%+\- ]+", r"\s+", r"\bcell\s+lines?\b"):
        s = re.sub(p, " ", s)
    words = s.split()
    return " ".join([w for w in words if w not in FILLER] or words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    rows = [(c, x, f"D{i % 3}", "rule") for i, (c, x) in enumerate(LABELS)]
    spark.createDataFrame(rows, "col string, input_label string, output_id string, source string").write.parquet(f"{at}/resolutions.parquet")
    vocab = [("cörtex", "D1", "A"), ("Fever, Type 1", "D2", "C"), ("1 type fever", "D2", "C"), ("été renal", "D3", "A"), ("liver", "D4", "A")]
    spark.createDataFrame(vocab, "term string, mesh_id string, category string").write.parquet(f"{at}/vocab.parquet")
    spark.createDataFrame([("HeLa α", "CVCL_1")], "name string, cvcl string").write.parquet(f"{at}/cell_lines.parquet")
    return at


def test_labels_of_any_characters(spark, folder):
    assert {r["raw"]: r["canon"] for r in run(spark, folder, "canonical_values")} == {x: canon(x) for _, x in LABELS}
    mint = lambda c, x: f"OOV-{c[0]}-" + hashlib.sha1(f"{c}\x00{' '.join(x.lower().split())}".encode()).hexdigest()[:10].upper()
    assert {(r["col"], r["raw"]): r["ref_id"] for r in run(spark, folder, "mint_oov_ids")} == {(c, x): mint(c, x) for c, x in LABELS}
    safe = lambda x: re.sub("[^A-Za-z0-9_.-]", "_", x).strip("_")
    assert {r["raw"]: r["safe"] for r in run(spark, folder, "export_safe_names")} == {x: safe(x) for _, x in LABELS}


def test_groups_of_labels_of_any_characters(spark, folder):
    groups, answers = {}, {}
    for i, (c, x) in enumerate(LABELS):
        if canon(x):
            groups.setdefault((c, canon(x)), set()).add(x)
            answers.setdefault((c, canon(x)), set()).add(i % 3)
    want = {}
    for k in groups:
        if len(groups[k]) > 1:
            n, d = want.get(k[0], (0, 0))
            want[k[0]] = (n + 1, d + (len(answers[k]) > 1))
    assert {r["col"]: (r["groups"], r["disagree"]) for r in run(spark, folder, "identical_input_consistency")} == want
    assert sum(r["n_rows"] for r in run(spark, folder, "routing_decomposition")) == len(LABELS)


def test_vocabulary_of_any_characters(spark, folder):
    assert {r["term"] for r in run(spark, folder, "augmented_label_queries")} == {"cörtex", "Fever, Type 1", "1 type fever", "été renal", "liver"}
    assert [(r["k"], r["terms"]) for r in run(spark, folder, "blocking_key_groups")] == [("1 fever type", 2)]


def test_cascade_and_components_of_any_characters(spark, folder):
    got = {(r["col"], r["tier"]): r["labels"] for r in run(spark, folder, "resolution_cascade")}
    assert got == {("Tissue", "exact"): 2, ("Condition", "block"): 2, ("Tissue", "line"): 1, ("Tissue", "unresolved"): 3, ("Condition", "unresolved"): 3}
    assert sorted(r["labels"] for r in run(spark, folder, "consolidate_components")) == [1] * 5 + [2] * 3


def test_common_tokens(spark, tmp_path):
    vocab = [(f"disorder {chr(97 + i // 26)}{chr(97 + i % 26)}x", f"D{i:03}") for i in range(60)] + [("disorder", "D900"), ("anemia disorder", "D901"), ("anemia", "D901"), ("anemia", "D902")]
    spark.createDataFrame(vocab, "term string, mesh_id string").write.parquet(f"{tmp_path}/vocab.parquet")
    labels = ["Disorder", "disorder anemia", "severe anemia", "aax thing", "disorder of type abx", "nothing"]
    spark.createDataFrame([(x,) for x in labels], "input_label string").write.parquet(f"{tmp_path}/resolutions.parquet")
    tok = lambda s: set(re.findall("[a-z]{3,}", s.lower()))
    want = {}
    for x in map(str.lower, labels):
        scored = [(-round(len(tok(x) & tok(t)) / len(tok(x) | tok(t)), 6), t, i) for t, i in vocab if tok(x) & tok(t)]
        if scored:
            s, t, i = min(scored)
            want[x] = (t, i, -s)
    assert {r["label"]: (r["term"], r["mesh_id"], r["score"]) for r in run(spark, tmp_path, "lexical_rerank")} == want
    assert {"disorder", "disorder anemia"} <= set(want)
    # "disorder" stands in 62 terms; alone it covers the one-word term, which takes the label
    assert {r["label"]: r["name"] for r in run(spark, tmp_path, "lexical_picks")}["disorder"] == "disorder"


def test_vectors_joined_by_similarity(spark, tmp_path):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id as node", "embedding as vec")
    for threshold in (0.7, 0.35):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if vecs[i] @ vecs[j] >= threshold}
        for block in (200_000, 25):
            assert {tuple(r) for r in similar_pairs(df, threshold=threshold, block_rows=block).collect()} == want
    got = consolidate_vectors(spark, str(tmp_path), threshold=0.7).collect()
    near, part = {i: [j for j in range(60) if vecs[i] @ vecs[j] >= 0.7] for i in range(60)}, {}
    for i in range(60):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        part[i] = min(f"v{x}" for x in seen)
    sizes = {}
    for r in got:
        assert part[int(r["concept"][1:])] == r["component"]
        sizes[r["component"]] = sizes.get(r["component"], 0) + r["n_values"]
    assert sizes == {p: list(part.values()).count(p) for p in part.values()}


def test_context_longer_than_120(spark, tmp_path):
    rows = [("G1", "S1", "t", "x" * 150 + tail, "p" * 700) for tail in ("a", "b")]
    spark.createDataFrame(rows, "gse string, gsm string, title string, source_name string, treatment_protocol string").write.parquet(f"{tmp_path}/gsm_context.parquet")
    got = sorted(r["context"] for r in run(spark, tmp_path, "sample_context_text"))
    assert got == [f"title: t | source: {r[3]} | treatment: {'p' * 700}"[:700] for r in rows]


def test_long_chain_is_one_component(spark):
    # 119 ... 1 settle on 1, whose node is at the far end from 0
    path = [0, *range(119, 0, -1)]
    edges = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
    nodes = spark.createDataFrame([(x,) for x in [*path, 500]], "node long")
    got = {r["node"]: r["component"] for r in components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(path, 0), 500: 500}


def test_bootstrap_takes_10000_draws(spark, data, monkeypatch):
    drawn = []
    monkeypatch.setattr(audits, "cluster_bootstrap", lambda per, draws: drawn.append(draws) or cluster_bootstrap(per, draws=draws))
    row = audits.cluster_bootstrap_ci(spark, data).first()
    assert drawn == [10_000] and row["low"] <= row["rate"] <= row["high"]
