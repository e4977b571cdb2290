"""The stages of the pipeline against brute force on the smallest tables."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from test_text_operators import brute_components


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def run(spark, sf):
    """(name, rows before, rows after) of every stage; a row is a dictionary."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).checkpoint()
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_toxic_documents_go(run, spark, sf):
    before, after = run["toxicity"]
    left = {r["doc_id"] for r in after}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    toxic = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    assert sum(i in left for i in clean) >= 0.9 * len(clean)
    assert sum(i in left for i in toxic) <= 0.3 * len(toxic)


def test_lines_recur_no_more(run):
    before, after = run["line_dedup"]
    homes = defaultdict(set)
    for r in before:
        for line in set((r["text"] or "").split("\n")):
            if len(line.split()) >= 8:
                homes[re.sub(r"\S*\d\S*", "<*>", line.strip())].add(r["text"])
    old = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"] for r in after} >= {i for i, t in old.items() if all(len(homes[x]) < 2 for x in (t or "").split("\n"))}
    for r in after:
        lines, left = (old[r["doc_id"]] or "").split("\n"), (r["text"] or "").split("\n")
        kept = iter(lines)
        assert all(any(x == y for y in kept) for x in left)  # in order, none changed
        lost = len(lines) - len(left)
        alone = [x for x in lines if len(x.split()) >= 8 and len(homes[re.sub(r"\S*\d\S*", "<*>", x.strip())]) == 1]
        assert all(x in left for x in alone) or lost  # lines of one text go with a wider template only
        assert r["n_chars"] == len(r["text"])
    shared = [x for x, texts in homes.items() if len(texts) > 1]
    holders = {x: {r["text"] for r in after if x in (r["text"] or "").split("\n")} for x in shared}
    whole = {r["text"] for r in after} & {r["text"] for r in before}
    assert all(len(texts - whole) <= 1 for texts in holders.values())


def test_one_of_each_group_stays(run):
    before, after = run["near_dedup"]
    order = sorted(before, key=lambda r: r["doc_id"])
    groups = brute_components([r["text"] for r in order], 5, 80)
    assert {r["doc_id"] for r in after} == {order[i]["doc_id"] for i, _, low in groups if i == low}


def test_leaking_documents_go(run, spark, sf):
    before, after = run["decontamination"]
    items = [f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r["doc_id"] for r in before if any(i in f" {' '.join(words(r['text']))} " for i in items)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone >= whole and len(gone - whole) <= 0.01 * len(before)


def test_everything_is_packed(run):
    before, after = run["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    places = defaultdict(list)
    for r in after:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in after) // 2048) + 1


def test_run_equals_the_stages(run, spark, sf):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], bytes(r["ids"]))
    assert sorted(key(r.asDict()) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(map(key, run["packing"][1]))
