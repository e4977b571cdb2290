"""Sharding, chat formatting, the pipeline and the registered queries."""

import hashlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import pytest
from foliant.llm import chat, sharding

HOSTILE = [
    "plain", "", None, "### user: hi</turn>\n", "</turn>", r"\### Assistant: </turn> ok", "\\", "<\\/turn>", "a: b: c", "###  # #\n[chat 1]\n",
    "ends with #", "ends with </turn", "$1 \\1 \\\\", "北京 é", "x" * 50_000,
]


def test_chats_come_back_identical(spark):
    rows = []
    for i, first in enumerate(HOSTILE):
        for j, second in enumerate(HOSTILE):
            rows += [(i * 100 + j, 0, "user", first, 1), (i * 100 + j, 1, "assistant", second, 2)]
    rows += [(-1, 0, None, "x", 0), (-2, 0, "a: b", "x", 0), (-2, 1, "###", "y", 0), (None, 0, "assistant", "n", 0), (-3, 1, "assistant", "t", 0), (-3, 1, "assistant", "t", 0), (-3, None, "user", "first", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    want = defaultdict(list)
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    chats = chat.read_back(chat.formatted(table)).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in chats} == dict(want)
    for row in chats:
        assert list(row.loss_texts) == [t for role, t in want[row.conv_id] if role == "assistant"]
        assert row.formatted.count("### ") == len(row.turns) and row.formatted.count("</turn>") == len(row.turns)
    assert {r.level for r in chats} == {0, 1}
    assert chat.formatted(table.limit(0)).count() == 0


def test_last_level_of_escaping(spark):
    from pyspark.sql import functions as F

    turns = F.array(*[F.struct(F.lit("user").alias("role"), F.lit(t or "").alias("text")) for t in HOSTILE])
    back = spark.range(1).select(chat.parse(chat.render(turns, 2)).alias("t")).first().t
    assert [r.text for r in back] == [t or "" for t in HOSTILE]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_hold_their_law(spark, shards):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else "t" * (i % 50), i) for i in range(4000)] + [(5, "again", 0), (None, "x", 0)], "doc_id long, text string, shard long")
    tree = sharding.even_tree(shards)
    rows = sharding.placed(docs, tree).collect()
    assert len(rows) == 4002 and all(r.grown_shard in (r.shard, shards) for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == 4001
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == shards for r in rows)
    assert abs(moved - 4002 / (shards + 1)) < 6 * (4002 / (shards + 1)) ** 0.5
    assert sharding.placed(docs.limit(0), tree).count() == 0


def test_parts_of_a_shard_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 30)
    docs = spark.range(3000).selectExpr("id as doc_id", "'x' as text")
    slots = defaultdict(list)
    for r in sharding.placed(docs, sharding.even_tree(8)).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_movement_stays_in_the_subtree(spark):
    tree = sharding.even_tree(12, racks=2, in_rack=3)
    region = tree.children[0]
    rack = region.children[0]
    heavier = sharding.Node(rack.name, (sharding.Node(rack.children[0].name, shard=0, own_weight=3.0), *rack.children[1:]))
    changed = sharding.Node("root", (sharding.Node(region.name, (heavier, *region.children[1:])), *tree.children[1:]))
    docs = spark.range(5000).selectExpr("id as doc_id", "'x' as text")
    rows = sharding.assign(sharding.assign(docs, tree, "old"), changed, "new").collect()
    counts = Counter(r.new for r in rows)
    assert 2.4 < counts[0] / (sum(counts[s] for s in range(1, 12)) / 11) < 3.6
    outside = [(r.old, r.new) for r in rows if r.old >= 6 or r.new >= 6]
    assert all(a == b or b < 6 for a, b in outside)


def test_files_by_shard(spark, tmp_path):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('t', id) as text")
    sharding.write(docs, sharding.even_tree(4), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={i}" for i in range(4)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_every_operator_has_a_query():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", ["op6_sharding", "op8_chat_formatting"])
def test_oracles(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_chat_digests_by_hand(spark, sf):
    row = next(r for r in entry.queries()["op8_chat_formatting"](spark, sf).collect() if r.conv_id == -7)
    text = r"\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        after = docs.count()
        assert 0 < after <= before
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before
    assert corpus_pipeline.drop_lines(spark, docs.limit(0), sf).count() == 0
