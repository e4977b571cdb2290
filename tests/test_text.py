import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import chunking, converse
from foliant.streaming import webhook


def char_model(text, size, overlap):
    if not text:
        return []
    step = size - overlap
    return [text] if len(text) <= size else [text[i : i + size] for i in range(0, len(text), step)]


def sentence_model(text, size, overlap):
    """Independent model: chunks as index ranges over the sentence list."""
    if len(text) <= size:
        return [text] if text else []
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", text) if p.strip()]
    out, first = [], 0
    cost = [len(p) + 1 for p in parts]
    for i, part in enumerate(parts):
        if len(part) > size:
            if first < i:
                out.append(" ".join(parts[first:i]))
            out += char_model(part, size, overlap)
            first = i + 1
        elif first < i and sum(cost[first : i + 1]) > size:
            out.append(" ".join(parts[first:i]))
            start = i
            while start > first and sum(cost[start - 1 : i]) <= overlap:
                start -= 1
            first = start
    if first < len(parts):
        out.append(" ".join(parts[first:]))
    return out


def texts():
    rng = random.Random(5)
    words = ["a", "Bär", "coffee", "é", "x" * 30, "word.", "end!", "why?", "日本", "b. c"]
    gaps = [" ", "  ", "\n", "\t", " ", "\xa0", "　 "]
    made = ["", ".", "!!! ", "x" * 100, "x" * 101, "a. " * 60, " lead. trail. "]
    for _ in range(150):
        made.append("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60))))
    return made


@pytest.mark.parametrize("size,overlap", [(100, 20), (40, 39), (25, 0)])
def test_chunks_equal_model(spark, size, overlap):
    cases = texts()
    df = spark.createDataFrame(list(enumerate(cases)), "document_id long, content string")
    for strategy, model in (("char", char_model), ("sentence", sentence_model), ("other", char_model)):
        got = {}
        for r in chunking.chunk(df, size, overlap, strategy).orderBy("document_id", "chunk_index").collect():
            got.setdefault(r.document_id, []).append(r)
        for i, text in enumerate(cases):
            rows = got.get(i, [])
            want = model(text, size, overlap)
            assert [r.passage for r in rows] == want, (strategy, i)
            assert [r.chunk_index for r in rows] == list(range(len(want)))
            assert all(r.total_chunks == len(want) for r in rows)


def test_overlap_must_be_smaller(spark):
    df = spark.createDataFrame([(1, "x")], "document_id long, content string")
    with pytest.raises(ValueError):
        chunking.chunk(df, 10, 10)


def test_tail_chunk_is_kept(spark):
    df = spark.createDataFrame([(1, "x" * 1700)], "document_id long, content string")
    assert [len(r.passage) for r in chunking.chunk(df).orderBy("chunk_index").collect()] == [1000, 900, 100]


def test_strip_is_unicode(spark):
    odd = [" a ", "\x1c b \x1f", "　", " c", ""]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(X.strip("t").alias("s")).collect()
    assert [r.s for r in rows] == [t.strip() for t in odd]


def test_prefix_edges(spark):
    df = spark.sql(
        "SELECT '' title, CAST(NULL AS STRING) document_type, 'me' correspondent, array('', 'a', NULL, 'b') tags, "
        "map('k', ' ', 'm', 'v') custom_fields UNION ALL SELECT '', '', '', array(), map()"
    )
    assert [r.p for r in df.select(chunking.prefix_column().alias("p")).collect()] == ["From: me\nTags: a, b\nm: v\n\n", ""]


def test_links(spark):
    row = spark.range(1).select(
        X.deeplink("http://h/", F.lit(3)).alias("a"),
        X.public_link(F.lit("http://h/x"), "http://h/", "").alias("b"),
        X.public_link(F.lit("http://other/x"), "http://h", "https://p").alias("c"),
    ).first()
    assert tuple(row) == ("http://h/documents/3/details", "http://h/x", "http://other/x")


def test_webhook_cases(spark):
    cases = {
        '{"document_id": 5}': (5, None),
        '{"document_id": 0, "id": 7}': (7, None),
        '{"document_id": null, "doc_url": "/documents/12/"}': (12, None),
        '"{\\"id\\": 9}"': (9, None),
        '"plain"': (None, "invalid_json"),
        "17": (None, "unexpected_type"),
        "": (None, "invalid_json"),
        '{"doc_url": "/other/1"}': (None, "no_document_id"),
        '{"document_id": "0042"}': (42, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "body string")
    got = {r.body: (r.document_id, r.reason) for r in webhook.webhook_events(df).collect()}
    assert got == cases


def test_facts(spark):
    df = spark.createDataFrame(
        [(1, "none at all"), (2, "- first fact\n\n•• second fact \nshort\n→ a b c"), (3, "  "), (4, "•Nonesuch fact")],
        "session_id long, answer string",
    )
    got = [(r.session_id, r.fact_no, r.fact) for r in converse.parse_facts(df).orderBy("session_id", "fact_no").collect()]
    assert got == [(2, 0, "first fact"), (2, 1, "second fact"), (4, 0, "Nonesuch fact")]


def test_failed_embeddings(spark):
    class Half:
        name, max_batch = "half", 2

        def embed(self, texts):
            assert len(texts) <= 2
            return [None if "bad" in t else [1.0, 2.0] for t in texts]

    df = spark.createDataFrame([(1, "ok"), (1, "bad"), (2, "bad"), (3, "ok")], "document_id long, embed_text string")
    stored, failed = chunking.split_failed(chunking.embed(df, Half, 10))
    assert sorted(r.document_id for r in stored.collect()) == [1, 3]
    assert [tuple(r) for r in failed.collect()] == [(2, 1)]


def test_failing_calls_cost_their_own_items(spark):
    from foliant.operators import chunking

    class Flaky:
        """A plug-in whose calls fail for some texts: always, once, or by an item too few."""

        name, max_batch = "flaky", 2

        def __init__(self):
            self.seen = set()

        def answer(self, texts):
            if "bad" in texts:
                raise ValueError("no")
            if "once" in texts and "once" not in self.seen:
                self.seen.add("once")
                raise ValueError("later")
            return [t.upper() if t else None for t in texts][: 1 if "few" in texts else None]

        def embed(self, texts):
            return [None if t is None else [float(len(t))] for t in self.answer(texts)]

        def complete(self, texts, max_tokens):
            return self.answer(texts)

    texts = ["a", "b", "bad", "c", "once", "d", "few", "e", "", "f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, prompt string").coalesce(1)
    done = {r.prompt: (r.response, r.error) for r in chunking.complete(rows, Flaky, call_size=2).collect()}
    assert done["a"] == ("A", None) and done["once"] == ("ONCE", None) and done["f"] == ("F", None)
    assert done["bad"] == (None, "no") and done["c"] == (None, "no") and done[""] == (None, "no answer")
    assert done["few"][0] is None and done["e"][0] is None and "number" in done["e"][1]
    vectors = {r.prompt: r.vector for r in chunking.embed(rows, Flaky, 8, "prompt").collect()}
    assert {t for t, v in vectors.items() if v is None} == {"bad", "c", "few", "e", ""}


def test_sparse_terms_shuffle_texts_only(spark):
    odd = [(1, "A b\u2003a\x1cB  a "), (2, " \t"), (3, None), (1, "b\x85C")]
    terms = chunking.sparse_terms(spark.createDataFrame(odd, "document_id long, passage string"), ["document_id"])
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert {tuple(r) for r in terms.collect()} == {(1, "a", 3), (1, "b", 3), (1, "c", 1)}


def test_citations_are_numbered_before_passages_move(spark):
    chunks = spark.createDataFrame(
        [(1, 0, "A", "a0"), (1, 1, "A", "a1"), (2, 0, "B", ""), (3, 0, "C", None), (4, 0, "D", "d0")],
        "document_id long, chunk_index long, title string, passage string",
    )
    found = [(7, 2, 0, 1), (7, 4, 0, 2), (7, 3, 0, 3), (7, 1, 1, 4), (7, 1, 0, 5), (8, 1, 0, 1), (7, 4, 0, 11)]
    hits = spark.createDataFrame(found, "query_id long, document_id long, chunk_index long, rank long")
    cited = converse.citations(hits, chunks, 5)
    assert "Window" not in cited._jdf.queryExecution().toString()
    assert sorted((r.query_id, r["rank"], r.citation, r.context_line) for r in cited.collect()) == [
        (7, 2, 1, "[1] D (ID 4)\nd0"), (7, 4, 2, "[2] A (ID 1)\na1"), (7, 5, 2, "[2] A (ID 1)\na0"), (8, 1, 1, "[1] A (ID 1)\na0")
    ]
