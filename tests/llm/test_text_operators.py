"""Packing, near copies, lines and words against brute force on small tables with odd rows."""

import collections
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from foliant.llm import line_dedup, near_dup, packing
from foliant.llm.queries import tokenizer_path
from foliant.llm.words import batches, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta " * 4000
TEXTS = [
    None, "", "   \n\t ", "one", "one", "Two words", "two WORDS", "The quick brown fox jumps over the lazy dog again and again",
    "the quick brown fox jumps over the lazy dog again and  again", "the quick brown fox jumps over the lazy cat again and again",
    "x" * 3000, LONG, "naïve Élan ß 北京  wide\x1cgap", "a\x0bb\x0cc\x0dd",
]


def rows_of(spark, texts, first=0):
    data = [(first + i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, n string, key int")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_word_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr("foliant.llm.words.SLICE", 64)
    hashes, offsets, starts, ends = word_hashes(pa.array(TEXTS), spans=True)
    words = [WORD.findall(lower(t)) for t in TEXTS]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    seen = defaultdict(set)
    for word, h in zip([w for ws in words for w in ws], hashes.tolist()):
        seen[word].add(h)
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_words_by_letters_and_prefixes():
    hashes, offsets = word_hashes(pa.array(["Idiot, idiot! idiotic", "don't"]), letters=True, prefixes=(5,))
    assert offsets.tolist() == [0, 3, 5]
    assert hashes[0].tolist() == hashes[1].tolist() and hashes[0][1] == hashes[2][1] and hashes[0][0] != hashes[2][0]


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"text": ["aaaa", None, "b" * 100, "cc", "dd"]})
    assert [b.num_rows for b in batches(iter([batch, batch.slice(0, 0)]), "text", 8)] == [2, 1, 2]


def test_packing_places_every_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = rows_of(spark, TEXTS)
    docs = docs.unionByName(docs)
    placed = packing.pack(packing.token_pieces(docs, tokenizer_path())).collect()
    by_doc = defaultdict(list)
    for row in placed:
        by_doc[row.doc_id].append(row)
    for doc, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        rows = sorted(by_doc[doc], key=lambda r: r.piece)
        assert len(rows) % 2 == 0
        for piece, pair in enumerate(zip(rows[::2], rows[1::2])):
            for row in pair:
                part = ids[4 * 2048 * piece : 4 * 2048 * (piece + 1)]
                assert (row.piece, row.start, row.length, bytes(row.ids)) == (piece, 2048 * piece, len(part) // 4, part)
    sequences = defaultdict(list)
    for row in placed:
        sequences[row.sequence_id].append((row.offset, row.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r.length for r in placed) // 2048)


def test_packing_an_empty_table(spark):
    assert packing.pack(packing.token_pieces(rows_of(spark, []), tokenizer_path())).count() == 0


def test_patterns_use_every_count():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.minimum(100, rng.geometric(0.05, 400))
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        patterns = packing.best_two_fit(counts, 100)
        used = defaultdict(int)
        for times, inside in patterns:
            assert sum(inside) <= 100
            for length in inside:
                used[length] += times
        assert used == counts
        assert sum(t for t, _ in patterns) <= -(-int(lengths.sum()) // 100) + 1


def test_two_tighter_pieces_replace_the_smallest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def brute_components(texts, words, percent):
    sets = []
    for text in texts:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.integers(10**6)}" for w in words)


@pytest.mark.parametrize("words", [2, 5])
def test_components_match_all_pairs(spark, monkeypatch, words):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    texts = list(TEXTS)
    for family in range(3):
        base = [f"w{rng.integers(400)}" for _ in range(120)]
        texts += [edited(rng, base, rng.uniform(0, 0.12)) for _ in range(40)] + [" ".join(base)] * 3
    got = near_dup.near_components(rows_of(spark, texts), words, 80).collect()
    assert sorted(map(tuple, got)) == brute_components(texts, words, 80)


def test_kept_rows_of_components(spark):
    docs = rows_of(spark, [None, "same text here now ok", "same text here now ok", "", "other words in this one"])
    kept = near_dup.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 0, 1, 1, 3, 3, 4, 4]
    assert near_dup.near_components(rows_of(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "same text"), (1, "same text")], "doc_id long, text string")
    assert sorted(near_dup.near_components(nulls).collect(), key=str) == [(1, 1, 1), (None, 1, None)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[250:1250]
    sketch = near_dup.similarity_sketch(np.concatenate([a, b, pool[:1]]), np.array([0, 1000, 2000, 2001]))
    assert (sketch != near_dup._EMPTY).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.15


PASSAGE = "this passage of many words is found in several documents that otherwise have nothing in common with one another"


def test_recurring_lines_go(spark):
    own = [f"line {chr(97 + i)} speaks of topic{i} and nothing else in the world at all" for i in range(30)]
    texts = [f"{own[i]}\n{PASSAGE}\nshort one\n{own[i + 10]}" for i in range(8)]
    texts += [f"{own[20 + i]}\nView number {i * 37} of the page that was printed on day {i} for the reader of it" for i in range(4)]
    texts += [None, "", PASSAGE, "\n\n", texts[0], texts[0]]
    docs = rows_of(spark, texts)
    rows = {r.doc_id: r for r in line_dedup.drop_recurring(docs, "lost").collect()}
    assert len(rows) == len(texts)
    assert sum(PASSAGE in (r.text or "") for r in rows.values()) in (1, 3)  # the home text and its exact copies
    assert sum("View number" in (r.text or "") for r in rows.values()) == 1
    for i in range(8):
        assert own[i] in rows[i].text and own[i + 10] in rows[i].text and "short one" in rows[i].text
    assert rows[12].text is None and rows[13].text == "" and rows[15].text == "\n\n"
    assert all(r.lost == (0 if r.text == texts[i] else 1) for i, r in rows.items())
    assert line_dedup.drop_recurring(docs).columns == docs.columns
    assert line_dedup.drop_recurring(rows_of(spark, [])).count() == 0


def test_near_copies_keep_their_lines(spark):
    lines = [f"sentence {chr(97 + i)} of the one story with enough words to count here" for i in range(8)]
    texts = ["\n".join(lines), "\n".join([*lines[:7], "an end that differs from the other story by a lot of words"])]
    assert {r.text for r in line_dedup.drop_recurring(rows_of(spark, texts)).collect()} == set(texts)


def test_a_notice_that_fills_half_of_many_texts_stays_in_one(spark):
    notice = [f"this notice in its clause {c} was added to every page by the office that sends them out" for c in "abc"]
    own = "line {} tells of matter{} which no other page has in its words about thing{} at all ever"
    names = [f"{a}{b}" for a in "bcdfg" for b in "aeioulrt"]
    texts = ["\n".join([*notice, *(own.format(n + c, n + c, c + n) for c in "xyz")]) for n in names]
    rows = {r.doc_id: r for r in line_dedup.drop_recurring(rows_of(spark, texts), "lost").collect()}
    assert sorted(r.lost for r in rows.values()) == [0] + [3] * 39
    assert all(f"line {n}{c} " in rows[i].text for i, n in enumerate(names) for c in "xyz")


def test_near_copies_with_long_lines_keep_them(spark):
    """One word in 50 is another one, so that most lines differ: they count by their wider templates."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    edited = [f"new{w}" if i % 50 == 30 else w for i, w in enumerate(words)]
    texts = ["\n".join(" ".join(w[i : i + 25]) for i in range(0, 400, 25)) for w in (words, edited)]
    assert {r.text for r in line_dedup.drop_recurring(rows_of(spark, texts)).collect()} == set(texts)


def test_crc_of_pieces(spark):
    from pyspark.sql import functions as F

    row = packing.token_pieces(rows_of(spark, ["one"]), tokenizer_path()).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids))


def test_a_pair_meets_in_the_first_band_that_both_share(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words[:280], *"some other words at the end".split()])]
    brief = bytes(near_dup.COORDINATES)  # the bytes agree where the coordinates don't
    bands = near_dup.COORDINATES // near_dup.ROWS
    kind = "key long, band int, members long, class_id long, component long, brief binary, keys array<long>, text string"
    for shared, found in ([7], 1), ([3, 7], 0), (None, 1):
        keys = [[b if b in (shared or ()) else 1000 * (k + 1) + b for b in range(bands)] for k in range(2)]
        rows = [(7, 7, 2, k, k, brief, keys[k] if shared else None, texts[k]) for k in range(2)]
        edges = near_dup._in_blocks(spark.createDataFrame(rows, kind), 2, 80).collect()
        assert [(r.a, r.p) for r in edges] == [(1, 0)] * found


@pytest.mark.parametrize("few", [0, 10**6])
def test_labels_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(near_dup, "FEW_EDGES", few)
    pairs = [(5, 2), (9, 5), (7, 1), (8, 7), (1, 8), (30, 20), (20, 30)] + [(i + 1, i) for i in range(100, 160)]
    edges = spark.createDataFrame(pairs, "a long, p long")
    want = {2: 2, 5: 2, 9: 2, 1: 1, 7: 1, 8: 1, 20: 20, 30: 20} | {i: 100 for i in range(100, 161)}
    assert {r.id: r.component for r in near_dup._labels(edges).collect()} == want


def _line_model(texts):
    """Line dedup by plain loops: the lines every text keeps."""
    split = lambda line: re.split(r"[ \t\x0B\f\r]+", line.strip(" "))
    place = lambda text: (xxhash.xxh64_intdigest(text.encode(), seed=42) + 2**63) % 2**64

    def keys(line):
        words = split(re.sub(r"[^ \t]*[0-9][^ \t]*", "<*>", line))
        if len(words) < 3:
            return len(words), []
        out = [("own", tuple(words))]
        part = -(-(len(words) - 2) // 4)
        if len(words) >= 12:
            out += [(j, len(words), tuple(words[: 2 + part * j]), tuple(words[2 + part * (j + 1) :])) for j in range(4)]
        return len(words), out

    lines = {t: [keys(x) for x in t.split("\n")] for t in set(texts)}
    homes, docs = {}, collections.Counter()
    for text in texts:
        for key in {k for _, ks in lines[text] for k in ks}:
            homes.setdefault(key, set()).add(text)
            docs[key] += 1
    size = {t: sum(n for n, _ in ls) for t, ls in lines.items()}
    kept = {}
    for text in set(texts):
        taken, by_home = {}, collections.defaultdict(list)
        for at, (n, ks) in enumerate(lines[text]):
            found = [(min(homes[k], key=place), docs[k] >= (10 if k[0] != "own" else 2 if n >= 8 else 20)) for k in ks if len(homes[k]) > 1]
            found = [f for f in found if f[0] != text]
            if found:
                taken[at] = min((h for h, _ in found), key=place), any(d for _, d in found)
                by_home[taken[at][0]].append(n)
        kin = {h for h, ns in by_home.items() if len(ns) >= 3 and 10 * sum(ns) >= 7 * size[text] and 10 * sum(ns) >= 7 * size[h]}
        gone = {at for at, (home, drops) in taken.items() if drops and home not in kin}
        kept[text] = "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone)
    return kept


def test_line_dedup_is_the_model(spark, sf):
    """All documents, and pages whose half is a notice, a log, or another page with a few other words."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None]
    notice = "\n".join(f"clause {c} of the notice that stands below each of the pages here" for c in "abcd")
    for i in range(25):
        own = "\n".join(f"page x{chr(97 + i)} says in part {c * 2} what no other page of these has said so far{chr(97 + i)}" for c in "pqrst")
        texts += [f"{own}\n{notice}", f"job {i} done by worker{i} in room with a view of sea and {chr(97 + i)}hill near town\n{own}", "ok it goes", f"end of it\n{own[:60]}"]
        texts.append(own.replace("other", "earlier", 1))
    texts += texts[:7]
    want = _line_model(texts)
    got = line_dedup.drop_recurring(rows_of(spark, texts)).collect()
    assert {r.doc_id: r.text for r in got} == {i: want[t] for i, t in enumerate(texts)}
    assert sum(want[t] != t for t in texts) > 20
