import random
import unicodedata
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from foliant.functions.graph import connected_components
from foliant.functions.names import PIECE, normalise_name, piece_sides, similar_names
from foliant.operators import entities as E


def fold(name):
    """A model of the normalisation, character by character."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.strip().casefold()) if unicodedata.category(c) not in ("Mn", "Me") or not unicodedata.combining(c))


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = {}
    for n in nodes:
        groups.setdefault(root(n), []).append(n)
    return [sorted(g) for g in groups.values()]


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    edges, want = [], {}
    for case in range(30):
        pairs = [(rng.randrange(1, 31), rng.randrange(1, 31)) for _ in range(rng.randrange(1, 41))]
        if case == 0:
            pairs = [(i, i + 1) for i in range(1, 60)]  # a long chain
        if case == 1:
            pairs = [(1, i) for i in range(2, 200)]  # a hub
        edges += [(case, a, b) for a, b in pairs]
        for group in union_find({n for p in pairs for n in p}, pairs):
            for n in group:
                want[(case, n)] = group[0]
    df = spark.createDataFrame(edges, "scope long, a long, b long")
    assert {(r.scope, r.id): r.component for r in connected_components(df, "scope").collect()} == want


def test_names_are_folded(spark):
    rows = [("  Straße ÉTÉ ",), ("ﬁle",), (None,), ("",), ("İ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "name string").select(normalise_name("name")).collect()]
    assert got == ["strasse ete", "file", None, "", fold("İ")]


def names(rng, n):
    base = ["invoice", "telekom", "allianz versicherung", "brand#12", "tax office", "aa", "b", "rental contract"]
    out = []
    for _ in range(n):
        word = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            if rng.random() < 0.5 and len(word) > 1:
                word.pop(min(at, len(word) - 1))
            else:
                word.insert(at, rng.choice("abcdetxyz# 19"))
        out.append("".join(word))
    return out


def test_similar_names_misses_nothing(spark):
    rng = random.Random(2)
    distinct = sorted({n for n in names(rng, 350) if n})
    df = spark.createDataFrame([("tag", n) for n in distinct], "entity_type string, norm string")
    for threshold in (0.7, 0.85, 0.95):
        got = {frozenset((r.a, r.b)) for r in similar_names(df, threshold).collect()}
        want = {
            frozenset((a, b))
            for i, a in enumerate(distinct)
            for b in distinct[i + 1 :]
            if max(ratio(a, b), ratio(b, a)) >= threshold
        }
        assert got == want, threshold


def all_pairs(rows, dismissed, t_name, t_emb):
    """The pairwise definition with names that may be missing: {(a, b): (signal, similarity)}."""
    pairs = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if frozenset((a[0], b[0])) in dismissed:
                continue
            r = 0 if a[1] is None or b[1] is None else ratio(fold(a[1]), fold(b[1]))
            if r >= t_name:
                pairs[(a[0], b[0])] = ("name", round(r, 3))
            elif a[2] is not None and b[2] is not None:
                c = float(np.dot(a[2], b[2]) / (np.linalg.norm(a[2]) * np.linalg.norm(b[2])))
                if c >= t_emb:
                    pairs[(a[0], b[0])] = ("embedding", round(c, 3))
    return pairs


def clusters_by_pairs(rows, dismissed, t_name, t_emb):
    """The pairwise definition, on a small table."""
    pairs = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if frozenset((a[0], b[0])) in dismissed:
                continue
            r = ratio(fold(a[1]), fold(b[1]))
            if r >= t_name:
                pairs[(a[0], b[0])] = ("name", round(r, 3))
            elif a[2] is not None and b[2] is not None:
                x, y = np.array(a[2]), np.array(b[2])
                c = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
                if c >= t_emb:
                    pairs[(a[0], b[0])] = ("embedding", round(c, 3))
    nodes = {n for p in pairs for n in p}
    out = {}
    for group in union_find(nodes, pairs):
        inside = [v for (a, b), v in pairs.items() if a in group]
        signal = "embedding" if any(s == "embedding" for s, _ in inside) else "name"
        out[tuple(group)] = (signal, max(v for _, v in inside))
    return out


def test_dedup_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i, name in enumerate(names(rng, 160), 1):
        # A third of all rows carry one name, in several spellings.
        name = rng.choice(["Telekom", " telekom", "TELEKOM"]) if i % 3 == 0 else name
        vector = None if i % 4 == 0 else [rng.uniform(-1, 1) for _ in range(3)]
        rows.append((i, name, vector))
    ids = [r[0] for r in rows]
    dismissed = {frozenset(rng.sample(ids, 2)) for _ in range(150)}
    dismissed |= {frozenset((3, j)) for j in ids if j % 3 == 0 and j != 3}  # cut off from its own name
    entities = spark.createDataFrame(
        [("tag", i, n, v, "", v is not None) for i, n, v in rows],
        "entity_type string, entity_id long, name string, vector array<double>, description string, embedding_stored boolean",
    )
    dismissals = spark.createDataFrame(
        [("tag", min(p), max(p), "dedup") for p in dismissed] + [("tag", 1, None, "dedup"), ("tag", 1, 2, "add")],
        "entity_type string, entity_id long, other_entity_id long, action string",
    )
    links = E.dedup_links(entities, dismissals, 0.85, 0.97)
    assert links.count() < 160 * 160 / 6
    got = {}
    for r in E.dedup_clusters(links, entities).orderBy("cluster_id", "entity_id").collect():
        got.setdefault(r.cluster_id, []).append(r)
    got = {tuple(m.entity_id for m in v): (v[0].signal, round(v[0].similarity, 3)) for v in got.values()}
    assert got == clusters_by_pairs(rows, dismissed, 0.85, 0.97)


ENTITY = "entity_type string, entity_id long, name string, vector array<double>, description string, embedding_stored boolean"
DISMISSAL = "entity_type string, entity_id long, other_entity_id long, action string"


def test_dedup_links_are_all_pairs(spark):
    """Copies of names, of names with vectors, empty and missing names, two types: each pair that meets a threshold."""
    rng = random.Random(14)
    few = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(4)]
    rows = []
    for i, name in enumerate(names(rng, 140), 1):
        name = rng.choice(["Telekom", " telekom", "TELEKOM"]) if i % 4 == 0 else rng.choice(["", " ", None, None]) if i % 14 == 1 else name
        vector = None if i % 5 == 0 else rng.choice(few) if i % 2 else [rng.uniform(-1, 1) for _ in range(3)]
        rows.append((i, name, vector))
    dismissed = {frozenset(rng.sample(range(1, 141), 2)) for _ in range(200)} | {frozenset((4, j)) for j in range(8, 80, 4)}
    entities = spark.createDataFrame([(t, i, n, v, "", v is not None) for t in ("tag", "correspondent") for i, n, v in rows], ENTITY)
    dismissals = spark.createDataFrame([("tag", min(p), max(p), "dedup") for p in dismissed], DISMISSAL)
    tags = all_pairs(rows, dismissed, 0.85, 0.97)
    want = {("tag", *p): v for p, v in tags.items()} | {("correspondent", *p): v for p, v in all_pairs(rows, set(), 0.85, 0.97).items()}
    for copy_rows in (1024, 4):
        got = E.dedup_links(entities, dismissals, 0.85, 0.97, copy_rows).collect()
        assert len(got) == len(want)
        assert {(r.entity_type, r.id_a, r.id_b): (r.signal, r.similarity) for r in got} == want
    found = E.dedup_clusters(E.cluster_links(entities, dismissals, 0.85, 0.97), entities).where("entity_type = 'tag'").collect()
    parts = {}
    for r in found:
        parts.setdefault(r.cluster_id, []).append(r)
    groups = union_find({n for p in tags for n in p}, tags)
    inside = {tuple(g): [v for p, v in tags.items() if p[0] in g] for g in groups}
    assert {tuple(sorted(m.entity_id for m in v)): (v[0].signal, v[0].similarity) for v in parts.values()} == {
        g: ("embedding" if any(s == "embedding" for s, _ in v) else "name", max(x for _, x in v)) for g, v in inside.items()
    }


def test_order_of_names_counts_for_vectors(spark):
    """Names alike in one order only: copies on both sides of an id are linked by name there and by vector here."""
    a, b = "babbaab", "bababab"
    assert ratio(a, b) >= 0.85 > ratio(b, a)
    rows = [(1, a, [1.0, 0.0]), (5, b, [1.0, 0.01]), (10, a, [1.0, 0.0])]
    entities = spark.createDataFrame([("tag", i, n, v, "", True) for i, n, v in rows], ENTITY)
    none = spark.createDataFrame([], DISMISSAL)
    want = all_pairs(rows, set(), 0.85, 0.97)
    assert {s for s, _ in want.values()} == {"name", "embedding"}
    assert {(r.id_a, r.id_b): (r.signal, r.similarity) for r in E.dedup_links(entities, none, 0.85, 0.97).collect()} == want
    assert {r.signal for r in E.dedup_clusters(E.cluster_links(entities, none, 0.85, 0.97), entities).collect()} == {"embedding"}


def test_merge_keeps_other_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a", [5, 6, 7]), (2, "b", [6]), (3, "c", [8]), (4, "d", [])], "document_id long, title string, tag_ids array<long>"
    )
    entities = spark.createDataFrame([("tag", 5, "five"), ("tag", 6, "six"), ("tag", 7, "seven")], "entity_type string, entity_id long, name string")
    mapping = spark.createDataFrame([(6, 5), (7, 5)], "remove_id long, keep_id long")
    merged, audit, left = E.merge_entities(docs, entities, mapping, "tag", "ann", F.lit("2024-01-01").cast("timestamp"))
    assert {r.document_id: r.tag_ids for r in merged.collect()} == {1: [5], 2: [5], 3: [8], 4: []}
    assert sorted((r.document_id, r.previous_value, r.new_value) for r in audit.collect()) == [
        (1, "seven", "five"), (1, "six", "five"), (2, "six", "five"),
    ]
    assert [r.entity_id for r in left.collect()] == [5]


def test_pairs_in_cells_equal_all_pairs(spark):
    """Clusters of unlike width, a zero vector, one vector many times, three types with equal ids."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    vectors = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * rng.choice([0.02, 0.3, 1.0], (300, 1))
    vectors[7] = 0
    vectors[20:60] = vectors[20]
    kinds = ["tag", "correspondent", "document_type"]
    rows = [(kinds[i % 3], i // 3, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows.append(("tag", 1000, None))
    df = spark.createDataFrame(rows, "entity_type string, entity_id long, vector array<double>")
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    near = unit @ unit.T
    for threshold in (0.9, 0.3):
        want = sorted(
            ((kinds[i % 3], i // 3, j // 3), near[i, j])
            for i in range(300) for j in range(i + 3, 300, 3) if near[i, j] >= threshold
        )
        for sizes in ({"one_block": 10, "cell_rows": 20}, {}):
            got = E.embedding_pairs(df, threshold, **sizes).collect()
            got = sorted(((r.entity_type, r.id_a, r.id_b), r.cosine) for r in got)
            assert [pair for pair, _ in got] == [pair for pair, _ in want]
            assert np.allclose([c for _, c in got], [c for _, c in want], rtol=0, atol=1e-11)


def test_pieces_of_unlike_names_seldom_meet(spark):
    """Names of 12 characters meet in pieces of 4: few of 20 000 random ones, where pieces of 2 let millions meet."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("0123456789abcdef") for _ in range(12)) for _ in range(20_000)})
    df = spark.createDataFrame([("t", n) for n in names], "entity_type string, norm string")
    left, probe = piece_sides(df, 0.85, "entity_type", "norm")
    met = left.join(probe, PIECE).where("a < b").count()
    assert met < 4 * len(names)


def test_pieces_by_lengths_miss_nothing(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 24))) for _ in range(60)]
    names = set(base)
    for n in base:
        for _ in range(4):
            letters = list(n)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(letters))
                letters[at : at + rng.randrange(2)] = [rng.choice(["", "x", "yz"])]
            names.add("".join(letters) or "q")
    names = sorted(names)
    df = spark.createDataFrame([("t", n) for n in names], "entity_type string, norm string")
    for threshold in (0.7, 0.85):
        want = {frozenset((a, b)) for a in names for b in names if a != b and ratio(a, b) >= threshold}
        assert {frozenset((r.a, r.b)) for r in similar_names(df, threshold).collect()} == want
