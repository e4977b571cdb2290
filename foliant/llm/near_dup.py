"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch: round i hashes every shingle of a text to one of T bins with a value in
[i, i + 1); a bin keeps its smallest value. Rounds end as soon as no bin is empty, and
from round T on, round T + b fills bin b, so that every coordinate is filled after 2T
rounds at most. Coordinates agree with probability equal to the Jaccard similarity and
concentrate about it as independent ones do.

Bands of coordinates make buckets. Inside a bucket no pair list is made:

1. texts with equal sets are one class, and only one row of it goes on;
2. every member is compared with its bucket's smallest member, on full sets;
3. buckets whose members are not yet in one component compare them with another member,
   drawn by hash;
4. what is still apart is compared exhaustively, in blocks of a few hundred texts a task:
   pairs that the sketches do not exclude (six standard deviations) on full sets.

Similarity is at least ``percent`` / 100, on hashed shingles (64 bits) of whole texts. With
200 coordinates in bands of five, a linked pair shares no bucket with probability 1.3e-7.

Defined results: a null text, or one without words, has no shingles and stays alone;
fewer words than a shingle make one shingle of them all; rows that repeat an id are
separate documents under that id, equal texts always one class; a null id never links
and is its own (null) component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.graph import connected_components
from foliant.llm.common import broadcast_checked, collecting, discard, doc_rows, stored
from foliant.llm.words import batches, mix, word_hashes

COORDINATES = 200
ROWS = 5
ROUNDS = 2
#: Members of a bucket, and shingles of their sets, that a block of the exhaustive stage holds about.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
SALTS = 32
#: Edges that one task joins into components: some tens of MB.
FEW_EDGES = 200_000
_EMPTY = np.uint64((1 << 64) - 1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes text by text, offsets of n + 1 texts)."""
    hashes, offsets = word_hashes(texts)
    windows = hashes[: max(0, len(hashes) - words + 1)].copy()
    for j in range(1, words):
        windows = mix(windows * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + len(windows)], j)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(windows[a : b - words + 1]))
        elif b > a:
            whole = hashes[a : a + 1]
            for j in range(a + 1, b):
                whole = mix(whole * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + 1], 99 + b - a)
            sets.append(whole)
        else:
            sets.append(hashes[:0])
    return np.concatenate([hashes[:0], *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def similarity_sketch(values: np.ndarray, offsets: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """One row of ``size`` filled coordinates for each set; an empty set has all-empty ones."""
    sets = len(offsets) - 1
    bins = np.full(sets * size, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    for round_ in range(2 * size):
        if not len(values):
            break
        drawn = mix(values, 1000 + round_)
        place = (drawn & np.uint64(0xFFFF)) * np.uint64(size) >> np.uint64(16)
        if round_ >= size:
            place[:] = round_ - size
        at = owner * size + place.astype(np.int64)
        np.minimum.at(bins, at, np.uint64(round_ << 48) | (drawn >> np.uint64(16)))
        open_ = (bins.reshape(sets, size) == _EMPTY).any(axis=1)[owner]
        values, owner = values[open_], owner[open_]
    return bins.reshape(sets, size)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, rows)
    keys = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=np.uint64), 3), parts.shape[:2]).copy()
    for j in range(rows):
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, j], j)
    return keys


def sketches(docs: DataFrame, words: int = 2) -> DataFrame:
    """(doc_id, n, high, low, keys, brief): set size, its 128-bit digest, band keys, a byte per coordinate."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", 1 << 20):
            values, offsets = shingle_sets(batch.column(1), words)
            sketch = similarity_sketch(values, offsets)
            keys = band_keys(sketch)
            n = np.diff(offsets)
            digests = []
            for seed in (11, 12):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values, seed), dtype=np.uint64)])
                digests.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
            brief = mix(sketch, 5).astype(np.uint8)
            flat = pa.array(keys.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *map(pa.array, digests), lists, pa.array([b.tobytes() for b in brief], pa.binary())],
                ["doc_id", "n", "high", "low", "keys", "brief"],
            )

    return doc_rows(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n long, high long, low long, keys array<long>, brief binary"
    )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` per cent of their union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    spots = np.searchsorted(large, small)
    same = int((large[np.minimum(spots, len(large) - 1)] == small).sum())
    return 100 * same >= percent * (len(small) + len(large) - same)


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, p) whose full shingle sets are similar enough.

    Texts meet by p and a salt of a, each p first and then its a rows one by one, so a
    task holds one p at a time however many a rows it has.
    """
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt")
    wanted = pairs.select("a", "p", salt, F.lit(1).alias("role"))
    wanted = wanted.unionByName(
        wanted.select(F.col("p").alias("a"), "p", "salt", F.lit(0).alias("role")).distinct()
    )
    met = (
        doc_rows(docs, "doc_id", "text")
        .join(broadcast_checked(stored(wanted, "wanted")), F.col("doc_id") == F.col("a"))
        .select("p", "salt", "role", "a", "text")
        .repartition("p", "salt")
        .sortWithinPartitions("p", "salt", "role", "a")
    )

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, centres = None, []
        for batch in batches(rows, "text", 2 << 20):
            values, offsets = shingle_sets(batch.column(4), words)
            p, salts, roles, a = (batch.column(i).to_pylist() for i in range(4))
            found = []
            for i in range(len(p)):
                own = values[offsets[i] : offsets[i + 1]]
                if (p[i], salts[i]) != place:
                    place, centres = (p[i], salts[i]), []
                if roles[i] == 0:
                    centres.append(own)
                    continue
                if any(similar(own, centre, percent) for centre in centres):
                    found.append(i)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in found], pa.int64()), pa.array([p[i] for i in found], pa.int64())], ["a", "p"])

    return met.mapInArrow(compare, "a long, p long").distinct()


def _in_blocks(mixed: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, p) that join what is still apart in a bucket: every pair of its members is considered.

    ``mixed``: (key, band, members, shingles, class_id, component, brief, keys, text). Members of a bucket are dealt into
    blocks, by their number and the size of their sets; a task gets two blocks at a time, compares full sets where the sketches do not
    exclude a link, and returns only edges that join components. A pair is compared in
    the first band that both share, by the keys that made the buckets; a class without keys (its id
    has several rows) is compared in every band.
    """
    share = percent / 100
    bar = COORDINATES * share - 6 * (COORDINATES * share * (1 - share)) ** 0.5
    shingles = F.col("shingles") if "shingles" in mixed.columns else F.lit(0)
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("class_id", F.lit(7)), blocks).cast("int")
    dealt = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "class_id", "component", "brief", "keys", "text")

    def compare(group: pa.Table) -> pa.Table:
        ids, component = group["class_id"].to_numpy(), group["component"].to_numpy().copy()
        own, brief = group["own"].to_numpy(), np.frombuffer(b"".join(group["brief"].to_pylist()), np.uint8).reshape(len(ids), -1)
        values, offsets = shingle_sets(group["text"].combine_chunks(), words)
        lists = group["keys"].combine_chunks()
        sure, keys = lists.is_valid().to_numpy(zero_copy_only=False), np.zeros((len(ids), COORDINATES // ROWS), np.int64)
        keys[sure] = lists.flatten().to_numpy().reshape(-1, keys.shape[1])
        i, j, band = (group[c][0].as_py() for c in ("i", "j", "band"))
        right = np.flatnonzero(own == j)
        a, p = [], []
        for x in np.flatnonzero(own == i):
            near = right[component[right] != component[x]]
            near = near[near > x] if i == j else near
            near = near[(brief[near] == brief[x]).sum(axis=1) >= bar]
            near = near[~(sure[x] & sure[near] & (keys[near, :band] == keys[x, :band]).any(axis=1))]
            for y in near:
                if component[y] != component[x] and similar(
                    values[offsets[x] : offsets[x + 1]], values[offsets[y] : offsets[y + 1]], percent
                ):
                    a.append(max(ids[x], ids[y])), p.append(min(ids[x], ids[y]))
                    component[component == component[y]] = component[x]
        return pa.table({"a": pa.array(a, pa.int64()), "p": pa.array(p, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, p long").distinct()


def near_components(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``; a component's id is its smallest doc_id."""
    all_sketches = stored(sketches(docs, words), "sketches")
    same = ["n", "high", "low"]
    filled = all_sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy(*same).agg(F.min("doc_id").alias("class_id"))
    reps = filled.join(classes, same).where(F.col("doc_id") == F.col("class_id"))
    entries = reps.select("class_id", "n", F.posexplode("keys").alias("band", "key"))
    ends = entries.groupBy("key").agg(F.min("class_id").alias("pivot"), F.max("class_id").alias("last"))
    buckets = stored(entries.join(ends.where("pivot < last").drop("last"), "key").distinct(), "buckets")

    pairs = buckets.where("class_id != pivot").select(F.col("class_id").alias("a"), F.col("pivot").alias("p")).distinct()
    pairs = stored(pairs, "pairs")
    with collecting() as inner:
        found = verified(docs, pairs, words, percent)
    edges = stored(found, "edges")
    discard(docs.sparkSession, inner)
    labels = _labels(edges)
    for step in range(1, ROUNDS + 1):
        placed = buckets.join(labels, F.col("class_id") == F.col("id"), "left").select(
            "key", "band", "class_id", "n", F.coalesce("component", "class_id").alias("component")
        )
        chosen = F.struct(F.xxhash64("class_id", F.lit(step)), "class_id", "component")
        state = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min(chosen).alias("pivot"),
            F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.sum(F.shiftright(F.xxhash64("class_id"), 24)).alias("print"), F.min("band").alias("band"),
        ).where("low < high")
        with collecting() as inner:
            if step < ROUNDS:
                open_ = placed.join(state.select("key", "pivot"), "key").where(F.col("component") != F.col("pivot.component"))
                fresh = open_.select(F.greatest("class_id", "pivot.class_id").alias("a"), F.least("class_id", "pivot.class_id").alias("p"))
                fresh = stored(fresh.distinct().join(pairs, ["a", "p"], "left_anti"), "pairs")
                found = verified(docs, fresh, words, percent)
            else:  # of buckets with the same members, the one of the first band
                state = state.groupBy("members", "print").agg(F.min_by(F.struct("key", "shingles"), "band").alias("one"))
                members = stored(placed.drop("n").join(state.select("one.key", "members", "one.shingles"), "key"), "mixed")
                one = F.when(F.count(F.lit(1)) == 1, F.first("keys")).alias("keys")
                briefs = reps.groupBy("class_id").agg(F.first("brief").alias("brief"), one)
                known = members.select("class_id").distinct().join(briefs, "class_id")
                texts = doc_rows(docs, "doc_id", "text").join(broadcast_checked(known), F.col("doc_id") == F.col("class_id")).select("class_id", "brief", "keys", "text")
                found = _in_blocks(members.join(texts, "class_id"), words, percent)
        found = stored(found, "edges")
        discard(docs.sparkSession, inner)  # read for these edges only
        if not found.isEmpty():
            edges = edges.unionByName(found)
            labels = _labels(edges)
    groups = classes.join(labels, F.col("class_id") == F.col("id"), "left").select(
        *same, F.coalesce("component", "class_id").alias("component_id")
    )
    return all_sketches.select("doc_id", *same).join(groups, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _labels(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of ``edges``: up to ``FEW_EDGES`` in one task, more by rounds of joins."""
    if edges.limit(FEW_EDGES + 1).count() > FEW_EDGES:
        return stored(connected_components(edges.select("a", F.col("p").alias("b"))), "labels")

    def joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in rows:
            for a, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                above.setdefault(a, a), above.setdefault(p, p)
                low, high = sorted((root(a), root(p)))
                above[high] = low  # the smallest id of a component is its root
        ids = sorted(above)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], ["id", "component"])

    return stored(edges.select("a", "p").coalesce(1).mapInArrow(joined, "id long, component long"), "labels")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of a component beyond its smallest doc_id; a repeated id keeps its rows."""
    extra = near_components(docs, words, percent).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)
