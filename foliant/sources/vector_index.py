"""A stored vector index: built once, then searched by many jobs.

Under one folder lie

- ``blocks``, partitioned by ``cell``: up to ``BLOCK_ROWS`` points of one cell as one Arrow body,
  with the range of their cosines to the cell's centre; points are sorted by that cosine;
- ``codes``: ids and the sign bits of each vector, one long for 64 dimensions;
- ``cells``: centre, number of rows and least cosine of each cell, and the number of cells to
  probe. Written last, it marks the index as complete.

A search joins blocks with the queries that probe their cell, so that only the partitions of
probed cells are read, and no point is copied for a block of queries. ``search`` with ``probes`` is
approximate; without, cells and blocks are skipped by the triangle inequality only, and
the result is exact. ``search_signs`` ranks by sign bits inside the JVM and rescores exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.ranking import salted_top_n
from foliant.functions.vectors import (
    GRID,
    SLICE_PRODUCTS,
    TopN,
    _batch,
    _Pairs,
    _read,
    _score,
    _unit_matrix,
    _write,
    dot,
    in_key_order,
    meet_parts,
    norm,
    on_grid,
    score_blocks,
    unit_score,
)
from foliant.session import cut, spread
from foliant.sources.store import _files

POINT = ("document_id", "chunk_index")
BLOCK_ROWS = 2048
#: Cells that are chosen by default: about the square root of the rows, up to this many.
MAX_CELLS = 4096
#: Bounds of the sample that centres are fitted on; every row is indexed.
SAMPLE_PER_CELL, SAMPLE_BYTES = 32, 64 << 20
#: Points whose neighbours decide how many cells are probed.
TUNED = 256
#: Cell of vectors without a direction.
NO_DIRECTION = -1
#: Bytes of query vectors, over all cells they probe, that are broadcast; more meet the blocks in a shuffle.
BROADCAST_BYTES = 64 << 20
#: Queries in one packed row.
PACK_ROWS = 2048
#: More queries meet parts of all points as matrices where a search would read over a quarter of (query, cell) anyway, and signs always.
MANY_QUERIES = 4096
#: Queries that decide whether cells leave out enough.
TRIED = 256
#: Room for rounding in bounds on cosines; angles near 0 are known to 1.5e-8.
SLACK = 1e-7


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    dim: int
    probes: int  # as tuned at the build

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codes")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")


def exists(spark: SparkSession, path: str) -> bool:
    fs, marker = _files(spark, f"{path}/cells/_SUCCESS")
    return fs.exists(marker)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    dim, probes = spark.read.parquet(f"{path}/cells").select(F.max("dim"), F.max("probes")).first()
    return VectorIndex(spark, path, dim or 1, probes or 1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def fit_centres(points: DataFrame, cells: int, dim: int, total: int, seed: int = 7, iterations: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means on a sample of at most ``SAMPLE_PER_CELL`` rows a cell and ``SAMPLE_BYTES`` bytes, drawn by a hash of the id."""
    rows = max(1, min(SAMPLE_PER_CELL * cells, SAMPLE_BYTES // (8 * dim)))
    place = F.pmod(F.xxhash64(*POINT), F.lit(1 << 30))
    near = int(min(1.0, (rows + 10 * rows**0.5 + 10) / max(1, total)) * (1 << 30))
    drawn = points.withColumn("_h", place).where(F.col("_h") < near).orderBy("_h").limit(rows).select("vector").toArrow()
    sample = _unit_matrix(drawn.column("vector"), dim)
    sample = sample[(sample != 0).any(axis=1)]
    if not len(sample):
        return np.zeros((1, dim))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(iterations):
        home = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        filled = (sums != 0).any(axis=1)
        centres[filled] = _unit_rows(sums[filled])
    return centres


def sign_words(vector: Column, dim: int) -> Column:
    """The signs of a vector as longs of 64 bits; a bit is set for a positive entry."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(vector, 64 * w + 1, 64), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.array(*[word(w) for w in range(-(-dim // 64))])


def _tuned(points: DataFrame, placed: DataFrame, centres: np.ndarray, n: int, recall: float, total: int) -> int:
    """The number of cells to probe so that ``recall`` of the exact ``n`` nearest points of ``TUNED`` drawn ones lie in them."""
    near = int(min(1.0, (TUNED + 10 * TUNED**0.5) / max(1, total)) * (1 << 30))
    drawn = points.withColumn("_h", F.pmod(F.xxhash64(*POINT, F.lit(1)), F.lit(1 << 30))).where(F.col("_h") < near).orderBy("_h").limit(TUNED)
    asked = cut(drawn.select(F.col("_h").alias("query_id"), "vector"))
    order = [F.desc("cosine"), *[F.col(k) for k in POINT]]
    exact = salted_top_n(score_blocks(points, asked, TopN(n), POINT, ("query_id",)), ["query_id"], order, n, POINT)
    homes = placed.select(*POINT, "cell").join(F.broadcast(exact.select("query_id", *POINT)), list(POINT)).select("query_id", "cell").collect()  # TUNED x n rows
    vectors = {r["query_id"]: np.array(r["vector"], float) for r in asked.collect()}
    ranks = {q: np.argsort(np.argsort(-(centres @ v), kind="stable"), kind="stable") for q, v in vectors.items()}
    places = sorted(int(ranks[r["query_id"]][r["cell"]]) if r["cell"] != NO_DIRECTION else 0 for r in homes)
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1 if places else 1


def build(chunks: DataFrame, path: str, cells: int | None = None, seed: int = 7, tune_n: int = 10, recall: float = 0.95) -> VectorIndex:
    """Indexes every row of ``chunks`` that has a vector; a vector of another length is an error.

    The number of cells to probe is tuned for ``recall`` among ``tune_n`` neighbours on a sample of points (``TUNED``), searched exactly.
    """
    spark = chunks.sparkSession
    points = cut(spread(chunks.select(*POINT, "vector").where(F.col("vector").isNotNull())))
    total, dim = points.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim = dim or 1
    cells = cells or max(1, min(MAX_CELLS, round(total**0.5)))
    fitted = fit_centres(points, cells, dim, total, seed)
    shared = spark.sparkContext.broadcast(fitted)  # cells x dim, bounded as the sample is

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if batch.num_rows:
                unit = _unit_matrix(batch.column("vector"), dim)
                cos = unit @ centres.T
                home = cos.argmax(axis=1)
                best = np.clip(cos[np.arange(len(home)), home], -1, 1)
                blank = ~(unit != 0).any(axis=1)
                home[blank], best[blank] = NO_DIRECTION, 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(best)], names=[*batch.schema.names, "cell", "cos"])

    kind = points.schema["vector"].dataType.simpleString()
    row = f"document_id long, chunk_index long, vector {kind}"
    placed = cut(points.mapInArrow(homes, f"{row}, cell int, cos double"))
    order = ["cell", "cos", *POINT]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
                if held and held[0].column("cell")[0].as_py() != int(cell[a]):
                    yield packed(held)
                    held = []
                while a < b:
                    room = BLOCK_ROWS - sum(h.num_rows for h in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += min(room, b - a)
                    if sum(h.num_rows for h in held) == BLOCK_ROWS:
                        yield packed(held)
                        held = []
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        cos = table.column("cos").to_numpy()
        body = _write(table.select([*POINT, "vector"]))
        values = (table.column("cell")[0].as_py(), len(cos), float(cos.min()), float(cos.max()), body)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["cell", "n", "low", "high", "body"])

    # ranges of (cell, cosine): a cell that holds a third of all rows is spread over tasks like any other
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(pack, "cell int, n int, low double, high double, body binary").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    placed.select(*POINT, sign_words(F.col("vector"), dim).alias("code")).sortWithinPartitions(*POINT).write.mode("overwrite").parquet(f"{path}/codes")
    centres = [(i, c.tolist()) for i, c in enumerate(fitted)] + [(NO_DIRECTION, [0.0] * dim)]
    known = spark.createDataFrame(centres, "cell int, centre array<double>")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low")) if total else known.limit(0).select("cell", F.lit(0).alias("n"), F.lit(0.0).alias("low"))
    probes = _tuned(points, placed, fitted, tune_n, recall, total) if total else 1
    listed = known.join(sizes, "cell").withColumns({"dim": F.lit(dim), "probes": F.lit(probes)})
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # a row a cell
    return VectorIndex(spark, path, dim, probes)


# --- search by cells ---------------------------------------------------------------------


@dataclass(frozen=True)
class _Cells:
    ids: np.ndarray
    centres: np.ndarray
    rows: np.ndarray
    reach: np.ndarray  # largest angle between the centre and a point

    @classmethod
    def of(cls, index: VectorIndex) -> _Cells:
        """The cell table, of at most ``MAX_CELLS`` rows unless the builder chose more."""
        table = index.cells.orderBy("cell").toArrow()
        ids = table.column("cell").to_numpy()
        reach = np.arccos(np.clip(table.column("low").to_numpy(), -1, 1))
        return cls(ids, np.array(table.column("centre").to_pylist()).reshape(len(ids), index.dim), table.column("n").to_numpy(), np.where(ids == NO_DIRECTION, np.pi, reach))

    def near(self, unit: np.ndarray, n: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cosines to all centres, cells by falling cosine, how many of them are probed first): ``probes``, or more until they hold ``n`` rows."""
        cos = unit @ self.centres.T
        order = np.argsort(-cos, axis=1, kind="stable")
        enough = (np.cumsum(self.rows[order], axis=1) < n).sum(axis=1) + 1
        return cos, order, np.minimum(np.maximum(enough, probes), len(self.ids))


def _probed(queries: DataFrame, cells: _Cells, n: int, probes: int, rest: bool) -> DataFrame:
    """(query_id, vector, bar, cell): the cells that each query has to see.

    Without ``rest`` the first ones; with it, all others whose bound reaches the query's ``bar``, its n-th best cosine so far.
    """
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                cos, order, first = known.near(_unit_matrix(some.column("vector"), known.centres.shape[1]), n, probes)
                early = np.zeros(cos.shape, bool)
                np.put_along_axis(early, order, np.arange(cos.shape[1]) < first[:, None], axis=1)
                if rest:
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - known.reach))
                    early = ~early & (bound + SLACK >= some.column("bar").to_numpy()[:, None])
                row, cell = np.nonzero(early)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in some.columns], pa.array(known.ids[cell].astype(np.int32))], names=[*some.schema.names, "cell"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(task, f"{fields}, cell int").where(F.col("cell") >= NO_DIRECTION)


def _packs(probed: DataFrame, dim: int) -> DataFrame:
    """(cell, asked): the queries of a cell in packed rows; broadcast if their bytes, counted, allow it."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            body = pa.Table.from_batches([batch]).drop_columns(["cell"])
            spans = [(a, min(a + PACK_ROWS, end)) for start, end in zip(edges, edges[1:]) for a in range(start, end, PACK_ROWS)]
            if spans:
                parts = [_write(body.slice(a, b - a).combine_chunks()) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(cell[[a for a, _ in spans]]), pa.array(parts, pa.binary())], names=["cell", "asked"])

    stored = cut(probed)
    size = stored.count() * (8 * dim + 64)
    packs = stored.repartition("cell").sortWithinPartitions("cell").mapInArrow(task, "cell int, asked binary").where(F.col("cell") >= NO_DIRECTION)
    return F.broadcast(packs) if size <= BROADCAST_BYTES else packs


def _scored(index: VectorIndex, packs: DataFrame, query_type: str, n: int) -> DataFrame:
    """(query_id, point, cosine): for each block and the queries that probe its cell, the n best points of each query.

    A query leaves out blocks whose points lie too far from the centre, or too near it, to reach its bar.
    """
    names = ["query_id", *POINT, "cosine"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, centre, body, asked in zip(*(batch.column(c) for c in ("low", "high", "centre", "body", "asked"))):
                table = _read(asked.as_py())
                unit = _unit_matrix(table.column("vector"))
                angle = np.arccos(np.clip(unit @ np.array(centre.as_py()), -1, 1))
                far, near = np.arccos(np.clip(low.as_py(), -1, 1)), np.arccos(np.clip(high.as_py(), -1, 1))
                bound = np.cos(np.maximum(0, np.maximum(angle - far, near - angle))) if any(centre.as_py()) else np.ones(len(unit))
                kept = np.flatnonzero(bound + SLACK >= table.column("bar").to_numpy())
                if not len(kept):
                    continue
                ids = table.select(["query_id"]).take(pa.array(kept))
                pairs = _Pairs(TopN(n), ids)
                for some in _read(body.as_py()).to_batches():
                    for part in _score(some, unit[kept], list(POINT), TopN(n)):
                        pairs.add(part)
                if (found := pairs.drain()) is not None:
                    yield _batch(found, ids, list(POINT), names)

    centres = index.cells.select("cell", "centre")
    blocks = index.blocks.join(packs, "cell").join(F.broadcast(centres), "cell")  # a row a cell, as in the driver
    return blocks.select("low", "high", "centre", "body", "asked").mapInArrow(task, f"query_id {query_type}, document_id long, chunk_index long, cosine double")


def stored_points(index: VectorIndex) -> DataFrame:
    """(document_id, chunk_index, vector) of all blocks."""
    some = index.blocks.select("body").first()
    kind = "double" if some is None or pa.types.is_float64(_read(some["body"]).schema.field("vector").type.value_type) else "float"

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                yield from _read(body.as_py()).select([*POINT, "vector"]).to_batches()

    return index.blocks.select("body").mapInArrow(task, f"document_id long, chunk_index long, vector array<{kind}>")


def _reads_most(index: VectorIndex, asked: DataFrame, cells: _Cells, n: int, probes: int | None) -> bool:
    """Whether many queries would visit over a quarter of all cells; an exact search is tried with some of them."""
    if asked.limit(MANY_QUERIES + 1).count() <= MANY_QUERIES:
        return False
    if probes is not None:
        return 4 * probes > len(cells.ids)
    few = cut(asked.limit(TRIED))
    bars = search(index, few, n, 1).where(F.col("rank") == n).select("query_id", (2 * F.col("score") - 1).alias("bar"))
    barred = few.join(bars, "query_id", "left").select("query_id", "vector", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    return 4 * _probed(barred, cells, n, 1, True).count() > TRIED * len(cells.ids)


def search(index: VectorIndex, queries: DataFrame, n: int, probes: int | None = None) -> DataFrame:
    """(query_id, document_id, chunk_index, score, rank): the n best points of each query.

    With ``probes``, those in its nearest cells (at least as many cells, and n rows). Without, the exact ones: the nearest
    cells give a bar, and only cells and blocks that can hold a point above it are read besides. Where many queries would
    visit over a quarter of the cells either way, each part of the points is read once for all of them: the result is exact.
    """
    asked = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    kind = asked.schema["query_id"].dataType.simpleString()
    cells = _Cells.of(index)
    order = [F.desc("cosine"), *[F.col(k) for k in POINT]]
    best = lambda df: salted_top_n(df, ["query_id"], order, n, POINT)
    start = asked.withColumn("bar", F.lit(-2.0))
    if len(cells.ids) == 0:
        return index.spark.createDataFrame([], f"query_id {kind}, document_id long, chunk_index long, score double, rank long")
    if _reads_most(index, asked, cells, n, probes):
        found = best(score_blocks(stored_points(index), asked, TopN(n), POINT, ("query_id",)))
        return found.select("query_id", *POINT, unit_score("cosine").alias("score"), "rank")
    found = best(_scored(index, _packs(_probed(start, cells, n, probes or 1, False), index.dim), kind, n))
    if probes is None:
        found = cut(found)
        bars = found.where(F.col("rank") == n).select("query_id", F.col("cosine").alias("bar"))
        barred = asked.join(bars, "query_id", "left").select("query_id", "vector", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
        more = _scored(index, _packs(_probed(barred, cells, n, 1, True), index.dim), kind, n)
        found = best(found.drop("rank").unionByName(more))
    return found.select("query_id", *POINT, unit_score("cosine").alias("score"), "rank")


# --- search by signs -------------------------------------------------------------------------


def sign_candidates(index: VectorIndex, queries: DataFrame, wanted: int, block: int = 4096) -> DataFrame:
    """(query_id, document_id, chunk_index, distance): all points whose number of differing signs is among the ``wanted`` smallest.

    Distances are whole numbers, so counts by (query, distance) give each query's limit in one pass over the codes, and a
    second pass keeps what lies within it, ties included. Nothing is sorted, and queries meet codes in blocks of ``block``.
    """
    words = -(-index.dim // 64)
    asked = cut(queries.where(F.col("vector").isNotNull()).select("query_id", sign_words(F.col("vector"), index.dim).alias("code")))
    blocks = max(1, -(-asked.count() // block))
    own = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    codes = spread(index.codes).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))

    def met(side: DataFrame) -> DataFrame:
        grouped = side.groupBy(own.alias("_b")).agg(F.collect_list(F.struct(*side.columns)).alias("_asked"))  # about ``block`` codes a row
        small = blocks * block * (8 * words + 40) <= BROADCAST_BYTES
        pairs = codes.join(F.broadcast(grouped) if small else grouped, "_b").select(*POINT, "code", F.explode("_asked").alias("_q"))
        distance = sum((F.bit_count(F.col("code")[w].bitwiseXOR(F.col("_q.code")[w])) for w in range(words)), F.lit(0))
        return pairs.select(*POINT, "_q", distance.cast("int").alias("distance"))

    counts = met(asked).groupBy("_q.query_id", "distance").count()
    reached = counts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "count"))).alias("c"))  # dim rows at most
    running = F.aggregate(
        "c",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("limit")),
        lambda s, x: F.when(s["sum"] >= wanted, s).otherwise(F.struct((s["sum"] + x["count"]).alias("sum"), x["distance"].alias("limit"))),
    )
    limits = cut(reached.select("query_id", running["limit"].alias("limit")))
    near = met(asked.join(limits, "query_id")).where(F.col("distance") <= F.col("_q.limit"))
    return near.select("_q.query_id", *POINT, "distance")


def _bits(column: pa.Array) -> np.ndarray:
    """Codes as a matrix of words."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(len(column), -1)


def _distances(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Differing signs of every query and point; ``held`` has a row a word."""
    total = np.bitwise_count(asked[:, :1] ^ held[0]).astype(np.uint16)
    for w in range(1, len(held)):
        total += np.bitwise_count(asked[:, w : w + 1] ^ held[w])
    return total


class _SignCounts:
    """How many codes of a part lie at each distance of a query."""

    def __init__(self, points: pa.Table):
        self.held = np.ascontiguousarray(_bits(points.column("vector").combine_chunks()).T)

    def meet(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, bits = _bits(queries.column("vector")), 64 * len(self.held)
        rows, step = [], max(1, SLICE_PRODUCTS // self.held.shape[1])
        for at in range(0, len(asked), step):
            rows += [np.bincount(row, minlength=bits + 1) for row in _distances(asked[at : at + step], self.held)]
        counts = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (bits + 1)), pa.array(np.concatenate(rows)))
        yield pa.RecordBatch.from_arrays([queries.column("query_id"), counts], names=["query_id", "counts"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class _SignTop:
    """The n points of a part with the best cosine among those within a query's ``limit`` of differing signs."""

    def __init__(self, points: pa.Table, n: int):
        self.ids, order = in_key_order(points)
        self.unit, self.n = _unit_matrix(points.column("vector"))[order], n
        self.held = self._codes(self.unit).T.copy()

    @staticmethod
    def _codes(unit: np.ndarray) -> np.ndarray:
        packed = np.packbits(unit > 0, axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

    def meet(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit = _unit_matrix(queries.column("vector"), self.unit.shape[1])
        codes, limit = self._codes(unit), queries.column("limit").to_numpy()
        ids = pa.table({"query_id": queries.column("query_id")})
        pairs = _Pairs(TopN(self.n), ids)
        step = max(1, SLICE_PRODUCTS // self.held.shape[1])
        for at in range(0, len(unit), step):
            row, col = np.nonzero(_distances(codes[at : at + step], self.held) <= limit[at : at + step, None])
            for a in range(0, len(row), 32_768):
                r, c = row[a : a + 32_768] + at, col[a : a + 32_768]
                grid = np.rint(np.einsum("ij,ij->i", unit[r], self.unit[c]) * GRID).astype(np.int64)
                pairs.add((r, grid, *[k[c] for k in self.ids]))
        if (found := pairs.drain()) is not None:
            yield _batch(found, ids, list(POINT), ["query_id", *POINT, "cosine"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _many_by_signs(index: VectorIndex, points: DataFrame, asked: DataFrame, n: int, wanted: int) -> DataFrame:
    """(query_id, point, cosine): the best of each part of the points. Limits come from counts over the stored codes, as in ``sign_candidates``."""
    block = F.lit(0).cast("long").alias("block")
    kind = asked.schema["query_id"]
    codes = index.codes.select(block, *POINT, F.col("code").alias("vector"))
    signs = asked.select(block, "query_id", sign_words(F.col("vector"), index.dim).alias("vector"))
    counted = T.StructType([kind, T.StructField("counts", T.ArrayType(T.LongType()))])
    counts = meet_parts(codes, signs, POINT, ("query_id",), _SignCounts, counted, index.dim)
    sums = counts.select("query_id", F.posexplode("counts").alias("distance", "n")).where("n > 0").groupBy("query_id", "distance").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("distance"))  # dim rows a query
    limit = F.coalesce(F.min(F.when(F.col("n") >= wanted, F.col("distance"))), F.max("distance")).alias("limit")
    limits = sums.withColumn("n", upto).groupBy("query_id").agg(limit)
    limited = cut(asked.join(limits, "query_id").select(block, "query_id", "limit", "vector"))
    schema = T.StructType([kind, *[T.StructField(k, T.LongType()) for k in POINT], T.StructField("cosine", T.DoubleType())])
    return meet_parts(points.select(block, *POINT, "vector"), limited, POINT, ("query_id", "limit"), lambda table: _SignTop(table, n), schema, n)


def search_signs(index: VectorIndex, chunks: DataFrame, queries: DataFrame, n: int, oversample: int = 8) -> DataFrame:
    """(query_id, document_id, chunk_index, score, rank): candidates by signs, ranked by their exact cosine.

    Up to ``MANY_QUERIES`` queries need no Python on the way.
    """
    order = [F.desc("cosine"), *[F.col(k) for k in POINT]]
    wanted = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    if wanted.limit(MANY_QUERIES + 1).count() > MANY_QUERIES:
        scored = _many_by_signs(index, chunks.where(F.col("vector").isNotNull()), wanted, n, n * oversample)
        found = salted_top_n(scored, ["query_id"], order, n, POINT)
        return found.select("query_id", *POINT, unit_score("cosine").alias("score"), "rank")
    near = sign_candidates(index, queries, n * oversample)
    points = chunks.select(*POINT, F.col("vector").alias("p"), norm("vector").alias("_p"))
    asked = queries.select("query_id", F.col("vector").alias("q"), norm("vector").alias("_q"))
    pairs = near.join(points, list(POINT)).join(asked, "query_id")
    product = F.col("_p") * F.col("_q")
    scored = pairs.select("query_id", *POINT, on_grid(F.when(product == 0, F.lit(0.0)).otherwise(dot("p", "q") / product)).alias("cosine"))
    found = salted_top_n(scored, ["query_id"], order, n, POINT)
    return found.select("query_id", *POINT, unit_score("cosine").alias("score"), "rank")
