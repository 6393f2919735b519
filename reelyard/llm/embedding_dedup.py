"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, components.

Vectors are scaled to length one; equal vectors are one *class* that counts its copies.
Spherical k-means on a bounded sample gives the cell centres; every class lives in the cell
of its nearest centre and also *visits* the later cells in which a vector of cosine ``cosine``
may live. Cells are cut into blocks, pairs of blocks are multiplied, and a link between two
cells is found once, in the later one, and counted for both ends. A block hands on a spanning
forest of its links, never all of them.

A visit is no copy of the vector. Neighbouring blocks form *groups* of bounded size; a *tile* is
two groups, holds each of their blocks once and multiplies those rows that visit. So a vector is
shuffled once for each tile of its group, however many cells it visits, and a task holds two
groups, however large the table is.

``reach=None``, as registered, rules a cell out only by bounds that hold for all vectors: the
boundary between the two centres is farther than the angle of ``cosine``, or so are all
distances from the centre that members of the cell have. So every link is found, however the
vectors lie; cells of spread-out vectors visit nearly all others. With a number, visits to all
cells end at that many deviations ``sqrt((1 - cosine ** 2) / (d - 1))`` of an offset that is
spread evenly over all dimensions; links of vectors that vary in few directions are then lost,
and each end counts what it finds in its own cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import stored

COSINE = 0.95
#: Vectors of the sample that the centres are fitted on, at most.
SAMPLE = 20_000
#: Classes that a cell holds on average, until there are ``MOST_CELLS`` cells.
CELL = 4_000
MOST_CELLS = 2_048
BLOCK = 4_096
#: Bytes of the vectors of a group as shuffled, at most, if a block is no larger.
GROUP_BYTES = 32 << 20
#: Groups that a small table is cut into, so that there are tiles for many tasks.
LEAST_GROUPS = 12
#: Rows of a block that are multiplied at a time.
STRIP = 512
REACH = None
ROUNDS = 8


def valid(column: str) -> F.Column:
    """Whether a vector can link: not null or empty, all parts finite, not all zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    vectors = vectors / top
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.chunked_array(column).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centres, each the direction of the sum of its vectors."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1))
        centres[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9, None]
    return centres


def spans(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest angle between each centre and the vectors that live in its cell.

    A vector at the same distance from several centres, up to rounding, counts for all.
    """
    dots = vectors @ centres.T
    lives = dots >= dots.max(axis=1, keepdims=True) - 1e-9
    angle = np.arccos(np.clip(dots, -1, 1))
    return np.where(lives, angle, np.inf).min(axis=0), np.where(lives, angle, -np.inf).max(axis=0)


def place(
    vectors: np.ndarray, centres: np.ndarray, cosine: float, reach: float | None, within: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and "lives there" of every vector and every cell it lives in or visits.

    ``within`` has the ``spans`` of all vectors; with them fewer cells are visited.
    """
    dots = vectors @ centres.T
    home = dots.argmax(axis=1)
    best = dots[np.arange(len(dots)), home]
    near = may_visit(dots, best, between(centres)[home], cosine, reach, vectors.shape[1], within)
    near[np.arange(len(dots)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def between(centres: np.ndarray) -> np.ndarray:
    """Distances of the centres from each other."""
    return np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))


def may_visit(
    dots: np.ndarray, best: np.ndarray, apart: np.ndarray | float, cosine: float, reach: float | None, d: int,
    within: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Which cells (columns) each vector (row) visits.

    ``dots``: cosines with the cells' centres, ``best``: with the vector's own; ``apart``: distances
    of its own centre from the others.
    """
    gap = best[:, None] - dots
    if reach is not None:
        spread = np.sqrt((1 - cosine**2) / max(d - 1, 1))
        return gap * cosine <= apart * min(reach * spread, np.sqrt(2 - 2 * cosine)) + 1e-9
    far = np.sqrt(1 - cosine**2) if cosine > 0 else np.sqrt(2 - 2 * cosine)
    near = gap <= apart * far + 1e-9
    if within is not None:
        angle, turn = np.arccos(np.clip(dots, -1, 1)), np.arccos(cosine) + 1e-6  # arccos loses half the digits
        near &= (angle >= within[0] - turn) & (angle <= within[1] + turn)
    return near


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``n`` nodes."""
    parent = np.arange(n)
    label = np.arange(n)
    while True:  # smallest label of the neighbours, by pointer jumping
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(i, int(label[i])) for i in np.flatnonzero(label != parent)]


def link_tile(table: pa.Table, plan: Plan) -> pa.Table:
    """Links between the blocks of two groups, or inside one: counts by class, and a forest of each pair of blocks."""
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    sides = {low: [], high: []}
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            sides[batch["group"][i].as_py()].append(Block.of({c: batch[c][i] for c in batch.schema.names}, plan.kind))
    out = [NO_LINKS]
    for at, a in enumerate(sides[low]):
        for b in sides[low][at:] if low == high else sides[high]:
            out += link_blocks(a, b, plan)
    return pa.concat_tables(out)


@dataclass
class Block:
    """Vectors of one cell."""

    cell: int
    number: int
    ids: np.ndarray
    ns: np.ndarray
    x: np.ndarray
    #: Cosines with the cell's own centre.
    best: np.ndarray

    @staticmethod
    def of(row: dict, kind: str) -> Block:
        read = lambda c, t: np.frombuffer(row[c].as_buffer(), t)
        ids = read("ids", np.int64)
        x = unit(read("xs", kind).astype(np.float64).reshape(len(ids), -1))
        return Block(row["cell"].as_py(), row["block"].as_py(), ids, read("ns", np.int64), x, read("best", np.float64))

    def visitors(self, cell: int, plan: Plan) -> Block | None:
        """The vectors that visit a cell."""
        if not plan.visits[self.cell, cell]:
            return None
        dots = self.x @ plan.centres[cell : cell + 1].T
        within = None if plan.within is None else (plan.within[0][[cell]], plan.within[1][[cell]])
        apart = between(plan.centres[[self.cell, cell]])[0, 1]
        at = np.flatnonzero(may_visit(dots, self.best, apart, plan.cosine, plan.reach, self.x.shape[1], within)[:, 0])
        if len(at) == len(self.x):
            return self
        return Block(self.cell, self.number, self.ids[at], self.ns[at], self.x[at], self.best[at]) if len(at) else None


@dataclass
class Plan:
    """What all tiles of a table share; bounded by the number of cells."""

    centres: np.ndarray
    cosine: float
    reach: float | None
    within: tuple[np.ndarray, np.ndarray] | None
    #: Whether any vector of a cell (row) visits another (column).
    visits: np.ndarray
    #: Type of the parts of the vectors as shuffled.
    kind: str


def link_blocks(a: Block, b: Block, plan: Plan) -> list[pa.Table]:
    if a.cell == b.cell:
        return _link(a, b, plan.cosine, same=a.number == b.number, both=True)
    out = []
    for home, guest in ((a, b), (b, a)):
        seen = guest.visitors(home.cell, plan)
        if seen is not None:
            # with bounds that hold for all vectors a link is met in the later cell alone, so it counts for both ends
            out += _link(home, seen, plan.cosine, same=False, both=plan.reach is None)
    return out


LINKS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])
NO_LINKS = LINKS.empty_table()


def _link(a: Block, b: Block, cosine: float, same: bool, both: bool) -> list[pa.Table]:
    links_a, links_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    ends_a, ends_b = [], []
    for at in range(0, len(a.x), STRIP):
        hit = a.x[at : at + STRIP] @ b.x.T >= cosine
        if same:
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        links_a[at : at + STRIP] = hit @ b.ns
        links_b += a.ns[at : at + STRIP] @ hit
        # a forest of the strip holds its links in fewer pairs than it has rows
        nodes, place = np.unique(np.concatenate([a.ids[at + i], b.ids[j]]), return_inverse=True)
        tree = np.array(forest(len(nodes), place[: len(i)], place[len(i) :]))
        ends_a.append(nodes[tree[:, 0]])
        ends_b.append(nodes[tree[:, 1]])
    if not ends_a:
        return []
    nodes, place = np.unique(np.concatenate(ends_a + ends_b), return_inverse=True)
    half = len(place) // 2
    tree = nodes[np.array(forest(len(nodes), place[:half], place[half:]))]
    out = [_counted(a.ids, links_a), pa.table([tree[:, 0], np.zeros(len(tree), np.int64), tree[:, 1]], schema=LINKS)]
    return out + [_counted(b.ids, links_b)] if both and not same else out


def _counted(ids: np.ndarray, links: np.ndarray) -> pa.Table:
    at = np.flatnonzero(links)
    return pa.table([ids[at], links[at], pa.nulls(len(at), pa.int64())], schema=LINKS)


def linked_vectors(
    vectors: DataFrame, cosine: float = COSINE, reach: float | None = REACH, cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold a null or non-finite part link with nothing,
    and so do vectors of different lengths. Cosines are computed in double precision. Rows
    that repeat a vector are linked with each other. Null ids are never the smallest of a
    component. All links are found with ``reach=None``; a number loses some (see above), none
    below ``cosine`` is ever made.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(valid("embedding"), F.transform("embedding", lambda v: v.cast("double") + 0.0)).alias("x"),
    )
    classes = rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = stored(classes.select("x", "first_id", "n", F.size("x").alias("d")).withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    kind = "float32" if dict(vectors.dtypes)["embedding"] == "array<float>" else "float64"
    found = None
    for d, total in classes.groupBy("d").count().orderBy("d").collect():  # vectors of one length: as a rule one turn
        part = _links_of(classes.where(F.col("d") == d), total, d, kind, cosine, reach, cell, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    lowest = labels.join(classes.select(F.col("c").alias("node"), "first_id"), "node").groupBy("label").agg(F.min("first_id").alias("low"))
    of_class = (
        classes.select("x", "c", "first_id", (F.col("n") - 1).alias("twins"))
        .join(counts.withColumnRenamed("node", "c"), "c", "left")
        .join(labels.join(lowest, "label").select(F.col("node").alias("c"), "low"), "c", "left")
        .select("x", (F.col("twins") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("low", "first_id").alias("low"))
    )
    out = rows.join(of_class, "x", "left")
    component = F.when(F.col("x").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _links_of(
    classes: DataFrame, total: int, d: int, kind: str, cosine: float, reach: float | None, cell: int, block: int
) -> DataFrame:
    spark = classes.sparkSession
    cells = max(1, min(MOST_CELLS, total // cell))
    share = max(1, total // SAMPLE)
    sample = classes.select("x").where(F.pmod(F.xxhash64("x"), F.lit(share)) == 0) if share > 1 else classes.select("x")
    sample = sample.limit(SAMPLE).toArrow()  # bounded by SAMPLE
    centres = fit_centres(unit(matrix(sample["x"])), min(cells, max(1, sample.num_rows))) if sample.num_rows else None
    if centres is None:
        centres = unit(matrix(classes.select("x").limit(1).toArrow()["x"]))
    shared = spark.sparkContext.broadcast(centres)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                low, high = spans(unit(matrix(batch.slice(at, 1024).column("x"))), shared.value)
                lived = np.flatnonzero(high >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(lived.astype(np.int32)), pa.array(low[lived]), pa.array(high[lived])], ["cell", "low", "high"])

    once, within = reach is None, None
    if once and len(centres) > 1:
        rows = classes.select("x").mapInArrow(measure, "cell int, low double, high double")
        rows = rows.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()  # one row per cell
        within = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
        within[0][rows["cell"].to_numpy()] = rows["low"].to_numpy()
        within[1][rows["cell"].to_numpy()] = rows["high"].to_numpy()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = matrix(piece.column("x"))
                dots = unit(x) @ shared.value.T
                home = dots.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(home.astype(np.int32)), piece.column("c"), piece.column("n"),
                        pa.array(dots[np.arange(len(x)), home]), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                    ],
                    ["cell", "c", "n", "best", "x"],
                )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, apart = np.zeros((len(shared.value), len(shared.value)), bool), between(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = unit(np.frombuffer(b"".join(piece.column("x").to_pylist()), kind).astype(np.float64).reshape(piece.num_rows, -1))
                home = piece.column("cell").to_numpy()
                near = may_visit(x @ shared.value.T, piece.column("best").to_numpy(), apart[home], cosine, reach, x.shape[1], within)
                for cell in np.unique(home):
                    met[cell] |= near[home == cell].any(axis=0)
        for cell in np.flatnonzero(met.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.flatnonzero(met[cell])], pa.list_(pa.int32()))], ["cell", "to"])

    dealt = classes.select("c", "n", "x").mapInArrow(deal, "cell int, c long, n long, best double, x binary")
    dealt = stored(dealt, "vector-cells")
    visits = np.zeros((len(centres), len(centres)), bool)
    if len(centres) > 1:
        pairs = dealt.select("cell", "best", "x").mapInArrow(visit, "cell int, to array<int>")
        pairs = pairs.select("cell", F.explode("to").alias("to")).distinct().groupBy("cell").agg(F.collect_list("to").alias("to"))
        for row in pairs.toLocalIterator():  # one row per cell
            visits[row["cell"], row["to"]] = True
    if once:  # of two cells the later one is visited
        visits = np.triu(visits)
    np.fill_diagonal(visits, True)

    sizes = np.zeros(len(centres), np.int64)
    for row in dealt.groupBy("cell").count().collect():  # one row per cell
        sizes[row["cell"]] = row["count"]
    blocks = -(-sizes // block)
    offset = np.cumsum(blocks) - blocks
    rows = max(block, min(GROUP_BYTES // (np.dtype(kind).itemsize * d), -(-total // LEAST_GROUPS)))
    group_of = grouped(sizes, blocks, rows)
    tiles = spark.sparkContext.broadcast(tiles_of(group_of, np.repeat(np.arange(len(centres)), blocks), visits))
    visited = spark.sparkContext.broadcast(visits)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, h = batch.column("cell").to_numpy(), batch.column("h").to_numpy()
            at = (offset[cell] + np.mod(h, blocks[cell])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.select(["cell", "c", "n", "best", "x"]).columns], ["block", "cell", "c", "n", "best", "x"])

    def pack(table: pa.Table) -> pa.Table:
        at = table["block"][0].as_py()
        group = int(group_of[at])
        row = {"block": at, "cell": table["cell"][0].as_py(), "group": group, "others": np.flatnonzero(tiles.value[group]).tolist()}
        row |= {c: table[name].to_numpy().tobytes() for c, name in (("ids", "c"), ("ns", "n"), ("best", "best"))}
        return pa.Table.from_pylist([row | {"xs": b"".join(table["x"].to_pylist())}], schema=PACKED)

    numbered = dealt.withColumn("h", F.xxhash64("c")).mapInArrow(number, "block int, cell int, c long, n long, best double, x binary")
    packed = numbered.groupBy("block").applyInArrow(
        pack, "block int, cell int, group int, others array<int>, ids binary, ns binary, best binary, xs binary"
    )
    # a tile is one group: a block goes to each tile of its group
    held = packed.withColumn("other", F.explode("others")).select(
        F.least("group", "other").alias("low"), F.greatest("group", "other").alias("high"), "group", "cell", "block", "ids", "ns", "best", "xs"
    )
    return held.groupBy("low", "high").applyInArrow(
        lambda table: link_tile(table, Plan(shared.value, cosine, reach, within, visited.value, kind)), "node long, n long, other long"
    )


def grouped(sizes: np.ndarray, blocks: np.ndarray, rows: int) -> np.ndarray:
    """The group of each block: neighbours that hold about ``rows`` vectors together."""
    held = np.repeat(sizes / np.maximum(blocks, 1), blocks)
    groups = ((np.cumsum(held) - held / 2) // rows).astype(np.int64)
    return np.unique(groups, return_inverse=True)[1]


def tiles_of(group_of: np.ndarray, cell_of: np.ndarray, visits: np.ndarray) -> np.ndarray:
    """Which groups have blocks to be multiplied with each other."""
    cells = np.zeros((int(group_of.max()) + 1 if len(group_of) else 0, len(visits)), np.float32)
    cells[group_of, cell_of] = 1
    return cells @ (visits | visits.T).astype(np.float32) @ cells.T > 0


PACKED = pa.schema([
    ("block", pa.int32()), ("cell", pa.int32()), ("group", pa.int32()), ("others", pa.list_(pa.int32())),
    ("ids", pa.binary()), ("ns", pa.binary()), ("best", pa.binary()), ("xs", pa.binary()),
])


def digest(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return linked_vectors(vectors.select("vec_id", "embedding"))
