"""Embedding near-duplicates (operator 12) by an epsilon grid order join.

Unit vectors whose cosine is c lie sqrt(2 - 2 c) apart, so those that link are at most epsilon apart. Vectors of one label are sorted by
the grid cells, epsilon wide, of their leading principal coordinates, and cut into sequences of bounded size. Two intervals of
sequences whose boxes are more than epsilon apart hold no link; the others are split, down to single sequences, and then, in the
task that holds two of them, down to a few rows, which one matrix product compares.

Rows with the same label and vector are one node with a count, so copies are never expanded into pairs. A task sends for each row
with links their number and one row it is connected to: at most as many records as it has rows, however dense the links are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut
from .graph import components

COSINE = 0.93
#: Bytes of unit vectors in a sequence, rows of its smallest intervals, children of an interval of sequences.
SEQUENCE, LEAF, CHILDREN = 4 << 20, 128, 8
#: Principal coordinates whose cells sort the vectors; coordinates of a box.
SORTED, BOX = 8, 16
#: Vectors that the principal axes are fitted on, and the most components one of them may have. Any axes give the same links.
SAMPLE, LONGEST = 1024, 2048
#: Cosines this near the threshold are computed again, term after term.
NEAR = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, of components as large or as small as doubles may be."""
    u = v / np.abs(v).max(axis=1, keepdims=True)
    return u / np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]


def principal_axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Length of a vector -> its leading principal axes, as rows; the first coordinates' axes where the sample is small."""
    by: dict[int, list[list[float]]] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    return {d: np.linalg.svd((u := unit(np.array(v))) - u.mean(axis=0), full_matrices=False)[2][:BOX] for d, v in by.items() if len(v) >= 2 * BOX}


def coordinates(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """``BOX`` coordinates of unit vectors of one length, zeros where they have fewer."""
    d = u.shape[1]
    x = u @ axes[d].T if d in axes else u[:, :BOX]
    return np.pad(x, ((0, 0), (0, BOX - x.shape[1])))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine in double precision, terms added one after another."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    ab = aa = bb = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
    return ab / (aa**0.5 * bb**0.5)


def boxes(x: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The box of every interval of rows that halving comes to."""
    out: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(a: int, b: int):
        if b - a <= LEAF:
            low, high = x[a:b].min(axis=0), x[a:b].max(axis=0)
        else:
            (l1, h1), (l2, h2) = box(a, (a + b) // 2), box((a + b) // 2, b)
            low, high = np.minimum(l1, l2), np.maximum(h1, h2)
        out[a, b] = low, high
        return low, high

    box(0, len(x))
    return out


def leaves(left: dict, right: dict, n: int, m: int, same: bool, reach: float):
    """Pairs of smallest intervals that may hold rows within the root of ``reach``; of one sequence with itself, each pair once."""
    todo = [((0, n), (0, m))]
    while todo:
        a, b = todo.pop()
        if same and a[0] > b[0]:
            continue
        (l1, h1), (l2, h2) = left[a], right[b]
        gap = np.maximum(np.maximum(l1 - h2, l2 - h1), 0)
        if gap @ gap > reach:
            continue
        halves = [[s] if s[1] - s[0] <= LEAF else [(s[0], (s[0] + s[1]) // 2), ((s[0] + s[1]) // 2, s[1])] for s in (a, b)]
        if len(halves[0]) == len(halves[1]) == 1:
            yield a, b
        elif same and a == b:  # its halves with themselves and with each other
            todo += [(s, t) for i, s in enumerate(halves[0]) for t in halves[1][i:]]
        else:
            todo += [(s, t) for s in halves[0] for t in halves[1]]


class Forest:
    """Sets of nodes that are connected, joined as links are found."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[at] = r
        return r

    def join(self, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Connects node a[i] with b[j] wherever near[i, j]: rounds of one link for each row, until no link leaves its set."""
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = near & (ra[:, None] != rb)
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                return
            for i, j in zip(rows, apart[rows].argmax(axis=1)):
                x, y = self.roots(np.array([a[i], b[j]])).tolist()
                self.up[max(x, y)] = min(x, y)


def links(u: np.ndarray, x: np.ndarray, n: np.ndarray, v, w: np.ndarray | None = None, y: np.ndarray | None = None, m: np.ndarray | None = None, least: float = COSINE):
    """Number of linked rows (copies counted) and connected set of each row of a sequence, or of two.

    u: unit vectors, x: their coordinates, n: copies of each; v(i): row i as given, those of the second after those of the first.
    """
    same, size = w is None, len(u)
    if same:
        w, y, m = u, x, n
    off = 0 if same else size
    count, sets = np.zeros(off + len(w), np.int64), Forest(off + len(w))
    reach = 2 - 2 * least + NEAR
    left = boxes(x)
    for (a, b), (c, d) in leaves(left, left if same else boxes(y), size, len(w), same, reach):
        value = u[a:b] @ w[c:d].T
        near = value >= least
        for i, j in np.argwhere(np.abs(value - least) < NEAR):
            near[i, j] = cosine(v(a + i), v(off + c + j)) >= least
        if same and a == c:
            near = np.triu(near, 1)
        if near.any():
            count[a:b] += near @ m[c:d]
            count[off + c : off + d] += near.T @ n[a:b]
            sets.join(near, np.arange(a, b), off + np.arange(c, d))
    return count, sets.roots(np.arange(len(count)))


def _apart(a: str, b: str) -> Column:
    """The squared distance of two boxes."""
    gaps = [F.greatest(F.col(f"{a}.l{k}") - F.col(f"{b}.h{k}"), F.col(f"{b}.l{k}") - F.col(f"{a}.h{k}"), F.lit(0.0)) for k in range(BOX)]
    return sum((g * g for g in gaps), F.lit(0.0))


def _near_sequences(nodes: DataFrame, reach: float) -> DataFrame:
    """(a, b), a <= b: numbers of sequences of one group whose boxes are within ``reach``. nodes: group, at (place in the group's order), id, l0, h0, ...

    Intervals of ``CHILDREN`` ^ level sequences are paired from the widest level on; a pair that is too far apart is never split.
    """
    widest = nodes.agg(F.max("at")).first()[0]
    if widest is None:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    levels = 0
    while CHILDREN**levels <= widest:
        levels += 1
    bounds = [f(F.col(f"{c}{k}")).alias(f"{c}{k}") for k in range(BOX) for c, f in (("l", F.min), ("h", F.max))]

    def level(i: int) -> DataFrame:
        return nodes.withColumn("at", F.expr(f"at div {CHILDREN**i}")).groupBy("group", "at").agg(*bounds) if i else nodes

    pairs = level(levels).select("group", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    for i in reversed(range(levels)):
        below = level(i).withColumn("up", F.expr(f"at div {CHILDREN}"))
        a, b = below.withColumn("i", F.col("up")).drop("up").alias("a"), below.withColumn("j", F.col("up")).drop("up").alias("b")
        both = pairs.alias("p").join(a, (F.col("p.group") == F.col("a.group")) & (F.col("p.i") == F.col("a.i"))).join(b, (F.col("p.group") == F.col("b.group")) & (F.col("p.j") == F.col("b.j")))
        both = both.where((F.col("a.at") <= F.col("b.at")) & (_apart("a", "b") <= reach))
        if i:
            pairs = cut(both.select("p.group", F.col("a.at").alias("i"), F.col("b.at").alias("j")))
    if not levels:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def near_duplicates(vectors: DataFrame, least: float = COSINE, sequence: int = SEQUENCE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Rows link if their labels are equal and not null and their vectors' cosine is ``least`` at least. Vectors that are null, empty, zero or
    hold a component that is null or not finite link with nothing, nor do those of different lengths. n_links: the other rows linked
    directly, repeated rows included; component_id: the smallest vec_id reachable, null only where all ids reached are null;
    kept: whether that is the row's own.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("group"))
    good = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    plain = F.expr("transform(v, x -> x + 0D)")
    name = F.sha2(F.concat_ws(" ", F.to_json(F.struct("group")), F.concat_ws(",", F.transform(plain, lambda x: x.cast("string")))), 256)
    rows = rows.withColumn("name", F.when(F.col("group").isNotNull() & F.coalesce(F.expr(good), F.lit(False)), name))
    # one node for each label and vector; the least id stands first, a null one last
    nodes = rows.where("name is not null").groupBy("name").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("group").alias("group"), F.first(plain).alias("v"))
    nodes = cut(nodes)

    sample = nodes.where(F.size("v") <= LONGEST).select("v").orderBy(F.xxhash64("name"), "name").limit(SAMPLE)
    axes = spark.sparkContext.broadcast(principal_axes([r.v for r in sample.collect()]))
    width = (2 - 2 * least) ** 0.5 or 1.0

    def placed(batches):
        for batch in batches:
            cells = np.zeros((batch.num_rows, SORTED), np.int64)
            values = batch.column("v").to_pylist()
            for d in {len(v) for v in values}:
                at = [i for i, v in enumerate(values) if len(v) == d]
                x = coordinates(unit(np.array([values[i] for i in at])), axes.value)
                cells[at] = np.floor(x[:, :SORTED] / width)
            yield batch.append_column("cells", pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), SORTED).cast(pa.list_(pa.int64())))

    kind = "name string, copies long, group string, d int, v array<double>"
    ordered = nodes.select("name", "copies", "group", F.size("v").alias("d"), "v").mapInArrow(placed, f"{kind}, cells array<long>")
    total = nodes.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    order = ["group", "d", "cells", "name"]
    ordered = ordered.repartitionByRange(total // sequence + 1, *order).sortWithinPartitions(*order)
    bounds = ", ".join(f"l{k} double, h{k} double" for k in range(BOX))

    def sequences(batches):
        key, held, size, number = None, [], 0, 0

        def out():
            names, copies, values, cells = zip(*held)
            x = coordinates(unit(np.array(values)), axes.value)
            low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
            box = [pa.array([b]) for pair in zip(low, high) for b in pair]
            # group and length are one group from here on
            data = [pa.array([[key[0], str(key[1])]]), pa.array([number], pa.int64()), pa.array([list(cells[0])], pa.list_(pa.int64())), pa.array([names[0]]), pa.array([list(names)]), pa.array([list(copies)], pa.list_(pa.int64())), pa.array([np.array(values).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*data, *box], ["group", "number", "cells", "first", "names", "copies", "data", *[f"{c}{k}" for k in range(BOX) for c in "lh"]])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "d", "name", "copies", "v", "cells"))):
                if held and (row[:2] != key or size + 8 * row[1] > sequence):
                    yield out()
                    held, size, number = [], 0, number + 1
                key, size = row[:2], size + 8 * row[1]
                held.append(row[2:])
        if held:
            yield out()

    found = cut(ordered.mapInArrow(sequences, f"group array<string>, number long, cells array<long>, first string, names array<string>, copies array<long>, data binary, {bounds}"))
    found = found.withColumn("id", F.col("first"))
    # a row for each sequence of some megabytes
    tree = found.select("group", "id", *[f"{c}{k}" for k in range(BOX) for c in "lh"], F.row_number().over(W.partitionBy("group").orderBy("cells", "first")).cast("long").alias("at0"))
    tree = cut(tree.withColumn("at", F.col("at0") - 1).drop("at0"))
    pairs = cut(_near_sequences(tree, 2 - 2 * least + NEAR))

    sides = pairs.select(F.col("a").alias("id"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select(F.col("b").alias("id"), "a", "b", F.lit(1).alias("side")))
    sides = sides.join(found.select("id", "names", "copies", "data"), "id").select("a", "b", "side", "names", "copies", "data")

    def linked(key: tuple, t: pa.Table) -> pa.Table:
        parts = sorted(zip(*(t.column(c).to_pylist() for c in ("side", "names", "copies", "data"))), key=lambda r: r[0])
        each = [np.frombuffer(data).reshape(len(names), -1) for _, names, _, data in parts]
        names = np.array([n for _, of, _, _ in parts for n in of])
        units = [unit(v) for v in each]
        args = [x for u, (_, _, copies, _) in zip(units, parts) for x in (u, coordinates(u, axes.value), np.array(copies))]
        at = len(each[0])
        count, root = links(*args[:3], lambda i: each[0][i] if i < at else each[1][i - at], *args[3:], least=least)
        some = np.flatnonzero(count)
        return pa.table({"name": pa.array(names[some].tolist(), pa.string()), "n": pa.array(count[some]), "root": pa.array(names[root[some]].tolist(), pa.string())})

    some = cut(sides.groupBy("a", "b").applyInArrow(linked, "name string, n long, root string"))
    # nodes of the graph: least ids first, null ones last, names for those of the same id
    ids = nodes.select("name", F.struct(F.col("least").isNull().alias("none"), "least", "name").alias("node"))
    edges = some.where("name <> root").select("name", "root").distinct().join(ids, "name").join(ids.toDF("root", "other"), "root")
    reached = components(edges.select(F.col("node").alias("a"), F.col("other").alias("b")))
    reached = reached.select(F.col("node.name").alias("name"), F.col("root.least").alias("first"))
    degree = some.groupBy("name").agg(F.sum("n").alias("n"))
    of = cut(nodes.select("name", "copies", "least").join(degree, "name", "left").join(reached, "name", "left"))
    # a name with very many rows is one key of this join, which stands alone in its stage so that Spark can split it
    out = rows.select("vec_id", "name").join(of, "name", "left")
    out = out.select("vec_id", F.coalesce(F.col("n") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
