"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors by random directions, each split at the median of a sample, and a vector within the spill
margin of a split goes to both sides. Vectors are compared with all others in their leaves, by cosine in double
precision; pairs at or over the threshold link, and links are united to components. Trees are fitted on a bounded
sample (SAMPLE vectors, by hash; all vectors are then placed in them), and their depth follows the number of vectors.

Equal vectors form a class and are compared once: copies count in n_links and share the component. A pair is counted
in the first leaf that it shares, so a leaf gives only sums for each vector and a star for each component, never its
pairs. A leaf that holds more than LEAF vectors, or LEAF_BYTES of them, is dealt in blocks of half of that, and each two blocks are compared in
a task of their own, so no pair in it is missed: the sample bounds the depth of the trees, and so the work grows with
the square of such leaves.

A group that links with itself would be halved by each split that its median falls into. So dense places are found in
the sample first (see Crowds), and the links of the vectors in them are all found, by comparing blocks in pairs over
tasks; the work grows with the square of such a group. Only the other vectors are left to the trees.

Null vectors, zero vectors, and those with null or non-finite components link with nothing and are their own component.
Vectors of different lengths have no cosine: each length has trees of its own, or is compared whole if it has at most DEAL
vectors. Rows with a repeated vec_id count as vectors each. Labels and
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

THRESHOLD = 0.9
TREES, SPILL, SAMPLE, LEAF = 10, 0.12, 20_000, 20_000
#: Bytes of a sample, and of what a task compares, which bound their rows where vectors are wide.
SAMPLE_BYTES, LEAF_BYTES = 64 << 20, 512 << 20
#: Vectors for each leaf of the trees that deal them over the cluster.
DEAL = 600
MAX_DEPTH = 10
#: A vector with about so many links, and at least so many of them in the sample, makes a crowd.
CROWD, CROWD_SAMPLE = 150, 8
SEED = 11
FOUND = "kind byte, a long, b long"


class Tree:
    """One tree: directions and medians by heap number; a vector near a median goes both ways."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.direction = rng.standard_normal((2**depth, sample.shape[1]))
        self.direction /= np.linalg.norm(self.direction, axis=1, keepdims=True)
        self.median, self.low, self.high = np.zeros(2**depth), np.zeros(2**depth), np.zeros(2**depth)
        self._fit(sample, 1)

    def _fit(self, x: np.ndarray, node: int) -> None:
        if node >= 2**self.depth:
            return
        p = x @ self.direction[node] if len(x) else np.zeros(1)
        self.median[node] = np.median(p)
        self.low[node], self.high[node] = np.quantile(p, (0.5 - SPILL / 2, 0.5 + SPILL / 2))
        self._fit(x[p <= self.median[node]], 2 * node)
        self._fit(x[p > self.median[node]], 2 * node + 1)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of each row."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            p = np.empty(len(row))
            for a in range(0, len(row), 1 << 14):
                s = slice(a, a + (1 << 14))
                p[s] = np.einsum("ij,ij->i", x[row[s]], self.direction[node[s]])
            left, right = p <= self.high[node], p > self.low[node]
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        return row, node - 2**self.depth


def forest(sample: np.ndarray, n: int) -> list[Tree]:
    """Trees whose leaves hold about DEAL of n vectors, as far as the sample tells medians apart."""
    depth = 0
    while len(sample) and n / 2**depth * (1 + SPILL) ** depth > DEAL and depth < MAX_DEPTH and len(sample) / 2**depth >= 32:
        depth += 1
    return [Tree(sample, depth, SEED + t) for t in range(TREES if depth else 1)]


class Crowds:
    """Places where vectors have many links, found in the sample; all links of the vectors at their cores are found.

    A vector within the threshold of a centre is a core vector of the nearest centre's region. Whatever links with it is
    within twice the threshold's angle of that centre: such vectors are the region's members, and core vectors are
    compared with all of them. Centres within that angle of a region's first one belong to it.
    """

    def __init__(self, sample: np.ndarray, n: int, threshold: float):
        self.threshold, self.wide = threshold, (2 * threshold**2 - 1 if threshold > 0 else -1) - 1e-6
        least = max(CROWD_SAMPLE, CROWD * len(sample) / n)
        near = lambda rows: (sample[rows] @ sample.T) >= threshold
        blocks = lambda rows: (rows[a : a + 256] for a in range(0, len(rows), 256))
        count = np.concatenate([near(rows).sum(1) for rows in blocks(np.arange(len(sample)))])
        left, centres = np.ones(len(sample), bool), []
        while count[best := int(np.where(left, count, 0).argmax())] > least and left[best]:
            new = left & near([best])[0]
            new[best] = True
            left &= ~new
            centres.append(best)
            for rows in blocks(np.flatnonzero(new)):
                count -= near(rows).sum(0)
        self.rest = left
        heads, region = [], []
        for c in centres:
            like = sample[heads] @ sample[c] if heads else np.zeros(0)
            if not len(like) or like.max() < self.wide:
                heads.append(c)
                like = np.append(like, 1.0)
            region.append(int(like.argmax()))
        order = np.argsort(region, kind="stable")
        self.region = np.array(region, np.int64)[order]
        self.centre = sample[np.array(centres, np.int64)[order]]
        self.first = np.searchsorted(self.region, np.arange(len(heads)))

    def members(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, region) of all regions of each row, and the region in whose core each row is, or -1."""
        if not len(self.region):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(len(x), -1)
        like = x @ self.centre.T
        best = like.argmax(1)
        own = np.where(like[np.arange(len(x)), best] >= self.threshold, self.region[best], -1)
        row, region = np.nonzero(np.maximum.reduceat(like, self.first, axis=1) >= self.wide)
        return row, region, own


class Deal:
    """Where vectors are compared: core vectors of crowds in regions, the others among themselves in the leaves of trees.

    Regions are numbered on from the leaves. `plan` has, for what is dealt in blocks, the blocks of core vectors and of
    the others: each block of core vectors meets itself and each other block in a task.
    """

    def __init__(self, sample: np.ndarray, n: int, threshold: float):
        self.crowds = Crowds(sample, n, threshold)
        rest = sample[self.crowds.rest]
        self.trees = forest(rest, n * len(rest) // len(sample))
        self.per = 2 ** self.trees[0].depth
        self.regions = self.per * len(self.trees)
        self.plan: dict[int, tuple[int, int]] = {}

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(row, leaf or region, whether core there), and for each row all its leaves, or the region it is core of or -1."""
        at, region, own = self.crowds.members(x)
        rest = np.flatnonzero(own < 0)
        row, leaf = (np.concatenate(y) for y in zip(*((rest[r], leaf + t * self.per) for t, (r, leaf) in enumerate(tree.leaves(x[rest]) for tree in self.trees)), strict=True))
        order = np.lexsort((leaf, row))
        row, leaf = row[order], leaf[order].astype(np.int32)
        edge = np.searchsorted(row, np.arange(len(x) + 1))
        mine = own.astype(np.int32)
        notes = [leaf[edge[i] : edge[i + 1]].tobytes() for i in row] + [mine[i].tobytes() for i in at]
        return np.concatenate((row, at)), np.concatenate((leaf, region + self.regions)), np.concatenate((np.ones(len(row), bool), own[at] == region)), notes

    def sizes(self, batches):
        """(cls, v) to (leaf, core, n)."""
        total = np.zeros(2 * (self.regions + len(self.crowds.first)), np.int64)
        for batch in batches:
            _, leaf, core, _ = self.places(unit(_matrix(batch.column(1))))
            total += np.bincount(2 * leaf + core, minlength=len(total))
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((live // 2).astype(np.int32)), pa.array(live % 2 == 1), pa.array(total[live])], names=["leaf", "core", "n"])

    def divide(self, sizes: list, most: int) -> None:
        """Plans blocks for leaves and regions of more than `most` vectors."""
        by: dict[int, list[int]] = {}
        for leaf, core, n in sizes:
            by.setdefault(leaf, [0, 0])[not core] += n
        half = max(1, most // 2)
        self.plan = {leaf: (-(-core // half), -(-other // half)) for leaf, (core, other) in by.items() if core + other > most}

    def tasks(self, leaf: np.ndarray, core: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which, one, two, block): the pairs of blocks that each placed vector is needed for, and its own block."""
        if not self.plan:
            z = np.zeros(len(leaf), np.int32)
            return np.arange(len(leaf)), z, z, z
        inner, outer = (np.array([self.plan.get(x, (1, 0))[k] for x in range(self.regions + len(self.crowds.first))]) for k in (0, 1))
        k, o = inner[leaf], outer[leaf]
        apart = ~core & (o > 0)
        h = C.mix(cls.view(C.U64))
        block = np.where(apart, k, 0) + (h % np.where(apart, o, k).astype(C.U64)).astype(np.int64)
        each = np.where(apart, k, k + o)
        which = np.repeat(np.arange(len(leaf)), each)
        other = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        block = block[which]
        return which, np.minimum(block, other).astype(np.int32), np.maximum(block, other).astype(np.int32), block.astype(np.int32)

    def place(self, batches):
        """(cls, v, size) to a row for each task that the vector is compared in."""
        for batch in batches:
            row, leaf, core, notes = self.places(unit(_matrix(batch.column(1))))
            which, one, two, block = self.tasks(leaf, core, batch.column(0).to_numpy(zero_copy_only=False)[row])
            notes = pa.array(notes, pa.binary())
            for a in range(0, max(1, len(which)), 1 << 14):  # a vector may be needed in many tasks
                s = slice(a, a + (1 << 14))
                take = pa.array(row[which[s]])
                yield pa.RecordBatch.from_arrays([pa.array(leaf[which[s]].astype(np.int32)), pa.array(one[s]), pa.array(two[s]), pa.array(block[s]), *(batch.column(c).take(take) for c in (0, 2, 1)), notes.take(pa.array(which[s]))], names=["leaf", "one", "two", "block", "cls", "size", "v", "leaves"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded(owns: list[np.ndarray]) -> np.ndarray:
    """Lists of numbers as rows, filled up with -1."""
    table = np.full((len(owns), max(len(o) for o in owns)), -1, np.int32)
    for i, o in enumerate(owns):
        table[i, : len(o)] = o
    return table


def first_shared(table: np.ndarray, a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether `here` is the least number that rows a and b have in common."""
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 13):
        p, q = table[a[s : s + (1 << 13)]], table[b[s : s + (1 << 13)]]
        shared = ((p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)).any(2)
        out[s : s + (1 << 13)] = np.where(shared, p, np.iinfo(np.int32).max).min(1) == here
    return out


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of all rows after a and b are linked."""
    a, b = root[a], root[b]
    live = a != b
    if not live.any():
        return root
    node, low = C.merged(a[live], b[live])
    to = np.arange(len(root))
    to[node] = low
    return to[root]


def _compare(threshold: float, regions: int):
    """Two blocks of a leaf or region to rows: kind 0 (cls, links counted here), kind 1 (cls, root in these blocks).

    A leaf counts the links that it is the first to share. A region counts those of its core vectors, if none is a core
    vector of an earlier one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", ignore_index=True)
        leaf = int(pdf["leaf"].iloc[0])
        cls, size, block = pdf["cls"].to_numpy(), pdf["size"].to_numpy().astype(np.float64), pdf["block"].to_numpy()
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        table = padded([np.frombuffer(b, np.int32) for b in pdf["leaves"]])
        x = unit(raw)
        here, own = leaf - regions, table[:, 0]
        core, first = own == here, (own < 0) | (own >= here)
        same = bool(pdf["one"].iloc[0] == pdf["two"].iloc[0])
        left, right = (np.flatnonzero(block == pdf[c].iloc[0]) for c in ("one", "two"))
        count, root, y = np.zeros(len(cls)), np.arange(len(cls)), x[right]
        for s in range(0, len(left), 256):
            i, j = left[s : s + 256], right[s if same else 0 :]
            like = x[i] @ y[s if same else 0 :].T
            hit = like >= threshold - 1e-9
            if same:
                hit[:, : len(i)] &= np.triu(np.ones((len(i), len(i)), bool), 1)
            p, q = np.nonzero(hit & (like < threshold + 1e-9))
            hit[p, q] = exact_cosine(raw[i[p]], raw[j[q]]) >= threshold
            del like
            rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if not len(rows):
                continue
            root = united(root, np.concatenate((i[rows], i[hit[:, columns].argmax(0)])), np.concatenate((j[hit[rows].argmax(1)], j[columns])))
            p, q = np.nonzero(hit & (root[i][:, None] != root[j]))
            root = united(root, i[p], j[q])
            if here < 0:
                p, q = np.nonzero(hit)
                hit[p, q] = first_shared(table, i[p], j[q], leaf)
            else:
                hit &= (core[i][:, None] & first[j]) | (first[i][:, None] & core[j])
            weight = hit.astype(np.float64)
            count[i] += weight @ size[j]
            count[j] += size[i] @ weight
        live, own = np.flatnonzero(count), root != np.arange(len(root))
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int8), (len(live), own.sum())), "a": np.concatenate((cls[live], cls[own])), "b": np.concatenate((count[live].astype(np.int64), cls[root[own]]))})

    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    a, b = (x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300) if np.abs(x).max(initial=0) > 1e100 or 0 < np.abs(x).min(initial=1) < 1e-100 else x for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def near_vectors(rows: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = C.ready(rows.sparkSession)
    scratch = C.Scratch(spark, "embedding-dedup")
    kind = "float" if rows.schema["embedding"].dataType == T.ArrayType(T.FloatType(), rows.schema["embedding"].dataType.containsNull) else "double"  # as they are stored; compared as doubles
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = F.col("v").isNotNull() & F.forall("v", good) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    # A class for equal vectors, told by two hashes of their components, 128 bits; its rows are counted before any shuffle.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(f"array<{kind}>"))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("key2", F.when(F.col("ok"), F.xxhash64(F.lit(SEED), "v")))
    classes = rows.where("ok").groupBy("key", "key2").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}
    if not counts:
        return _result(rows, None, None, classes)
    wide = sorted(w for w, n in counts.items() if n > DEAL)
    parts = [_found(classes if len(counts) == 1 else classes.where(F.size("v") == w), counts[w], kind, threshold, scratch) for w in wide]
    if len(wide) < len(counts):  # few vectors of a length: all with all
        few = classes.where(~F.size("v").isin(wide)) if wide else classes
        zero = [F.lit(0).alias(c) for c in ("leaf", "one", "two", "block")]
        few = few.select(F.size("v").alias("w"), *zero, "cls", "size", "v", F.lit(bytes(4)).alias("leaves"))
        parts.append(scratch.table(few.groupBy("w").applyInPandas(_compare(threshold, 1), FOUND)))
    C.tidy(spark)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    root = C.components(found.where("kind = 1").select("a", "b"), scratch)
    return _result(rows, links, root, classes)


def _found(classes: DataFrame, n: int, kind: str, threshold: float, scratch: C.Scratch) -> DataFrame:
    """What `_compare` finds among n classes of one length."""
    width = len(classes.select("v").first().v)
    drawn = classes.orderBy(F.xxhash64("key", F.lit(3)), "key", "key2").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width))))
    sample = _matrix(drawn.select("v").toArrow().column("v").combine_chunks())
    deal = Deal(unit(sample), n, threshold)
    vectors = classes.select("cls", "v", "size")
    deal.divide(vectors.mapInArrow(C.lean(deal.sizes), "leaf int, core boolean, n long").groupBy("leaf", "core").agg(F.sum("n")).collect(), max(2, min(LEAF, LEAF_BYTES // (24 * width))))  # three copies of doubles
    placed = vectors.mapInArrow(C.lean(deal.place), f"leaf int, one int, two int, block int, cls long, size long, v array<{kind}>, leaves binary")
    return scratch.table(placed.groupBy("leaf", "one", "two").applyInPandas(_compare(threshold, deal.regions), FOUND))


def _result(rows: DataFrame, links: DataFrame | None, root: DataFrame | None, classes: DataFrame) -> DataFrame:
    info = classes.select("key", "key2", "cls", "size", "least")
    if links is not None:
        info = info.join(links.withColumnRenamed("a", "cls"), "cls", "left").join(root.select(F.col("node").alias("cls"), "root"), "cls", "left")
    else:
        info = info.withColumn("links", F.lit(0).cast("long")).withColumn("root", F.col("cls"))
    info = info.withColumn("root", F.coalesce("root", "cls"))
    info = info.join(info.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "key2", "size", "links", "component_id")
    out = rows.join(info, ["key", "key2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.when(F.col("ok"), F.col("size") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all rows of embeddings at cosine 0.9."""
    return near_vectors(C.load(spark, sf_dir, "embeddings"))


def sql() -> str:
    """The same for DuckDB: all pairs by cosine, and all that each vector reaches."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
r(v, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a),
m AS (SELECT v AS k, min(c) AS component_id FROM r GROUP BY v), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN m ON k = vec_id LEFT JOIN n ON a = vec_id
"""
