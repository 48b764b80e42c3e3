"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best-bin-first.

The tree is fitted on a bounded sample and broadcast (its size is a parameter); every row is indexed.
Equal vectors are one entry with their smallest ids, as many as a result can name: further copies
could only come after them. A query walks the tree with a priority queue, best bound first, and
visits leaves until it has seen enough; how many leaves is calibrated: for a sample of queries the
exact neighbours are found by comparing with all rows, and visits are widened until the wanted share
of them is reached. A leaf's entries are dealt in blocks of bounded size, one copy for each QUERIES
queries; a block is held while its queries pass by. With more rows than the tree was fitted for, leaves
hold more entries, and as many more blocks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.llm.common import materialize

SAMPLE = 50_000
LEAF, MOST_LEAVES, BRANCH = 96, 4096, 12
CALIBRATION = 128
MEMBERS, QUERIES, GROUPS = 4096, 65_536, 64


@dataclass
class Tree:
    """Nodes in order of making; a leaf has a number, an inner node its children."""

    centers: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    n_leaves: int

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), dtype=np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = self.children[node]
            c = self.centers[own]
            near = (vectors[rows] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
            todo += [(child, rows[near == i]) for i, child in enumerate(own) if (near == i).any()]
        return out

    def order(self, query: np.ndarray, stop) -> list[int]:
        """Leaves in best-bin-first order until ``stop(leaves)`` says so. The bound of a node is the
        product with its centre and a share of what its radius could add."""
        size, out = float(np.linalg.norm(query)) * 0.5, []
        queue, made = [(0.0, 0)], 0
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                made += 1
                if stop(out):
                    break
                continue
            own = self.children[node]
            bound = self.centers[own] @ query + size * self.radius[own]
            for b, child in zip(bound.tolist(), own, strict=True):
                heapq.heappush(queue, (-b, child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def grow(sample: np.ndarray, leaf_size: int) -> Tree:
    rng = np.random.default_rng(7)
    tree = Tree(np.empty((0,)), np.empty((0,)), [], [], 0)
    centers, radius = [], []

    def add(rows):
        x = sample[rows]
        c = x.mean(axis=0) if len(rows) else np.zeros(sample.shape[1])
        centers.append(c)
        radius.append(float(np.sqrt(((x - c) ** 2).sum(axis=1).max(initial=0))))
        tree.children.append([])
        tree.leaf.append(-1)
        return len(centers) - 1

    todo = [(add(np.arange(len(sample))), np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        k = min(BRANCH, max(2, len(rows) // leaf_size))
        groups = []
        if len(rows) > leaf_size:
            c = _kmeans(sample[rows], k, rng)
            near = (sample[rows] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
            groups = [rows[near == i] for i in range(k) if (near == i).any()]
        if len(groups) < 2:
            tree.leaf[node] = tree.n_leaves
            tree.n_leaves += 1
            continue
        for g in groups:
            child = add(g)
            tree.children[node].append(child)
            todo.append((child, g))
    tree.centers, tree.radius = np.array(centers), np.array(radius)
    return tree


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): rows whose vector is not null, empty or zero and holds no null or number that is
    not finite. Shorter vectors end in zeros, as the longest need them: that leaves their products as
    they are."""
    v = F.col("vec")
    df = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where(v.isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    ends = df.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if ends[0] == ends[1]:
        return df
    zero = F.lit(0).cast(rows.schema[vec_col].dataType.elementType)
    return df.withColumn("vec", F.concat("vec", F.array_repeat(zero, F.lit(ends[1]) - F.size("vec"))))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _top(score: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties to the smaller id."""
    if len(score) > 4 * k:
        border = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= border)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((first_id[at], -score[at]))[:k]]


def exact(entries: DataFrame, queries: dict[int, np.ndarray], k: int) -> list:
    """The k best entries (by leaf and smallest id) of a bounded set of queries, over all entries but
    those that are the query's row alone."""
    shared = entries.sparkSession.sparkContext.broadcast((np.array(list(queries)), np.stack(list(queries.values()))))

    def run(batches):
        names, q = shared.value
        for batch in batches:
            score = _matrix(batch.column(2)) @ q.T
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            leaf = batch.column(0).to_numpy(zero_copy_only=False)
            single = batch.column(3).to_numpy(zero_copy_only=False) == 1
            for j, name in enumerate(names):
                at = _top(np.where(single & (ids == name), -np.inf, score[:, j]), ids, k)
                at = at[~(single & (ids == name))[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), pa.array(leaf[at]), pa.array(ids[at]), pa.array(score[at, j])], ["q", "leaf", "id", "score"])

    made = entries.select("leaf", F.col("ids")[0].alias("id"), "vec", F.size("ids").alias("n")).mapInArrow(run, "q bigint, leaf int, id bigint, score double")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return made.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).collect()


def search(rows: DataFrame, is_query, k: int = 20, recall: float = 0.94, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (a condition on vec_id)
    holds its k nearest found rows, nearest first, ties to the smaller id; its own row is none. Fewer
    if there are fewer candidates. Scores are the inner products of the vectors in double precision.
    Rows that ``usable`` leaves out are neither queries nor candidates; none left give no rows. Of
    rows with the same id and vector one is kept; rows with the same id and other vectors are further
    candidates, but not for the rows of that id. Other columns are not read."""
    spark = rows.sparkSession
    element = rows.schema[vec_col].dataType.elementType.simpleString()
    base = usable(rows, id_col, vec_col).withColumn("key", F.xxhash64("vec"))
    copies = Window.partitionBy("key", "vec").orderBy("vec_id")
    least = base.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    groups = materialize(least.groupBy("key", "vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    n = groups.count()
    sample = groups.orderBy("key", "vec").limit(SAMPLE).select("vec").toArrow().column(0) if n else []
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], result)
    matrix = _matrix(sample.combine_chunks())
    tree = grow(matrix, max(8, int(len(matrix) / min(MOST_LEAVES, max(1, n // LEAF)))))
    shared_tree = spark.sparkContext.broadcast(tree)

    def index(batches):
        for batch in batches:
            leaf = shared_tree.value.assign(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "ids", "vec"])

    entries = materialize(groups.select("ids", "vec").mapInArrow(index, f"leaf int, ids array<bigint>, vec array<{element}>"), "entries")
    sizes = np.zeros(tree.n_leaves, dtype=np.int64)
    for r in entries.groupBy("leaf").agg(F.count("*"), F.sum(F.size("ids"))).collect():
        sizes[r[0]] = r[2]
    asked = base.where(is_query(F.col("vec_id"))).select("vec_id", "key", "vec").distinct()
    vectors = asked.groupBy("key", "vec").agg(F.min("vec_id").alias("q"))
    queries = materialize(vectors.select("q", "vec"), "queries")

    trial = {r["q"]: np.array(r["vec"]) for r in queries.orderBy(F.xxhash64("q")).limit(CALIBRATION).collect()}
    visits = _visits(tree, trial, exact(entries, trial, k) if trial else [], recall)
    shared_sizes = spark.sparkContext.broadcast(sizes)

    width = -(-tree.n_leaves // GROUPS)  # neighbouring leaves make a group, so that a query goes to few

    def walk(batches):
        own, size = shared_tree.value, shared_sizes.value
        for batch in batches:
            rows, groups, lists = [], [], []
            for i, q in enumerate(_matrix(batch.column(1))):
                seen = [0]

                def stop(out, seen=seen):
                    seen[0] += size[out[-1]]
                    return len(out) >= visits and seen[0] > k

                by_group: dict[int, list[int]] = {}
                for x in own.order(q, stop):
                    if size[x]:
                        by_group.setdefault(x // width, []).append(x)
                rows += [i] * len(by_group)
                groups += by_group
                lists += by_group.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(groups, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["q", "vec", "grp", "leaves"])

    n_queries = queries.count()
    walks = max(2 * spark.sparkContext.defaultParallelism, n_queries // 4096)
    tasks = queries.repartition(walks, "q").mapInArrow(walk, f"q bigint, vec array<{element}>, grp int, leaves array<int>")
    entries = entries.withColumn("grp", F.floor(F.col("leaf") / width).cast("int"))
    held = entries.groupBy("grp").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("mb"))
    qb = int(max(1, -(-n_queries // QUERIES)))
    blocks = F.broadcast(held)  # GROUPS rows at most
    none = F.lit(None)

    left = tasks.join(blocks, "grp").select("grp", F.pmod(F.xxhash64("q"), F.lit(qb)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), "q", "leaves", none.cast("int").alias("leaf"), none.cast("array<bigint>").alias("ids"), "vec")
    right = entries.join(blocks, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("b"), F.pmod(F.xxhash64(F.col("ids")[0]), F.col("mb")).cast("int").alias("m"), none.cast("bigint").alias("q"), none.cast("array<int>").alias("leaves"), "leaf", "ids", "vec")

    def compare(batches):
        now, members = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
            is_entry = table.column("q").is_null().to_numpy()
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]).any(axis=1) | (is_entry[1:] != is_entry[:-1])])
            for start, end in zip(cuts, np.r_[cuts[1:], len(block)], strict=True):
                part, key = table.slice(start, end - start), tuple(block[start].tolist())
                if key != now:
                    now, members = key, []
                if is_entry[start]:
                    members.append(part.select(["leaf", "ids", "vec"]))
                elif members:
                    members = [pa.concat_tables(members).combine_chunks()]
                    for at in range(0, part.num_rows, 1024):
                        yield from best_of(part.slice(at, 1024), members[0]).to_batches()

    def best_of(own: pa.Table, members: pa.Table) -> pa.Table:
        ids = members.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        m, q = _matrix(members.column("vec").combine_chunks()), _matrix(own.column("vec").combine_chunks())
        leaf = members.column("leaf").to_numpy()
        base = int(leaf.min())
        visited = np.zeros((len(q), int(leaf.max()) - base + 1), dtype=bool)
        for i, own_leaves in enumerate(own.column("leaves").to_pylist()):
            inside = [x - base for x in own_leaves if 0 <= x - base < visited.shape[1]]
            visited[i, inside] = True
        score = np.where(visited[:, leaf - base], q @ m.T, -np.inf)
        best = [_top(row, first, k + 1) for row in score]
        best = [b[np.isfinite(row[b])] for b, row in zip(best, score, strict=True)]
        at = np.concatenate(best)
        by = np.repeat(np.arange(len(q)), [len(b) for b in best])
        return pa.Table.from_arrays([pa.array(own.column("q").to_numpy()[by]), ids.take(pa.array(at)), pa.array((q[by] * m[at]).sum(axis=1))], ["q", "ids", "score"])

    dealt = left.unionByName(right).repartition("grp", "b", "m").sortWithinPartitions("grp", "b", "m", F.col("q").isNotNull())
    found = dealt.mapInArrow(compare, "q bigint, ids array<bigint>, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    each = best.select("q", F.explode("ids").alias("vec_id"), "score")
    per_vector = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = per_vector.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    named = asked.join(vectors, ["key", "vec"]).select(F.col("vec_id").alias("query_id"), "q").join(lists, "q")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = named.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _visits(tree: Tree, trial: dict[int, np.ndarray], true: list, recall: float) -> int:
    """Fewest leaf visits with which the trial queries reach the recall; all leaves for a recall of 1, which
    makes the search exact."""
    if recall >= 1:
        return tree.n_leaves
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["q"], []).append(r["leaf"])
    needed: list[int] = []
    for q, leaves in wanted.items():
        place = {x: i + 1 for i, x in enumerate(tree.order(trial[q], lambda out: False))}
        needed += [place[x] for x in leaves]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1
