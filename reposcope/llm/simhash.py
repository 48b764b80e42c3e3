"""SimHash near-duplicates under a Hamming bound, by the generalised pigeonhole principle.

1. Every document gets a 64-bit fingerprint (majority of the bits of its shingles' XXH64).
2. Over all distinct fingerprints the co-occurrence of bits is summed; bits that go together are
   put into the same partition.
3. If thresholds t_i of the m partitions add up to bound - m + 1, two fingerprints within the bound
   differ by at most t_i bits in some partition i (t_i = -1 leaves a partition out). A dynamic
   programme allocates the thresholds, and picks m, for the least estimated cost: signatures to
   deal out and candidates to verify, from exact counts of equal partition values.
4. Fingerprints meet at signatures and are verified. A signature that many share is dealt over
   tiles, each pair of tiles being one group of bounded size; each group emits a spanning forest
   of its links, never all pairs.
5. Connected components of the links.

Where a similarity of the whole shingle sets is asked for (``alike``), fingerprints only propose:
further candidates come from bands of MinHash minima, and a link needs its two sets to be as similar
as asked for, which is counted over all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import connected_components, free_name, materialize, parts

SEED = 42
#: Members of a tile; a group that is verified together holds two tiles at most.
TILE = 2048
#: What one dealt signature costs, in verified candidates.
ROW_COST = 300
_SLICE = 1 << 16
#: Bands of minima: sets of similarity 0.8 share none of them with a chance of 2e-4, of 0.85 with 2e-6;
#: half of those at 0.8 that share none are near by their fingerprints.
BANDS, BAND_ROWS = 28, 6
#: Documents and characters of a tile of whole texts; two tiles at most are compared together.
SET_TILE, SET_CHARS = 512, 16_000_000
_ODD = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words; fewer words: of the whole sequence; none: empty."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) <= words:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[i:] for i in range(words))))
    if distinct:
        grams = set(grams)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit is 1 if set in over half the hashes; no hashes: 0. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(1).cast(pa.large_binary())
            made = [fingerprint(shingle_hashes(t.as_py(), words, distinct)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def bit_statistics(reps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set, over all fingerprints."""

    def run(batches):
        total, rows = np.zeros((64, 64), dtype=np.int64), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            rows += len(fps)
        where = np.arange(64 * 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1)), pa.array(np.append(total.ravel(), rows))], ["at", "n"])

    summed = reps.select("fp").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    cells = {r["at"]: r["n"] for r in summed}
    return cells.get(-1, 0), np.array([cells.get(i, 0) for i in range(4096)], dtype=np.float64).reshape(64, 64)


def correlated_groups(rows: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of near equal width, correlated bits together."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    seeds = [int(corr.sum(axis=0).argmax())]
    while len(seeds) < m:
        reach = corr[seeds].max(axis=0)
        reach[seeds] = np.inf
        seeds.append(int(reach.argmin()))
    groups, room = [[s] for s in seeds], [(64 + m - 1 - i) // m for i in range(m)]
    left = sorted(set(range(64)) - set(seeds), key=lambda b: (-corr[b].max(), b))
    for bit in left:
        free = [i for i in range(m) if len(groups[i]) < room[i]]
        groups[max(free, key=lambda i: (corr[bit, groups[i]].mean(), -i))].append(bit)
    return [sorted(g) for g in groups]


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(fps), dtype=np.int64)
    for j, b in enumerate(bits):
        value |= ((fps >> np.int64(b)) & 1) << j
    return value


def equal_pairs(reps: DataFrame, layouts: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each layout and partition, the number of pairs with equal values, counted over all rows."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for m, groups in layouts.items():
                for i, bits in enumerate(groups):
                    value, n = np.unique(part_values(fps, bits), return_counts=True)
                    key = np.full(len(value), m * 64 + i)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(n.astype(np.int64))], ["k", "v", "n"])

    counted = reps.select("fp").mapInArrow(run, "k bigint, v bigint, n bigint").groupBy("k", "v").agg(F.sum("n").cast("double").alias("n"))
    return {(r["k"] // 64, r["k"] % 64): r["c"] for r in counted.groupBy("k").agg(F.sum(F.expr("n * n / 2")).alias("c")).collect()}


def signatures(width: int, t: int) -> float:
    return (0, 1, 1 + width / 2, 1 + width)[t + 1]


def allocate(rows: int, groups: list[list[int]], equal: list[float], total: int) -> tuple[float, list[int]]:
    """Least cost thresholds (-1..2) that add up to ``total``; infinite cost if there are none."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, same in zip(groups, equal, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t in (-1, 0, 1, 2):
                made = signatures(len(bits), t)
                at, now = done + t, cost + ROW_COST * made * rows + same * made * made
                if at not in step or now < step[at][0]:
                    step[at] = (now, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(reps: DataFrame, bound: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to probe."""
    rows, both = bit_statistics(reps)
    layouts = {m: correlated_groups(rows, both, m) for m in range(max(2, (bound + 1) // 3), min(bound + 1, 8) + 1)}
    equal = equal_pairs(reps, layouts)
    chosen = min((allocate(rows, g, [equal.get((m, i), 0.0) for i in range(m)], bound - m + 1) + (m,) for m, g in layouts.items()), key=lambda x: (x[0], x[2]))
    return [(bits, t) for bits, t in zip(layouts[chosen[2]], chosen[1], strict=True) if t >= 0]


def probe(reps: DataFrame, layout: list[tuple[list[int], int]]) -> DataFrame:
    """(g, fp, rep): each fingerprint at each of its signatures. Threshold 1: a value also stands at
    the values with one more bit set; 2: at all values one bit away, so that values two bits apart
    meet between."""

    def run(batches):
        for batch in batches:
            fps, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, (bits, t) in enumerate(layout):
                value = part_values(fps, bits)
                base = np.int64(i) << np.int64(40)
                keys, rows = [value | base], [np.arange(len(fps))]
                for j in range(len(bits) if t > 0 else 0):
                    take = np.arange(len(fps)) if t == 2 else np.flatnonzero(~(value >> j) & 1)
                    keys.append((value[take] ^ (1 << j)) | base)
                    rows.append(take)
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fps[at]), pa.array(rep[at])], ["g", "fp", "rep"])

    return reps.select("fp", "rep").mapInArrow(run, "g bigint, fp bigint, rep bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed 64-bit fingerprints (bitwise_count takes absolute values of signed ones)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, rep: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Spanning forest of the links in one group: each found member is compared with those not yet
    found only."""
    links, left = [], np.arange(len(fps))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = distance(fps[left], fps[at]) <= bound
            if near.any():
                found = left[near]
                links += [(int(rep[at]), int(rep[x])) for x in found]
                todo += found.tolist()
                left = left[~near]
    return links


def _reduce(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Drop links that close a cycle."""
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _verify(g: np.ndarray, fps: np.ndarray, rep: np.ndarray, bound: int) -> list[tuple[int, int]]:
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[start, len(g)])
    links: list[tuple[int, int]] = []
    for s, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        links += _forest(fps[s : s + n], rep[s : s + n], bound)
    few = np.repeat(size <= 64, size)
    g, fps, rep = g[few], fps[few], rep[few]
    a, b = [], []
    for k in range(1, int(size[size <= 64].max(initial=0))):
        hit = np.flatnonzero((g[k:] == g[:-k]) & (distance(fps[k:], fps[:-k]) <= bound) & (rep[k:] != rep[:-k]))
        a.append(rep[hit])
        b.append(rep[hit + k])
    return links + (_reduce(np.concatenate(a), np.concatenate(b)) if a else [])


def links(reps: DataFrame, bound: int) -> DataFrame:
    """(a, b): links that connect whatever fingerprints differ by ``bound`` bits or fewer. Their
    number is that of spanning forests of the groups, not of all linked pairs. The probes are made
    anew for the count of hot signatures: that takes less than writing and reading them."""
    probes = probe(reps, plan(reps, bound))
    hot = probes.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 2 * TILE).select("g", F.ceil(F.col("n") / TILE).alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    dealt = (
        probes.join(hot, "g", "left")
        .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))))
        .select(F.when(F.col("other") < 0, F.col("g")).otherwise(F.xxhash64("g", F.least(own, "other"), F.greatest(own, "other"))).alias("g"), "fp", "rep")
    )

    def run(batches):
        held = [np.empty(0, dtype=np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if len(held[0]) < 20_000:
                continue
            cut = int(np.flatnonzero(held[0] != held[0][-1]).max(initial=-1)) + 1
            if cut:
                yield _pairs(_verify(*(h[:cut] for h in held), bound))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield _pairs(_verify(*held, bound))

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, bound: int = 9, distinct: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id that links reach.

    The defaults are for similarity 0.8: fingerprints of sets with Jaccard similarity 0.8 have
    cosine 2 * 0.8 / 1.8 and differ by 9.7 of 64 bits on average. Null or empty texts have
    fingerprint 0 and link like any other; rows with equal ids share a component only by their
    texts; a null id stands for itself in no component (component null). An empty table gives no
    rows; other columns are not read.
    """
    fps = materialize(fingerprints(docs, words, distinct, id_col, text_col), "fingerprints")
    reps = materialize(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    linked = connected_components(links(reps, bound))
    named = reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima of a non-empty set's shingle hashes, as signed 64-bit integers."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _ODD[0]).min(axis=0), out=least)
    return ((least ^ (least >> np.uint64(29))) * _ODD[1]).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def marks(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp, same, bands) of every row: ``mark`` is xxhash64 of the text, ``same`` is equal for equal
    sets of shingles; no bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps, same, keys = [], [], []
            for t in batch.column(2).cast(pa.large_binary()):
                hashes = shingle_hashes(t.as_py(), words, True)
                fps.append(fingerprint(hashes))
                same.append(xxhash.xxh3_128_digest(np.sort(hashes).tobytes()))
                keys.append(bands(hashes) if len(hashes) else np.empty(0, dtype=np.int64))
            starts = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(same, pa.binary()), lists], ["id", "mark", "fp", "same", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, mark bigint, fp bigint, same binary, bands array<bigint>")


def similar_forest(sets: list[np.ndarray], rep: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets (of distinct hashes) with Jaccard ``similarity`` or more:
    each found member is compared, by an inverted index, with those not yet found only."""
    size = np.array([len(s) for s in sets])
    grams = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(grams, kind="stable")
    holders, first = owner[order], np.r_[0, np.cumsum(np.bincount(grams))]
    start = np.r_[0, np.cumsum(size)]
    links, left = [], np.ones(len(sets), dtype=bool)
    for seed in range(len(sets)):
        todo = [seed] if left[seed] else []
        left[seed] = False
        while todo:
            at = todo.pop()
            own = grams[start[at] : start[at + 1]]
            met = np.concatenate([holders[first[g] : first[g + 1]] for g in own]) if len(own) else np.empty(0, dtype=np.int64)
            shared = np.bincount(met, minlength=len(sets))
            near = np.flatnonzero(left & (shared > 0) & (shared >= similarity * (size + size[at] - shared) - 1e-9))
            left[near] = False
            links += [(int(rep[at]), int(rep[x])) for x in near]
            todo += near.tolist()
    return links


def _meet(key: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, the least rep of each, and the (rep, least rep) of all others as distinct rows."""
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    least = np.repeat(rep[new], np.diff(np.r_[new, len(key)]))
    other = rep != least
    return key[new], rep[new], np.unique(np.stack([rep[other], least[other]], axis=1), axis=0)


def band_links(reps: DataFrame) -> DataFrame:
    """(a, b): links that connect all ``reps(rep, bands)`` that share a band. Whatever meets within a
    batch is linked there, so that one row for each key and batch is shuffled, however many share it;
    the sorted rows of a key then pass by, none being held but the first."""

    def local(batches):
        for batch in batches:
            lists = batch.column(1)
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            key, least, met = _meet(lists.flatten().to_numpy(zero_copy_only=False), rep)
            columns = [np.r_[key, met[:, 0]], np.r_[least, met[:, 0]], np.r_[least, met[:, 1]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "a", "b"])

    def across(batches):
        now, first = None, 0
        for batch in batches:
            key, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            known = a != b
            key, rep = key[~known], a[~known]
            pairs = [np.stack([a[known], b[known]], axis=1)]
            if len(key):
                starts = np.flatnonzero(np.r_[key[0] != now, key[1:] != key[:-1]])
                heads = rep[starts]
                if not len(starts) or starts[0]:
                    starts, heads = np.r_[0, starts], np.r_[first, heads]
                head = np.repeat(heads, np.diff(np.r_[starts, len(key)]))
                pairs.append(np.stack([rep, head], axis=1)[rep != head])
                now, first = key[-1], head[-1]
            table = np.concatenate(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])

    met = reps.select("rep", "bands").mapInArrow(local, "key bigint, a bigint, b bigint")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(across, "a bigint, b bigint")


def _stars(keyed: DataFrame, key: str) -> DataFrame:
    """(a, b): each ``rep`` of a key that several share, with the key's smallest."""
    least = keyed.groupBy(key).agg(F.min("rep").alias("b"), F.max("rep").alias("_most")).where("b < _most").select(key, "b")
    return keyed.join(least, key).where("rep <> b").select(F.col("rep").alias("a"), "b")


def similar_links(texts: DataFrame, clusters: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links that connect whatever documents of one cluster are similar. ``texts(rep, text)`` has
    each set once, ``clusters(node, component)``; a cluster larger than a tile is dealt like a hot signature."""
    held = texts.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("g")), "rep")
    large = held.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = large.select("g", F.ceil(F.greatest(F.col("n") / SET_TILE, F.col("chars") / SET_CHARS)).alias("tiles")).where("tiles > 2")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles"))
    dealt = (
        held.join(large, "g", "left")
        .withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))))
        .select(F.when(F.col("other") < 0, F.xxhash64("g")).otherwise(F.xxhash64("g", F.least(own, "other"), F.greatest(own, "other"))).alias("g"), F.col("rep").cast("bigint").alias("rep"), "text")
    )

    def run(batches):
        now, sets, reps = None, [], []
        for batch in batches:
            for g, rep, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                if g != now and len(sets):
                    yield _pairs(similar_forest(sets, np.array(reps), similarity))
                    sets, reps = [], []
                now = g
                sets.append(shingle_hashes(t.as_py(), words, True))
                reps.append(rep)
        if len(sets):
            yield _pairs(similar_forest(sets, np.array(reps), similarity))

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")


def _classes(docs: DataFrame, words: int, similarity: float, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, class) of every row with an id. Sets of shingles are numbered, whatever ids their
    documents have, and linked by their numbers; a class is the number of one of its sets."""
    found = materialize(marks(docs, words, id_col, text_col).where("id is not null"), "marks")
    first = F.min(F.struct("id", "mark")).alias("shown")
    sets = found.groupBy("same").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    reps = materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "representatives")  # numbers as they are written
    by_bits = materialize(reps.groupBy("fp").agg(F.min("rep").alias("rep")), "fingerprints")
    candidates = links(by_bits, bound).union(_stars(reps.select("rep", "fp"), "fp")).union(band_links(reps))
    clusters = materialize(connected_components(candidates), "clusters")
    asked = reps.join(clusters.select(F.col("node").alias("rep")), "rep").select("rep", F.col("shown.id").alias("_id"), F.col("shown.mark").alias("_mark"))
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark"), F.col(text_col).alias("text"))
    texts = own.join(asked, ["_id", "_mark"]).groupBy("rep").agg(F.first("text").alias("text"))
    linked = connected_components(similar_links(texts, clusters, words, similarity))
    named = reps.select("same", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("class"))
    return found.join(named, "same").select("id", "mark", "class")


#: Bits between fingerprints that are compared as whole sets. Unrelated texts are within 6 bits with a
#: chance of 4.5e-12, so that up to 10^11 documents chance joins few of them; within 9 it is 1.8e-9.
NEAR = 6


def alike(docs: DataFrame, words: int = 5, similarity: float = 0.8, bound: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of every row: component is the smallest id of the texts that links reach. Two texts
    are linked if their sets of shingles have Jaccard ``similarity`` or more, or are equal (null and
    empty texts have the empty set). Fingerprints within ``bound`` bits and shared bands only say
    which texts to compare. Rows of one id are as many documents. Null ids are in no component."""
    rows = _classes(docs, words, similarity, bound, id_col, text_col)
    least = rows.groupBy("class").agg(F.min("id").alias("component"))
    none = docs.where(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("component"))
    return rows.join(least, "class").select("id", "component").unionByName(none)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, bound: int = NEAR) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts (see ``alike``) one row, that with the
    smallest doc_id (of several with that id, the one whose text has the smallest xxhash64; of rows with
    that text too, the one with the smallest hash of all columns). What goes is similar to what stays, by links, whatever ids repeat. All columns stay, whatever
    they are called; rows without an id stay; an empty table stays empty."""
    rows = _classes(docs, words, similarity, bound, "doc_id", "text")
    stays = materialize(rows.groupBy("class").agg(F.min(F.struct("id", "mark")).alias("x")).select(F.col("x.id").alias("_id"), F.col("x.mark").alias("_mark")), "stays")
    text = F.xxhash64(docs["text"])
    kept = docs.join(stays, (docs["doc_id"] == stays["_id"]) & (text == stays["_mark"]), "left_semi")
    repeated = rows.join(stays, (rows["id"] == stays["_id"]) & (rows["mark"] == stays["_mark"]), "left_semi").groupBy("id", "mark").count().where("count > 1")
    if repeated.limit(1).count():
        own, mark = free_name("_row", docs.columns), free_name("_text", docs.columns)
        whole = kept.select(F.struct("*").alias(own), F.xxhash64("text").alias(mark))
        order = F.xxhash64(*(F.col(f"{own}.`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
        one = whole.groupBy(F.col(f"{own}.doc_id"), mark).agg(F.min_by(own, order).alias(own))
        kept = one.select(*(F.col(f"{own}.`{c}`").alias(c) for c in docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))
