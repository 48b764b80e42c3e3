"""Line dedup, centroid clustering and whitening against brute force on small tables."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reposcope.llm import centroids, common, entries, line_dedup, whitening

SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows, chars=20, documents=3):
    """(n_lines, n_dropped, sha256) of each row of (doc_id, text)."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    def order(d):
        return (d is not None, d or 0)

    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stays = [x for x in lines if len(key(x)) < chars or len(holders[key(x)]) < documents or max(holders[key(x)]) == order(d)]
        out.append((d, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=repr)


def lined_rows(seed, n=120):
    rng = random.Random(seed)
    stock = [f"{'A Shared line of Text ' * 2}{i}" for i in range(12)] + ["short", "", "  ", "x" * 19, "y" * 20, "é" * 19, "é" * 20, " " + "z" * 20 + "\x0b", "Z" * 20 + "\r"]
    hot = "the line that a third of all documents hold"
    rows = [(i, "\n".join(([hot.upper()] if i % 3 == 0 else []) + [rng.choice(stock).center(rng.choice([0, 60])) for _ in range(rng.randrange(7))])) for i in range(n)]
    rows += [(7, "other text of id 7\n" + hot), (7, "other text of id 7\n" + hot), (None, hot + "\n" + stock[0]), (None, stock[0]), (500, None), (501, ""), (502, "\n\n"), (-3, hot + "\n" + hot), (900, ("\n".join(stock) + "\n") * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op11_equals_brute_force(spark, seed):
    rows = lined_rows(seed)
    path = common.scratch_path(spark, "op11")
    spark.createDataFrame([(d, t, "k", 1, True) for d, t in rows], "doc_id bigint, text string, mark string, n_lines int, keep boolean").repartition(5).write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in entries.op11_line_dedup(spark, path).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute_lines(rows)


def test_lines_at_the_borders_of_ranges_and_batches(spark):
    """Few hashes over many ranges and tiny batches: most rows are at a border."""
    rows = lined_rows(3, 60)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")} | {"spark.sql.adaptive.coalescePartitions.enabled": "true"}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for size in ("1", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            docs = spark.createDataFrame(rows, "doc_id bigint, text string")
            got = line_dedup.digests(docs, common.materialize(line_dedup.keep_bitmaps(docs), "bitmaps")).collect()
            assert sorted((tuple(r) for r in got), key=repr) == brute_lines(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_streamed_ranges_equal_brute_force():
    """The stream alone over sorted rows that are cut into ranges and batches at random."""
    rng = random.Random(4)
    for _ in range(60):
        rows = sorted({(rng.randrange(3), 0, rng.random() < 0.9, rng.randrange(6)) for _ in range(rng.randrange(1, 25))}, key=lambda r: (r[0], r[1], -r[2], -r[3] if r[2] else 0))
        rows = list(dict.fromkeys((h, lo, d if named else 0, named) for h, lo, named, d in rows))
        made = [[]]
        for r in rows:
            made[-1].append(r)
            if rng.random() < 0.2:
                made.append([])
        passed = []
        for part in made:
            cuts = sorted(rng.sample(range(len(part) + 1), min(len(part), 3)))
            batches = [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]
            arrow = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in b], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))] + [pa.array([1] * len(b), pa.int64()), pa.array([1] * len(b), pa.int32()), pa.array([[0]] * len(b), pa.list_(pa.int32()))], ["hi", "lo", "doc", "named", "mark", "n_lines", "at"]) for b in batches]
            passed += [r for b in line_dedup._stream(3)(iter(arrow)) for r in b.to_pylist()]
        sums = defaultdict(int)
        tops = {}
        for r in passed:
            if r["kind"] == "sum":
                sums[r["hi"]] += r["docs"]
                tops[r["hi"]] = max(tops.get(r["hi"], (False, 0)), (r["named"], r["doc"]))
        lost = sorted((r["hi"], r["named"], r["doc"]) for r in passed if r["kind"] == "drop" or r["kind"] == "open" and sums[r["hi"]] >= 3 and (r["named"], r["doc"]) != tops[r["hi"]])
        by = defaultdict(set)
        for h, _lo, d, named in rows:
            by[h].add((named, d))
        assert lost == sorted((h, *x) for h, own in by.items() if len(own) >= 3 for x in own if x != max(own))


def test_lines_applied_and_empty_tables(spark):
    rows = lined_rows(5, 40)
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id bigint, text string, _keep int")
    out = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    assert out.columns == docs.columns and out.where("_keep <> 3").count() == 0
    got = sorted(((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == sorted(((r[0], r[3]) for r in brute_lines(rows)), key=repr)
    assert out.where("doc_id = 500 and text is null").count() == 1
    none = docs.limit(0)
    assert line_dedup.keep_bitmaps(none).count() == 0 and line_dedup.apply(none, line_dedup.keep_bitmaps(none)).count() == 0
    assert line_dedup.digests(docs.where("doc_id = 500"), line_dedup.keep_bitmaps(none)).first()["n_lines"] == 1


def test_bitmaps():
    for n in (1, 8, 9, 1000):
        gone = np.array(sorted(random.Random(n).sample(range(n), n // 2)), dtype=np.int64)
        assert np.flatnonzero(~line_dedup.unpack(line_dedup.pack(n, gone), n)).tolist() == gone.tolist()


VECTORS = "vec_id bigint, embedding array<float>, cluster int, q string, w double"


def vector_rows(n=150, d=64, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, d)) * 2
    x = (middles[rng.integers(0, 7, n)] + rng.normal(size=(n, d)) * np.linspace(0.2, 2, d)).astype(np.float32)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1]), (-4, rows[5][1]), (9001, None), (9002, []), (9005, [0.0] * d), (None, rows[9][1])]
    bad = [float("nan"), float("inf"), None]
    return rows + [(9010 + i, [b, *rows[0][1][1:]]) for i, b in enumerate(bad)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if usable(v) and len(v) == 64]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in first[:k]]
    for r in range(rounds + 1):
        x = np.array([v for _, v in kept], dtype=object)
        near = []
        for v in x:
            d = [int(sum((a - b) ** 2 for a, b in zip(v, c, strict=True))) for c in cent]
            near.append((min(d), d.index(min(d))))
        if r < rounds:
            for c in range(len(cent)):
                own = [v for v, m in zip(x, near, strict=True) if m[1] == c]
                if own:
                    cent[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    every = sum(d for d, _ in near)
    own = defaultdict(int)
    for d, c in near:
        own[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, d, own[c], every, names[c]) for (i, _), (d, c) in zip(kept, near, strict=True)), key=repr)


def write_vectors(spark, rows):
    path = common.scratch_path(spark, "vectors")
    spark.createDataFrame([(i, v, 1, "q", 2.0) for i, v in rows], VECTORS).repartition(6).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_op12_equals_brute_force(spark):
    rows = vector_rows()
    got = entries.op12_centroids(spark, write_vectors(spark, rows)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows)


def test_clusters_of_few_and_no_vectors(spark):
    few = vector_rows()[:9]
    got = entries.op12_centroids(spark, write_vectors(spark, few)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(few)
    assert entries.op12_centroids(spark, write_vectors(spark, [(1, None), (2, [1.0])])).count() == 0
    with pytest.raises(Exception, match="distances would not fit"):
        entries.op12_centroids(spark, write_vectors(spark, [(1, [1e9] * 64)])).count()


def test_partial_distances_leave_nothing_out():
    rng = np.random.default_rng(3)
    for d, step in ((64, 8), (10, 3), (1, 8)):
        x, c = rng.integers(-4, 4, (300, d)), rng.integers(-4, 4, (25, d))
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        number, best = centroids.nearest(x, c, rng.permutation(d), step)
        assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def plain_whitening(rows):
    kept = [(i, v) for i, v in rows if usable(v)]
    most = max(len(v) for _, v in kept)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (most - len(v))]] for _, v in kept], dtype=np.int64)
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, total, strict=True)) for row in x]
    return [i for i, _ in kept], n, deviation, centred @ vectors[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


@pytest.mark.parametrize("fan", [2, 16])
def test_op13_equals_plain_eigenvectors(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "STEP", 20)
    rows = [r for r in vector_rows(300) if r[0] is None or r[0] < 9001] + [(9001, None), (9002, []), (9003, [1.0, 2.0])] + vector_rows(300)[-3:]
    ids, n, deviation, white, share = plain_whitening(rows)
    got = defaultdict(list)
    for r in entries.op13_whitening(spark, write_vectors(spark, rows)).collect():
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        got[r["component"]].append((r["vec_id"], r["deviation"], r["whitened"]))
    assert sorted(got) == list(range(1, 9))
    for c, made in got.items():
        made.sort(key=lambda r: (repr(r[0]), r[1], abs(r[2])))
        wanted = sorted(zip(ids, deviation, white[:, c - 1].tolist(), strict=True), key=lambda r: (repr(r[0]), r[1], abs(r[2])))
        assert [r[:2] for r in made] == [r[:2] for r in wanted]
        a, b = np.array([r[2] for r in made]), np.array([r[2] for r in wanted])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_of_flat_and_empty_tables(spark):
    flat = entries.op13_whitening(spark, write_vectors(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = entries.op13_whitening(spark, write_vectors(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0])])).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in line] == [False, True] * 2 and abs(abs(line[0]["whitened"]) - 1) < 1e-12 and line[0]["explained"] == 1.0
    assert entries.op13_whitening(spark, write_vectors(spark, [(1, None), (2, [float("nan")])])).count() == 0


def test_summaries_merge_without_loss():
    rng = np.random.default_rng(9)
    x = rng.integers(90_000, 110_000, (500, 12))
    cuts = [0, 1, 2, 90, 91, 350, 500]
    made = whitening.Summary(0, [], np.empty((0, 12)))
    for a, b in zip(cuts, cuts[1:], strict=False):
        made = whitening.merge(made, whitening.summary(x[a:b]))
    centred = x - x.mean(axis=0)
    assert made.n == 500 and made.total == x.sum(axis=0).tolist()
    assert np.abs(made.factor.T @ made.factor - centred.T @ centred).max() < 1e-10 * np.abs(centred.T @ centred).max()


def test_deviations_are_exact():
    for n, most in ((10, 200), (10**9, 10**6), (10**13, 10**6)):
        x = np.random.default_rng(n % 7).integers(-most, most, (5, 4))
        total = [n * 3, -n, 0, n * most]
        assert whitening.deviations(x, n, total) == [sum((n * int(v) - t) ** 2 for v, t in zip(row, total, strict=True)) for row in x]
