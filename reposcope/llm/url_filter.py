"""URL filter: host and path rules first, then the ratio of two character language models.

The models are Markov models of the characters of accepted and of rejected URLs, orders 0 to 4, each
order smoothed by the one below it (hierarchical Dirichlet). Counts cover all labelled URLs and are
exact: a key holds the order and all bytes, so that no two contexts share a count. The model grows
with the number of distinct keys, 24 bytes each: up to MODEL_ROWS rows it is broadcast; of a larger one the
keys of one or two characters are, and the others are joined to batches of the different URLs. The score is the difference of the log-likelihoods over
the length; its border is calibrated on URLs that did not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import materialize, parts

ORDERS, STRENGTH = 5, 4.0
BINS, SPAN = 400, 4.0
#: Counts that a broadcast model holds at most.
MODEL_ROWS = 4_000_000
#: Keys below are of two characters at most; different texts that ask for the others together.
LOW_KEYS, BATCH = 5 << 40, 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MODEL_SCHEMA = "label int, key bigint, n bigint"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path: what follows the first ``://``; both empty if there is none or no URL."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return df.withColumns({
        "host": F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    })


def rule_of(rules: dict[str, str], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does), and its verdict. A rule is a host, which also
    stands for its subdomains, and the start of a path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in sorted(rules, key=lambda r: (len(r), r)):
        own_host, slash, own_path = name.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, rules[name]).otherwise(verdict)
    return rule, verdict


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all characters (bytes) of all texts: keys of the context and of context and character, for
    each order, and where each text starts. A key is up to five bytes below what it counts."""
    pad = b"\x02" * (ORDERS - 1)
    raw = [pad + t.encode("utf-8", "surrogatepass") + b"\x03" for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(r) - len(pad) for r in raw])
    start = np.cumsum(sizes + len(pad)) - sizes
    at = np.repeat(start - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    context, own = np.empty((ORDERS, len(at)), dtype=np.int64), np.empty((ORDERS, len(at)), dtype=np.int64)
    held = np.zeros(len(at), dtype=np.int64)
    for k in range(ORDERS):
        if k:
            held |= data[at - k] << (8 * k)
        context[k] = held | (2 * k << 40)
        own[k] = held | data[at] | (2 * k + 1 << 40)
    return context, own, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)


def count(labelled: DataFrame) -> DataFrame:
    """Summed counts of ``labelled(text, label)``, label 1 for rejected: (label, key, n). Null texts count
    as empty ones; an empty table gives no rows."""

    def run(batches):
        for batch in parts(batches, 10_000):
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                texts = [t or "" for t in batch.column(0).filter(pa.array(labels == label)).to_pylist()]
                if texts:
                    key, n = np.unique(np.concatenate([x.ravel() for x in _keys(texts)[:2]]), return_counts=True)
                    for a in range(0, len(key), 100_000):
                        part = slice(a, a + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), label, dtype=np.int32)), pa.array(key[part]), pa.array(n[part].astype(np.int64))], ["label", "key", "n"])

    return labelled.select("text", "label").mapInArrow(run, MODEL_SCHEMA).groupBy("label", "key").agg(F.sum("n").alias("n"))


#: Sorted keys, and the counts of accepted and of rejected URLs beside them.
Model = tuple[np.ndarray, np.ndarray]


def model_of(counts: DataFrame) -> Model:
    rows = counts.select("label", "key", "n").toArrow()
    label, key, n = (rows.column(i).to_numpy() for i in range(3))
    keys = np.unique(key)
    model = np.zeros((2, len(keys)))
    model[label, np.searchsorted(keys, key)] = n
    return keys, model


def _ratios(own: np.ndarray, context: np.ndarray, start: np.ndarray) -> np.ndarray:
    """From counts (label, order, character) of context and character and of contexts."""
    p = np.full((2, own.shape[2]), 1 / 256)
    for k in range(ORDERS):
        p = (own[:, k] + STRENGTH * p) / (context[:, k] + STRENGTH)
    size = np.diff(np.r_[start, own.shape[2]])
    return np.add.reduceat(np.log(p[1]) - np.log(p[0]), start) / size


def ratios(texts: list[str], model: Model) -> np.ndarray:
    """Log-likelihood as rejected less as accepted, over the length."""
    if not texts:
        return np.empty(0)
    keys, counts = model
    context, own, start = _keys(texts)

    def found(asked):
        if not len(keys):
            return np.zeros((2, *asked.shape))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, counts[:, at], 0.0)

    return _ratios(found(own), found(context), start)


def score_by_join(df: DataFrame, counts: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The same as ``score`` for a model of any size. Keys up to LOW_KEYS, of at most two characters, are
    131,585 at most and always sent to the tasks; longer ones are asked for once for each BATCH of
    different texts, meet their counts by a join, and come back to the batch, which is then scored. No
    key has more rows than there are batches, and a batch holds the n-grams of its own texts."""
    texts = materialize(df.select(F.coalesce(text_col, F.lit("")).alias("text")).distinct().withColumn("uid", F.monotonically_increasing_id()), "urls").withColumn("batch", F.floor(F.col("uid") / BATCH))
    labels = counts.groupBy("key").agg(*(F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(f"n{x}") for x in (0, 1)))
    low = labels.where(F.col("key") < LOW_KEYS).orderBy("key").toArrow()
    shared = df.sparkSession.sparkContext.broadcast((low.column(0).to_numpy(), np.stack([low.column(i).to_numpy().astype(np.float64) for i in (1, 2)])))

    def asked(batches):
        for part in parts(batches, BATCH):
            number = part.column(1).to_numpy()
            for b in np.unique(number):
                context, own, _ = _keys(part.column(0).filter(pa.array(number == b)).to_pylist())
                key = np.unique(np.concatenate([context.ravel(), own.ravel()]))
                key = key[key >= LOW_KEYS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b)), pa.array(key)], ["batch", "key"])

    none = F.lit(None)
    met = texts.select("text", "batch").mapInArrow(asked, "batch bigint, key bigint").join(labels.where(F.col("key") >= LOW_KEYS), "key")
    both = met.select("batch", none.cast("string").alias("text"), "key", "n0", "n1").unionByName(texts.select("batch", "text", none.cast("bigint").alias("key"), none.cast("bigint").alias("n0"), none.cast("bigint").alias("n1")))

    def scored(batches):
        now, held, model = None, [], None
        for batch in batches:
            number, is_text = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (is_text[1:] != is_text[:-1])])
            for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(number)], strict=True):
                part = batch.slice(start, end - start)
                if number[start] != now:
                    now, held, model = number[start], [], None
                if not is_text[start]:
                    held.append(np.stack([part.column(i).to_numpy() for i in (2, 3, 4)]))
                    continue
                if model is None:
                    found = np.concatenate(held, axis=1) if held else np.empty((3, 0), dtype=np.int64)
                    key, at = np.unique(found[0], return_index=True)
                    keys, n = shared.value
                    model = np.r_[keys, key], np.concatenate([n, found[1:, at].astype(np.float64)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(ratios(part.column(1).to_pylist(), model))], ["_of", "llr"])

    dealt = both.repartition("batch").sortWithinPartitions("batch", F.col("text").isNotNull())
    made = dealt.mapInArrow(scored, "_of string, llr double")
    return df.join(made, F.coalesce(df[text_col], F.lit("")) == F.col("_of")).select(*keep, "llr")


def score(df: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and llr double; a null text counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in parts(batches, 1000):
            made = ratios([t or "" for t in batch.column(0).to_pylist()], own)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made)], [*keep, "llr"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(text_col).alias("_text"), *keep).mapInArrow(run, f"{kinds}, llr double")


def calibrate(scored: DataFrame) -> float:
    """Border of ``scored(llr, label)`` with the best mean of the two classes' accuracies, from counts
    in fixed bins."""
    bin_ = F.floor((F.least(F.greatest("llr", F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * (BINS / (2 * SPAN)))
    found = np.zeros((2, BINS + 1))
    for r in scored.groupBy(bin_.alias("b"), "label").count().collect():
        found[int(r["label"]), int(r["b"])] = r["count"]
    share = found / np.maximum(found.sum(axis=1, keepdims=True), 1)
    gain = np.r_[0, np.cumsum(share[0])] + 1 - np.r_[0, np.cumsum(share[1])]
    best = np.flatnonzero(gain == gain.max())
    return float(best[len(best) // 2] * (2 * SPAN / BINS) - SPAN) if found.min(axis=0).size and found.sum(axis=1).all() else 0.0


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, llr) of every row. The rules' verdicts label the URLs from
    which the models are made (four fifths count, one fifth calibrates, by a hash of the URL); the
    other rows are judged by the models. Without rows of both labels the border is 0, and the verdict
    allow at it. Null URLs have an empty host and path. Repeated rows are judged alike; other columns
    are not read; an empty table gives no rows. The models read whole URLs as they are."""
    base = with_parts(pages.select(F.col(id_col), F.col(url_col).alias("url")))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    base = base.withColumns({"rule": rule, "_own": verdict, "_text": F.coalesce("url", F.lit(""))})
    labelled = base.where("_own is not null").select(F.col("_text").alias("text"), (F.col("_own") == "block").cast("int").alias("label"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"))
    counts = materialize(count(labelled.where("not held")), "url-counts")
    if counts.count() <= MODEL_ROWS:
        way, model = score, model_of(counts)
    else:
        way, model = score_by_join, counts
    border = calibrate(way(labelled.where("held"), model, "text", ["label"]))
    kept = [id_col, "host", "path", "rule", "_own"]
    scored = way(base, model, "_text", kept)
    own = F.when(F.col("llr") > border, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("_own", own).alias("verdict"), "llr")
