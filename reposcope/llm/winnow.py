"""Document fingerprints by winnowing, in column expressions only.

Tokens are runs without white space of up to RUN code points; longer runs are cut after signs that
end a token wherever they stand (or after LONGEST code points without one), so that what changes at
one place of a run leaves the cuts behind it as they are. Every k tokens give a gram, hashed by a
rolling hash: H(i+1) = (H(i) - x(i) B^(k-1)) B + x(i+k) modulo a prime, x being the token's hash. The
hash rolls over blocks of BLOCK grams, each block starting anew, so that what an expression has to
copy is bounded by the block and not by the text. Of every w neighbouring grams the one with the
smallest hash is chosen, the rightmost of equal ones, so that any match of w + k - 1 tokens shares a
chosen gram, and none shorter than k tokens is found. Chosen grams are kept with their positions.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 3, 6
RUN, SHORTEST, LONGEST = 24, 4, 24
#: A run as a whole, or a part of a longer one that a sign of about a third of all letters and digits ends.
TOKEN = rf"\S{{1,{RUN}}}(?!\S)|\S{{{SHORTEST},{LONGEST}}}?(?<=[aeio0369\p{{InCJK_Unified_Ideographs}}])|\S{{1,{LONGEST}}}"
#: Rolling hash: a prime below 2^31, so that products fit 63 bits, and the base.
PRIME, BASE = 2_147_483_629, 1_103_515_245
BLOCK = 64
#: Rows between two borders of document ids, until there are MOST_RANGES; then ranges grow, and spill.
RANGE_ROWS, MOST_RANGES = 1500, 65_536
_LOW, _NULL = 0xFFFFFFFF, -(1 << 63)


def _let(value: Column, body) -> Column:
    """body(value), the value being taken once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<bigint>: the chosen grams in document order, each as hash * 2^32 + 2^32 - 1 - position
    (31 bits of hash; position of its first token, from 0). Fewer tokens than a gram: one gram of all
    of them; none (empty or null text): empty array."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))
    last = pow(BASE, gram - 1, PRIME)

    def whole(h: Column, i: Column, n: int) -> Column:
        made = F.get(h, i)
        for j in range(1, n):
            made = (made * BASE + F.get(h, i + j)) % PRIME
        return made

    def marked(value: Column, i: Column) -> Column:
        return F.shiftleft(value, 32) + (F.lit(_LOW) - i)

    def rolled(h: Column, start: Column, end: Column) -> Column:
        """The grams that start from ``start`` to ``end``, from the first one on."""
        first = whole(h, start, gram)
        begin = F.struct(first.alias("at"), F.array(marked(first, start)).alias("all"))

        def step(s: Column, i: Column) -> Column:
            now = ((s["at"] - F.get(h, i - 1) * last % PRIME + PRIME) * BASE + F.get(h, i + (gram - 1))) % PRIME
            return _let(now, lambda x: F.struct(x.alias("at"), F.array_append(s["all"], marked(x, i)).alias("all")))

        return F.aggregate(F.slice(F.sequence(start, end), F.lit(2), F.lit(BLOCK)), begin, step)["all"]

    def grams(h: Column) -> Column:
        end = F.size(h) - gram
        many = F.flatten(F.transform(F.sequence(F.lit(0), end, F.lit(BLOCK)), lambda start: rolled(h, start, F.least(start + (BLOCK - 1), end))))
        few = F.array(marked(F.aggregate(h, F.lit(0).cast("bigint"), lambda done, x: (done * BASE + x) % PRIME), F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < gram, few).otherwise(many)

    def least(v: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(v) - (window - 1)), lambda i: F.array_min(F.slice(v, i, window)))
        one = F.array(F.array_min(v))
        return F.when(F.size(v) == 0, v).when(F.size(v) < window, one).otherwise(F.array_distinct(many))

    return _let(_let(tokens, grams), least)


def hashes(picked: Column) -> Column:
    return F.array_distinct(F.transform(picked, lambda x: F.shiftright(x, 32)))


def as_text(picked: Column) -> Column:
    """``hash@position`` in hexadecimal, comma-joined."""
    return F.array_join(F.transform(picked, lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit("@"), F.hex(F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, 1.0).otherwise(shared / total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id_col, position, hash) of every chosen gram: rows to join on for matching passages."""
    picked = docs.select(F.col(id_col), F.explode(chosen(F.col(text_col), gram, window)).alias("x"))
    return picked.select(id_col, (F.lit(_LOW) - F.col("x").bitwiseAND(F.lit(_LOW))).alias("position"), F.shiftright("x", 32).alias("hash"))


def _array(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def _range_of(x: Column, borders: list[int]) -> Column:
    """Number of borders that are less than x, by bisection in a constant array."""
    if not borders:
        return F.lit(0)
    array = _array(borders)
    steps = F.sequence(F.lit(1), F.lit(len(borders).bit_length()))
    start = F.struct(F.lit(0).alias("a"), F.lit(len(borders)).alias("b"))

    def halve(s, _):
        middle = F.shiftright(s["a"] + s["b"], 1)
        less = F.get(array, middle) < x
        return F.when(s["a"] >= s["b"], s).when(less, F.struct((middle + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), middle.alias("b")))

    return F.aggregate(steps, start, halve)["a"]


def beside_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every
    row: its text, the text whose last half is the start of the next document, and the next document.

    Next is by descending doc_id, after the last the first; equal ids stand in the order of their
    texts' hashes, null ids come last. Null texts count as empty; other columns are not read. The ids are
    cut at quantiles into ranges, and an id that several quantiles hit into parts by its texts' hashes,
    so that only rows equal in both must stand together; the first row of each range also goes to the
    one before. Each range is one window, which spills; texts are shuffled once. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(_NULL)).cast("bigint").alias("_id"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = rows.count()
    ranges = int(min(max(1, n // RANGE_ROWS), MOST_RANGES))
    cuts = Counter(rows.agg(F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [] if ranges > 1 else [])
    borders = sorted(cuts.keys() | {c - 1 for c, times in cuts.items() if times > 1 and c > _NULL})
    width = [max(1, cuts[b]) for b in borders] + [1]
    base = [0, *accumulate(width)]
    at = _range_of(F.col("_id"), borders)
    share = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * F.get(_array(width), at)).cast("int"), F.get(_array(width), at) - 1)
    rows = rows.withColumn("r", (F.get(_array(base), at) + share).cast("int"))
    tops = {r["r"]: r["top"] for r in rows.groupBy("r").agg(F.max(F.struct("_id", F.bitwise_not("tie").alias("t"))).alias("top")).collect()}
    used = [r for i in reversed(range(len(width))) for r in range(base[i], base[i + 1]) if r in tops]
    before = dict(zip(used, used[-1:] + used[:-1], strict=True))
    head = [tops.get(r, (0, 0)) for r in range(base[-1])]
    is_head = (F.get(_array([h[0] for h in head]), F.col("r")) == F.col("_id")) & (F.get(_array([h[1] for h in head]), F.col("r")) == F.bitwise_not("tie"))
    own = F.struct(F.col("r"), F.lit(0).alias("extra"))
    goes = F.struct(F.get(_array([before.get(r, 0) for r in range(base[-1])]), F.col("r")).cast("int").alias("r"), F.lit(1).alias("extra"))
    places = F.when(is_head, F.array(own, goes)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "_id", "tie", "text", F.explode(places).alias("p")).select("doc_id", "_id", "tie", "text", F.col("p.r").alias("r"), F.col("p.extra").alias("extra")).repartition("r")
    marked = dealt.withColumn("picked", chosen(F.col("text"), gram, window))
    order = Window.partitionBy("r").orderBy("extra", F.desc("_id"), "tie")
    after = marked.select("*", F.lead("text").over(order).alias("next_text"), F.lead("picked").over(order).alias("next_picked")).where("extra = 0")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    made = after.select("doc_id", size.cast("bigint").alias("n_chars"), "picked", hashes(F.col("next_picked")).alias("next_hashes"), edited.alias("edited"))
    made = made.withColumn("edited_picked", chosen(F.col("edited"), gram, window)).withColumn("own_hashes", hashes(F.col("picked")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("picked")).alias("fingerprint"),
        as_text(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), hashes(F.col("edited_picked"))).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
