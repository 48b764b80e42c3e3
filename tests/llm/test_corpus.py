"""Corpus operators against brute force, round trips and held-out rows, on small tables."""

import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposcope.llm import bpe, common, entries, html_text, mixing, nearest, pii, simhash, token_output, toxicity, url_filter, winnow
from reposcope.llm.common import connected_components, table

SMALL = "/root/testdata/sf0.001"
ODD = ["", "one", "a b c", "A  b\tc\n d", "x" * 3000, "tie tie tie tie tie tie", "日本 語é ß", "same text here now ok"]


def odd_docs(spark):
    rows = [(i, t, "src0", 7) for i, t in enumerate(ODD)] + [(20, None, "src0", 7), (21, ODD[-1], "s", 7), (22, ODD[-1], "s", 7), (22, ODD[-1], "s", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fp string, score int")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (20, 19), (21, 20), (22, 21), (23, 22), (24, 23)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 19 for i in range(19, 25)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_components_of_hubs(spark, monkeypatch, hot):
    """Hubs with the smallest and the largest id, a chain and scattered links, however many nodes count as hubs."""
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(100, 160)] + [(i, i + 1) for i in range(300, 320)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(150, 450)]
    comp = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in comp:
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == comp and len(got) == len(comp)


def test_op1_equals_brute_force(spark):
    """The whole query against all pairs of its fixture's fingerprints."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))) for _ in range(40)]
    for t in list(texts):
        words = t.split()
        for _ in range(2):
            if words:
                words[rng.randrange(len(words))] = "Changed"
            texts.append(" ".join(words))
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(2001, None), (2002, ""), (2003, texts[0].upper())]
    path = f"{common.scratch_path(spark, 'op1')}"
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entries.queries()["op1_simhash"](spark, path).collect()}
    rows.sort()
    fps = [brute_simhash(t, 4) for _, t in rows]
    comp = brute_components(fps, 4)
    assert got == {i: (f"{fps[k]:016x}", rows[comp[k]][0]) for k, (i, _) in enumerate(rows)}
    assert len({c for _, c in got.values()}) < len(rows) - 5


def brute_simhash(text, k):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bound):
    comp = {i: i for i in range(len(fps))}
    for _ in fps:
        for i in comp:
            for j in comp:
                if (fps[i] ^ fps[j]).bit_count() <= bound:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


def test_simhash_fingerprints_and_empty(spark):
    got = simhash.near_duplicates(odd_docs(spark), words=4, bound=4, distinct=False).collect()
    assert len(got) == len(ODD) + 4
    for r in got:
        text = ODD[r["id"]] if r["id"] < len(ODD) else None if r["id"] == 20 else ODD[-1]
        assert r["fp"] & (2**64 - 1) == brute_simhash(text, 4)
    by = {r["id"]: r["component"] for r in got}
    assert by[0] == by[20] == 0 and by[21] == by[22] == by[7] == 7
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("bound", [4, 9])
def test_simhash_links(bound):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(140):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, bound)):
            x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    a = np.array(fps, dtype=np.uint64).view(np.int64)
    found = simhash._forest(a, np.arange(len(a)), bound)
    root = {i: i for i in range(len(a))}
    for x, y in found:
        assert (fps[x] ^ fps[y]).bit_count() <= bound
        p, q = root[x], root[y]
        root = {k: min(p, q) if v in (p, q) else v for k, v in root.items()}
    assert root == brute_components(fps, bound) and len(found) < len(a)


def test_simhash_thresholds_cover(spark):
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63, 300)
    near = fps.copy()
    for i in range(len(near)):
        for b in rng.choice(64, 9, replace=False):
            near[i] ^= np.int64(1) << np.int64(b)
    rows = [(int(f), i) for i, f in enumerate(fps)] + [(int(f), 1000 + i) for i, f in enumerate(near)]
    reps = spark.createDataFrame(rows, "fp bigint, rep bigint")
    assert sum(t + 1 for _, t in simhash.plan(reps, 9)) >= 9 + 1
    comp = {r[0]: r[1] for r in connected_components(simhash.links(reps, 9)).collect()}
    assert all(comp.get(1000 + i) == i for i in range(300))


def test_keep_one(spark):
    kept = simhash.keep_one(odd_docs(spark))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(ODD)))
    assert kept.columns == ["doc_id", "text", "fp", "score"]


def test_keep_one_of_repeated_ids(spark):
    """Ids that repeat name several documents: each group keeps one of its own."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a, "x"), (5, b, "x"), (7, b + " more", "x"), (9, c, "x"), (9, c, "x"), (9, c.upper(), "x"), (11, c, "x"), (None, a, "x"), (3, d, "x"), (3, d + " end", "x"), (2, "", "x"), (2, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _mark string")
    kept = simhash.keep_one(docs)
    got = sorted((r.doc_id, (r.text or "")[:1].lower()) for r in kept.where("doc_id is not null").collect())
    assert got == [(2, ""), (3, "d"), (5, "a"), (5, "b"), (9, "c")] and kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1
    shown = sorted(tuple(r) for r in simhash.alike(docs.where("doc_id is not null")).collect())
    assert shown == [(2, 2), (2, 2), (3, 3), (3, 3), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9), (9, 9), (11, 9)]


def test_keep_one_of_empty_tables(spark):
    none = odd_docs(spark).limit(0)
    assert simhash.keep_one(none).count() == 0 and simhash.alike(none).count() == 0
    unnamed = spark.createDataFrame([(None, "a")], "doc_id bigint, text string")
    assert simhash.keep_one(unnamed).count() == 1


def test_keep_one_goes_by_whole_sets(spark):
    """Pairs of Jaccard similarity 0.8 and little more all lose one, pairs below 0.8 none."""
    rng, rows, similar = random.Random(11), [], set()

    def grams(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    for i in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(90, 300))]
        other, changed = list(words), 0
        while True:
            trial = list(other)
            trial[rng.randrange(len(words))] = f"n{changed}"
            a, b = grams(words), grams(trial)
            if len(a & b) < 0.8 * len(a | b) and i % 2 == 0:
                break
            other, changed = trial, changed + 1
            if len(a & b) < 0.8 * len(a | b):
                break
        if i % 2 == 0:
            similar.add(2 * i + 1)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(range(600)) - similar


def test_similar_forest_tiles(spark, monkeypatch):
    """A cluster dealt over tiles has the components of the exact comparison of all pairs."""
    monkeypatch.setattr(simhash, "SET_TILE", 8)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(x if rng.random() > 0.02 else f"n{rng.random()}" for x in base) for _ in range(60)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    comp = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.id: r.component for r in simhash.alike(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(comp)) and 1 < len(set(comp)) < 60


def test_tokens_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_output.tokens_of(odd_docs(spark)).orderBy("start").collect()
    ids = [x for r in rows for x in r["ids"]]
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert [r["start"] for r in rows] == starts and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    for r in rows[: len(ODD)]:
        assert r["ids"] == [*own.encode(ODD[r["doc_id"]], add_special_tokens=False).ids, 0]
    assert len(ids) == sum(r["n_tokens"] for r in rows)
    assert token_output.tokens_of(odd_docs(spark).limit(0)).count() == 0


def test_tokens_of_special_strings(spark):
    """Strings of added tokens in a text give the ids that the library alone gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made, rng = token_output.encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    signs = ["a", "b ", "<|endoftext|>", " the", "é", "\n", "<|", "|>", " ", "12", "'s", " x", "日本", "?!"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(10_000)]
    got = [np.frombuffer(x, dtype=made.dtype).tolist() for x in made.encode(texts)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_one_id_many_files(spark, monkeypatch):
    """Rows that share an id spread over files; starts go on over them."""
    monkeypatch.setattr(token_output, "FILE_BYTES", 500)
    rows = [(7 if i % 3 else i, f"text {i} " + "word " * (i % 9)) for i in range(200)] + [(None, "x"), (7, None), (-5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    manifest = token_output.write_tokens(docs, f"file:///tmp/planes-{random.random()}", __import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert sum(r.n_docs for r in manifest.collect()) == len(rows) and manifest.count() > 5
    got = token_output.read_tokens(manifest).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -(1 << 63) if x is None else x)


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    rng = np.random.default_rng(5)
    docs = [(i if i != 3 else None, rng.integers(0, 2**32 if i % 2 else 9, rng.integers(0, 400)).astype(np.uint32)) for i in range(40)]
    data = token_output.in_memory(docs, bits, block=128)
    reader = token_output.PlaneReader(io.BytesIO(data), len(data))
    back = list(reader.documents())
    assert [b[0] for b in back] == [d[0] for d in docs] and all(np.array_equal(b[2], d[1]) for b, d in zip(back, docs, strict=True))
    whole = np.concatenate([d[1] for d in docs])
    assert np.array_equal(reader.ids(100, 500), whole[100:500])


def test_bpe_equals_library(spark):
    import base64

    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    del public_tokenizers
    made = bpe.codec(path, pattern)
    rng = random.Random(2)
    texts = [*ODD, "don't  we'll 12 345\n\n x", "\t \n b", "a\u00a0\n b", "=-" * 300, "zzz" * 500]
    texts += ["".join(rng.choice("abcdeéñ '\n.,1 ") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        ids = made.encode(t)
        assert ids == library.encode_ordinary(t) and made.decode(ids) == t.encode()
        assert "".join(made.decode_stream([i] for i in ids)) == t
    for r in bpe.encode(odd_docs(spark), digests=True).where("doc_id < 8").collect():
        assert r["decoded_sha256"] == hashlib.sha256(ODD[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(library.encode_ordinary(ODD[r["doc_id"]]))
    back = bpe.decode(bpe.encode(odd_docs(spark)))
    assert {r.doc_id: r.text for r in back.collect()}[6] == ODD[6]


def plain_bpe(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while found := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_bpe_transducer_equals_merges(monkeypatch):
    """Steps alone, with tables that are emptied often, give the tokens of plain merging by rank; what is
    settled on the way is never taken back."""
    monkeypatch.setattr(bpe, "STATES", 300)
    fst = bpe.Codec(*bpe.default_vocabulary()).fst
    rng = random.Random(5)
    for word in [b"a", b" therblingly", "aaaaaaaaaé\u00fcß".encode(), bytes(range(256)), *(bytes(rng.choice(b"abest in'\xc3\xa9\xff") for _ in range(rng.randint(1, 40))) for _ in range(400))]:
        want = plain_bpe(word, fst.ranks)
        assert fst.encode(word) == want
        fst.clear()
        state, settled = 0, []
        for byte in word:
            state, emitted = fst.step(state, byte)
            settled += emitted
            assert settled == want[: len(settled)] and len(fst.states[state][1]) <= max(map(len, fst.ranks))


def test_bpe_decodes_broken_characters_in_parts():
    made = bpe.codec(*bpe.default_vocabulary())
    ids = made.encode("a日本é😀" * 3000)
    assert "".join(made.decode_stream(ids[i : i + 7] for i in range(0, len(ids), 7))) == "a日本é😀" * 3000
    assert made.digests(" ".join(map(str, ids)))[2] == hashlib.sha256(("a日本é😀" * 3000).encode()).hexdigest()


def test_url_filter(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = [(0, "https://A.Example.net/en/5#x"), (1, "http://example.net"), (2, None), (3, "no scheme"), (4, "http://badexample.com/de/"), (5, "http://m.example.com/de/1?q"), (6, "x://b.org/fr/"), (7, "http://c.net/?a"), (8, "http://c.net?a")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id bigint, url string"), rules).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/5", "example.net/en/", "allow")
    assert got[1].rule is None and got[2].host == got[3].path == "" and got[4].rule is None
    assert (got[5].rule, got[6].rule, got[7].rule, got[8].rule) == ("example.com/de/", "org/fr/", "net/", None)
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_url_models_tell_classes_apart(spark):
    rng = random.Random(1)
    rows = [(f"{rng.choice(['win', 'casino', 'bet'])}{rng.randint(0, 99)}.com/play", 1) for _ in range(300)] + [(f"{rng.choice(['news', 'docs', 'wiki'])}{rng.randint(0, 99)}.com/read", 0) for _ in range(300)]
    model = url_filter.model_of(url_filter.count(spark.createDataFrame(rows, "text string, label int")))
    bad, good = url_filter.ratios(["casino7.com/play", "docs3.com/read"], model)
    assert bad > 0 > good


def test_url_models_count_exactly(spark):
    """Scores equal those from plain counts of n-grams, for many more n-grams than 65,536."""
    rng = random.Random(13)
    signs = "abcdefghijklmnopqrstuvwxyz0123456789/?&=#.-_%ABCDEFGHIJKLMNOP"
    rows = [("".join(rng.choice(signs) for _ in range(100)), i % 2) for i in range(2000)]
    seen = [{}, {}]
    for text, label in rows:
        raw = b"\x02" * 4 + text.encode() + b"\x03"
        for i in range(4, len(raw)):
            for k in range(5):
                for key in ((k, raw[i - k : i]), (k, raw[i - k : i], raw[i])):
                    seen[label][key] = seen[label].get(key, 0) + 1
    asked = ["http://a.b/c?d=1", "", *("".join(rng.choice(signs) for _ in range(60)) for _ in range(5)), rows[3][0]]
    model = url_filter.model_of(url_filter.count(spark.createDataFrame(rows, "text string, label int")))
    for text, got in zip(asked, url_filter.ratios(asked, model), strict=True):
        raw, total = b"\x02" * 4 + text.encode() + b"\x03", 0.0
        for i in range(4, len(raw)):
            for label in (0, 1):
                p = 1 / 256
                for k in range(5):
                    p = (seen[label].get((k, raw[i - k : i], raw[i]), 0) + 4 * p) / (seen[label].get((k, raw[i - k : i]), 0) + 4)
                total += (2 * label - 1) * np.log(p)
        assert abs(got - total / (len(raw) - 4)) < 1e-9


def test_url_models_read_whole_urls(spark):
    rows = [(i, f"http://h.{('net', 'org')[i % 2]}/fr/{i}?{('spam', 'book')[i % 2]}={i}#x") for i in range(200)] + [(900, "http://e.com/a?spam=1#x"), (901, "http://e.com/a?book=1#x")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), {"net/": "block", "org/fr/": "allow"}).collect()}
    assert got[900].llr > got[901].llr


def test_winnowing(spark):
    rows = {r["doc_id"]: r for r in winnow.beside_next(odd_docs(spark).where("doc_id <> 22")).collect()}
    order = sorted(rows, reverse=True)
    text = {i: t for i, t in enumerate(ODD)} | {20: "", 21: ODD[-1]}
    for at, d in enumerate(order):
        after, n = text[order[(at + 1) % len(order)]], len(text[d])
        edited = text[d][: n - n // 2] + after[: n // 2]
        assert rows[d]["n_chars"] == n and rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[7]["fingerprint"] == rows[21]["fingerprint"] and rows[0]["fingerprint"] == ""
    assert winnow.beside_next(odd_docs(spark).limit(0)).count() == 0
    one = winnow.beside_next(odd_docs(spark).where("doc_id = 2")).first()
    assert one["near_next"] == 1.0


def brute_winnow(text, token):
    """Tokens by one expression, a hash for each gram from its own tokens, the least of each window."""
    import xxhash

    x = [(xxhash.xxh64_intdigest(t.encode(), 42) ^ (1 << 63)) - (1 << 63) for t in token(text)]
    x = [v % winnow.PRIME for v in x]

    def h(part):
        made = 0
        for v in part:
            made = (made * winnow.BASE + v) % winnow.PRIME
        return made

    if not x:
        return []
    grams = [h(x[i : i + winnow.GRAM]) for i in range(max(1, len(x) - winnow.GRAM + 1))]
    picked = []
    for i in range(max(1, len(grams) - winnow.WINDOW + 1)):
        part = grams[i : i + winnow.WINDOW]
        j = max(k for k in range(len(part)) if part[k] == min(part))
        if (grams[i + j], i + j) not in picked:
            picked.append((grams[i + j], i + j))
    return picked


def brute_tokens(text):
    out = []
    for run in re.findall(r"[^\s]+", text, re.A):
        while len(run) > winnow.RUN:
            n = next((k for k in range(winnow.SHORTEST, min(winnow.LONGEST, len(run)) + 1) if run[k - 1] in "aeio0369" or "\u4e00" <= run[k - 1] <= "\u9fff"), winnow.LONGEST)
            out.append(run[:n])
            run = run[n:]
        if run:
            out.append(run)
    return out


def test_winnowing_equals_brute_force(spark):
    """All columns, over ranges of few rows, with ties in windows, long runs, repeated ids and rows."""
    rng = random.Random(14)
    texts = {i: " ".join(rng.choice(["a", "bb", "ccc", "dédé", "日本", "x9"]) for _ in range(rng.randint(0, 200))) for i in range(0, 80, 2)}
    texts |= {i: "".join(rng.choice("abcdefgh0123") for _ in range(rng.randint(1, 400))) for i in range(1, 80, 2)}
    texts |= {100: "same " * 150, 101: "x" * 3000, 102: "", 103: " \n\t "}
    rows = [*texts.items(), (100, "same " * 150), (None, "no id at all")]
    got = winnow.beside_next(spark.createDataFrame([(*r, 0, "p") for r in rows], "doc_id bigint, text string, r int, tie string")).collect()
    order = sorted(texts, reverse=True)
    order.insert(order.index(100), 100)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    whole = [*(texts[i] for i in order), "no id at all"]
    prints = [{h for h, _ in brute_winnow(t, brute_tokens)} for t in whole]

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for at, d in enumerate([*order, None]):
        after = whole[(at + 1) % len(whole)]
        text, n = whole[at], len(whole[at])
        edited = text[: n - n // 2] + after[: n // 2]
        want = ["@".join(("%X" % h, "%X" % p)) for h, p in brute_winnow(text, brute_tokens)]
        other = {h for h, _ in brute_winnow(edited, brute_tokens)}
        made = (n, hashlib.sha256(edited.encode()).hexdigest(), ",".join(want), round(like(prints[at], other), 9), round(like(prints[at], prints[(at + 1) % len(whole)]), 9))
        assert made in [(r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in by[d]], (d, made)
    assert len(got) == len(rows)


def test_winnowing_of_one_id_over_ranges(spark, monkeypatch):
    """An id that half of all rows share is parted by its texts; each row still has its own next one."""
    monkeypatch.setattr(winnow, "RANGE_ROWS", 7)
    rows = [(50 if i % 2 else i, f"{i:03d} is the number of this one text of many {i}") for i in range(200)]
    got = winnow.beside_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    shas = {hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest(): (t, u) for _, t in rows for _, u in rows}
    pairs = [(shas[r.edited_sha256][0], shas[r.edited_sha256][1]) for r in got]
    assert len(got) == len(rows) and len({t for t, _ in pairs}) == 200 and len({u for _, u in pairs}) == 200
    after = {t: u for t, u in pairs}
    plain = sorted((i, t) for i, t in rows if i != 50)
    assert all(after[t] == u for (_, u), (i, t) in zip(plain, plain[1:], strict=False) if not (i > 50 > _))


def test_winnowing_after_a_shift(spark):
    """What is put before a long run without spaces leaves most of its grams."""
    rng = random.Random(15)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(4000))
    got = spark.createDataFrame([(1, run), (2, "zz" + run)], "doc_id int, text string").select(winnow.hashes(winnow.chosen(F.col("text"))).alias("h")).collect()
    a, b = set(got[0].h), set(got[1].h)
    assert len(a & b) > 0.9 * len(a | b)


def test_winnowing_guarantee(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    shared = rng.sample(words, winnow.WINDOW + winnow.GRAM - 1)
    a, b = (" ".join([*rng.sample(words, 40), *shared, *rng.sample(words, 40)]) for _ in range(2))
    rows = winnow.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id int, text string")).collect()
    assert {r.hash for r in rows if r.doc_id == 1} & {r.hash for r in rows if r.doc_id == 2}


def test_html(spark):
    menu = "<nav><a href=x>Home</a></nav><div class='ad'>Buy {}</div>"
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body>" + menu + "<article><h1>Head {}</h1><p><b>One &amp; two {}<br>x<p>a<i>b</i>c</article><footer>&copy; h</footer></body>"
    rows = [(i, f"http://h{i % 3}.com/{i}", page.format(i % 2, chr(97 + i), chr(97 + i))) for i in range(12)] + [(50, None, None), (51, "http://h0.com/", "")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert len(got) == 14 and got[3].text == "Head d One & two d x abc" and got[3].n_chars == len(got[3].text)
    assert got[50].text == got[51].text == ""


@pytest.mark.parametrize("wrap", ["<form id=aspnetForm>{}</form>", "<div class='has-sidebar'>{}</div>", "<div class='content-sidebar'><div class='search-results'>{}</div></div>"])
def test_html_wrappers(spark, wrap):
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(12):
        text = [" ".join(f"w{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}{rng.choice('qrstuvw')}" for _ in range(60)) for _ in range(2)]
        body = f"<nav><a>Menu {text[1][:9]}</a></nav><div class=text><p>{text[0]}</p><div class={'columns' if i % 2 else 'side-by-side'}>{text[1]}</div></div><div class=sidebar>Ad {text[0][:9]}</div><footer>f {text[0][9:17]}</footer>"
        inner = body if i % 2 else body.replace("<div class=text>", "<main>").replace("</div></div><div", "</div></main><div")
        rows.append((i, f"http://h{i % 2}.com/{i}", f"<html><body>{wrap.format(inner)}</body></html>"))
        want[i] = text
    for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect():
        assert r.text == " ".join(want[r.page_id])


@pytest.mark.parametrize("copies, single", [(100, 50), (200, 6)])
def test_html_copies_leave_unique_articles(spark, copies, single):
    """One article under differing menus, on most of a host's pages, does not cut the others' articles."""
    rng, rows, want = random.Random(9), [], {}
    for i in range(copies + single):
        words = " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)) if i >= copies else "the one copied article"
        menu = "".join(chr(97 + int(c)) for c in str(i))
        rows.append((i, f"http://h.com/{i}", f"<html><body><nav>Menu {menu}</nav><div class=text>{words}</div><div class=foot>All rights</div></body></html>"))
        want[i] = words
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[i] == want[i] for i in range(copies, copies + single))
    assert single < 10 or all(got[i] == want[i] for i in range(copies))


def styled_pages(rng, pages, names):
    """Pages of three hosts whose menus, adverts and footers come from stocks, and what their articles hold."""
    def text(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))

    words, adverts = [text(1) for _ in range(30)], [text(8) for _ in range(12)]
    rows, want = [], {}
    for i in range(pages):
        own = [text(20) for _ in range(rng.randint(1, 4))]
        parts = {"menu": "".join(f"<p>{rng.choice(words)}" for _ in range(5)), "advert": rng.choice(adverts), "body": "".join(f"<p>{t}</p>" for t in own), "foot": "All rights " + rng.choice(adverts)}
        rows.append((i, f"http://h{i % 3}.com/{i}", "<html><body>" + "".join(f"<div class='{names[k]}'>{v}</div>" for k, v in parts.items()) + "</body></html>"))
        want[i] = " ".join(own)
    return rows, want


def test_html_trees_decide_without_names(spark):
    """Class names that mean nothing: menus, adverts and footers go by the tree alone, articles stay."""
    rows, want = styled_pages(random.Random(3), 240, {"menu": "qx", "advert": "zw", "body": "vk", "foot": "jy"})
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
    tree, _ = html_text.importance(html_text.observations(pages))
    said = html_text.verdicts(tree).collect()
    changed = [r for r in said if (r.odds >= 0) != (r.prior >= 0)]
    print(f"the tree changes the verdict of {len(changed)} of {len(said)} nodes")
    assert len(changed) == 9


def test_html_trees_overrule_names(spark):
    """A wrapper named like a sidebar that holds the host's text stays; a repeated block in an article goes."""
    rows, want = styled_pages(random.Random(4), 120, {"menu": "menu", "advert": "zw", "body": "sidebar", "foot": "footer"})
    rows = [(i, u, h.replace("</body>", "<article><div>Share this page</div></article></body>")) for i, u, h in rows]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == want


def test_html_joined_way_is_the_same(spark, monkeypatch):
    rows, want = styled_pages(random.Random(5), 90, {"menu": "qx", "advert": "zw", "body": "vk", "foot": "jy"})
    rows += [(200, None, None), (201, "x", ""), (5, *rows[5][1:]), (5, *rows[5][1:])]
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(900))
    rows.append((300, "http://h0.com/x", f"<html><body><div class='zw'>{long}</div></body></html>"))
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id int, url string, html string, host int, text string")
    one = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html_text.extract(pages).collect()), key=str) == one and len(one) == len(rows)
    assert {r[0]: r[2] for r in one}[300] == " ".join(long.split()) and all(r[2] == want[r[0]] for r in one if r[0] in want)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for s in ("<" + "a" * 1_000_000, "<a " * 300_000, '<a "' * 250_000, "<div>" * 200_000, "</p>" * 250_000 + "<div>" * 999, '<a ">" ' * 150_000, "<!--" * 250_000, "<" * 1_000_000, "<p class='" + "x " * 400_000 + "'>t"):
        html_text.Page(s)
    assert time.time() - began < 30
    assert [t for _, t in html_text.Page("a <é b < c <3 <p title='x>y'>d</p> <a href=\"u>e").blocks][:2] == ["a <é b < c <3", "d"]


def brute_segments(s):
    best = max(((sum(s[i:j]), -(i - j), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,), key=lambda x: (x[0], -x[1] if len(x) > 1 else 0))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return brute_segments(s[:i]) + [s[i:j]] + brute_segments(s[j:])


def test_segments():
    rng = random.Random(6)
    for _ in range(300):
        s = [rng.choice([-3.01, -2.07, -1.13, 1.31, 2.17, 0.71]) + rng.random() / 1000 for _ in range(rng.randint(0, 12))]
        got = toxicity.segments(np.array(s))
        assert [round(x, 6) for *_, x in got] == [round(sum(x), 6) for x in brute_segments(s)]


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SMALL.replace("0.001", "0.1"), "documents"), table(spark, SMALL.replace("0.001", "0.1"), "labels")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    predicted, true = {r.doc_id for r in rows if r.score >= 0.5}, {r.doc_id for r in rows if r.toxic == 1}
    assert len(predicted & true) >= 0.8 * len(true) and len(predicted & true) >= 0.85 * len(predicted)
    odd = toxicity.score(odd_docs(spark), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) + 4 and all(0 <= r[1] <= 1 for r in odd)
    assert toxicity.passages(docs.join(labels.where("toxic = 1"), "doc_id"), model).limit(1).count() == 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text, kind):
    for m in re.finditer(PATTERNS[kind], text):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
            yield m.span()


def test_pii_equals_patterns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 45))) for chars in ("0123456789.+- @a()", "12.", "4111 -", "ab.@-1") for _ in range(3000)]
    for t in [*texts, "4111 1111 1111 1111", "+1 (886) 555-9674", "a@b@c.de.", "1.2.3.4.5.6.7.256"]:
        found = pii.spans(t)
        assert all(found[k] == list(brute_pii(t, k)) for k in pii.KINDS), t
    assert pii.spans("IBAN: GB82 WEST 1234 5698 7654 32 x")["iban"] and not pii.spans(None)["email"]
    docs = spark.createDataFrame([(1, "mail a.b@c.de or 10.0.0.1", 3), (2, None, 0)], "doc_id int, text string, n_chars bigint")
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or [IP]", 20), (2, None, 0)]
    assert pii.find(docs).count() == 2


def test_pii_cues_are_words():
    for clean in ("classname99999x", "passnumber12345", "the assn 1234567", "BASSNOTE1234567", "amounts: 123456", "hotel:5551234567"):
        assert not any(v for v in pii.spans(clean).values()), clean
    assert pii.spans("my ssn 123-45-6789.")["account"] == [(7, 18)]
    assert pii.spans("https://" + "u" * 5000 + ":pw@h/x")["userinfo"] == [(8, 5011)]
    assert pii.spans("mailto:jürgen@x.de, tel:(555) 012-3456")["mailbox"] == [(7, 18)]
    assert pii.spans("tel:(555) 012-3456")["number"] == [(4, 18)]


def test_pii_long_texts_and_empty_tables(spark):
    for long in ("@" * 1_000_000, "1." * 500_000, "ssn " * 250_000, "http://" * 150_000, "+1 " * 300_000):
        pii.spans(long)
    docs = spark.createDataFrame([], "doc_id int, text string, email int, spans string")
    assert pii.find(docs).count() == 0 and pii.redacted(docs).columns == docs.columns


def test_toxicity_odd_labels_and_names(spark):
    rows = [(i, "you vile scum" if i % 3 == 0 else f"fair words {i}", "s") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "s"), (101, "", "s"), (3, "you vile scum", "s")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([*((i, int(i % 3 == 0)) for i in range(60)), (1, 2), (2, -1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, docs.columns, "_score")
    assert got.columns == [*docs.columns, "_score"] and got.count() == 63
    assert {r["doc_id"]: r["_score"] for r in got.collect()}[3] > 0.5
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0)), ["doc_id"]).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0)), ["doc_id"]).count() == 63


def test_nearest_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in nearest.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hit >= 0.9 * 20 * len(got)
    assert nearest.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert nearest.search(df.where("vec_id in (0, 1, 2)"), lambda i: i % 20 == 0).count() == 2


def test_mixing_meets_targets(spark):
    docs = table(spark, SMALL.replace("0.001", "0.01"), "documents")
    labelled = mixing.quality_domains(table(spark, SMALL.replace("0.001", "0.01"), "labels"))
    rows = mixing.rates(docs, labelled, {"high": 0.95, "low": 0.05}).collect()
    n = sum(r.n_tokens for r in rows)
    shares = [sum(r.rate * r.posterior[i] * r.n_tokens for r in rows) / n for i in (0, 1)]
    assert abs(shares[0] - 0.95) < 0.01 and abs(shares[1] - 0.05) < 0.01 and min(r.rate for r in rows) >= 0
    assert max(r.residual for r in rows) < 0.01
    mixed = mixing.mix(docs, labelled, {"high": 0.95, "low": 0.05})
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.rates(docs.limit(0), labelled, {"high": 1.0, "low": 1.0}).count() == 0


def test_mixing_learns_from_labels(spark):
    """Accuracy on labelled rows that the model has not seen, and on a task that only the words tell."""
    docs = table(spark, SMALL.replace("0.001", "0.1"), "documents")
    labelled = mixing.quality_domains(table(spark, SMALL.replace("0.001", "0.1"), "labels")).withColumn("part", F.crc32(F.col("doc_id").cast("string")) % 4).persist()
    model = mixing.fit_classifier(docs, labelled.where("part > 0"), ["high", "low"])
    held = docs.join(labelled.where("part = 0"), "doc_id").select("domain", mixing.posteriors(F.col("text"), model, ["high", "low"]).alias("p")).collect()
    right = sum((r.p[0] > 0.5) == (r.domain == "high") for r in held)
    print(f"held-out accuracy {right / len(held):.3f} of {len(held)}")
    assert right >= 0.9 * len(held)
    rng, kinds = random.Random(3), {"a": "tree leaf root bark", "b": "wave salt tide shore", "c": "star moon comet orbit"}
    rows = [(i, " ".join(rng.choice((kinds["abc"[i % 3]] + " the of and in").split()) for _ in range(30)), "abc"[i % 3]) for i in range(600)]
    own = spark.createDataFrame(rows, "doc_id int, text string, domain string")
    got = mixing.rates(own, own.where("doc_id < 400").select("doc_id", "domain"), {"a": 0.6, "b": 0.3, "c": 0.1}).collect()
    assert sum(max(range(3), key=lambda k: r.posterior[k]) == r.doc_id % 3 for r in got) >= 590
    shares = [sum(r.rate * r.posterior[k] * r.n_tokens for r in got) / sum(r.n_tokens for r in got) for k in range(3)]
    assert max(abs(x - y) for x, y in zip(shares, (0.6, 0.3, 0.1), strict=True)) < 0.01


def plain_rates(cells, n, targets, steps=20_000):
    """Least squares with the same pull by plain projected gradient, for comparison."""
    rates, p = np.ones(len(n)), cells / mixing.GRID
    for _ in range(steps):
        residual = (rates * n) @ p / n.sum() - targets
        rates = np.maximum(0, rates - 0.5 * (p @ residual + mixing.PULL * (rates - 1)))
    return rates


def test_mixing_rates_equal_plain_solver(spark):
    rng = np.random.default_rng(2)
    first = rng.integers(0, mixing.GRID + 1, 40)
    rows = [(i, int(n), [int(a), int(mixing.GRID - a)], [float(a / mixing.GRID), float(1 - a / mixing.GRID)]) for i, (a, n) in enumerate(zip(first, rng.integers(1, 1000, 40), strict=True))]
    found = mixing.fit_rates(spark.createDataFrame(rows, "i int, n bigint, cell array<int>, posterior array<double>"), [0.8, 0.2]).collect()
    cells = sorted({tuple(r[2]) for r in rows})
    n = np.array([sum(r[1] for r in rows if tuple(r[2]) == c) for c in cells], dtype=float)
    want = plain_rates(np.array(cells, dtype=float), n, np.array([0.8, 0.2]))
    got = {tuple(r.cell): r.rate for r in found}
    assert max(abs(got[c] - w) for c, w in zip(cells, want, strict=True)) < 0.01 and found[0].residual < 0.01


def test_mixing_steps_are_one_job_and_equal_a_job_each(spark, monkeypatch):
    rows = [(i, i % 37 + 10, [i * 40, mixing.GRID - i * 40], [i * 40 / mixing.GRID, 1 - i * 40 / mixing.GRID]) for i in range(6)]
    scored, found = spark.createDataFrame(rows, "i int, n bigint, cell array<int>, posterior array<double>"), []
    for few in (mixing.FEW_CELLS, 0):
        monkeypatch.setattr(mixing, "FEW_CELLS", few)
        spark.sparkContext.setJobGroup(f"fit-{few}", "")
        found.append({tuple(r["cell"]): (r["rate"], r["residual"]) for r in mixing.fit_rates(scored, [0.4, 0.6]).collect()})
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{few}"))
        assert few == 0 or jobs <= 10  # a job or two for each step before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0].keys() == found[1].keys() and len(found[0]) == 6
    assert all(found[0][c] == pytest.approx(found[1][c], abs=1e-9) for c in found[0])


def test_mixing_odd_rows_and_names(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x", 2.0), (1, "a b", 1, "x", 2.0), (2, None, 1, "x", 0.0), (3, "", 1, "x", 0.0), (None, "c", 1, "x", 0.0)], "doc_id bigint, text string, copies int, row string, rate double")
    labels = spark.createDataFrame([(1, 1), (2, 5), (9, 0), (None, 1)], "doc_id bigint, quality int")
    weights = {"high": 0.5, "low": 0.5}
    got = mixing.rates(docs, mixing.quality_domains(labels), weights).collect()
    assert len(got) == 5 and all(r.rate >= 0 for r in got)
    mixed = mixing.mix(docs, mixing.quality_domains(labels), weights)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0), mixing.quality_domains(labels.limit(0)), weights).count() == 0


def test_url_join_equals_broadcast(spark, monkeypatch):
    rules = {"net/": "block", "org/": "allow"}
    rng = random.Random(6)
    urls = [(i, f"http://{rng.choice(['a', 'bb', 'c.d'])}.{rng.choice(['net', 'org', 'com'])}/{'xyz'[i % 3] * (i % 7)}?q={i}", 1) for i in range(120)] + [(500, None, 1), (501, "", 1), (3, "http://a.net/", 1), (3, "http://a.net/", 1)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string, llr int")
    one = sorted((tuple(r[:5]), round(r.llr, 9)) for r in url_filter.judge(pages, rules).fillna("-").collect())
    monkeypatch.setattr(url_filter, "MODEL_ROWS", 0)
    assert sorted((tuple(r[:5]), round(r.llr, 9)) for r in url_filter.judge(pages, rules).fillna("-").collect()) == one and len(one) == len(urls)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    monkeypatch.setattr(url_filter, "BATCH", 7)
    assert sorted((tuple(r[:5]), round(r.llr, 9)) for r in url_filter.judge(pages.repartition(5), rules).fillna("-").collect()) == one


def test_url_verdicts_equal_a_plain_version(spark):
    """Border and verdicts of the whole query against counts, likelihoods and a border worked out in plain Python."""
    rng = random.Random(9)
    urls = [f"http://{rng.choice(['a', 'shop', 'c.d'])}.{rng.choice(['net', 'org', 'info'])}/{''.join(rng.choice('abxyz/-') for _ in range(rng.randrange(12)))}" for _ in range(150)]
    path = common.scratch_path(spark, "op3")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    pages.write.parquet(f"{path}/pages.parquet")
    held = {r[0]: r[1] for r in pages.select("url", F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()}
    got = {r.page_id: r for r in entries.op3_url_filter(spark, path).collect()}
    label = {u: {"net/": 1, "org/fr/": 0}.get(got[i]["rule"]) for i, u in enumerate(urls)}
    assert all((got[i]["rule"] == "net/") == u.split("/")[2].endswith(".net") for i, u in enumerate(urls))
    counts = [{}, {}]
    for u in urls:
        if label[u] is not None and not held[u]:
            raw = b"\x02" * 4 + u.encode() + b"\x03"
            for at in range(4, len(raw)):
                for k in range(5):
                    for key in ((k, raw[at - k : at], None), (k, raw[at - k : at], raw[at])):
                        counts[label[u]][key] = counts[label[u]].get(key, 0) + 1

    def ratio(u):
        raw, total = b"\x02" * 4 + u.encode() + b"\x03", 0.0
        for at in range(4, len(raw)):
            p = [1 / 256, 1 / 256]
            for k in range(5):
                for x in (0, 1):
                    c, o = (counts[x].get((k, raw[at - k : at], s), 0) for s in (None, raw[at]))
                    p[x] = (o + url_filter.STRENGTH * p[x]) / (c + url_filter.STRENGTH)
            total += np.log(p[1]) - np.log(p[0])
        return total / (len(raw) - 4)

    scores = {u: ratio(u) for u in urls}
    assert all(abs(got[i]["llr"] - scores[u]) < 1e-9 for i, u in enumerate(urls))
    trial = [(scores[u], label[u]) for u in urls if label[u] is not None and held[u]]
    border = 0.0
    if {x for _, x in trial} == {0, 1}:
        edges = [i * 2 * url_filter.SPAN / url_filter.BINS - url_filter.SPAN for i in range(url_filter.BINS + 1)]
        gains = [sum(s < e for s, x in trial if x == 0) / sum(x == 0 for _, x in trial) + sum(s >= e for s, x in trial if x == 1) / sum(x == 1 for _, x in trial) for e in edges]
        best = [e for e, g in zip(edges, gains, strict=True) if g >= max(gains) - 1e-12]
        border = best[len(best) // 2]
    for i, u in enumerate(urls):
        want = {1: "block", 0: "allow"}.get(label[u], "block" if scores[u] > border else "allow")
        assert got[i]["verdict"] == want or label[u] is None and abs(scores[u] - border) < 2 * url_filter.SPAN / url_filter.BINS


def test_nearest_finds_all_when_asked_to(spark):
    """With a recall of 1 every leaf is visited: results are those of brute force."""
    x = np.random.default_rng(5).normal(size=(700, 12)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = nearest.search(rows, lambda i: i % 50 == 0, k=5, recall=1.0).collect()
    score = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(score, -np.inf)
    want = {(q, r + 1, int(v)) for q in range(0, 700, 50) for r, v in enumerate(np.argsort(-score[q], kind="stable")[:5])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == want


def test_nearest_of_vectors_of_two_lengths(spark, monkeypatch):
    """Shorter vectors count with zeros; blocks of few entries give the same as one."""
    monkeypatch.setattr(nearest, "MEMBERS", 30)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[::3, 4:] = 0
    rows = [(i, v.tolist()[: 4 if i % 3 == 0 else 6], 1) for i, v in enumerate(x)] + [(400, [], 1), (420, [None, 1.0], 1)]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int"), lambda i: i % 20 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert sorted(got) == list(range(0, 300, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(found.values()) & set(np.lexsort((np.arange(300), -s))[:20].tolist()))
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda v: (-s[v], v))
    assert hit >= 0.98 * 20 * len(got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "ids"] and 0 < got.count() < 2 * docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "bpe"]
