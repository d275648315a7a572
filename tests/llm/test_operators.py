"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import gzip
import hashlib
import io
import os
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepfield.llm import common, components, html, mixing, nearcopies, packing, quality, simhash, substring, tokens, topk, urls, warc
from stepfield.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, _uid string, gone int, row string, size string, fp string, copies string, n_words int, `a.b` string, c1 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "r", "s", "f", "c", 2, "d", "e") for i, t, s in rows], DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


def odd_rows():
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60), "a"), (2, None, None), (3, "", "a"), (4, " \t\n ", "b"), (5, prose(2, 60), "a"), (5, prose(2, 60), "a"),
        (6, long, "b"), (7, "x\u00a0y " + long[:400], None), (8, "one", "c"), (9, "<|endoftext|> İÉ'S 12a ﬁ \u0301e Ünï-cödé…!!", "c"),
        (None, prose(3, 50), "a"), (None, prose(3, 50), "a"), (10, prose(4, 30) + " " + prose(5, 45), "a"), (11, prose(6, 20) + "\n" + prose(5, 45) + "  end", "b"),
        (12, " ".join(["again and"] * 40), "a"),
    ]


# --- 1 ---


def brute_top(vectors, k, every):
    out = []
    for q in {i for i, _ in vectors if i % every == 0}:
        s = sorted((-int(np.dot(v, w)), i) for own, v in vectors if own == q for i, w in vectors if i != q)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vs = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(300)]
    vs += [(3, vs[3][1]), (3, [9.0] * 8), (40, [0.9] * 8), (7, [-1.0] * 8)]  # ids that several rows share
    bad = [(801, None), (802, [1.0] * 7 + [None]), (803, [float("nan")] * 8), (804, [float("inf")] * 8), (None, [1.0] * 8), (820, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vs + bad], "vec_id long, embedding array<double>, rank string, query int")
    want = brute_top([(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vs], 20, 20)
    for sizes in ({"block": 128, "query_block": 8, "leaf": 16}, {}):
        assert sorted(tuple(r) for r in topk.top_k(df, k=20, every=20, **sizes).collect()) == want
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where("vec_id = 3")).collect() == []


def test_top_k_of_equal_rows_and_of_large_components(spark):
    """Rows equal in id and vector are dealt to several blocks; scores that could exceed 64 bits raise."""
    rows = [(7, [1.0, 0.5])] * 300 + [(20, [1.0, 1.0]), (3, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=20, block=16).collect())
    assert got == [(20, i, 7, 64 * 64 + 32 * 64) for i in range(1, 6)]
    got = topk.top_k(df, k=400, every=20, block=16).collect()
    assert len(got) == 301 and sum(r.vec_id == 3 for r in got) == 1
    for large in (1e300, 2.0**26):
        with pytest.raises(OverflowError):
            topk.top_k(spark.createDataFrame([(20, [large, 1.0]), (1, [-large, 0.0])], "vec_id long, embedding array<double>"))
    wide = spark.createDataFrame([(20, [2.0**24, 1.0]), (1, [-(2.0**24), 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(wide).collect()] == [(20, 1, 1, -(2**60))]


def test_top_k_of_repeated_ids_equals_the_sql(spark):
    import duckdb

    from stepfield.llm.queries import ORACLE_SQL

    rows = [(1, [0.5, 0.0]), (1, [0.9, 0.0]), (20, [1.0, 0.25]), (20, [-1.0, 0.0]), (40, [0.25, 0.5]), (3, [0.1, 0.1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    duckdb.sql("create or replace table embeddings (vec_id bigint, embedding double[])")
    duckdb.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted(tuple(r) for r in got) == sorted(duckdb.sql(ORACLE_SQL["op1_topk"]).fetchall())
    duckdb.sql("drop table embeddings")


def test_cover_tree_prunes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 300
    points = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)))
    q = points[::10]
    s = topk.Search(q.astype(int), np.arange(0, 4000, 10), points.astype(int), np.arange(4000), 5, leaf=32)
    assert s.compared < 0.5 * len(q) * len(points)
    tree = topk.cover_tree(points, 32)
    stack, seen = [tree], 0
    while stack:
        n = stack.pop()
        assert np.sqrt(((points[n.rows] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        seen += 0 if n.children else len(n.rows)
        stack += n.children
    assert seen == len(points)


# --- 2 ---


def fingerprint(text, n=3):
    import xxhash

    w = ("".join(c.lower() if c.isascii() else c for c in text or "")).encode().split()
    sh = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def linked(ids, fps, most=3):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                label[find(i)] = find(j)
    out = []
    for i in range(len(fps)):
        group = [ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(group, default=None))
    return out


def test_simhash(spark):
    base = prose(9, 400).split()
    rows = odd_rows()
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[random.Random(i).randrange(400)] = f"changed{i}"
        rows.append((100 + i, " ".join(w), "a"))
    d = docs(spark, rows)
    for chunk in (8192, 3):
        got = simhash.near_duplicates(d, chunk=chunk).collect()
        fps = [fingerprint(t) for _, t, _ in rows]
        want = sorted(zip([i for i, _, _ in rows], fps, linked([i for i, _, _ in rows], fps), strict=True), key=str)
        assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(d.limit(0)).collect() == []


def shingles(text, n=5):
    w = ("".join(c.lower() if c.isascii() else c for c in text or "")).encode().split()
    return frozenset(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([b" ".join(w)] if w else [])


def alike_groups(ids, texts, least=0.8):
    """For each row, the smallest id in its group by exact similarity of shingle sets, and the rows of the group."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b)):
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return [min((ids[j] for j in groups[find(i)] if ids[j] is not None), default=None) for i in range(len(ids))]


def test_near_copies(spark):
    rows = odd_rows()
    for g in range(6):  # similarity to the first is about 1 - 10 * edits / 400
        base = prose(900 + g, 400).split()
        for i in range(12):
            w = list(base)
            for e in range((0, 1, 2, 3, 4, 24)[i % 6]):
                w[random.Random(100 * i + e).randrange(400)] = f"changed{g}x{i}x{e}"
            rows.append((1000 - 20 * g - i, " ".join(w), "a"))
    chain = prose(990, 500).split()  # each is like the next, the first not like the last
    rows += [(2000 + i, " ".join(chain[i * 30 : i * 30 + 320]), "b") for i in range(6)]
    d = docs(spark, rows)
    ids, texts = [i for i, _, _ in rows], [t for _, t, _ in rows]
    want = alike_groups(ids, texts)
    for chunk in (2048, 3):
        got = nearcopies.near_copies(d, chunk=chunk).collect()
        assert sorted(map(tuple, got), key=str) == sorted(zip(ids, want, strict=True), key=str)
    kept = nearcopies.keep_one(d)
    assert kept.columns == d.columns
    alone = [i for i, w in zip(ids, want, strict=True) if w is None]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w for w in want if w is not None} | {None for _ in alone}, key=str)
    assert nearcopies.near_copies(d.limit(0)).collect() == [] and nearcopies.keep_one(d.limit(0)).collect() == []


def test_near_copies_at_the_limit(spark):
    """Pairs at a similarity of 0.8 and of 0.798, which an estimate can't tell apart."""
    rows = []
    for g in range(40):
        w = [f"w{g}x{i}" for i in range(1100)]
        k = 100 + g % 2
        rows += [(2 * g, " ".join(w[:904]), "a"), (2 * g + 1, " ".join(w[k : 904 + k]), "a")]
    for chunk in (2048, 1):
        got = dict(map(tuple, nearcopies.near_copies(docs(spark, rows), chunk=chunk).collect()))
        assert got == {i: i - 1 if i % 4 == 1 else i for i, _, _ in rows}


def test_near_copies_by_fingerprints(spark):
    """The search by pivot tables finds close texts by itself: here no two texts share a min-wise key."""
    rows = []
    for g in range(30):  # similarity to the first: 1 for the first two, 0.99 or so, and below 0.8
        base = prose(700 + g, 600).split()
        for i, edits in enumerate((0, 1, 40)):
            w = list(base)
            for e in range(edits):
                w[15 * e + 3] = f"changed{g}x{i}x{e}"
            rows.append((3 * g + i, " ".join(w), "a"))
    texts = Scratch(spark).keep(docs(spark, rows).select(F.col("doc_id").alias("uid"), "doc_id", "text"), "texts")
    sketched = Scratch(spark).keep(nearcopies.sketch_rows(texts, 5), "sketched").withColumn("bands", F.array(*(F.col("uid") * nearcopies.BANDS + b for b in range(nearcopies.BANDS))))
    fp = {r.uid: r.fp for r in sketched.select("uid", "fp").collect()}
    close = {i for i in fp if i % 3 == 1 and ((fp[i] ^ fp[i - 1]) % (1 << 64)).bit_count() <= 3}
    assert len(close) > 20
    roots = nearcopies.linked_texts(sketched.select("uid", "fp", "bands"), sketched.select("uid", "size", "fp", "checks"), texts.select("uid", "text"), Scratch(spark), 5, 0.8, 2048)
    assert {r.node: r.root for r in roots.collect()} == {i: i - 1 for i in close}


def test_sketch():
    """Fingerprints, and an estimate near the exact similarity, from texts of many lengths."""
    texts = [prose(i, n) for i, n in enumerate((1, 3, 5, 6, 40, 300, 2000))] + [None, " "]
    got = nearcopies.sketches(texts, 5)
    assert got["size"].tolist() == [len(shingles(t)) for t in texts]
    for t, f in zip(texts, got["fp"].tolist(), strict=True):
        import xxhash

        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(t)]
        assert f == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    w = prose(77, 600).split()
    pairs = [(" ".join(w[:500]), " ".join(w[k : 500 + k])) for k in (0, 20, 55, 100)]
    for a, b in pairs:
        c = nearcopies.sketches([a, b], 5)["checks"]
        exact = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert abs(((c[0] == c[1]).mean() * 256 - 1) / 255 - exact) < 0.08


def test_every_close_pair_shares_a_bucket():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.integers(0, 64, 3):
            y ^= 1 << int(b)
        a, b = (list(simhash.block_keys(np.array([v], np.uint64), 3)) for v in (x, y))
        assert any(p[1][0] == q[1][0] for p, q in zip(a, b, strict=True))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()))
    u, v = map(np.array, zip(*[e for e in edges if e[0] != e[1]], strict=True))
    node, root = components.forest(u, v)
    assert got == dict(zip(node.tolist(), root.tolist(), strict=True))
    assert all(got[i] == 0 for i in range(1, 41))


# --- 3 ---


def test_warc(spark):
    big = "é" * 50
    rows = [(1, "http://a/\n", "x" * 99), (2, None, "x" * 99), (9, "u", big), (3, "u", big), (3, "u", big), (4, "u", None), (5, "u", ""), (None, "u", big), (7, "u", "<p>" + "long " * 400_000)]
    pages = spark.createDataFrame([(*r, "d", "f") for r in rows], "page_id long, url string, html string, digest string, first string")
    scratch = Scratch(spark)
    folder = scratch.folder("w")
    files = scratch.keep(warc.write_warc(pages, folder), "files")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(files, folder).collect()}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == big and i != 3
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == want
    for f in os.listdir(folder.removeprefix("file://")):
        if f.endswith(".warc.gz"):
            data = gzip.open(f"{folder.removeprefix('file://')}/{f}").read()
            assert data.startswith(b"WARC/1.1\r\n")
    empty = scratch.folder("e")
    assert warc.read_warc(warc.write_warc(pages.limit(0), empty), empty).collect() == []


def test_damaged_warc():
    rec = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    data = gzip.compress(rec) + gzip.compress(rec)
    assert len(list(warc.read_records(io.BytesIO(data)))) == 2
    for bad in (data[:-20], gzip.compress(rec[:-1]), gzip.compress(rec + b"x"), gzip.compress(rec.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")), gzip.compress(b"hello\r\n\r\n")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.read_records(io.BytesIO(bad)))


# --- 4 ---


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens(spark):
    rows = odd_rows()
    scratch = Scratch(spark)
    folder = scratch.folder("t")
    files = tokens.write_token_files(docs(spark, rows), "word_bpe_49k.json", 2, folder, scratch, block=500, step=16)
    got = tokens.read_token_files(files, folder).orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda x: (x is not None, x or 0))
    want = library_ids([t for _, t, _ in rows])
    assert sorted(ids) == sorted(want)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(i) for i in ids])[:-1]]).tolist()
    crc = tokens.read_token_files(files, folder).select("start", F.crc32("ids").alias("c")).orderBy("start").collect()
    assert [r.c for r in crc] == [zlib.crc32(struct.pack(f"<{len(i)}I", *i)) for i in ids]
    empty = scratch.folder("e")
    assert tokens.read_token_files(tokens.write_token_files(docs(spark, rows).limit(0), "word_bpe_49k.json", 2, empty, scratch), empty).collect() == []


def test_encoder_equals_the_library():
    rnd = random.Random(11)
    alphabet = "abcdefgXYZéÀß'’-.,!?*$% \n\t0123ñİσΣς\u0301\u00a0ﬁ<|>京"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(400)] + ["it's I'm we'll <|endoftext|> a<|startoftext|>b"]
    flat, n = tokens.TextEncoder(tokens.vocabulary("word_bpe_49k.json"), most=50).encode(pa.array(texts), 2)
    assert np.split(flat, np.cumsum(n)[:-1])[-1].tolist() == library_ids(texts[-1:])[0]
    assert flat.tolist() == [i for ids in library_ids(texts) for i in ids]


def test_encoder_remembers_what_comes_again():
    enc = tokens.TextEncoder(tokens.vocabulary("word_bpe_49k.json"), most=50)
    rare = ["".join(random.Random(i).choices("abcdefghij\xe9", k=9)) for i in range(90)]
    for at in range(0, 90, 30):
        texts = ["the often seen \xe9t\xe9. 12 " + " ".join(rare[at : at + 30])]
        flat, n = enc.encode(pa.array(texts), 2)
        assert flat.tolist() == library_ids(texts)[0]
    assert {"the", "often", "\xe9t\xe9", "12", "."} <= set(enc.known) and not set(rare[:30]) & set(enc.known)


def test_pairs_of_both_widths():
    rng = np.random.default_rng(8)
    for most in (50, 1 << 31):
        counts = rng.integers(0, 30, 40)
        ids = rng.integers(0, most, counts.sum()).astype(np.uint32)
        want = Counter(zip(ids.tolist(), np.repeat(np.arange(40), counts).tolist(), strict=True))
        term, doc, tf = packing.distinct_pairs(ids, counts)
        assert list(zip(term.tolist(), doc.tolist(), tf.tolist(), strict=True)) == [(*k, n) for k, n in sorted(want.items())]
    assert [len(x) for x in packing.distinct_pairs(np.zeros(0, np.uint32), np.zeros(0, np.int64))] == [0, 0, 0]


def test_memory_of_the_encoder():
    """Of arrays, per id of a text: its ids twice, its words and a little more, not places of all ids."""
    import tracemalloc

    enc = tokens.TextEncoder(tokens.vocabulary("word_bpe_49k.json"))
    text = pa.array(["zqxjvkwzqxjvkw " * 200_000])
    enc.encode(text, 2)
    tracemalloc.start()
    n = len(enc.encode(text, 2)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1_000_000 and peak < 16 * n


def test_workers_forget_the_encoder(spark):
    """Python workers serve all stages: what only the encoder needs does not stay with them while others run."""
    assert tokens.tokenized(docs(spark, [(i, prose(i, 50), "a") for i in range(20)]), "word_bpe_49k.json", 2).count() == 20

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(tokens._encoders)])], ["n"])

    assert {r.n for r in spark.range(0, 8, numPartitions=8).mapInArrow(common.lean(held), "n long").collect()} == {0}


def test_no_second_worker_for_the_filter(spark):
    """Rows that the filter lets through are shuffled before the next Python step, which else takes a worker beside the filter's."""
    cut = substring.cut_repeats(docs(spark, [(1, prose(1, 60), "a"), (2, prose(1, 60), "a"), (3, prose(3, 60), "b")]))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" in plan and "BroadcastHashJoin" not in plan
    ids = spark.range(0, 3000, 3)
    assert common.Sieve(ids, "id").holds(np.arange(0, 3000)).nonzero()[0].tolist() == list(range(0, 3000, 3))


def test_encoder_gives_whole_texts_to_other_vocabularies():
    from tokenizers import Tokenizer

    path, texts = tokens.vocabulary("byte_bpe_50k.json"), ["Hello  there,\n x.", None, "", "éa b|  "]
    enc = tokens.TextEncoder(path)
    assert not enc.apart and tokens.TextEncoder(tokens.vocabulary("word_bpe_49k.json")).apart
    flat, n = enc.encode(pa.array(texts), 2)
    want = [[*e.ids, 2] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want


def test_offsets_of_token_files(spark):
    n = [5, 0, 7, 1, 2, 9, 4]
    files = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "number int, n long").repartition(3)
    got = sorted(tokens._offsets(files, cell=3).collect())
    assert got == [(f"part-{i}.sft", sum(n[:i])) for i in range(len(n))]


def test_whole_keys():
    key = np.repeat(np.arange(6), [1, 5, 2, 9, 1, 4])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 3])], ["key"]) for i in range(0, len(key), 3)]
    parts = [t.column("key").to_pylist() for t in common.whole_keys(iter(batches), ["key"], 4, 1 << 20)]
    assert sum(parts, []) == key.tolist() and len(parts) > 2
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
    assert list(common.whole_keys(iter([]), ["key"], 4, 1 << 20)) == []


@pytest.mark.parametrize("limit", [6, 9, 16])
def test_code(limit):
    rng = np.random.default_rng(3)
    counts = np.zeros(100, np.int64)
    counts[rng.permutation(100)[:60]] = (2.0 ** rng.uniform(0, 30, 60)).astype(int)
    lengths = tokens.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(int)
    assert used.min() > 0 and used.max() <= limit and (2.0**-used).sum() == pytest.approx(1)
    ids = rng.choice(np.flatnonzero(counts), 5000)
    code = tokens.Code(lengths)
    body, bits, marks = code.pack(ids, 64)
    assert bits == lengths[ids].sum() and (code.unpack(body, len(ids), marks, 64) == ids).all()
    if limit == 16:  # as good as an unlimited code where the limit does not bind
        import heapq

        flat = np.where(counts > 0, rng.integers(1, 50, 100), 0)
        heap = [int(c) for c in flat if c]
        heapq.heapify(heap)
        total = 0
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            total += s
            heapq.heappush(heap, s)
        assert (tokens.code_lengths(flat, 16) * flat).sum() == total
    assert tokens.code_lengths(np.array([0, 5]), 4).tolist() == [0, 1]
    with pytest.raises(ValueError):
        tokens.code_lengths(np.ones(5), 2)


def test_damaged_token_file():
    code, out = tokens.Code(tokens.code_lengths(np.ones(8), 8)), io.BytesIO()
    out.write(tokens.MAGIC)
    tokens.write_block(out, code, [1, None], np.array([3, 2]), np.array([1, 2, 3, 4, 5]), 2)
    ((ids, counts, flat),) = tokens.read_blocks(io.BytesIO(out.getvalue()), code)
    assert (ids, counts.tolist(), flat.tolist()) == ([1, None], [3, 2], [1, 2, 3, 4, 5])
    for bad in (b"x" + out.getvalue(), out.getvalue()[:-1]):
        with pytest.raises(ValueError):
            list(tokens.read_blocks(io.BytesIO(bad), code))


# --- 5 ---


def statistics(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    good = [(i, prose(i, 80), "a") for i in range(1000, 1200)]
    junk = [(i, " ".join(x + "$$$ ***" for x in prose(i, 40).split()), "a") for i in range(2000, 2200)]
    rows = odd_rows() + good + junk + [(50, "a line\nb\na line\n \n \nb", "a")]
    d = docs(spark, rows)
    labels = [(i, 1, 0) for i, _, _ in good[:150]] + [(i, 0, 0) for i, _, _ in junk[:150]] + [(None, 1, 0), (1, None, 0), (5, 0, 0), (5, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(d, labels).collect()
    want = Counter((i, *statistics(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, *(r[c] for c in quality.STATISTICS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    held = {r.doc_id: r.kept for r in got}
    assert all(held[i] for i, _, _ in good[150:]) and not any(held[i] for i, _, _ in junk[150:])
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    none = quality.judge(d, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.probability is None for r in none)
    assert quality.judge(d.limit(0), labels).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("held", F.pmod(F.hash("doc_id"), F.lit(3)) == 0)
    model = quality.judge(d, rows.where("not held")).join(rows.where("held"), "doc_id").where("not base_failed")
    right = model.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


# --- 6 ---


def test_mixing(spark):
    rnd = random.Random(8)
    rows = odd_rows() + [(100 + i, prose(i, rnd.randint(1, 300)), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    total, sizes = 0, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + statistics(t)[0]
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, fixed = {}, set()
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in fixed)
        level = rest / sum(weight[s] for s in order if s not in fixed)
        want = {s: 2.0 * sizes[s] if s in fixed else level * weight[s] for s in order}
        over = {s for s in order if want[s] > 2 * sizes[s]}
        if not over:
            break
        fixed |= over
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s in order:  # no document that has a copy left would fit into what is missing
        spare = [r["size"] for r in got if r.source == s and r["size"] and r.copies < 2]
        assert abs(taken[s] - want[s]) <= min(spare, default=0)
    tilt = {}
    for r in got:  # exponentially tilted: log rates are proportional to size within a source, up to the cap
        assert 0 < r.rate <= 2
        if r["size"] and r.rate < 2:
            assert np.log(r.rate) / r["size"] == pytest.approx(tilt.setdefault(r.source, np.log(r.rate) / r["size"]), rel=1e-6, abs=1e-12)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    many = mixing.mixed(d)
    assert many.columns == d.columns and Counter(r.doc_id for r in many.collect()) == Counter({r.doc_id: 0 for r in got}) + sum((Counter({r.doc_id: r.copies}) for r in got), Counter())
    assert mixing.mix(d.limit(0)).collect() == [] and mixing.mixed(d.limit(0)).collect() == []


def test_mixing_goes_past_a_large_document(spark):
    """One document of 9,000 words among small ones: what its copies leave open is filled with small ones."""
    rows = [(1, "big " * 9000, "a")] + [(10 + i, f"w{i} " * 10, "a") for i in range(399)] + [(1000 + i, f"v{i} " * 10, "b") for i in range(400)]
    got = mixing.mix(docs(spark, rows)).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10
    again = mixing.mix(docs(spark, rows).repartition(6)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_of_equal_rows(spark):
    """200 equal rows among 250: their copies are spread over them, so that the source comes near its target."""
    rows = [(7, prose(1, 60), "a")] * 200 + [(100 + i, prose(i, 40 + i), "a") for i in range(50)] + [(1000 + i, prose(5, 200), "b") for i in range(90)]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(5)).collect()))
    assert mixing.mixed(d).count() == sum(r.copies for r in got)


def test_mixing_says_when_it_is_not_solved(spark):
    d = docs(spark, [(i, prose(i, 10 + i), "ab"[i % 2]) for i in range(40)])
    with pytest.raises(RuntimeError):
        mixing.mix(d, weights=(3, 1), rounds=1)


# --- 7 ---


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme.org/": ("", "", None, "allow"), "http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "x://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"), "http://example.org/en/2#a": ("example.org", "/en/2", "org/", "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"), "http://example.org": ("example.org", "", None, "allow"), "http://example.org?/es/": ("example.org", "", None, "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"), "http://com/fr/1": ("com", "/fr/1", "com/fr/", "allow"), "http://a.com/FR/": ("a.com", "/FR/", None, "allow"),
        "http://com:80/fr/": ("com:80", "/fr/", None, "allow"), "http://É.org/x\ny": ("É.org", "/x\ny", "org/", "allow"), "://": ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = urls.judge_urls(df.union(df)).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert urls.judge_urls(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="broadcast"):
        urls.judge_urls(df, most_bytes=10)


def test_trie_takes_the_longest():
    t = urls.Trie([("block", "com/"), ("allow", "a.com/x/"), ("block", "a.com/x/y"), ("allow", "b.a.com"), ("block", "a.com/x/y")])
    assert t.match("z.a.com", "/x/yes") == ("a.com/x/y", "block")
    assert t.match("a.com", "/x/n") == ("a.com/x/", "allow")
    assert t.match("c.com", "/x/") == ("com/", "block")
    assert t.match("b.a.com", "/x/y") == ("b.a.com", "allow")
    assert t.match("net", "/") is None


# --- 8 ---


def test_html_held_out():
    field = html.default_field()
    right = total = 0
    for page, gold in html.labelled_pages(150, seed=12345):
        blocks = html.leaf_blocks(page)
        labels = html.labels_of(blocks, gold)
        assert labels is not None
        right += sum(a == b for a, b in zip(field.decode(html.features(blocks)), labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_html(spark):
    text = "A first sentence of the text, which goes on. And &eacute;&#233; then&nbsp;&amp; ends."
    page = f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>The   title</h1><p>{text}<p>Sec<b>ond</b>\n one here.</p><div class='ad'>Buy now, cheap.</div></article><div id='comments'><p>Reader says hello there.</p></div><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>" + "many words here. " * 20_000), (1, "u", page), (5, "u", "<<>><p</p>&#xD800;<!-- <![x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text == "The title A first sentence of the text, which goes on. And éé then & ends. Second one here."
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "") and got[4].n_chars > 300_000
    assert html.extract(df).count() == 6 and html.extract(df.limit(0)).collect() == []


#: Written by hand, of layouts, names and words that training pages do not have: (page, main text).
HAND = [
    ("<html><body><div class=top><a href=/>Home</a> <a href=/b>Blog</a></div><div class=txt><h1>On rivers</h1><p>Rivers carry water from the hills to the sea. They have done so for ages.</p><p>Some of them are long, and some are short, but all of them flow.</p></div>"
     "<div class=rvw><p>Great read, thanks a lot!</p></div><div class=rvw><p>I do not agree with this at all.</p></div><div class=rvw><p>First!</p></div></body></html>",
     "On rivers Rivers carry water from the hills to the sea. They have done so for ages. Some of them are long, and some are short, but all of them flow."),
    ("<body><div class='entry-content'><p>The museum opened its doors again on Monday after two years of work.</p><p>Visitors queued for an hour, and the mayor gave a short speech.</p></div>"
     "<ol class='commentlist'><li><p>Wonderful news for the town.</p></li><li><p>When will the cafe open?</p></li></ol><div><p>Subscribe to our list</p><form><label>Mail</label><input></form></div></body>",
     "The museum opened its doors again on Monday after two years of work. Visitors queued for an hour, and the mayor gave a short speech."),
    ("<html><body bgcolor=white><table><tr><td><a href=a>Index</a><br><a href=b>Links</a><br><a href=c>Guestbook</a></td><td><p>Welcome to my page about steam engines. I have collected them since I was a boy.</p><p>The oldest one was built before the war and still runs every summer.</p></td></tr><tr><td>(c) 1999 by me</td></tr></table></body></html>",
     "Welcome to my page about steam engines. I have collected them since I was a boy. The oldest one was built before the war and still runs every summer."),
    ("<body><noscript>Please turn on JavaScript to see this page.</noscript><div class='cmp'><p>We use cookies.</p><button>Accept</button></div><article><h2>Bread</h2><p>Flour, water and salt are all that a good loaf needs. Time does the rest.</p></article><form><textarea>Write here what you think.</textarea></form></body>",
     "Bread Flour, water and salt are all that a good loaf needs. Time does the rest."),
    ("<body><div id=w><div id=l><ul><li><a href=1>News</a><li><a href=2>Sport</a><li><a href=3>Arts</a></ul></div><div id=m><p>The council met on Tuesday to talk about the new bridge, which is late.</p><p>It will cost twice what was planned, the engineer said.</p><ul><li>The work began in spring.</li><li>It should end next year.</li></ul></div><div id=r><p><a href=x>Ten tips for your garden</a></p><p><a href=y>The best soups</a></p></div></div><div id=f>All rights reserved.</div></body>",
     "The council met on Tuesday to talk about the new bridge, which is late. It will cost twice what was planned, the engineer said. The work began in spring. It should end next year."),
    ("<body><center><a href=/>main</a> | <a href=/faq>faq</a></center><p>This is a plain page without any parts. It only has a few paragraphs of text.</p><p>Here is the second of them, which is a little longer than the first one was.</p><hr><a href=mailto:x>write to me</a></body>",
     "This is a plain page without any parts. It only has a few paragraphs of text. Here is the second of them, which is a little longer than the first one was."),
]


def test_html_of_other_layouts():
    """Over nine words in ten of hand-written pages are right, and the main text is found whole in most."""
    field = html.default_field()
    right = total = whole = 0
    for page, want in HAND:
        got = html.main_text(page, field)
        for b in html.leaf_blocks(page):
            total += 1
            right += (b.text in got) == (b.text in want)
        whole += got == want
    assert right / total > 0.9 and whole >= len(HAND) - 1


def test_html_of_deep_pages():
    """Time grows with a page's length, not with its depth."""
    import time

    field = html.default_field()
    for page in ("<div>" * 100_000 + "deep", "<div>a " * 100_000, "<b>" * 50_000 + "</i>x" * 50_000, "".join(f"<div class=n{i}>a" for i in range(50_000))):
        began = time.time()
        html.main_text(page, field)
        assert time.time() - began < 30


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><![foo[x]]><p>b</p>", "a b"), ("<p>a</p><![if IE]><p>b<![endif]></p>", "a b"), ("<p>a<!-- b", "a"), ("<p>a<!-->b<!--->c", "abc"), ("<p>a<!-- x --!>b", "ab"),
        ("<!DOCTYPE html [<!ELEMENT a>]><p>a", "a"), ("<!DOCTYPE html [ x><p>a", "a"), ("<p>a<b x='1>c", "a"), ("<p>a<b", "a"), ("<p>1 < 2 <3 & 4</p>", "1 < 2 <3 & 4"), ("<p>a</><b>c", "ac"),
        ("<p>a</ x>b<?php echo '>'?>c", "ab'?>c"), ("<p>&#x41;&#0000000000000000066;&#" + "9" * 9000 + ";&#xD800;", "AB\ufffd\ufffd"), ("<p>a<", "a<"), ("<p>a</", "a"), ("<script>x</script >a", "a"),
        ("<p>a<script>b", "a"), ("<title>x <b> y</title>z", "x <b> y z"), ("<p>x<![CDATA[ <p>no ]]>y", "xy"), ("<p =a ==b / c = 'd' e=f/>g", "g"), ("<p>a<!x", "a"),
    ],
)
def test_html_of_broken_markup(page, text):
    assert " ".join(b.text for b in html.leaf_blocks(page)) == text


def test_html_never_fails():
    rnd = random.Random(12)
    pieces = ["<", ">", "</", "/>", "<!", "<!--", "-->", "--!>", "<![", "]]>", "[", "]", "<?", "?>", "&", "&#", "&#x", ";", "99", "'", '"', "=", " ", "\n", "\x00", "é", "a", "p", "div", "script", "style", "title", "DOCTYPE", "CDATA[", "if", "class=", "<a ", "<p>", "</p>", "<script>", "</script", "\ud800"]
    field = html.default_field()
    for _ in range(10_000):
        html.main_text("".join(rnd.choices(pieces, k=rnd.randint(1, 40))), field)


def test_html_of_unclosed_markup():
    """Time grows with a page's length, whatever is never closed."""
    import time

    field = html.default_field()
    for piece in ("<a ", "<!--", "<![", "<!DOCTYPE [", "<a b='", "<script>", "<title>", "</", "<?", "&#", "&#0", "<a b=\"'", "</a ", "<![CDATA[", "<p>.'", "<a/", "< ", "--!", "<!DOCTYPE a[b]"):
        page = piece * (600_000 // len(piece))
        began = time.time()
        html.main_text(page, field)
        assert time.time() - began < 5, piece


def test_html_features_of_whole_values():
    """Names, marks and sentences far into a value or a text."""
    utility = " ".join(f"px-{i}" for i in range(100))
    page = f"<div class='{utility} sidebar'><p>{'word ' * 100}© 2024</p><p>{'word ' * 450}</p></div>"
    first, second = html.features(html.leaf_blocks(page))
    assert "name=sidebar" in first and "name=sidebar" in second
    assert "copyright" in first and "copyright" not in second
    assert "sentences=0" in second


def test_viterbi_is_the_best_path():
    from itertools import product

    f = html.Field({"a": 1.3, "b": -0.7, "c": 0.2}, [[0.5, -0.4], [-0.9, 0.8]], [0.1, -0.2])
    rnd = random.Random(1)
    for _ in range(50):
        rows = [[rnd.choice("abc") for _ in range(2)] for _ in range(6)]
        score = lambda y: f.opening[y[0]] + sum(f.steps[a][b] for a, b in zip(y, y[1:], strict=False)) + sum(f.weights[x] for r, v in zip(rows, y, strict=True) if v for x in r)  # noqa: E731, B023
        assert score(f.decode(rows)) == pytest.approx(max(map(score, product((0, 1), repeat=6))))


# --- 9 ---


def brute_repeats(rows, size=20):
    """By words in order of doc_id, null first, ties as read."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        w = (rows[i][1] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        out[i] = (rows[i][0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return Counter(out.values())


def test_substring(spark):
    passages = [prose(20 + i, n) for i, n in enumerate((19, 20, 21, 60))]
    rows = odd_rows() + [(200 + i, prose(100 + i, 15) + " " + passages[i % 4] + "  " + prose(150 + i, 12) + " " + passages[(i * 3) % 4], "a") for i in range(40)]
    rows += [(300, " ".join(["w"] * 70), "a"), (301, " ".join(["w"] * 25), "a"), (302, " ".join(["p", "q", "r"] * 15), "b")]
    d = docs(spark, rows)
    got = substring.repeats(d, Scratch(spark)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows)
    assert all(sum(g.end - g.first for g in r.gone) == r.n_removed for r in got)
    cut = substring.cut_repeats(d)
    assert cut.columns == d.columns
    assert Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect()) == Counter((r.doc_id, r.kept_sha256) for r in got)
    assert substring.repeats(d.limit(0), Scratch(spark)).collect() == [] and substring.cut_repeats(d.limit(0)).collect() == []


# --- 10 ---


def check_packing(got, rows, window):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or (at < window and at & (at - 1) == 0)
    want = Counter(map(tuple, library_ids([t for _, t, _ in rows])))
    assert sum(r.length for r in got) == sum(len(i) * n for i, n in want.items())
    ids = {i for i, _, _ in rows}
    for i in ids:
        mine = library_ids([t for d, t, _ in rows if d == i])
        assert Counter(x for r in by_doc[i] for x in np.frombuffer(r.ids, "<u4").tolist()) == Counter(x for m in mine for x in m)
        if len(mine) == 1:
            parts = sorted(by_doc[i], key=lambda r: r.start)
            assert [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()] == mine[0]
            assert all(r.doc_tokens == len(mine[0]) for r in parts)


def test_packing(spark):
    rows = odd_rows() + [(400 + i, prose(i, 20 + 7 * i), "a") for i in range(80)]
    d = docs(spark, rows)
    got = packing.pack(d, window=256, shard_tokens=1 << 13).collect()
    check_packing(got, rows, 256)
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(d.repartition(3), window=256, shard_tokens=1 << 13).collect()))
    assert len({r.sequence_id >> 32 for r in got}) > 3
    assert packing.pack(d.limit(0)).collect() == []
    equal = [(1, prose(1, 40), "a")] * 600 + [(2, prose(2, 9000), "a")]
    check_packing(packing.pack(docs(spark, equal), window=256, shard_tokens=1 << 12).collect(), equal, 256)
    check_packing(packing.pack(docs(spark, [(1, None, None)])).collect(), [(1, None, None)], 4096)


def test_bm25_finds_the_related():
    rng = np.random.default_rng(6)
    topics = [np.arange(k * 50, k * 50 + 50) for k in range(8)]
    pieces = [rng.choice(topics[i % 8], 60) for i in range(64)]
    ids, counts = np.concatenate(pieces).astype(np.uint32), np.full(64, 60)
    s = packing.Index(ids, counts).scores(3)
    assert set(np.argsort(-s)[:8] % 8) == {3}
    rows = packing.pack_shard(ids, counts, 240)
    full = [set((rows[rows[:, 3] == q, 0] % 8).tolist()) for q in np.unique(rows[:, 3])]
    assert sum(len(t) == 1 for t in full) >= 12


def test_greedy_windows_by_brute_force():
    """The documents of each window: best first, of those not used yet, for its first document."""
    rng = np.random.default_rng(9)
    pieces = [rng.integers(0, 60, rng.integers(5, 40)) for _ in range(50)]
    ids, counts = np.concatenate(pieces).astype(np.uint32), np.array([len(p) for p in pieces])
    n, mean = len(pieces), counts.mean()
    df = Counter(x for p in pieces for x in set(p.tolist()))

    def score(a, b):
        tf = Counter(pieces[b].tolist())
        return sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * counts[b] / mean)) for t in set(pieces[a].tolist()) if tf[t])

    got, used, window = packing.pack_shard(ids, counts, 100), set(), 100
    for q in np.unique(got[:, 3]).tolist():
        own = got[got[:, 3] == q]
        own = own[np.argsort(own[:, 4])]
        if own[:, 2].sum() < window:
            break  # the rest
        seed = int(own[0, 0])
        assert seed == (min(set(range(n)) - used) if own[0, 1] == 0 else last)
        used.add(seed)
        for d in own[1:, 0].tolist():
            free = [x for x in range(n) if x not in used]
            best = max(score(seed, x) for x in free)
            assert score(seed, d) == pytest.approx(best)
            used.add(d)
        last = int(own[-1, 0])


def test_shards_of_like_documents(spark):
    """Documents of one topic meet more often than by chance."""
    rows = [(i, " ".join(f"{WORDS[i % 8]}{random.Random(i).choice('abc')}{WORDS[(i % 8 + random.Random(j + i).randint(0, 2)) % 24]}" for j in range(120)), "a") for i in range(160)]
    got = packing.pack(docs(spark, rows), window=256, shard_tokens=1 << 13).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    together = [a % 8 == b % 8 for s in shards.values() for a in s for b in s if a < b]
    assert len(shards) > 4 and np.mean(together) > 3 / 8


def test_bm25_of_a_shard_scores_by_the_whole_corpus(spark):
    """As an index of all documents scores them."""
    rows = odd_rows() + [(400 + i, prose(i, 20 + 7 * i), "a") for i in range(40)]
    table = tokens.tokenized(docs(spark, rows), "word_bpe_49k.json", 2).repartition(3)
    corpus = packing.statistics(table)
    got = sorted(library_ids([t for _, t, _ in rows]), key=len)
    flat = lambda some: (np.array([x for g in some for x in g], np.uint32), np.array([len(g) for g in some]))
    df = Counter(x for g in got for x in set(g))
    assert (corpus.docs, corpus.tokens) == (len(rows), sum(map(len, got)))
    assert {i: n for i, n in enumerate(corpus.df.tolist()) if n} == df
    shard = list(range(1, len(got), 3))
    every = packing.Index(*flat(got)).scores(shard[2])[shard]
    assert np.allclose(packing.Index(*flat([got[i] for i in shard]), corpus=corpus).scores(2), every)
    assert packing.statistics(table.limit(0)).docs == 0


# --- Pipeline ---


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark)
    seen = [d]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(scratch.keep(stage(spark, seen[-1], SF), name.replace(" ", "-")))
    for x in seen[1:-1]:
        assert x.dtypes == d.dtypes
    judged = {r.doc_id for r in quality.judge(d, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in seen[1].collect()} == judged
    one = seen[1].collect()
    want = alike_groups([r.doc_id for r in one], [r.text for r in one])
    assert sorted(r.doc_id for r in seen[2].collect()) == sorted(set(want))
    two = [(r.doc_id, r.text, r.source) for r in seen[2].collect()]
    got = Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in seen[3].collect())
    assert got == Counter((i, sha) for i, _, _, sha in brute_repeats(two).elements())
    plan = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert Counter(r.doc_id for r in seen[4].collect()) == Counter({k: v for k, v in plan.items() if v})
    four = [(r.doc_id, r.text) for r in seen[4].collect()]
    assert seen[5].agg(F.sum("length")).first()[0] == sum(len(i) for i in library_ids([t for _, t in four]))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, seen[5].collect()))
