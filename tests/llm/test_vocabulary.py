"""Operators on words of the corpus against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stepfield.llm import divergence, spelling
from stepfield.llm.common import Scratch

SPELLED = "doc_id long, text string, word string, n int, `a.b` string, side string"


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spelled_rows():
    rnd = random.Random(8)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(60)] + ["intern" + "".join(rnd.choice("ab") for _ in range(k)) for k in range(5) for _ in range(6)]
    stems += ["a" * k for k in range(6, 12)] + ["x" * 3000, "x" * 2999 + "y", "Straße×÷", "ÀÉÿabc", "ÀÉÿabd"]
    words = []
    for s in stems:
        words += [s] * rnd.choice([5, 6, 25, 30, 150])
        for _ in range(3):
            i = rnd.randrange(len(s))
            words += [rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abz") + s[i:], s[:i] + rnd.choice("abz") + s[i + 1 :]])] * rnd.choice([4, 5, 7])
    rnd.shuffle(words)
    words = [w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in words]
    rows = [(i, rnd.choice([" ", "1", "-", "\n", "中", "ſ"]).join(words[i::40])) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, " 12 \t"), (None, "aaaaaa bbbbbb aaaaab " * 5), (7, rows[7][1]), (103, "aaaaaa " * 3)]


@pytest.mark.parametrize("most", [1 << 16, 12])
def test_spelling(spark, most):
    rows = spelled_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SPELLED)
    got = sorted(tuple(r) for r in spelling.variants(df, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(rows)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain
    assert spelling.variants(df.limit(0)).collect() == []


def test_near_pairs_of_a_dense_vocabulary():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9))) for _ in range(500)})
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    forward = np.array([w.encode() for w in words])
    got = [(forward[a].tolist(), forward[b].tolist()) for a, b in spelling.near_pairs(forward, np.zeros(len(words), int), None)]
    pairs = [tuple(sorted((x.decode(), y.decode()))) for a, b in got for x, y in zip(a, b, strict=True)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_words_of_no_vocabulary(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.links(none, Scratch(spark)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(none, least_letters=5)


def test_checksums():
    words = pa.array(["a", "", "öß", "x" * 500, "abc"])
    first = np.array([zlib.crc32(p) for p in (b"1:", b"", b"23:", b"9:", b"4:")], np.uint32)
    of = np.array([4, 3, 2, 1, 0])
    assert spelling.crc32_of(first, words, of).tolist() == [zlib.crc32(words[int(w)].as_py().encode(), int(s)) for s, w in zip(first, of, strict=True)]


def brute_divergence(rows, least, top):
    rows = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, count = Counter(), defaultdict(Counter)
        for la, source, words in rows:
            if la == lang:
                docs.update(set(words))
                count[source].update(words)
        kept = [t for t, n in docs.items() if n >= least]
        v = len(kept)
        whole = sum((Counter(c) for c in count.values()), Counter())

        def weight(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v)  # noqa: B023

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in count.items():
            pairs = [(-sum(f(weight(c, t), weight(d, t)) for t in kept), o) for o, d in count.items() if o != s]
            terms = [(-f(weight(c, t), weight(whole, t)), t) for t in kept if c[t] and weight(c, t) > weight(whole, t)]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, r + 1) for r, (value, item) in enumerate(items)]
    return sorted(out)


def test_divergence(spark):
    rnd = random.Random(4)
    vocabulary = ["Der", "das", "été", "naïve", "x1y", "a", "B", "don't", "日本", "zeta", "eta", "theta"]
    rows = [(rnd.choice(["de", "fr", None]), rnd.choice(["s1", "s1", "s1", "s2", "é", "", None]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 12)))) for _ in range(200)]
    rows += [("de", "s9", None), ("de", "s8", "123 !?"), ("xx", "a", "once"), ("xx", "b", ""), ("one", "only", "das " * 3)] + [("one", "only", "das eta")] * 10 + [("de", "s1", "das " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "lang string, source string, text string, term string, n int, value string, v int")
    got = sorted(tuple(r) for r in divergence.divergence(df, least=10, top=3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows, 10, 3)
    assert divergence.divergence(df.limit(0)).collect() == []
