"""The Jaccard join against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stepfield.llm import jaccard

JOINED = "doc_id long, text string, n long, node long, `a.b` string, t1 string, path int"
SPACES = " \t\n\x0b\x0c\r"


def shingles(text):
    words = "".join(c if c not in SPACES else " " for c in text or "").split(" ")
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), own) if x is not None]
        least[find(i)] = min(known, default=None)
    return sorted(((own, len(s), least[find(i)] if s else own) for i, ((own, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rnd, words, k):
    words = list(words)
    for _ in range(k):
        i = rnd.randrange(len(words)) if words else 0
        words[i : i + 1] = rnd.choice([[], [f"e{rnd.randint(0, 999)}"], [*words[i : i + 1], f"e{rnd.randint(0, 999)}"]])
    return words


def alike_rows():
    rnd = random.Random(11)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(40):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 5, 6, 12, 40, 90, 200]))]
        for _ in range(rnd.choice([1, 1, 2, 3, 8])):
            words = edited(rnd, base, rnd.choice([0, 0, 1, 2, 4, 6]))
            if g % 3 == 0:
                at = rnd.randint(0, len(words))
                words[at:at] = passage[: rnd.choice([20, 40, 60])]
            rows.append(" ".join(w.upper() if rnd.random() < 0.05 else w for w in words))
    copies = [f"c{i}" for i in range(80)]
    rows += [" ".join(edited(rnd, copies, rnd.randint(0, 3))) for _ in range(120)]  # a large group of near copies
    chain = [f"k{i}" for i in range(104)]
    rows += [" ".join(chain[i : i + 64 + i % 3]) for i in range(0, 40, 3)]  # each alike to the next, the ends not
    rows = list(enumerate(rows))
    rnd.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, None), (1004, "one two"), (1005, "ONE two"), (5, rows[9][1]), (5, "other text of five words"), (None, rows[3][1]), (None, "alone it is null here"), (None, "alone it is null here"), (1006, rows[0][1]), (1006, rows[0][1])]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_join(spark, chunk):
    rows = alike_rows()
    df = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], JOINED)
    got = sorted((tuple(r) for r in jaccard.join(df, chunk=chunk).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute_join(rows)
    assert jaccard.join(df.limit(0)).collect() == []


def forest_of(pairs, k):
    root = list(range(k))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [min(j for j in range(k) if find(j) == find(i)) for i in range(k)]


@pytest.mark.parametrize("seed", range(40))
def test_bucket_joins_all_that_are_alike(seed):
    rnd = np.random.default_rng(seed)
    sets = []
    for _ in range(rnd.integers(2, 30)):
        base = rnd.choice(200, rnd.integers(1, 40), replace=False) if not sets or rnd.random() < 0.4 else sets[rnd.integers(len(sets))].copy()
        flip = rnd.choice(200, rnd.integers(0, 6), replace=False)
        base = np.setxor1d(base, flip)
        sets.append(np.unique(base) if len(base) else np.array([7]))
    own = rnd.integers(0, 3, len(sets))
    size = np.array([len(s) for s in sets])
    side = np.full(len(sets), 2) if seed % 2 else rnd.integers(0, 2, len(sets))
    got = jaccard.Bucket(np.concatenate(sets), size, size + own, np.arange(len(sets)), side, (4, 5)).links
    want = [(i, j) for i in range(len(sets)) for j in range(i) if (side[i] == 2 or side[i] != side[j]) and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (size[i] + own[i] + size[j] + own[j])]
    assert set(map(frozenset, got)) <= set(map(frozenset, want))
    assert forest_of(got, len(sets)) == forest_of(want, len(sets))


def test_bucket_prunes():
    rnd = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([[10_000], rnd.choice(5000, 60)])) for _ in range(200)]
    size = np.array([len(s) for s in sets])
    b = jaccard.Bucket(np.concatenate(sets), size, size, np.arange(200), np.full(200, 2), (4, 5))
    assert b.links == [] and b.visited < 1000


def test_shingle_sets():
    row, token, n = jaccard.shingle_sets(pa.array(["a b c d e f", None, "", "a b c d", "A B c D e f", "x x x x x x x x"]), 5)
    assert n.tolist() == [2, 0, 0, 1, 2, 1]
    assert token[row == 0].tolist() == token[row == 4].tolist()


def test_join_goes_over_the_sets_again_only_where_that_helps(spark, monkeypatch):
    """A chain of texts, each of which has enough in common with two others together: without its ends one more falls away at each end, and so on."""
    words = [[f"l{i}_{j}" for j in range(4)] + [f"l{i + 1}_{j}" for j in range(4)] + [f"own{i}_{j}" for j in range(2)] for i in range(16)]
    near = [[f"n{j}" for j in range(9)] + [x] for x in "xy"]
    rows = [(i, " ".join(w)) for i, w in enumerate(words + near)]
    calls, reduce = [], jaccard.reduce
    monkeypatch.setattr(jaccard, "reduce", lambda *a: calls.append(1) or reduce(*a))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words=1)
    assert sorted(map(tuple, got.collect())) == [(i, 10, 16 if i == 17 else i) for i in range(18)]
    assert len(calls) <= 2
