"""The Merkle manifest, window deduplication and product codes, against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes, merkle, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_g", "_pos", "_n", "_node", "_with", "path", "leaf", "root", "_id", "_row", "_text", "_at", "kept", "_runs")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def brute_leaf(d):
    return h(*("-" if d[k] is None else f"{len(str(d[k]).encode())}:{d[k]}" for k in ("doc_id", "source", "lang", "n_chars", "text")))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(all_levels, p):
    """(left, right) for each level."""
    out = []
    for nodes in all_levels[:-1]:
        out.append(("", nodes[p + 1] if p + 1 < len(nodes) else "") if p % 2 == 0 else (nodes[p - 1], ""))
        p //= 2
    return out


def brute_manifest(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d["lang"], []).append(d)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, brute_leaf(d))) for g in names}
    trees = {g: levels([brute_leaf(d) for d in ordered[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names]) if names else []
    out = []
    for k, g in enumerate(names):
        for p, d in enumerate(ordered[g]):
            path = siblings(trees[g], p) + siblings(top, k)
            out.append((d["doc_id"], brute_leaf(d), trees[g][-1][0], top[-1][0], path))
    return out


def manifest_of(spark, rows, schema=DOCS):
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in CLASHING})
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in merkle.manifest(docs).collect()), key=repr)


def documents(n, seed=3):
    rng = random.Random(seed)
    return [(k, f"text {rng.random()}é", rng.choice(["en", "en", "en", "de", None, "é"]), rng.choice(["web", None]), rng.randrange(100)) for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize(("depth", "n"), [(10, 60), (1, 37), (2, 41), (2, 64)])
def test_manifest_is_that_of_plain_trees(spark, monkeypatch, depth, n):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "WIDTH", 2**depth)
    rows = documents(n)
    assert manifest_of(spark, rows) == sorted(brute_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]), key=repr)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", None, None, 0), (1, "", "", "", 0), (1, "", "", "", 0), (1, "x", "", "", None), (2, "w" * 300_000, "zz", "web", 2**63 - 1), (-5, "y", "zz", "web", 1)]
    got = manifest_of(spark, rows)
    assert got == sorted(brute_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]), key=repr)
    assert manifest_of(spark, []) == []
    assert [p for *_, p in manifest_of(spark, rows[5:6])] == [[]]


def test_proofs_fold_to_the_root_and_tell_changes(spark):
    docs = spark.createDataFrame(documents(50), DOCS)
    changed = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    rows = merkle.manifest(docs, also={"other": changed})
    folded = rows.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("same"), merkle.fold(F.col("other"), F.col("path")).alias("not_same"), merkle.proof(F.col("path")).alias("proof"), "path")
    for r in folded.collect():
        assert r["same"] == r["root"] != r["not_same"]
        assert r["proof"] == h(*(s["left"] + s["right"] for s in r["path"]))


def test_wider_runs(spark, monkeypatch):
    for name, value in (("ARITY", 3), ("DEPTH", 2), ("WIDTH", 9)):
        monkeypatch.setattr(merkle, name, value)
    rows = merkle.manifest(spark.createDataFrame([(k, str(k), "en", "a", k) for k in range(40)], DOCS)).orderBy("doc_id")
    nodes = [r["leaf"] for r in rows.collect()]
    while len(nodes) > 1:
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    assert {r["root"] for r in rows.collect()} == {nodes[0]}
    assert rows.filter(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 40


# Window deduplication


def brute_windows(docs, size):
    words = [(i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in docs]
    order = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, order(i)), order(i))
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < order(i) for p in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def windows_of(spark, rows, size=13):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASHING})
    return sorted(map(tuple, windows.remove_windows(docs, size=size).collect()), key=repr)


def passages(n, seed):
    """Documents of shared passages, with changed words, periodic stretches and a very small vocabulary."""
    rng = random.Random(seed)
    common = [[f"w{rng.randrange(9)}" for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    out = []
    for k in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(common)) if rng.random() < 0.7 else [f"v{rng.randrange(400)}" for _ in range(rng.randrange(30))]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            w += part if rng.random() < 0.9 else ["a", "b"] * rng.randrange(60)
        out.append((k, rng.choice([" ", "\n", " \t  "]).join(w)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("size", "bucket", "seed"), [(13, 1 << 14, 1), (13, 8, 2), (3, 40, 3), (1, 4, 4)])
def test_windows_are_those_of_brute_force(spark, monkeypatch, size, bucket, seed):
    monkeypatch.setattr(windows, "BUCKET", bucket)
    rows = passages(80, seed)
    assert windows_of(spark, rows, size) == brute_windows(rows, size)


def test_windows_of_odd_rows(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, None), (2, ""), (3, " \x0b\x0c\r\n\t"), (5, a), (5, a), (5, "x " + a), (4, b), (None, b), (None, b + " more"), (7, "u " + a + "\x1f" + b), (8, "q " * 500), (9, "q " * 700), (0, " ".join(f"é{k}" for k in range(12)))]
    assert windows_of(spark, rows) == brute_windows(rows, 13)
    assert windows_of(spark, []) == []


def test_long_texts_come_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    shared = [f"s{rng.randrange(1000)}" for _ in range(400)]
    rows = [(k, " ".join([f"p{k}-{rng.randrange(99)}" for _ in range(rng.randrange(300))] + shared[rng.randrange(200) :])) for k in range(8)]
    want = brute_windows(rows, 13)
    for part in (7, 64, 1000):
        for _, text in rows:
            words = text.encode().split()
            monkeypatch.setattr(windows, "PART", part)
            seen = {place + k: tuple(own[k : k + 13]) for place, own in windows.pieces(text.encode(), 13) for k in range(len(own) - 12)}
            assert seen == {k: tuple(words[k : k + 13]) for k in range(len(words) - 12)}
    assert windows_of(spark, rows) == want


def test_super_kmers_hold_every_window_once():
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(5)}".encode() for _ in range(rng.randrange(60))] for _ in range(30)] + [[b"x"] * 400]
    words, bounds = [w for t in texts for w in t], np.cumsum([0, *map(len, texts)])
    start, n, bucket = windows.super_kmers(words, bounds, 13, windows.Hashes())
    got = sorted(s + k for s, m in zip(start.tolist(), n.tolist(), strict=True) for k in range(m))
    assert got == [low + k for low, t in zip(bounds.tolist(), texts, strict=False) for k in range(len(t) - 12)]
    of = {}
    for s, m, b in zip(start.tolist(), n.tolist(), bucket.tolist(), strict=True):
        assert m <= windows.LONGEST
        for k in range(m):
            assert of.setdefault(tuple(words[s + k : s + k + 13]), b) == b


# Product codes


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    kept = sorted((i, [int(np.floor(4096 * np.float64(x))) for x in v]) for i, v in vectors)
    d = len(kept[0][1]) // parts

    def cut(v, p):
        return v[p * d : (p + 1) * d]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v in kept:
                of.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    out = []
    for i, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, [k for _, k in found], sum(x for x, _ in found)))
    return out, books


def codes_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(c) for c in ("_x", "_id", "error", "_key", "codes", "_sum")})
    found, books = codes.compress(df, **more)
    return sorted(map(tuple, found.collect()), key=repr), books


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_are_those_of_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 16)) * rng.choice([0.01, 1, 30], (150, 1))
    x[100:] = x[rng.integers(0, 20, 50)].round(1)
    rows = [(int(k), [float(v) for v in x[n]], None if n % 5 == 0 else int(n % 3)) for n, k in enumerate(rng.permutation(150))]
    got, books = codes_of(spark, rows)
    want, want_books = brute_codes([(i, v) for i, v, _ in rows])
    assert books == want_books
    label = {i: y for i, _, y in rows}
    sums = {}
    for i, _, e in want:
        sums[label[i]] = sums.get(label[i], 0) + e
    assert got == sorted(((i, label[i], c, e, sums[label[i]]) for i, c, e in want), key=repr)


def test_pruned_search_is_that_of_all_entries():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, 10**8):
        book, x = rng.integers(-scale, scale + 1, (16, 4)), rng.integers(-scale, scale + 1, (3000, 4))
        book[5], book[9] = book[2], -book[2]
        x[:16] = book
        index, squared = codes.Annulus(book).nearest(x)
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (squared == every.min(1)).all()


def test_codes_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(k, [float(k % 5), -k / 7, 0.0, 1.0], k % 2) for k in range(6)]
    bad = [(-1, None, 1), (-2, [1.0, None, 0.0, 0.0], 1), (-3, [inf, 0.0, 0.0, 0.0], 1), (-4, [nan, 0.0, 0.0, 0.0], 1), (-5, [], 1), (9, [1.0], 1), (-6, [1e300, 0.0, 0.0, 0.0], None)]
    got, books = codes_of(spark, [*good, *bad, good[3]], parts=4)
    want, want_books = brute_codes([(i, v) for i, v, _ in [*good, good[3]]], parts=4)
    assert books == want_books and sorted((i, c, e) for i, _, c, e, _ in got) == sorted(want)
    got, books = codes_of(spark, [(k, [v[0], v[1], v[3]], y) for k, v, y in good], parts=2)
    assert [len(b[0]) for b in books] == [2, 2] and len(got) == 6
    assert codes_of(spark, []) == ([], []) and codes_of(spark, bad[:5]) == ([], [])
    assert codes_of(spark, [(None, [1.0] * 8, None)])[0] == [(None, None, [0] * 8, 0, 0)]
