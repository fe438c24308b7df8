"""Decontamination, repeats, near duplicates, line deduplication and the pipeline, against brute force on small tables."""

import hashlib
import importlib.util
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, embeddings, graph, jaccard, lines, queries, repeats

DATA = "/root/testdata/sf0.001"
TWO = "doc_id long, text string"
CLASHING = "doc_id long, text string, _id int, _row string, n_lines string, kept string, start int, item string"


def frame(spark, rows, schema=TWO):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, got[columns].itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))


# Benchmark decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def close(w, terms, reach, share=0.8):
    return any(len(terms & set(w[k : k + reach])) >= share * len(terms) - 1e-9 for k in range(max(1, len(w) - reach + 1)))


def brute_contamination(docs, items, size=10, near=True):
    wins = {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for i, t in items if (w := words(t))}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, own in wins.items():
            for win in own:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found.add(str(i))
        near_items = {i for i, own in wins.items() if near and any(len(x) == size and close(w, set(x), size + 5) for x in own)}
        out.append((d, len(w), len(hit), len(found), sorted(found), len(near_items)))
    return sorted(out, key=repr)


def test_contamination(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(12)] + ["Ünï", "MiXed", "7"]

    def some(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(1, some(25)), (2, some(3)), (3, "w1"), (4, ""), (5, None), (6, some(10)), (7, "a b c d e f g h i j k"), (8, "... !")]
    docs = [(k, some(rng.randrange(60))) for k in range(40)] + [(100, "x A b, c d E f g h i j k y"), (101, None), (102, ""), (103, items[0][1]), (104, "W1")]
    found = decontaminate.contamination(frame(spark, docs).withColumn("items", F.lit("clash")), frame(spark, items, "item_id long, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["n_near"]) for r in found.collect()), key=repr)
    assert got == brute_contamination(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in found.collect())


def test_contamination_of_empty_tables_and_null_ids(spark):
    items = frame(spark, [(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), items).count() == 0
    assert [r["n_hit"] for r in decontaminate.contamination(frame(spark, [(1, "one two three")]), items.filter("false")).collect()] == [0]
    twice = decontaminate.contamination(frame(spark, [(None, "one two three"), (None, "one two three"), (None, "other")]), items).collect()
    assert sorted(r["n_hit"] for r in twice) == [0, 3, 3]


@pytest.mark.parametrize("seed", range(2))
def test_proximity(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(8, 16)))) for k in range(6)]
    docs = []
    for k in range(60):
        own = words(rng.choice(items)[1])
        rng.shuffle(own)
        for _ in range(rng.randrange(6)):
            own.insert(rng.randrange(len(own)), rng.choice(vocab))
        docs.append((k, " ".join([rng.choice(vocab) for _ in range(rng.randrange(9))] + own)))
    found = decontaminate.contamination(frame(spark, docs).withColumns({c: F.lit("clash") for c in ("_win", "_posts", "_term", "near")}), frame(spark, items, "item_id long, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["n_near"]) for r in found.collect()), key=repr)
    assert got == brute_contamination(docs, items) and sum(r[5] for r in got) > 10


def test_windows_beyond_the_broadcast_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10)
    items = frame(spark, [(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = [(1, "x a b c d e f g h i j k"), (2, "j i h g f e d c b a"), (3, "a b")]
    got = sorted((r["doc_id"], r["n_hit"], r["n_near"]) for r in decontaminate.contamination(frame(spark, docs), items).collect())
    assert got == [(1, 11, 1), (2, 0, 1), (3, 0, 0)]


# Repeated strings


def brute_repeats(rows, size):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [20, 50, 200])
@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, size, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(3 * size))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(parts)[rng.randrange(5) :] for _ in range(rng.randrange(5))) + "".join(rng.choice("xyz") for _ in range(rng.randrange(size)))) for k in range(40)]
    rows += [(90, "a" * (3 * size)), (91, "ab" * size), (92, None), (93, ""), (94, rows[0][1]), (94, rows[0][1]), (None, rows[1][1])]
    got = repeats.remove_repeats(frame(spark, rows).withColumn("kept", F.lit(1)).repartition(5), size=size).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == brute_repeats(rows, size)


def test_periodic_texts_are_a_few_runs(spark):
    rng = random.Random(1)
    period = "".join(rng.choice("abcdefgh") for _ in range(180))
    docs = frame(spark, [(1, "x" * 3_000_000), (2, period * 16_000), (3, "xy" * 500_000)])
    start = time.perf_counter()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (3_000_000, 3_000_000, 1), 2: (2_880_000, 2_880_000, 1), 3: (1_000_000, 1_000_000, 1)}
    assert time.perf_counter() - start < 60


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_in_one_text_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 1000)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(700))
    text = "".join(rng.choice("abcdefgh") for _ in range(2500)) + passage + "".join(rng.choice("stuvw") for _ in range(1800)) + passage + "end"
    r = repeats.remove_repeats(frame(spark, [(1, text)])).first()
    assert (r["n_removed"], r["n_spans"]) == (1400, 2)


def test_phrases_depend_on_their_bytes_alone():
    rng = random.Random(2)
    x = bytes(rng.randrange(256) for _ in range(5000))
    both = x + b"#" * 50 + x
    bounds = np.array([0, len(both)])
    part, trigger, low, high = repeats.parse(both, bounds, 200)
    first = {(a, b) for a, b in zip(low.tolist(), high.tolist()) if 0 < a and b + 200 < len(x)}
    shift = len(x) + 50
    second = {(a - shift, b - shift) for a, b in zip(low.tolist(), high.tolist()) if a > shift and b + 200 < len(both)}
    assert len(first) > 20 and first == second
    covered = [s for a, b in zip(low.tolist(), high.tolist()) for s in range(a, b + 1)]
    assert covered == list(range(len(both) - 199))


# Embeddings


def brute_links(vectors, threshold=0.95):
    ok = {i: np.array(v, float) / max(map(abs, v)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = defaultdict(set)
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                out[i].add(j)
    return out


def reachable(links, nodes):
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in links.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = min(seen)
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(15, 24))
    rows = [(k, (centres[k % 15] + rng.normal(size=24) * rng.uniform(0, 0.4)).tolist()) for k in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None] + [1.0] * 23), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, rows[0][1]), (508, [x * 1e-200 for x in rows[0][1]]), (509, [float("inf")] + [0.0] * 23)]
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_vec", F.lit(1)).repartition(6)).collect()}
    links = brute_links(rows)
    parts = reachable(links, [i for i, _ in rows])
    total = sum(map(len, links.values()))
    assert all(found[i]["n_links"] <= len(links[i]) for i, _ in rows)
    assert sum(r["n_links"] for r in found.values()) >= 0.995 * total > 1000
    assert all(found[i]["component_id"] == parts[i] and found[i]["kept"] == (parts[i] == i) for i, _ in rows)
    assert found[0]["n_links"] == len(links[0]) and found[507]["component_id"] == parts[0] == found[508]["component_id"]


def test_embeddings_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], schema)).collect())
    assert got == [(0, 0, True), (1, 0, True), (2, 1, True), (2, 1, True)]


# Near-duplicate texts


def shingles(t, size=5):
    w = words(t)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        base = [f"t{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own)))
    rows += [(200, rows[0][1].upper()), (201, None), (202, ""), (203, "one two"), (204, "One, two!"), (205, "two one"), (206, "...")]
    found = {r["doc_id"]: r for r in jaccard.near_duplicates(frame(spark, [(*r, 1) for r in rows], TWO + ", _rep int").repartition(5)).collect()}
    sets = {d: shingles(t) for d, t in rows}
    links = {a: {b for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9} for a in sets}
    parts = reachable(links, list(sets))
    for d in sets:
        assert found[d]["n_links"] == len(links[d]), d
        assert found[d]["component_id"] == parts[d] and found[d]["kept"] == (parts[d] == d)


def test_near_duplicates_of_odd_tables(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    got = sorted((r["doc_id"] or 0, r["n_links"], r["kept"]) for r in jaccard.near_duplicates(frame(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")])).collect())
    assert got == [(0, 0, True), (1, 2, True), (1, 2, True), (2, 2, False)]


def test_recall_at_the_threshold_against_brute_force(spark):
    rng = random.Random(11)
    rows, linked = [], set()
    for _ in range(400):  # pairs whose similarity is 0.80 to 0.85
        base = [f"v{rng.randrange(5000)}" for _ in range(100)]
        other = list(base)
        for k in rng.sample(range(10, 80, 10), 2):
            other[k] = "changed"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.85
        linked.add((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    found = {r["doc_id"]: r for r in jaccard.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    hit = sum(found[b]["component_id"] == a and found[a]["n_links"] == 1 for a, b in linked)
    assert hit >= 0.995 * len(linked)


def test_prefixes_are_shortened_by_what_was_found():
    assert jaccard.next_depth({}, 8, 0.8, 0.9999) == jaccard.SHORTEST
    assert jaccard.next_depth({196: 1_000_000}, 8, 0.8, 0.9999) == 8
    many = {162: 1_000, 198: 100_000}
    d = jaccard.next_depth(many, 8, 0.8, 0.9999)
    assert jaccard.SHORTEST < d < 8 and jaccard.next_depth(many, d, 0.8, 0.9999) == d


def test_signatures_share_values_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = jaccard.signatures([np.unique(x[:3600]), np.unique(x[400:])]).view(np.uint8).reshape(2, -1)
    assert abs((a == b).mean() - 0.8) < 0.12


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)]
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = reachable(links, list(links))
    assert got == {n: c for n, c in want.items() if links[n] - {n}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_large_stars(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 20)
    rng = random.Random(7)
    pairs = [(c, rng.randrange(1000)) for c in (3, 500, 999) for _ in range(200)] + [(k, k + 1) for k in range(2000, 2100)]
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in reachable(links, list(links)).items() if links[n] - {n}}


# Lines


def brute_lines(rows, least=40, docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < least or len(holders[key(x)]) < docs or d == max(holders[key(x)])]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(spark):
    rng = random.Random(7)
    pool = [f"Line number {k} of the pool with some more words é" for k in range(6)] + ["short", "", "  " + "padded line that is long enough to count here\t", "x" * 40, "X" * 40, "y" * 39]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for k in range(40)] + [(50, None), (51, ""), (52, "\n\n"), (53, pool[0] + "\r\n" + pool[0])]
    clashing = ["_line", "_row", "_text", "_did", "_drop", "_id", "_key", "_lines", "_salt"]
    got = lines.dedup_lines(frame(spark, rows).withColumns({c: F.lit(c) for c in clashing} | {"n_lines": F.lit("old")}).repartition(4))
    assert got.columns == ["doc_id", "text", *clashing, "n_lines", "n_dropped"]
    assert [tuple(r) for r in got.select(clashing).distinct().collect()] == [tuple(clashing)]
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(rows)


def test_lines_of_odd_tables(spark):
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    line = "a line that is quite long enough to be counted here"
    got = lines.dedup_lines(frame(spark, [(None, line), (1, line), (1, line), (2, line), (3, line), (4, line)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


# Pipeline


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="without the pipeline")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, DATA).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and after
        if name == "line_dedup":
            want = {d: t for d, _, _, t in brute_lines([(d, r["text"]) for d, r in before.items()])}
            assert {d: r["text"] for d, r in after.items()} == want
        if name == "near_duplicates":
            sets = {d: shingles(r["text"]) for d, r in before.items()}
            links = {a: {b for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9} for a in sets}
            parts = reachable(links, list(sets))
            assert set(after) == {d for d in sets if parts[d] == d}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            judged = brute_contamination([(d, r["text"]) for d, r in before.items()], items, near=False)
            assert set(after) == {d for d, _, hit, *_ in judged if not hit}
    packed = p.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(after)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="without the pipeline")
def test_pipeline_on_odd_documents(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, None, None, None, None), (2, "", "en", "web", 0), (2, "", "en", "web", 0), (None, "some words that stand here alone", "en", "web", 5), (3, "w " * 100_000, "en", "web", 200_000)]
    for name, data in (("odd", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{t}.parquet").limit(3).write.parquet(str(d / f"{t}.parquet"))
        assert (p.run(spark, str(d)).count() > 0) == bool(data)


def test_kept_texts_are_hashed(spark):
    r = queries.op10_line_dedup(spark, DATA).orderBy("doc_id").first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())


def test_different_texts_with_one_id_are_judged_apart(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (0, b + " other")]
    got = sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (5, 1, 1, False), (6, 2, 0, False)]
    vectors = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (5, [1.0, 0.1, 0.0]), (0, [0.0, 1.0, 0.1])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 1, True), (5, 1, 1, False)]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="without the pipeline")
def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    import corpus_pipeline as p

    a, b, item = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clashing = {c: F.lit(c) for c in ("_row", "_id", "_key", "_doc", "row", "kept", "_hid", "count", "n_hit")}
    docs = frame(spark, [(1, a), (1, b), (0, b + " more"), (1, a)]).withColumns(clashing)
    found = p.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(tuple(r)[:2] for r in found.collect()) == [(0, b + " more"), (1, a)]
    docs = frame(spark, [(1, a), (1, item), (None, item), (None, a)]).withColumns(clashing)
    found = p.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted((tuple(r)[:2] for r in found.collect()), key=repr) == [(1, a), (None, a)]
    assert found.columns == docs.columns and found.select(*clashing).distinct().count() == 1
