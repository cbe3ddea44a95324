"""Each corpus operator against a plain version on small tables with nulls, empty and long texts, ties, repeats, and columns with clashing names."""

import random
import time
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxscribe.llm import embedding_dedup, html_text, licenses, lm, mixing, near_copies, packing, quality, simhash, topk, toxicity
from voxscribe.llm.components import components
from voxscribe.llm.queries import vocabulary_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, u long, node string, row string, digest string, score double, size long, class string, no long, label int"
BENCH = "sun moon star sea tree leaf road city bird fish stone wind rain snow fire lake hill moss reed corn".split()


def sentence(rng, n):
    return " ".join(rng.choice(BENCH) + str(rng.randrange(50)) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    texts = [*base, base[0], base[0], base[1].replace("sun", "SUN"), base[2] + " tail", None, "", "   ", "one", "one two", "a b c", "Licensed under the Apache License, Version 2.0.\n" + base[3], "MIT License", sentence(rng, 30_000)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None, "src"]), len(t or ""), 1, 2, "n", "r", "d", 0.5, 7, "c", 3, 1) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "x y z", *out[0][2:]), (None, None, None, None, None, *out[0][5:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


# --- licences -------------------------------------------------------------------------------------------------------


def plain_scan(doc_id, text):
    known = licenses.known()
    lines = [known.get(licenses.digest_of(x)) for x in (text or "").split("\n")]
    found = [x for x in lines if x]
    return doc_id, licenses.digest_of(text or ""), known.get(licenses.digest_of(text or "")), ",".join(sorted(set(found))) or None, len(found)


def test_licenses_match_plain_version(docs, empty):
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=key)
    assert got == sorted((plain_scan(r[0], r[1]) for r in rows()), key=key)
    assert any(r[3] == "Apache-2.0" for r in got) and any(r[2] == "MIT" for r in got)
    assert licenses.scan(empty).count() == 0


def test_license_texts_in_other_dress(spark):
    text = "Copyright (c) 2020 Some One\n\n" + licenses.TEXTS["MIT"][0].upper().replace("SUBLICENSE", "sub-licence").replace("\n", "\n   ")
    got = licenses.scan(spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["MIT", None]


def test_whole_texts_under_usual_headings(spark):
    mit, bsd = licenses._MIT, licenses._BSD_HEAD + "\n" + licenses._BSD_TAIL
    texts = ["The MIT License (MIT)\n\nCopyright The Some Project Authors\n\n" + mit, "BSD 2-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + bsd]
    want = ["MIT", "BSD-2-Clause"]
    for name, license in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        path = Path("/usr/share/common-licenses") / name
        if path.exists():
            texts.append(path.read_text())
            want.append(license)
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in out] == want


# --- mixing ---------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)
    return out


def test_mix_targets_and_bounds(docs, empty):
    got = mixing.mix(docs).collect()
    words = lambda t: len((t or "").encode().split())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in got) == sorted((r[0] if r[0] is not None else -1, words(r[1])) for r in rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += words(r[1])
    want = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, map(tuple, again)))
    assert mixing.mix(empty).count() == 0


def test_mix_without_words(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_mixed_documents_hold_the_taken_words(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert +want == +got


def plain_seats(weights, house):
    seats = dict.fromkeys(weights, 0)
    for _ in range(house):
        best = min(weights, key=lambda s: (-weights[s] / (2 * seats[s] + 1), s))
        seats[best] += 1
    return seats


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(1)
    parents = {p: {c: rng.randrange(0, 500) for c in range(rng.randrange(1, 9))} for p in range(20)}
    houses = {p: rng.randrange(0, 60) for p in parents}
    t = spark.createDataFrame([(p, c, w, houses[p]) for p, cs in parents.items() for c, w in cs.items()], "p long, c long, w long, h long")
    got = {(r["p"], r["c"]): r["quota"] for r in mixing.apportion(t, ["p"], "c", "w", "h").collect()}
    for p, cs in parents.items():
        want = plain_seats(cs, houses[p]) if sum(cs.values()) else dict.fromkeys(cs, 0)
        assert {c: got[p, c] for c in cs} == want


# --- near-duplicates ------------------------------------------------------------------------------------------------


def unite(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups_match_all_pairs(docs, empty):
    fps = [simhash.fingerprint(r[1]) for r in rows()]
    n = len(fps)
    root = unite(range(n), [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for i, r in enumerate(rows()):
        least[root[i]] = min((x for x in (least.get(root[i]), r[0]) if x is not None), default=None)
    want = sorted(((r[0], f"{fps[i]:016x}", least[root[i]]) for i, r in enumerate(rows())), key=key)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key) == want
    assert simhash.near_duplicates(empty).count() == 0


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def all_pairs_groups(texts):
    """The least place that links of similarity 0.8 reach from each text, by comparing all pairs."""
    sets = [near_copies.shingles(t, 5) for t in texts]
    n = len(texts)
    root = unite(range(n), [(i, j) for i in range(n) for j in range(i) if near_copies.jaccard(sets[i], sets[j]) >= 0.8])
    least = {}
    return [least.setdefault(root[i], i) for i in range(n)]


def test_near_copies_match_all_pairs(spark):
    """Groups of copies with some words changed, chains of copies of copies, short and empty texts, repeats."""
    rng = random.Random(3)
    texts = [None, "", " ", "one", "ONE", "one two three four", "one two three four five", "one two three four five six"]
    for k in range(60):
        words = sentence(rng, rng.choice([8, 40, 150, 600])).split()
        texts += [" ".join(words)] * (1 + k % 2)
        for _ in range(rng.randrange(4)):
            words = edited(rng, words, rng.randrange(1, 1 + len(words) // 40 + 1))
            texts.append(" ".join(words))
    want = all_pairs_groups(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    got = {r["id"]: r["component"] for r in near_copies.groups(rows).collect()}
    assert len(got) == len(texts) and all(want[i] == want[c] for i, c in got.items())  # nothing is joined that shouldn't be
    wrong = sum(got[i] != got[want[i]] for i in got)
    assert wrong <= 0.02 * len(texts)
    assert near_copies.groups(rows.where("false")).count() == 0


def test_near_copies_lose_no_link(spark, monkeypatch):
    """Pairs that are barely similar, and texts that share common lines: the groups are those of all pairs, even where the index finds no candidate."""
    rng = random.Random(11)
    lines = [sentence(rng, 30) for _ in range(3)]
    texts = []
    for k in range(150):
        words = f"{sentence(rng, rng.choice([30, 60, 150]))} {lines[k % 3]}".split()
        size = len(set(zip(*(words[i:] for i in range(5)))))
        texts += [" ".join(words), " ".join(edited(rng, words, size // 45 + k % 2))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    want = all_pairs_groups(texts)
    assert 200 < len(set(want)) < 250
    got = {r["id"]: r["component"] for r in near_copies.groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(near_copies, "candidates", lambda marked: marked.select(F.col("id").alias("u"), F.col("id").alias("v")).where("false"))
    monkeypatch.setattr(near_copies, "common", lambda rows, width: (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)))
    got = {r["id"]: r["component"] for r in near_copies.groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_large_group_of_near_copies(spark):
    """A third of the rows are copies of one text, each edited in another place: one group, and the others stay apart."""
    rng = random.Random(4)
    words = sentence(rng, 120).split()
    texts = [" ".join(edited(rng, words, 1)) for _ in range(1500)] + [sentence(rng, 60) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    got = {r["id"]: r["component"] for r in near_copies.groups(rows).collect()}
    assert {got[i] for i in range(1500)} == {0} and all(got[i] == i for i in range(1500, 2000))


@pytest.mark.parametrize("crowd", [2, 64, 10**6])
def test_prefix_pass_meets_few_pairs_and_loses_none(spark, crowd):
    """A large component and many rows that share most of its shingles but are too far from it: few candidates, and every similar pair of different components is one."""
    rng = random.Random(12)
    words = sentence(rng, 150).split()
    texts = [" ".join(edited(rng, words, rng.randrange(3))) for _ in range(200)] + [" ".join(edited(rng, words, rng.randrange(3, 7))) for _ in range(120)]
    for size in (3, 5, 6, 12, 40, 90, 400):
        for _ in range(6):
            own = sentence(rng, size).split()
            texts += [" ".join(own), " ".join(edited(rng, own, size // 45)), " ".join(own[: size - size // 8]), " ".join(words[: size // 2] + own)]
    texts += ["", None, "one", "one"]
    owns = [0 if i < 200 else i for i in range(len(texts))]
    rows = spark.createDataFrame([*zip(range(len(texts)), owns, texts)], "id long, own long, text string").repartition(3)
    sets = [near_copies.shingles(t, 5) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if owns[i] != owns[j] and sets[i] and near_copies.jaccard(sets[i], sets[j]) >= 0.8}
    got = near_copies.bridges(rows, 5, 0.8, **{} if crowd == 64 else {"crowd": crowd}).collect()
    assert len(got) == len(set(got)) and {(r["u"], r["v"]) for r in got} >= want
    assert len(want) > 50 and len(got) < 3 * len(want)


def test_sketches_of_a_text_do_not_depend_on_its_neighbours():
    texts = [r[1] for r in rows()]
    digests, marks, words = near_copies.Sketcher(5)(texts)
    for i, t in enumerate(texts):
        d, m, w = near_copies.Sketcher(5)([t])
        assert d[0] == digests[i] and m[0] == marks[i] and w[0].tolist() == words[i].tolist()
    bits = np.array([[h >> k & 1 for k in range(64)] for h in lm.mixed(shingle_hashes(texts[0]) + np.uint64(1)).tolist()])
    assert marks[0] == sum(1 << k for k in range(64) if 2 * bits[:, k].sum() > len(bits))


def shingle_hashes(text):
    """The hash of each distinct five-word shingle, one after the other."""
    import xxhash

    words, out = text.encode().lower().split(), set()
    for i in range(len(words) - 4):
        h = 0
        for w in words[i : i + 5]:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w)) % 2**64
        out.add(h)
    return np.unique(lm.mixed(np.array(sorted(out), dtype=np.uint64)))


def test_simhash_links_of_crowded_fingerprints(spark):
    rng = np.random.default_rng(2)
    middle = rng.integers(0, 2**63, 4)
    flips = np.array([[1 << int(b) for b in rng.integers(0, 62, 2)] for _ in range(900)])
    fps = np.unique(middle[rng.integers(0, 4, 900)] ^ flips[:, 0] ^ flips[:, 1])
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    want = unite(fps.tolist(), [(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(np.tril(near, -1)))])
    edges = [(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), leaf_rows=16).collect()]
    assert unite(fps.tolist(), edges) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, cell string, u string, size long, score long"


def vectors():
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((6, 16))
    x = middle[rng.integers(0, 6, 160)] + 0.06 * rng.standard_normal((160, 16))
    out = [(i, v.astype(np.float32).tolist(), int(i % 3) if i % 10 else None, "c", "u", 1, 2) for i, v in enumerate(x)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None] + [1.0] * 15, 1), (505, [float("inf")] * 16, 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1), (None, out[1][1], 1), (550, out[1][1], 1), (550, out[1][1], 1)]
    return out + [(*o, "c", "u", 1, 2) for o in odd]


def taking_part(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


@pytest.mark.parametrize("task_rows", [2048, 8])
def test_embedding_links_match_all_pairs(spark, task_rows):
    data = vectors()
    unit = [np.array(r[1], dtype=np.float64) / np.linalg.norm(np.array(r[1], dtype=np.float64)) if taking_part(r[1]) and any(r[1]) else None for r in data]
    n = len(data)
    pairs = [(i, j) for i in range(n) for j in range(i) if unit[i] is not None and unit[j] is not None and data[i][2] is not None and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    degree, root = Counter(x for p in pairs for x in p), unite(range(n), pairs)
    least = {}
    for i, r in enumerate(data):
        least[root[i]] = min((x for x in (least.get(root[i]), r[0]) if x is not None), default=None)
    want = sorted(((r[0], degree[i], least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(data)), key=key)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, VECTORS), task_rows=task_rows, block_dims=4)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert len(pairs) > 100


def test_embedding_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_top_k_matches_all_scores(spark):
    data = [r for r in vectors() if r[0] != 550]
    whole = {i: np.floor(256 * np.array(r[1], dtype=np.float64)) for i, r in enumerate(data) if r[0] is not None and taking_part(r[1])}
    want = []
    for i, q in whole.items():
        if data[i][0] % 50 == 0:
            scores = sorted((-int(q @ x), data[j][0]) for j, x in whole.items() if data[j][0] != data[i][0] and len(x) == len(q))
            want += [(data[i][0], k + 1, v, -s) for k, (s, v) in enumerate(scores[:5])]
    got = topk.top_k(spark.createDataFrame(data, VECTORS), pivots=4, sample_rows=20, query_rows=2, block_rows=40)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_top_k_ties_and_large_numbers(spark):
    data = [(0, [1.0, 1.0], 1)] + [(i, [2.0, 0.0], 1) for i in (9, 4, 7, 5, 8, 6, 3)] + [(100, [3e38, 3e38], 1)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [100, 3, 4, 5, 6]


def depth_of(tree):
    depth = np.zeros(len(tree.start), dtype=int)
    for node in range(len(tree.start)):
        kids = np.arange(tree.child[node], tree.child[node] + tree.children[node])
        depth[kids] = depth[node] + 1
    return int(depth.max())


def test_cover_tree_covers():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5)) * np.repeat([1.0, 10.0, 0.1], 1000)[:, None]
    tree = topk.CoverTree(x)
    for node, (a, b) in enumerate(zip(tree.start, tree.end)):
        away = np.linalg.norm(x[tree.order[a:b]] - x[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-9
        kids = np.arange(tree.child[node], tree.child[node] + tree.children[node])
        if len(kids):
            assert tree.start[kids[0]] == a and tree.end[kids[-1]] == b and (tree.start[kids[1:]] == tree.end[kids[:-1]]).all()
            assert (tree.radius[kids] <= tree.radius[node] / 2 + 1e-9).all()
            centres = x[tree.centre[kids]]
            between = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.eye(len(kids)) * 1e9
            assert between.min() > tree.radius[node] / 2 * (1 - 1e-9)
    assert sorted(tree.order) == list(range(3000)) and depth_of(tree) >= 5


def brute(queries, query_ids, points, ids, k):
    out = {}
    for i, q in enumerate(queries):
        best = sorted((-float(q @ x), int(j)) for x, j in zip(points, ids) if j != query_ids[i])[:k]
        out[i] = [(-s, j) for s, j in best]
    return out


@pytest.mark.parametrize(("dims", "spread", "most"), [(3, 0.05, 0.25), (64, 0.05, 0.4), (64, 2.0, 3.0)])
def test_dual_search_prunes_and_is_exact(dims, spread, most):
    """Groups of near vectors are pruned as wholes, in 64 dimensions too; vectors that spread evenly aren't, and come out right all the same."""
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((60, dims))
    make = lambda n: np.floor(256 * (middle[rng.integers(0, 60, n)] + spread * rng.standard_normal((n, dims)) / dims**0.5))
    points, queries = make(3000), make(150)
    ids, query_ids = np.arange(3000), np.arange(0, 1500, 10)
    search = topk.DualSearch(points, ids, 5)
    got = {at: list(zip(scores.tolist(), best.tolist())) for at, scores, best in search(queries, query_ids, np.full(150, -np.inf))}
    assert got == brute(queries, query_ids, points, ids, 5)
    assert search.looked <= most * search.all and depth_of(search.x) >= 1


def test_table_vectors_have_a_tree_of_levels():
    """The table's vectors of 64 dimensions: near copies make levels below the first, and the search is exact whatever it prunes."""
    import pyarrow.parquet as pq

    rows = [(i, np.floor(256 * np.array(v, dtype=np.float64))) for i, v in zip(*pq.read_table("/root/testdata/sf0.01/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict().values()) if taking_part(v)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    near = np.floor(x[:40, None] + np.random.default_rng(2).uniform(-2, 2, (1, 20, x.shape[1]))).reshape(-1, x.shape[1])
    points, all_ids = np.concatenate([x, near]), np.concatenate([ids, 10_000 + np.arange(len(near))])
    search = topk.DualSearch(points, all_ids, 5)
    assert depth_of(search.x) >= 2
    got = {at: list(zip(scores.tolist(), best.tolist())) for at, scores, best in search(x[::50], ids[::50], np.full(len(x[::50]), -np.inf))}
    assert got == brute(x[::50], ids[::50], points, all_ids, 5)
    assert search.looked < 0.7 * search.all  # 800 of 1,300 points fall in groups of twenty


def test_null_and_repeated_ids_lose_no_group(spark):
    texts = [sentence(random.Random(i), 60) for i in range(6)]
    docs = spark.createDataFrame([*((None, t) for t in texts[:3]), *((7, t) for t in texts[3:]), (3, texts[0]), (None, texts[1])], "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in near_copies.one_of_each(docs).collect()), key=key)
    assert kept == sorted([(3, texts[0]), (None, texts[1]), (None, texts[2]), *((7, t) for t in texts[3:])], key=key)


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing_round_trip(docs, empty):
    files = vocabulary_files()
    got = packing.pack(docs, **files, with_ids=True).collect()
    seen = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 2048
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seen.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    whole = sorted(tuple([*packing.token_ids(r[1], files["tokenizer"]), 1]) for r in rows())
    parts = {}
    for r in got:
        parts.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(tuple(np.frombuffer(r["ids"], "<u4").tolist()))
    assert sum(r["length"] for r in got) == sum(map(len, whole))
    tokens = Counter(t for p in parts.values() for ids in p for t in ids)
    assert tokens == Counter(t for ids in whole for t in ids)
    full = {d: sorted((s, ids) for (x, _, s), p in parts.items() if x == d for ids in p) for d in (0, 22)}
    assert [t for _, ids in full[22] for t in ids] == [*packing.token_ids(rows()[22][1], files["tokenizer"]), 1]
    assert packing.pack(empty, **files).count() == 0


def test_both_tokenizer_files_agree():
    files = vocabulary_files()
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(32, 127), rng.randrange(0xC0, 0x100), rng.randrange(0x100, 0x3000), 32, 10])) for _ in range(rng.randrange(60)))
        assert packing.token_ids(text, **files) == packing.token_ids(text, files["tokenizer"])


def test_cutting_plan_holds_all_pieces_with_little_waste():
    rng = random.Random(4)
    counts = {b: rng.randrange(1, 60) for b in range(1, 129)}
    plan = packing.plan(counts, 128)
    held = Counter()
    for p, times in plan:
        assert sum(s * k for s, k in p.items()) <= 128
        for s, k in p.items():
            held[s] += k * times
    assert held == counts
    least = sum(s * n for s, n in counts.items()) / 128
    assert sum(times for _, times in plan) <= 1.05 * least + 3
    assert packing.plan({}, 128) == []


def test_best_pattern_is_best():
    rng = np.random.default_rng(1)
    sizes, values = np.array([3, 5, 7, 11]), rng.random(4)
    value, counts = packing.best_pattern(values, sizes, 29)
    every = [(a, b, c, d) for a in range(10) for b in range(6) for c in range(5) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 29]
    assert value == pytest.approx(max(np.dot(values, e) for e in every)) == pytest.approx(values @ counts)


# --- language model -------------------------------------------------------------------------------------------------


def tokens_of(text):
    return (text or "").encode().lower().split() + [lm.END]


def plain_model(texts):
    """Counts of words and bigrams; a text's first token follows an end."""
    ones, twos = Counter(), Counter()
    for ts in map(tokens_of, texts):
        ones.update(ts)
        twos.update(zip([lm.END, *ts], ts))
    return ones, twos


def plain_logs(text, ones, twos):
    """log10 of each token's probability."""
    read = lambda c: 2.0 ** (int(2 * np.log2(c) + 1e-9) / 2) if c else 0.0
    total, known, before, out = sum(map(read, ones.values())) + 0.1 * (len(ones) + 1), 0, lm.END, []
    for t in tokens_of(text):
        pair, context = read(twos[before, t]), read(ones[before])
        trust = lm.TRUST[min(known, 3)] if context else 0.0
        bigram = min(1.0, pair / max(context * 2**0.5, pair)) if pair and context else 0.0
        out.append(log10(trust * bigram + (1 - trust) * (read(ones[t]) + 0.1) / total))
        known, before = known + 1 if pair else 0, t
    return out


def held_out(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0


def test_base_scores_match_plain_counts(docs, empty):
    data = rows()
    counts, pairs = plain_model([r[1] for r in data if not held_out(r[0])])
    n, v = sum(counts.values()), len(counts)
    want = sorted((r[0] is None, r[0] or 0, held_out(r[0]), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for r in data for ts in [tokens_of(r[1])])
    model = {(r[0], r[1]): sum(plain_logs(r[1], counts, pairs)) for r in data}
    for chars in (4_000_000, 300):  # also with a piece for nearly every text
        out = lm.score(docs, piece_chars=chars).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
        off = [min(abs(r["score"] - x) for (i, _), x in model.items() if i == r["doc_id"]) for r in out]
        assert not [(x, r) for x, r in zip(off, out) if x > 0.5 + 0.03 * r["n_tokens"]]  # an n-gram in a hundred is read a level too high
    assert lm.score(empty).count() == 0


def test_scores_match_a_plain_model():
    """Where the filter answers without error, scores are those of a loop over tokens with dictionaries."""
    texts = [r[1] for r in rows()][:24]
    ones, twos = plain_model(texts[:15])
    reader = lm.Reader(256)
    reader.read(texts)
    name = {i: w for w, i in reader.place.items()}
    level = lambda c: lm.level_of(np.array(c)).astype(np.uint8)
    exact = [ones[name[i]] for i in reader.words.tolist()]
    befores = [reader.place[lm.END], *reader.ids[:-1].tolist()]
    pairs = dict(zip(reader.pair.tolist(), (twos[name[a], name[b]] for a, b in zip(befores, reader.ids.tolist()))))
    mass = lm.count_of(lm.level_of(np.array(list(ones.values())))).sum()
    scorer = lm.Scorer(256, sum(ones.values()), len(ones), mass)
    got = scorer(texts, level(exact), level([pairs[h] for h in sorted(pairs)]), np.array(exact))
    assert np.allclose(got["score"], [sum(plain_logs(t, ones, twos)) for t in texts])
    assert got["n_tokens"].tolist() == [len(tokens_of(t)) for t in texts]


def test_rows_without_training_have_probability_one(spark):
    out = lm.score(spark.createDataFrame([(None, "a b", "x"), (None, None, "y")], "doc_id long, text string, words string")).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["train_tokens"] == 0 for r in out) and len(out) == 2


def test_filter_reads_counts_back():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**56, 5000, dtype=np.uint64) | np.uint64(3 << 56)  # a slab's n-grams share their highest bits
    count = rng.integers(1, 2000, 5000)
    level = lm.level_of(count)
    f = lm.Filter(h, level)
    got = f.levels(h)
    assert (got >= level).all() and (got == level).mean() > 0.98
    assert (lm.count_of(level) <= count).all() and (lm.count_of(level + 1) > count - 1e-6).all()
    assert (f.levels(rng.integers(0, 2**64, 5000, dtype=np.uint64)) > 0).mean() < 0.02
    assert lm.Filter(h[:0], level[:0]).levels(h).max() == 0


def test_words_of_one_hash_are_counted_apart():
    keys, sums, place = lm._summed([np.array([5, 7, 5, 5], dtype=np.uint64), np.array([1, 1, 2, 1], dtype=np.uint64)], np.array([10, 20, 30, 40]))
    assert keys.tolist() == [5, 5, 7] and sums.tolist() == [50, 30, 20] and place.tolist() == [0, 2, 1, 0]


def test_probabilities_add_up():
    """The probabilities over the vocabulary and one unknown word stay at most one after any context."""
    ones, twos = plain_model(["a b c a b", "a a b", "c"])
    for prefix in ("", "a", "a b", "b c a", "zz"):
        after = [plain_logs(f"{prefix} {w}", ones, twos)[-2] for w in ("a", "b", "c", "zz")]
        assert sum(10**x for x in (*after, plain_logs(prefix, ones, twos)[-1])) <= 1.0 + 1e-9


# --- classifiers ----------------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(7)
    bad = ["vile", "foul", "nasty", "rotten"]
    docs, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 120)).split()
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        text = " ".join(words) if good else " ".join(f"{w}%%%" for w in words)
        docs.append((i, text, rng.choice(["en", "de"]), "s", len(text), *rows()[0][5:]))
        labels.append((i, int(good), int(toxic)))
    odd = [(1000, None), (1001, ""), (None, "quiet words"), (1002, sentence(rng, 20_000))]
    return spark.createDataFrame(docs + [(a, b, None, None, None, *rows()[0][5:]) for a, b in odd] + [docs[0]], SCHEMA), spark.createDataFrame([*labels, (5000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def held_out_accuracy(out, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    mine = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and truth.get(r["doc_id"]) is not None and r["doc_id"] is not None and r["doc_id"] < 1000]
    return np.mean([p == t for p, t in mine]), len(mine)


def test_toxicity_held_out_and_odd_rows(spark, empty):
    docs, labels = labelled(spark)
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 4 == 2) for r in out)
    accuracy, n = held_out_accuracy(out, labels, "toxic")
    assert accuracy > 0.95 and n > 60
    assert all(r["predicted"] == 0 for r in out if r["doc_id"] in (1000, 1001, None))
    again = toxicity.classify(docs.repartition(5), labels).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 5)) for r in out) == sorted((str(r["doc_id"]), round(r["score"], 5)) for r in again)
    assert {r["rejected"] for r in out} == {True, False} and toxicity.classify(empty, labels).count() == 0
    unlabelled = toxicity.classify(docs, labels.where("false"), carry=True)
    assert {r["predicted"] for r in unlabelled.collect()} == {0}
    assert unlabelled.select("row.*").columns == docs.columns


def test_toxic_word_deep_in_a_long_text(spark):
    docs, labels = labelled(spark)
    long = " ".join([sentence(random.Random(1), 15_000), "vile", sentence(random.Random(2), 15_000)])
    more = docs.union(spark.createDataFrame([(2000, long, "en", "s", 1, *rows()[0][5:]), (2001, long.replace("vile", "hill1"), "en", "s", 1, *rows()[0][5:])], SCHEMA))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(more, labels).where("doc_id >= 2000").collect()}
    assert got == {2000: 1, 2001: 0}


def test_toxicity_learns_from_long_texts_and_all_shards(spark):
    """Toxic words that occur in texts of over 20,000 characters only; several shards make one model, of counts over all of them."""
    rng = random.Random(4)
    texts = [sentence(rng, 4500) + " vile" if i % 3 == 0 else sentence(rng, 30) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    rows = toxicity.labelled(docs, labels, 4, 2)
    learned = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(r["id"] for r in rows.collect()) == learned and min(len(texts[i]) for i in range(0, 240, 3)) > 20_000
    counts = Counter(b for i in learned for b in {toxicity.bucket(w) for w in texts[i].lower().split()})
    arrays = toxicity.train(rows, epochs=6, shard_rows=40)
    assert arrays["buckets"].tolist() == sorted(b for b, n in counts.items() if n >= 3)
    model = toxicity.TextCnn.of(arrays)
    model.prepare()
    scores = model.scores(["sun moon vile star", "sun moon star", texts[3], texts[4]])
    assert scores[0] > scores[1] and scores[2] > scores[3]


def test_toxicity_keeps_what_reaches_the_driver_bounded(spark):
    """However many words there are the model has at most BUCKETS of them, no epoch's result grows with the shards, and their average is that of plain sums."""
    texts = [" ".join(f"w{i // 3}x{k}" for k in range(20_000)) for i in range(210)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(8)
    rows = toxicity.labelled(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic"), 10**9, 0)
    arrays = toxicity.train(rows, epochs=1, shard_rows=30)
    assert 700_000 < len(arrays["buckets"]) <= toxicity.BUCKETS  # of 1,400,000 words
    before = small_cnn(["sun", "moon", "star"]).arrays()
    made = [{n: a + (k + 1) * np.ones_like(a) for n, a in before.items() if n in (*toxicity.SMALL, "embedding")} for k in range(2)]
    made[0]["embedding"][1] = before["embedding"][1]  # moved by one shard only
    found = [toxicity._changed(before, m, n) for m, n in zip(made, (1, 3))]
    sums = {}
    for r, w, c in zip(*map(np.concatenate, zip(*found))):
        a, b = sums.get(r, (0, 0))
        sums[r] = a + w, b + c
    at = np.array(list(sums))
    after = toxicity._moved(before, at, np.array([sums[r][0] for r in at]), list(np.array([sums[r][1] for r in at]).T))
    moved = after["embedding"] - before["embedding"]
    assert np.allclose(moved[1], 2, atol=1e-5) and np.allclose(moved[2:], 1.5, atol=1e-5)
    assert all(np.allclose(after[n] - before[n], 1.75, atol=1e-5) for n in toxicity.SMALL)


def test_quality_held_out_and_odd_rows(spark, empty):
    docs, labels = labelled(spark)
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    accuracy, n = held_out_accuracy(out, labels, "quality")
    assert accuracy > 0.95 and n > 80
    assert quality.classify(empty, labels).count() == 0
    assert {r["predicted"] for r in quality.classify(docs, labels.where("false")).collect()} == {1}


def test_byte_network_reads_every_byte():
    model = quality.ByteCnn()
    model.prepare()
    text = "x" * 5000
    plain = model.scores([text, text[:4990] + "\x01Q\x02" + text[4993:]])
    assert plain[0] != plain[1]


def small_cnn(words):
    rng = np.random.default_rng(8)
    model = toxicity.TextCnn(np.array(sorted({toxicity.bucket(w) for w in words}), dtype=np.int64))
    model.embedding[1:] = rng.standard_normal(model.embedding[1:].shape)
    model.shift = [rng.standard_normal(s.shape).astype(np.float32) for s in model.shift]
    model.prepare()
    return model


def plain_toxicity(model, text):
    """One text's probability, window by window and filter by filter."""
    place = {b: i + 1 for i, b in enumerate(model.buckets.tolist())}
    words = [place.get(toxicity.bucket(w), 0) for w in (text or "").lower().split()]
    pooled = []
    for f, shift in zip(model.filters, model.shift):
        for k in range(f.shape[2]):
            found = []
            for at in range(max(len(words), 1)):
                inside = [model.embedding[words[at + o]] if at + o < len(words) else np.zeros(f.shape[1]) for o in range(len(f))]
                found.append(sum(float(x @ f[o][:, k]) for o, x in enumerate(inside)))
            pooled.append(max(max(found) + float(shift[k]), 0.0))
    return 1 / (1 + np.exp(-(float(np.array(pooled) @ model.out) + float(model.bias[0]))))


def test_toxicity_scores_match_a_plain_convolution():
    texts = ["vile words, here!", "", None, "sun moon star", "sun", "unknown words only", sentence(random.Random(2), 90), "moon vile sun " * 5]
    model = small_cnn(["vile", "words", "sun", "moon", "star", "here"])
    assert np.allclose(model.scores(texts), [plain_toxicity(model, t) for t in texts], atol=1e-5)
    assert np.allclose(model.scores(texts[::-1])[::-1], [float(model.scores([t])[0]) for t in texts], atol=1e-6)


def plain_quality(model, text):
    """One text's probability by sums over single bytes: windows every two bytes, chunks of two halves."""
    b = (text or "").encode()
    size = max(2 * quality.HALF, -(-len(b) // quality.HALF) * quality.HALF)
    data = list(b + bytes(size - len(b) + quality.WIDTH))
    values = np.array([sum(model.table[o][data[at + o]] for o in range(quality.WIDTH)) for at in range(0, size, quality.STRIDE)])
    hidden = []
    for begin in range(0, size - quality.HALF, quality.HALF):
        inside = values[begin // quality.STRIDE : (begin + 2 * quality.HALF) // quality.STRIDE]
        pooled = np.maximum(inside.max(0) + model.shift, 0)
        filled = sum(x != 0 for x in data[begin : begin + 2 * quality.HALF]) / (2 * quality.HALF)
        hidden.append(np.maximum(pooled @ model.dense[:-1] + filled * model.dense[-1] + model.dense_shift, 0))
    hidden = np.array(hidden)
    return 1 / (1 + np.exp(-(float(np.concatenate([hidden.max(0), hidden.mean(0)]) @ model.out) + float(model.bias[0]))))


def test_quality_scores_match_a_plain_convolution():
    rng = random.Random(6)
    texts = ["", None, "a", "é" * 200, "x" * 255, "x" * 256, "x" * 257, sentence(rng, 30), sentence(rng, 400), "y" * 127]
    model = quality.ByteCnn()
    model.prepare()
    assert np.allclose(model.scores(texts), [plain_quality(model, t) for t in texts], atol=1e-4)
    assert np.allclose(model.scores(texts), [float(model.scores([t])[0]) for t in texts], atol=1e-6)  # neighbours don't count


# --- pages ----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy this now</div><article><h1>Caf&eacute; &amp; bar</h1><p>First   paragraph with <b>bold</b> words, enough of them to look like a real story about things that happen.<br>More.
<p>Second paragraph goes on for a while, with a <a href="/x">link</a> and further words to read.</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I like this a lot</p></div></section>
<footer>&copy; site</footer><script>var t = "</p>";</script>"""


def test_main_text_of_a_page(spark):
    got = html_text.extract(spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>", 5), (None, "u", "no markup < here", 5)], "page_id long, url string, html string, text long")).collect()
    out = {r["page_id"]: r for r in got}
    assert out[1]["text"] == "Café & bar First paragraph with bold words, enough of them to look like a real story about things that happen. More. Second paragraph goes on for a while, with a link and further words to read."
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == out[3]["text"] == out[4]["text"] == "" and len(got) == 5
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_unseen_layouts():
    model = html_text.fit()
    same = []
    for source in html_text.training_pages(150, 99):
        page = html_text.Page(source)
        x = page.features()
        states = html_text.decode(page.parent, model.predict(x), 1 + np.minimum(np.expm1(x[:, 0]), 2000) / 400)
        for i, p in enumerate(page.parent[1:], 1):  # nothing below a cut returns, nothing inside is outside
            assert (states[p], states[i]) in {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)}
        same.append(page.text(states) == page.text(html_text.marked(page)))
    assert np.mean(same) > 0.85


def test_attributes_named_like_marks_do_no_harm(spark):
    html = """<p data-truth="x">One two three.</p><div data-truth>Four</div><p data-truth='1' data-x=1>Five</p>"""
    assert html_text.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).count() == 1
    plain, named = html_text.Page(html), html_text.Page(html.replace("data-truth", "data-other"))
    assert (plain.features() == named.features()).all()


@pytest.mark.parametrize("part", ['<a "', "<a", '<a ">"', "<a '\">", "<b>", "<b><p>", "</b", "<!--", "<![CDATA[", "<x y='", "<script>", "<title>", "<li><b>", "<div>", "a < b ", "<!", "</ "])
def test_broken_markup_takes_time_in_proportion(part):
    times = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_text.Page(part * n).features()
        times.append(time.process_time() - began)
    assert times[1] < 12 * max(times[0], 0.05)


def test_quotes_and_raw_elements():
    page = html_text.Page("""<p title="a > b">One</p><script>if (a<b) x = '"';</script><p title='c"d'>Two</p><textarea>x <b> y</textarea><p>Three""")
    assert [r[1] for r in page.runs if r[0] >= 0] == ["One", "Two", "x <b> y", "Three"]
    deep = html_text.Page("<div>" * 1000 + "deep" + "</div>" * 1000 + "<p>after")
    assert [r[1] for r in deep.runs if r[0] >= 0] == ["deep", "after"]


# Layouts by hand, in styles that the made-up pages don't have.
BY_HAND = [
    (
        """<html><head><title>Tide</title></head><body class="home"><div id="hd"><a href="/">The Harbour Post</a><form action="/find"><input name=q><button>Find</button></form></div>
<main><h1>The tide tables of the old harbour</h1><p>For two hundred years the harbour master wrote the height of the water on the wall of the custom house every morning, and nobody asked why.</p>
<p>When the wall was cleaned last spring, the numbers came to light again, and with them a record of storms that no book had kept.</p>
<blockquote>It was like finding a diary that the town had written without knowing it, the restorer said.</blockquote></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ferry times</a></li><li><a href="/2">Weather</a></li></ul></aside>
<footer><p>&copy; The Harbour Post. <a href="/imprint">Imprint</a></p></footer></body></html>""",
        "The tide tables of the old harbour For two hundred years the harbour master wrote the height of the water on the wall of the custom house every morning, and nobody asked why. When the wall was cleaned last spring, the numbers came to light again, and with them a record of storms that no book had kept. It was like finding a diary that the town had written without knowing it, the restorer said.",
    ),
    (
        """<!doctype html><body><nav><ol><li><a href=/>Start</a><li><a href=/b>Bread</a></ol></nav><article><header><h1>Rye bread without haste</h1></header>
<p>Mix the flour and the water in the evening and let them stand until the next day; the dough does the work while you sleep, and the crumb is better for it.
<ul><li>Five hundred grams of rye flour<li>Four hundred grams of water<li>Ten grams of salt</ul>
<p>Bake it in a closed pot, first hot and then gently, until the crust sounds hollow when you knock on it.</article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>Worked well for me, thank you for this.</p></article></section></body>""",
        "Rye bread without haste Mix the flour and the water in the evening and let them stand until the next day; the dough does the work while you sleep, and the crumb is better for it. Five hundred grams of rye flour Four hundred grams of water Ten grams of salt Bake it in a closed pot, first hot and then gently, until the crust sounds hollow when you knock on it.",
    ),
]


def test_layouts_by_hand(spark):
    got = html_text.extract(spark.createDataFrame([(i, "u", source) for i, (source, _) in enumerate(BY_HAND)], "page_id long, url string, html string")).orderBy("page_id").collect()
    for r, (_, want) in zip(got, BY_HAND):
        mine, theirs = Counter(r["text"].split()), Counter(want.split())
        assert sum((mine & theirs).values()) >= 0.95 * max(sum(mine.values()), sum(theirs.values())), r["text"]


def plain_odds(model, row):
    """One block's probability by walking every tree by itself."""
    bins = [sum(x >= e for e in edges) for x, edges in zip(row, model.edges)]
    margin = model.start
    for t in range(model.trees):
        node = 0
        for d in range(model.depth):
            at = 2**d - 1 + node
            node = 2 * node + int(bins[model.feature[t, at]] > model.cut[t, at])
        margin += model.value[t][node]
    return 1 / (1 + np.exp(-margin))


def plain_decoding(parent, p, weight):
    """The least cost over all consistent labellings, each tried."""
    import itertools

    n, best = len(parent), (np.inf, None)
    allowed = {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)}
    for states in itertools.product((0, 1, 2), repeat=n - 1):
        s = (0, *states)
        if all((s[parent[i]], s[i]) in allowed for i in range(1, n)):
            cost = sum(-np.log(p[i] if s[i] == 1 else 1 - p[i]) * weight[i] for i in range(1, n)) + sum(s[parent[i]] != s[i] for i in range(1, n))
            best = min(best, (cost, s))
    return best[0]


def test_trees_and_decoding_match_plain_versions():
    model = html_text.fit(60, 3)
    page = html_text.Page(PAGE)
    x = page.features()
    assert np.allclose(model.predict(x), [plain_odds(model, row) for row in x])
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 8))
        parent = [-1, *(int(rng.integers(i)) for i in range(1, n))]
        p, weight = rng.uniform(0.02, 0.98, n), rng.uniform(0.5, 3, n)
        s = html_text.decode(parent, p, weight)
        cost = sum(-np.log(p[i] if s[i] == 1 else 1 - p[i]) * weight[i] for i in range(1, n)) + sum(s[parent[i]] != s[i] for i in range(1, n))
        assert np.isclose(cost, plain_decoding(parent, p, weight))


def test_parser_survives_anything():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<div class='a", '<a href="', "<", ">", "<!--", "-->", "text ", "</article>", "<script>", "</scr", "<li>", "<td>", "&amp", "&#x41;", "<br/>", "<title>", "é"]
    for _ in range(300):
        source = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        page = html_text.Page(source)
        assert len(page.features()) == len(page.tag)
