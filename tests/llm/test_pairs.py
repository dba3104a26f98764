"""SimHash and spherical caps against brute force, and their edge cases."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import cap_filters, queries, simhash
from tidemark.llm.components import connected_components
from tidemark.llm.shared import Forest

DOCS = "doc_id long, text string, fp string, node string, component_id int"


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3_against_brute_force(spark, sf):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, sf).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert links
    assert got == {d: (format(f, "016x"), docs[c][0]) for (d, _), f, c in zip(docs, fps, components(len(docs), links), strict=True)}


def test_simhash_edge_cases(spark):
    """Nulls, blanks, one word, repeated rows and ids, a very long text, clashing columns."""
    long = " ".join(f"w{i % 997}" for i in range(150_000))
    data = [(1, None, "x", "x", 0), (2, "", "x", "x", 0), (3, " \t\n", "x", "x", 0), (4, "one", "x", "x", 0), (5, "ONE", "x", "x", 0), (5, "ONE", "x", "x", 0), (None, "one", "x", "x", 0), (7, long, "x", "x", 0), (8, long, "x", "x", 0), (None, "quite another text", "x", "x", 0)]
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(data, DOCS)).collect()]
    assert len(got) == len(data)
    assert sorted(c for d, _, c in got if d in (1, 2, 3)) == [1, 1, 1] and {f for d, f, _ in got if d in (1, 2, 3)} == {0}
    assert sorted(c for d, _, c in got if d in (4, 5)) == [4, 4, 4]
    assert {c for d, _, c in got if d in (7, 8)} == {7}
    assert sorted((c is None, c or 0) for d, _, c in got if d is None) == [(False, 4), (True, 0)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("tile", [3, 1000])
def test_links_in_dense_buckets_are_whole(spark, tile):
    """Random and dense fingerprints, with tiles that cut the buckets and without."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(c ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)), np.uint64(0))) for c in centre for _ in range(60)}
    fps = sorted(fps)
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(i, [f], [f]) for i, f in enumerate(signed)], "node long, cut array<long>, check array<long>")
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, 3, tile).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() >= 1 for a, b in links)
    assert components(len(fps), links) == want


def test_near_copies_stay_once(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(5000)]
    base = [list(rng.choice(words, 300)) for _ in range(8)]
    docs = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        near = list(b)
        for k in rng.choice(300, 2, replace=False):
            near[k] = "changed"
        docs.append((100 + i, " ".join(near)))
        docs.append((200 + i, " ".join(b)))
    docs += [(300, None), (301, ""), (None, "no id"), (None, "no id"), (0, docs[0][1]), (None, " ".join(base[3])), (7, "other text of an id")]
    kept = simhash.one_of_each(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, stays string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [*((False, i) for i in range(8)), (False, 7), (False, 300), (True, 0)]
    assert kept[0]["stays"] == "x"


def test_documents_are_an_id_with_a_text(spark):
    """An id with two texts, one of them a copy of another document's."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, c), (9, c), (None, b), (None, f"{c} d"), (None, None)]
    kept = simhash.one_of_each(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, own int, first int")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (3, a), (5, b), (9, c)]
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_have_their_shingles_once(spark, monkeypatch):
    """Many rows without an id repeat one text that has a near copy: no row of the search is made for each."""
    made, plain = [], simhash._sets
    monkeypatch.setattr(simhash, "_sets", lambda *a: made.append(plain(*a)) or made[-1])
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text)] * 300 + [(None, text.replace("w77", "other"))] * 300 + [(4, "nothing like it " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.one_of_each(docs).collect()
    assert made[0].count() == made[0].select("node").distinct().count() == 2
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 4] and len(kept) == 2


def test_a_large_component_with_few_others_makes_few_rows(spark):
    """9,000 members of one component and 100 others: each of the former meets the others once."""
    rows = [(0, 1, i, 0 if i < 9000 else i, 0, 9000, 100) for i in range(9100)]
    members = spark.createDataFrame(rows, "seg int, val long, node long, root long, large long, n_large long, n_others long")
    tiles = simhash._tiles(members, 256)
    assert tiles.count() == 9000 + 100 * 37
    met = tiles.where("root <> large").select("tile_i", "tile_j", F.col("node").alias("a")).join(tiles.where("root = large").select("tile_i", "tile_j", F.col("node").alias("b")), ["tile_i", "tile_j"])
    assert met.count() == met.distinct().count() == 9000 * 100


def edited(words, kind, similarity, rng):
    """A near copy: words cut off at the end, put before, or replaced in one block, for a similarity of five-word shingles."""
    n = len(words) - 4
    new = [f"new{i}" for i in rng.integers(0, 1 << 40, len(words))]
    if kind == "cut":
        return words[: round(n * similarity) + 4]
    if kind == "appended":
        return new[: round(n / similarity - n)] + words
    k = round(n * (1 - similarity) / (1 + similarity)) - 4
    return words[:100] + new[:k] + words[100 + k :]


def jaccard(a, b, width=5):
    a, b = ({tuple(x[i : i + width]) for i in range(max(1, len(x) - width + 1))} for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("kind", ["cut", "appended", "replaced"])
def test_near_copies_by_one_block_are_candidates(spark, kind):
    """Whatever one block of words does, pairs of a similarity of 0.8 to 0.95 share a fingerprint."""
    rng = np.random.default_rng(8)
    rows, at = [], {}
    for similarity in (0.8, 0.85, 0.9, 0.95):
        for _ in range(100):
            words = [f"w{i}" for i in rng.integers(0, 20_000, 300)]
            other = edited(words, kind, similarity, rng)
            at[len(at)] = similarity
            assert abs(jaccard(words, other) - similarity) < 0.01
            rows += [(2 * len(at), " ".join(words)), (2 * len(at) + 1, " ".join(other))]
    found = simhash._wide(spark.createDataFrame(rows, "doc_id long, text string"), 5).withColumnRenamed("doc_id", "node")
    groups = simhash._members(found).groupBy("seg", "val").agg(F.collect_set("node").alias("nodes")).collect()
    pairs = {n // 2 - 1 for g in groups for n in g["nodes"] if n ^ 1 in g["nodes"]}
    recall = {s: sum(at[p] == s for p in pairs) / 100 for s in (0.8, 0.85, 0.9, 0.95)}
    print(kind, recall)
    assert min(recall.values()) >= 0.98


@pytest.mark.parametrize("tile", [3, 256])
def test_similar_links_by_exact_jaccard(spark, tile):
    """Families of pairs from 0.6 to 0.95: linked at 0.8 and above, not below; the same for related texts of a family."""
    rng = np.random.default_rng(9)
    docs = []
    for family in range(24):
        words = [f"w{i}" for i in rng.integers(0, 20_000, 200)]
        docs.append(words)
        for similarity in (0.6, 0.7, 0.75, 0.78, 0.79, 0.81, 0.85, 0.95)[family % 4 * 2 :][:2]:
            docs.append(edited(words, ("cut", "appended", "replaced")[family % 3], similarity, rng))
    base = [f"b{i}" for i in range(300)]
    for i in range(20):  # each is 0.8 or more from few others: hubs alone don't connect them
        docs.append(base[10 * i : 10 * i + 100])
        docs.append(base[10 * i + 5 : 10 * i + 105])
    docs += [[f"s{i}" for i in range(n)] for n in (3, 8, 9, 10)]
    docs = [docs[i] for i in rng.permutation(len(docs))]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(docs[i], docs[j]) >= 0.8]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), tile=tile).collect()}
    assert len(links) > 50
    assert [got[i] for i in range(len(docs))] == components(len(docs), links)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    odd = [(7, 7), (1, 0), (1, 0), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, (2, 200))
    forest = Forest(300)
    for k in range(0, 200, 20):
        forest.link(a[k : k + 20], b[k : k + 20])
    assert forest.root.tolist() == components(300, list(zip(a.tolist(), b.tolist(), strict=True)))


def brute_vectors(rows, least=0.93):
    good = lambda v: v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] is not None and rows[i][2] == rows[j][2] and good(rows[i][1]) and good(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= least]
    count = np.zeros(len(rows), int)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return count.tolist(), components(len(rows), links), links


def planted(seed=1, n=400, d=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    near = base[: n // 2] / np.linalg.norm(base[: n // 2], axis=1)[:, None]
    noise = rng.standard_normal(near.shape)
    noise -= (noise * near).sum(1)[:, None] * near
    cosine = rng.uniform(0.9, 1.0, len(near))[:, None]
    near = cosine * near + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1)[:, None]
    vectors = np.r_[base, near, near[:20]]
    return [(i, v.tolist(), int(i % (n // 2) % 3)) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("tile", [8, 512])
def test_op10_recall_and_precision(spark, tile):
    rows = planted()
    count, root, links = brute_vectors(rows)
    got = {r["vec_id"]: r for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=tile).collect()}
    assert len(links) > 100
    found = [got[i]["n_links"] for i in range(len(rows))]
    assert all(f <= c for f, c in zip(found, count, strict=True)) and sum(found) >= 0.97 * sum(count)
    assert sum(got[i]["component_id"] == root[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_op10_edge_cases(spark):
    v = [float(i % 7 - 3) for i in range(64)]
    rows = [(1, v, 1, "x"), (2, v, 1, "x"), (3, [2 * x for x in v], 1, "x"), (4, v, 2, "x"), (5, v, None, "x"), (6, None, 1, "x"), (7, [0.0] * 64, 1, "x"), (8, [None, *v[1:]], 1, "x"), (9, [float("nan"), *v[1:]], 1, "x"), (10, [float("inf"), *v[1:]], 1, "x"), (11, [], 1, "x"), (12, v[:10], 1, "x"), (1, v, 1, "x"), (None, v, 1, "x"), (None, None, None, "x")]
    got = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vector string")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] not in (1, None)}
    assert by == {2: (4, 1, False), 3: (4, 1, False)} | {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] == 1] == [(4, 1, True)] * 2
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 9, 12, 15, 16, 24, 32, 64, 100])
def test_cap_filters_at_any_width(width):
    """Of pairs at a cosine of 0.93, at least 99 in a hundred share a filter."""
    rng = np.random.default_rng(width)
    a, b = rng.standard_normal((2, 3000, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    if width > 1:
        b -= (a * b).sum(1)[:, None] * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    else:
        b = a
    code = cap_filters.Code(width, 12, 2, 64, 3.33, 11)
    shared = [len(np.intersect1d(x, y)) for x, y in zip(code.filters(a), code.filters(b), strict=True)]
    sizes = [len(f) for f in code.filters(a)]
    print(width, "recall", np.mean(np.array(shared) > 0), "filters", np.mean(sizes), max(sizes))
    assert np.mean(np.array(shared) > 0) >= 0.99
    assert np.mean(sizes) < 250


def test_op10_query_on_a_planted_table(spark, tmp_path):
    """The registered query over a table with near pairs, a large group of copies and vectors of few components."""
    rows = planted(2)
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(300)]
    rng = np.random.default_rng(4)
    rows += [(2000 + i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((150, 3)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).orderBy("vec_id").collect()]
    count, root, links = brute_vectors(rows)
    got = {r["vec_id"]: r for r in queries.op10_cap_filters(spark, str(tmp_path)).collect()}
    found = [got[v]["n_links"] for v, _, _ in rows]
    assert all(f <= c for f, c in zip(found, count, strict=True)) and sum(found) >= 0.99 * sum(count)
    assert sum(got[v]["component_id"] == rows[r][0] for (v, _, _), r in zip(rows, root, strict=True)) >= 0.99 * len(rows)


def test_near_dedup_finds_candidates_by_deletion_variants(spark, monkeypatch):
    """Without any shared least hashes, pairs within 3 bits of a SimHash are found by its deletion variants, and stay
    linked only where their shingles are alike."""
    rng = np.random.default_rng(11)
    docs = []
    for _ in range(20):
        words = [f"w{i}" for i in rng.integers(0, 1 << 40, 400)]
        docs += [words, [*words[:-1], "other"]]
    docs += [["a"] * 300 + ["b"], ["a"] * 300 + ["c"]]  # 1 of their 3 different shingles is in both
    monkeypatch.setattr(simhash, "_members", lambda nodes: nodes.where("false").select(F.lit(0).alias("seg"), F.lit(0).cast("long").alias("val"), "node", F.lit(0).cast("long").alias("size")))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()}
    near = [k for k in range(0, 40, 2) if np.bitwise_count(np.bitwise_xor(*(np.array(simhash._majority(iter([simhash._once([w.encode() for w in d], 5)]), 1)) for d in docs[k : k + 2]))).sum() <= 3]
    assert len(near) > 10 and all(got[k + 1] == got[k] == k for k in near)
    assert got[40] == 40 and got[41] == 41
