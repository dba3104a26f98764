"""The pipeline's stages on small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import line_dedup, mixing, rule_ensemble, simhash
from tidemark.llm.queries import MIX, RUN_WORDS, tokenizer


def plain_score(model, stats):
    """A rule ensemble's score, worked out one row at a time."""
    total = model.intercept
    for rule, weight in model.rules:
        total += weight * all((stats[place] > threshold) == above for place, above, threshold in rule)
    return 1 / (1 + math.exp(-total))


def plain_near(rows):
    """The ids that stay of (id, text): all pairs by Jaccard of five-word shingles, the least id of each component."""
    grams = {}
    for i, text in rows:
        parts = text.encode().lower().split()
        grams[i] = {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(grams), 2):
        if grams[a] == grams[b] or 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in grams if find(i) == i}


def test_stages_against_brute_force(spark, sf, monkeypatch):
    """Each stage on the rows of the one before it, and run() against them all: rules and shingles in plain Python,
    sentences and the mix in DuckDB, tokens by the library."""
    models, plain_fit = [], rule_ensemble.fit
    monkeypatch.setattr(rule_ensemble, "fit", lambda *a, **k: models.append(plain_fit(*a, **k)) or models[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    steps = dict(corpus_pipeline.STAGES)
    con = duckdb.connect()

    def given(name):
        frame = steps[name](spark, spark.createDataFrame(rows, docs.schema), sf).toPandas()
        con.register("given", frame)
        return [tuple(r) for r in frame.astype(object).where(frame.notna(), None).values.tolist()]

    def checked(got, want):
        assert sorted(got, key=repr) == sorted(want, key=repr)
        return got

    got = given("quality classifier")
    want = [r for r in rows if plain_score(models[0], rule_ensemble._of((r[1] or "").encode())) >= 0.3]
    rows = checked(got, want)
    assert 0 < len(rows) < docs.count()

    got = given("near-dedup by shingles")
    stay = plain_near([(r[0], r[1] or "") for r in rows])
    rows = checked(got, [r for r in rows if r[0] in stay])

    con.register("before", spark.createDataFrame(rows, docs.schema).toPandas())
    cut = con.execute(f"SELECT doc_id, n_removed, chars_left, text_md5 FROM ({line_dedup.oracle('before', RUN_WORDS)})").fetchall()
    got = given("line dedup")
    here = dict(con.execute("SELECT doc_id, md5(text) FROM given").fetchall())
    assert here == {i: h for i, n, chars, h in cut if not n or h != hashlib.md5(b" " * chars).hexdigest()}
    assert all(r[4] == len(r[1]) for r in got) and any(n for _, n, *_ in cut)
    rows = got

    con.register("before", spark.createDataFrame(rows, docs.schema).toPandas())
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({mixing.oracle('before', **MIX)})").fetchall()
    got = given("mixing sources")
    times = Counter(r[0] for r in got)
    assert {i: times[i] * size for i, size, _ in taken} == {i: words for i, _, words in taken}
    assert set(got) <= set(rows)
    rows = got

    coder = Tokenizer.from_file(tokenizer())
    want = Counter()
    for i, text, *_ in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()) if len(ids) <= 1024 else None] += 1
    packed = steps["best-fit packing"](spark, spark.createDataFrame(rows, docs.schema), sf).toPandas()
    total = defaultdict(int)
    for r in packed.itertuples():
        total[r.doc_id] += r.length
    assert total == {i: sum(n * k for (j, n, _), k in want.items() if j == i) for i in times}
    whole = packed[packed.piece == 0].merge(packed[packed.piece == 1][["doc_id"]].drop_duplicates(), "left", "doc_id", indicator=True).query("_merge == 'left_only'")
    assert Counter(zip(whole.doc_id, whole.length, whole.ids_crc32, strict=True)) == {k: n for k, n in want.items() if k[2] is not None}
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024

    final = corpus_pipeline.run(spark, sf).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, final[columns].values.tolist())) == Counter(map(tuple, packed[columns].values.tolist()))
    assert final.sequence_id.nunique() == packed.sequence_id.nunique()


def test_better_documents_are_taken_more_often(spark):
    """In the part of an epoch that a source has left, with the classifier's score as quality; the same
    as in SQL."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words, 60)) + (". " if i % 2 else " $$ ## | 99 && ") * 9, "en", "src0" if i < 200 else "src1", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    scored = rule_ensemble.scored(docs, rule_ensemble.fit_seen(docs, labels), "mark").drop("n_chars").persist()
    got = Counter(r["doc_id"] for r in mixing.mixed_rows(scored, quality=F.col("mark"), **MIX).where("source = 'src1'").select("doc_id").collect())
    good, bad = (sum(n for i, n in got.items() if i % 2 == k) for k in (1, 0))
    assert good > 1.1 * bad > 0
    con = duckdb.connect()
    con.register("before", scored.toPandas())
    want = con.execute(f"SELECT doc_id, taken // size FROM ({mixing.oracle('before', quality='mark', **MIX)}) WHERE doc_id >= 200 AND taken > 0").fetchall()
    assert got == dict(want)


def test_very_long_near_copies(spark, monkeypatch):
    """Tiles are bounded by shingles too: long texts and small bounds give the same groups."""
    rng = np.random.default_rng(9)
    long = [f"w{x}" for x in rng.integers(0, 50_000, 40_000)]
    texts = [long, long[:-2000], long[3000:], long[: len(long) // 2], ["x", *long], *[[f"v{x}" for x in rng.integers(0, 300, 60)] for _ in range(40)]]
    texts += [[*t[:30], "other", *t[31:]] for t in texts[5:25]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_near([(i, " ".join(t)) for i, t in enumerate(texts)])
    for bound in (simhash.SHINGLES, 50):
        monkeypatch.setattr(simhash, "SHINGLES", bound)
        assert {r["doc_id"] for r in corpus_pipeline.near_deduplicated(spark, docs, "").collect()} == want


def test_stages_take_and_give_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        own = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert own and set(own) <= ids, name
        assert name == "mixing sources" or len(own) == len(set(own))
        assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        ids = set(own)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    copies = Counter(own)
    first = packed.where("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in first} == copies


def test_repeated_documents_and_passages_go(spark, sf):
    """A planted copy, a near copy and a repeated passage, among the table's documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = " ".join(f"plain{i % 211} word{i % 317}." for i in range(200))
    passage = " ".join(f"passage{i}" for i in range(60))
    extra = [(10_000, clean), (10_001, clean), (10_002, clean.replace("word7.", "other")), (10_003, " ".join(f"first{i}" for i in range(90)) + "\n" + passage), (10_004, passage + "\n" + " ".join(f"second{i}" for i in range(90)))]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in extra], docs.schema))
    near = corpus_pipeline.near_deduplicated(spark, rows, sf)
    assert sorted(r["doc_id"] for r in near.where("doc_id >= 10000").collect()) == [10_000, 10_003, 10_004]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplicated(spark, near, sf).where("doc_id >= 10000").collect()}
    assert passage in cut[10_003] and cut[10_004] == " ".join(f"second{i}" for i in range(90))


def test_stages_take_nulls_repeats_and_other_columns(spark, sf):
    """Nulls in every column, blank and very long texts, repeated ids and rows, columns named like the operators' own,
    without n_chars; and an empty table."""
    rows = [(1, None, "en", "a"), (None, "no id " * 30, None, None), (None, "no id " * 30, None, None), (3, "", "en", "a"), (4, " \n", None, "b"), (5, "some words of a text. " * 20, "en", "b"), (5, "quite other words here. " * 20, "en", "a"), (5, "quite other words here. " * 20, "en", "a"), (9, " ".join(f"w{i}" for i in range(60_000)), "en", "a"), (None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, removed string, score int, size string, first int, own string, length string, node int"
    full = spark.createDataFrame([(*r, "x", 1, "x", 1, "x", "x", 1) for r in rows], names)
    for docs in (full, full.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            own = step(spark, docs, sf)
            assert own.columns == docs.columns, name
            got = [r["removed"] for r in own.collect()]
            assert (got == []) if docs is not full else set(got) <= {"x"}, name
        near = sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in corpus_pipeline.near_deduplicated(spark, docs, sf).collect())
        assert near == ([] if docs is not full else [(0, "no id"), (1, ""), (5, "quite"), (5, "some "), (9, "w0 w1")])
        packed = corpus_pipeline.packed(spark, docs, sf).collect()
        assert len([r for r in packed if r["piece"] == 0]) == (0 if docs is not full else len(rows))
