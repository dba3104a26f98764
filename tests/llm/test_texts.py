"""Rules, line dedup, mixing, packing, token files and classifier: brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import line_dedup, mixing, packing, perplexity, queries, rule_ensemble, token_orc
from tidemark.llm.shared import new_path
from tidemark.llm.tokens import Encoder, encoded

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "b"), (5, "one two\none two\n\n", "de", "b"), (5, "one two\none two\n\n", "de", "b"), (None, "no id", None, "c"), (8, "x  y\x0bz\x1c\u00a0w \u2028 <|endoftext|> #*$%&|<>" * 3, "en", "c"), (9, "w " * 200_000, "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string, size int, score string, removed string, length string, n string, kept int"


def edges(spark, rows=EDGES):
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", 1) for r in rows], SCHEMA)


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


# quality rules


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_op1_base_rules_and_bands(spark, sf):
    """The bands by an own computation, for a table of fewer than 10,000 texts."""
    got = {r["doc_id"]: r for r in queries.op1_perplexity(spark, sf).collect()}
    logs, band = defaultdict(list), {}
    for r in got.values():
        if not r["base_failed"]:
            logs[r["lang"]].append(np.log(r["perplexity"]))
    for lang, own in logs.items():
        low, high = (sorted(own)[max(0, -(-len(own) * q // 4) - 1)] for q in (1, 3))
        out = 2 * max(high - low, 0.01)
        band[lang] = np.exp(low - out), np.exp(high + out)
    for doc, text, lang, _ in documents(spark, sf):
        r = got[doc]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(text)
        if lang in band:
            assert (r["lower"], r["upper"]) == pytest.approx(band[lang])
            assert r["kept"] == (not r["base_failed"] and band[lang][0] <= r["perplexity"] <= band[lang][1])


def test_op1_rejects_both_ends(spark):
    """Among like texts, one of rare letters and one of a few words over and over (not in the same order) go."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(words, 200)), "en") for i in range(150)]
    rows += [(200, " ".join("".join(rng.choice(list("qrstuvwxyz0123456789"), 6)) for _ in range(200)), "en"), (201, " ".join(rng.choice(words[:9], 200)), "en")]
    got = {r["doc_id"]: r["kept"] for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("not base_failed").collect()}
    assert not got[200] and not got.get(201, False) and sum(got.values()) >= 145


def test_op1_edge_cases(spark):
    """Also with a model in many blocks: the same numbers."""
    one, many = (perplexity.judge(edges(spark), block=n).collect() for n in (perplexity.BLOCK, 40))
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["lang"])
    for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
        assert a["perplexity"] == (b["perplexity"] and pytest.approx(b["perplexity"])) and a["kept"] == b["kept"]
    assert len(one) == len(EDGES)
    for doc, text, *_ in EDGES:
        own = [r for r in one if r["doc_id"] == doc]
        assert all(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(text) for r in own)
        assert all((r["perplexity"] is None) == (not WORD.search(text or "")) for r in own)
    assert perplexity.judge(edges(spark, [])).count() == 0
    assert perplexity.judge(edges(spark, EDGES[:3])).where("kept").count() == 0


def test_kneser_ney_matches_a_plain_one(spark, monkeypatch):
    """Windows given out in small parts; a plain model that sums to one."""
    monkeypatch.setattr(perplexity, "HELD", 20)
    monkeypatch.setattr(perplexity, "CHARACTERS", 30)
    words = "the then there these they this that hat hats heat a an and any ten tent net the the the an and the".split()
    texts = [" ".join(words[:12]), " ".join(words[12:]), "the an and", None, ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9, "other words", "de")], "doc_id long, text string, lang string")
    padded = ["\0" * 4 + t + " " for t in texts if t]
    counts = {perplexity.ORDER: Counter(t[i : i + 5] for t in padded for i in range(len(t) - 4))}
    for k in range(perplexity.ORDER - 1, 0, -1):
        before, raw = defaultdict(set), Counter()
        for g, n in counts[k + 1].items():
            before[g[1:]].add(g[0])
            raw[g[1:]] += n
        counts[k] = {g: raw[g] if g[0] == "\0" else len(before[g]) for g in before}

    def own_discounts(found):
        t1, t2, t3, t4 = (found.get(x, 0) for x in (1, 2, 3, 4))
        if not (t1 and t2 and t3 and t4):
            return 0.5, 0.75, 0.9
        y = t1 / (t1 + 2 * t2)
        return tuple(min(max(x - (x + 1) * y * b / a, 0.05), x - 0.05) for x, a, b in ((1, t1, t2), (2, t2, t3), (3, t3, t4)))

    discount = {k: own_discounts(Counter(c.values())) for k, c in counts.items()}

    def plain(gram, k=perplexity.ORDER):
        if not k:
            return 1 / (len(counts[1]) + 1)
        own = gram[-k:]
        same = {g: n for g, n in counts[k].items() if g[:-1] == own[:-1]}
        lower = plain(gram, k - 1)
        if not same:
            return lower
        d = lambda n: discount[k][min(n, 3) - 1]
        used = sum(n - d(n) for n in same.values())
        total = sum(same.values())
        return (max(same[own] - d(same[own]), 0) if own in same else 0) / total + (1 - used / total) * lower

    symbols = [*counts[1], "?"]
    for context in ("\0" * 4, "\0\0\0t", " the", "zzzz", "e an"):
        assert sum(plain(context + s) for s in symbols) == pytest.approx(1)
    got = {r["gram"]: r["log_p"] for r in perplexity.log_probabilities(perplexity.count_grams(docs)).where("lang = 'en'").collect()}
    assert got.keys() == counts[perplexity.ORDER].keys()
    assert all(np.exp(p) == pytest.approx(plain(g)) for g, p in got.items())
    measured = {r["doc_id"]: r["perplexity"] for r in perplexity.measure(docs).collect()}
    for i, t in enumerate(padded):
        logs = [np.log(plain(t[k : k + 5])) for k in range(len(t) - 4)]
        assert measured[i] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-5)


# line dedup


def test_line_dedup_edge_cases(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"a\n{line}\nb", "en", "s"), (2, f"{line.upper()}  \nrest", "en", "s"), (3, f"x\n{line}\n{line}", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, "short\nshort", "en", "s"), (7, f"\u00e9\u00e9\n {line}", "en", "s"), (1, f"a\n{line}\nb", "en", "s"), (None, line, "en", "s"), (None, "\n\n", "en", "s")]
    got = line_dedup.dedup(edges(spark, rows))
    assert set(got.columns) == set(edges(spark, []).columns)
    by = {r["doc_id"]: (r["text"], [tuple(p) for p in r["removed"]]) for r in got.where("doc_id is not null or text <> '\n\n'").collect()}
    n = len(line)
    assert by[1] == (rows[0][1], []) and by[4] == (None, []) and by[5] == ("", []) and by[6] == ("short\nshort", [])
    assert by[2] == ("rest", [(0, n + 3)]) and by[3] == ("x\n", [(2, 3 + 2 * n)])
    assert by[7] == ("\u00e9\u00e9\n", [(3, 4 + n)]) and by[None] == ("", [(0, n)])
    assert got.count() == len(rows)
    assert line_dedup.dedup(edges(spark, [])).count() == 0


def test_passages_inside_lines_go_and_common_sentences_stay(spark):
    passage = " ".join(" ".join(f"p{k}x{i}" for i in range(11)) + "." for k in range(6))
    rows = [(1, f"Own one. {passage} Common here. More of it.", "en", "s"), (2, f"Another start. {passage} Common here. End of two.", "en", "s"), (3, "Common here. Nothing else.", "en", "s")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(edges(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Another start. End of two.", 3: rows[2][1]}


def test_units_are_the_text():
    for text in ("", "a", "a. b! \n\n c?\nd", "\n", "one\n\n\ntwo\nthree\n \n four", "a.b.  c.\t"):
        sentences, blocks = line_dedup.cut(text)
        assert "".join(text[a:b] for a, b, *_ in sentences) == text
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        paragraphs = re.findall(r"(?:[^\n]*[^ \t-\r][^\n]*(?:\n|$))+", text)
        assert Counter(text[a:b] for a, b, *_ in blocks) == Counter(x for x in lines if x.split()) + Counter(paragraphs)
        assert all(words == len(text[a:b].split()) for a, b, words, _ in sentences + blocks)


def test_paragraphs_go_however_they_are_wrapped(spark):
    words = [f"a{i}" for i in range(60)]
    one, two = " ".join(words), " ".join(f"b{i}" for i in range(30))
    wrapped = "\n".join(" ".join(words[k : k + 7]) for k in range(0, 60, 7))
    rows = [(1, f"{one}\n\n{two}", "en", "s"), (2, f"{two}\nmore\n\nnew\n\n{wrapped}", "en", "s"), (3, f"x\n \n{wrapped.upper()}\n\ny", "en", "s")]
    got = {r["doc_id"]: (r["text"], [tuple(p) for p in r["removed"]]) for r in line_dedup.dedup(edges(spark, rows)).collect()}
    n, m = len(wrapped), len(two)
    assert got == {1: (rows[0][1], []), 2: ("more\n\nnew\n\n", [(0, m + 1), (m + 12, m + 12 + n)]), 3: ("x\n \n\ny", [(4, 5 + n)])}


def test_without_a_least_number_every_later_unit_goes():
    assert line_dedup.places("a\nb\n", set(), 0) == []
    assert line_dedup.places("a\na\nb\n", set(), 0) == [(2, 4)]
    assert line_dedup.places("a\n\nb. a.\n\na\n", set(), 0) == [(10, 12)]
    assert line_dedup.places("\n\n \n", set(), 0) == line_dedup.places("", set(), 0) == []


def test_dedup_same_as_sql_without_a_least_number(spark):
    """Also with one, over texts of few words in all kinds of lines and paragraphs."""
    rng = np.random.default_rng(4)
    parts = ["a", "b", "c d", ".", ". ", "\n", "\n\n", " ", "!", "? ", "e"]
    texts = [None, "", *("".join(rng.choice(parts, 9)) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("docs", docs.toPandas())
    for least in (0, 2, 4):
        found = line_dedup.dedup(docs, least).collect()
        got = sorted((r["doc_id"], ",".join(f"{a}-{b}" for a, b in r["removed"]), None if r["text"] is None else hashlib.md5(r["text"].encode()).hexdigest()) for r in found)
        assert got == con.execute(f"SELECT doc_id, removed, text_md5 FROM ({line_dedup.oracle('docs', least)}) ORDER BY 1").fetchall()
        assert any(p for _, p, _ in got)


# mixing


def plain_targets(sizes, weights, share, most):
    left, weight = share * sum(sizes.values()), {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, open_ = {}, set(sizes)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)


def test_mix_meets_its_targets(spark, sf):
    got = queries.op4_mix_sources(spark, sf).collect()
    docs = {d: (len(WORD.findall(t or "")), s) for d, t, _, s in documents(spark, sf)}
    sizes = Counter()
    for n, s in docs.values():
        sizes[s] += n
    targets, taken = plain_targets(sizes, (5, 2, 1), 1.5, 2.0), Counter()
    for r in got:
        n, s = docs[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and r["target"] == pytest.approx(targets[s]) and r["taken"] in (0, n, 2 * n)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= max(n for n, x in docs.values() if x == s) for s in sizes)
    again = queries.op4_mix_sources(spark, sf).collect()
    assert sorted(got) == sorted(again)


def test_mix_edge_cases(spark):
    got = mixing.mix(edges(spark)).collect()
    assert len(got) == len(EDGES) and sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, *_ in EDGES)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(edges(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(edges(spark, EDGES[:3])).collect()} == {0}
    assert {r["n"] for r in mixing.mixed_rows(edges(spark)).select("n").collect()} == {"x"}
    rows = mixing.mixed_rows(edges(spark)).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    want = Counter()
    for r in mixing.mix(edges(spark)).collect():
        want["all"] += r["taken"]
    assert sum(r["n"] for r in rows) == want["all"]


def test_mix_by_a_quality_column_with_nulls_and_zeros(spark):
    """Null, NaN, zero, negative and large qualities are weights like others, and the target is met."""
    odd = [None, float("nan"), 0.0, -3.0, 0.5, 1e9, float("inf")]
    data = [(i, "a b c d", "s" if i % 2 else "t", odd[i % 7]) for i in range(700)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string, q double"), share=0.75, quality=F.col("q")).collect()
    assert len(got) == 700
    for source in {r["target"] for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == source) - source) <= 4
    plain = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string, q double"), share=0.75, quality=F.lit(None)).collect()
    assert sum(r["taken"] for r in plain) > 0


def test_many_repeated_rows_share_what_is_taken_of_them(spark):
    """A third of all rows with a null id and one text: as many rows come out as the mix takes, with their own columns."""
    data = [(None, "a b", "s", i) for i in range(300)] + [(i, f"w{i} x y", "s", i) for i in range(300)] + [(9000, "", "t", 1)] * 40
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, own int").repartition(7)
    how = {"weights": (5, 2, 1), "share": 1.5, "most": 2.0}
    want = mixing.mix(docs, **how).groupBy("doc_id").agg(F.sum("times").alias("n")).where("n > 0").collect()
    got = mixing.mixed_rows(docs, **how)
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["n"] for r in want}
    assert got.columns == docs.columns
    each = [r["count"] for r in got.where("doc_id is null").groupBy("own").count().collect()]
    assert len(each) == 300 and set(each) == {1, 2}


def test_better_documents_come_first(spark):
    rows = [(i, "word " * 50 if i % 2 else "1234 #*$% " * 25, "en", "s") for i in range(400)]
    got = mixing.mix(edges(spark, rows), weights=(1,), share=0.3, most=2.0).collect()
    good, bad = (sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert abs(good + bad - 0.3 * 400 * 50) <= 50 and good > 1.8 * bad


# packing and tokens


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_is_exact(special_as_text):
    import random

    random.seed(4)
    plain = Tokenizer.from_file(queries.tokenizer())
    plain.encode_special_tokens = special_as_text
    own = Encoder(queries.tokenizer(), entries=500, special_as_text=special_as_text)
    letters = [*"ab'sl .\n\t\r\x0b\x1c\u00a0\u00e91!?  \n\n\u2003\0\1", "<|endoftext|>"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 16))) for _ in range(3000)] + ["", "a", " a", "a ", "don't  do\n\n\nit", "<|endoftext|>", "a <|endoftext|> b", None, "don't. '.s, a.\nb,\n.c"]
    texts += ["".join(random.choice("ab'c .,!\n\u00e9") for _ in range(random.randint(0, 30))) for _ in range(3000)]
    for k in range(0, len(texts), 100):
        ids, bounds = own.encode(pa.array(texts[k : k + 100], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts[k : k + 100]]
    assert own.encode(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("characters", [1, 7, 50, 10_000])
def test_texts_are_encoded_in_parts_of_bounded_size(characters, tokenizer):
    texts = [None, "", "a b", "c" * 40, "", "d e f", None, "g" * 9, *["hi"] * 30]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part))), pa.array(part, pa.string())], ["i", "t"]) for k in range(0, len(texts), 5) for part in [texts[k : k + 5]]]
    got, at = [], []
    for rows, ids, bounds in encoded(iter([*batches, batches[0].slice(0, 0)]), queries.tokenizer(), 1, 2, characters=characters):
        assert rows.num_rows == 1 or sum(len(t or "") for t in rows.column(1).to_pylist()) <= characters
        at += rows.column(0).to_pylist()
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert at == list(range(len(texts))) and got == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check_packing(got, ids, capacity=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, own in ids.items():
        place = 0
        for k, r in enumerate(sorted(pieces[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, place) and zlib.crc32(own[place : place + r["length"]].tobytes()) == r["ids_crc32"]
            assert not k or r["length"] == capacity
            place += r["length"]
        assert place == len(own) and (len(own) > capacity or len(pieces[doc]) == 1)
    for own in sequences.values():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= capacity
    return len(sequences)


def test_op5_and_op7_hold_all_tokens(spark, sf, tokenizer):
    docs = documents(spark, sf)
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t, *_ in docs}
    n = check_packing(queries.op5_best_fit_packing(spark, sf).collect(), ids)
    total = sum(map(len, ids.values()))
    assert -(-total // 1024) <= n <= 1.02 * total / 1024 + 1
    start, want = 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), zlib.crc32(ids[d].tobytes())))
        start += len(ids[d])
    assert sorted(map(tuple, queries.op7_token_orc(spark, sf).collect())) == want


@pytest.mark.parametrize("seed", range(30))
def test_patterns_pack_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, 101, rng.integers(1, 40))}
    packed = Counter()
    for lengths, times in packing.patterns(counts, 100):
        assert times > 0 and sum(lengths) <= 100
        for x in lengths:
            packed[x] += times
    assert packed == counts
    assert packing.patterns({}, 100) == []


@pytest.mark.parametrize("seed", range(200))
def test_replacements_never_need_more_sequences(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 101, rng.integers(1, 40))}
    used = lambda found: sum(times for _, times in found)
    assert used(packing.patterns(counts, 100)) <= used(packing._filled(counts, 100, 0)[0])


def test_two_take_the_smallest_ones_place():
    """60 + 30 leaves 10; 21 and 19 fill 40 exactly where 30 stood."""
    assert packing.patterns({60: 1, 30: 1, 21: 1, 19: 1}, 100) == [([60, 19, 21], 1), ([30], 1)]


def test_pieces_are_packed_with_any_columns_and_more_than_once(spark, monkeypatch):
    """Repeated rows, full pieces, clashing columns, blocks much smaller than the table; lengths that aren't allowed."""
    monkeypatch.setattr(packing, "BLOCK", 7)
    pieces = spark.createDataFrame([(None, n, "x", "y", 1) for n in [100, 100, 60, 30, 21, 19, *[33] * 50, *[1] * 20]], "doc_id long, length long, sequence_id string, offset string, _block int")
    for _ in range(2):
        got = packing.pack(pieces, 100).collect()
        assert Counter(r["length"] for r in got) == Counter(r["length"] for r in pieces.collect()) and got[0].asDict().keys() == {*pieces.columns}
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in sequences.values():
            assert [a for a, _ in sorted(own)] == np.r_[0, np.cumsum([n for _, n in sorted(own)])[:-1]].tolist() and sum(n for _, n in own) <= 100
        assert len(sequences) == 21
    assert packing.pack(pieces.limit(0), 100).count() == 0
    for bad in (0, 101, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,), (5,)], "length long"), 100)


def test_tokens_edge_cases(spark, tokenizer):
    """Nulls, blanks, repeated rows, a special token's name, a very long text."""
    texts = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for d, t, *_ in EDGES)
    assert any(50256 in ids for _, ids in texts) and max(len(ids) for _, ids in texts) > 200_000
    rows = edges(spark)
    got = packing.pack_documents(rows, queries.tokenizer()).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for (d, ids), n in texts.items():
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] * n
        assert sorted(pieces[d]) == sorted(want)
    assert max(Counter((r["sequence_id"], r["offset"]) for r in got).values()) == 1
    assert packing.pack_documents(edges(spark, []), queries.tokenizer()).count() == 0
    path = new_path(spark, "test")
    token_orc.write_tokens(rows, path, queries.tokenizer())
    read = token_orc.read_tokens(spark, path)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in read.collect()) == texts
    starts = sorted((r["start"], r["n_tokens"]) for r in read.collect())
    assert [s for s, _ in starts] == np.r_[0, np.cumsum([n for _, n in starts])[:-1]].tolist()
    assert read.where("doc_id = 4").count() == 1
    empty = new_path(spark, "test")
    token_orc.write_tokens(edges(spark, []), empty, queries.tokenizer())
    assert token_orc.read_tokens(spark, empty).count() == 0


def test_token_starts_hold_in_files_of_any_number(spark, tokenizer):
    """Several files a task, and more parts than rows; a hot id with one text."""
    rows = spark.range(300).selectExpr("id % 100 AS doc_id", "concat('word ', id % 100) AS text").unionByName(spark.range(200).selectExpr("cast(null AS long) AS doc_id", "'hot' AS text"))
    path = new_path(spark, "test")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "9")
    try:
        token_orc.write_tokens(rows, path, queries.tokenizer(), partitions=12)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in token_orc.read_tokens(spark, path).collect())
    assert [d for _, d, _ in got] == sorted(d for _, d, _ in got)
    assert [s for s, *_ in got] == np.r_[0, np.cumsum([n for *_, n in got])[:-1]].tolist()
    hot = spark.read.orc(f"{path}/data").where("doc_id is null").select("part").distinct().count()
    assert hot > 2


def test_orc_files_skip_what_a_lookup_does_not_need(spark, capsys):
    """Stripes, row groups and Bloom filters are in the files, and a lookup of an id reads few rows."""
    path = new_path(spark, "test")
    rows = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    token_orc.write_tokens(rows, path, queries.tokenizer(), partitions=2)
    read = token_orc.read_tokens(spark, path)
    read.where("doc_id = 77").explain("formatted")
    assert "EqualTo(doc_id,77)" in capsys.readouterr().out
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [f.replace("file://", "") for f in spark.read.orc(f"{path}/data").inputFiles()]
    rows = 0
    for name in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows += reader.getNumberOfRows()
        assert reader.getRowIndexStride() == 1000
        inside = reader.rows()
        for stripe in reader.getStripes():
            kinds = Counter((s.getColumn(), s.getKind().toString()) for s in inside.readStripeFooter(stripe).getStreamsList())
            assert kinds[1, "ROW_INDEX"] == 1 and kinds[1, "BLOOM_FILTER_UTF8"] == 1  # of doc_id, the first column
        inside.close()
    assert rows == 20_000
    assert read.where("doc_id = 78").count() == 1 and read.where("doc_id = 77").count() == 0


# classifier


def test_op9_on_held_out_labels(spark, sf):
    got = {r["doc_id"]: r for r in queries.op9_rule_ensemble(spark, sf).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert held and sum(p == q for p, q in held) >= 0.9 * len(held)


def test_classifier_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 0), (4, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    got = rule_ensemble.classify(edges(spark), labels)
    assert got.count() == len(EDGES) and got.where("score between 0 and 1 and predicted is not null").count() == len(EDGES)
    assert rule_ensemble.classify(edges(spark, []), labels).count() == 0
    none = rule_ensemble.classify(edges(spark), labels.limit(0))
    assert {r["score"] for r in none.select("score").collect()} == {0.5}


def test_rules_are_conjunctions_over_statistics(spark):
    model = rule_ensemble.RuleEnsemble(-1.0, ((((0, True, 1.0), (1, False, 2.0)), 3.0),))
    got = spark.createDataFrame([([2.0, 2.0],), ([2.0, 3.0],), ([1.0, 0.0],)], "s array<double>").select(model.score(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([1 / (1 + np.exp(-2)), 1 / (1 + np.exp(1)), 1 / (1 + np.exp(1))])
    assert rule_ensemble._tightest(((0, True, 1.0), (0, True, 2.0), (0, False, 5.0), (0, False, 4.0))) == ((0, False, 4.0), (0, True, 2.0))
