"""Hard negatives, token counts of prefixes and spelling variants against brute force, and their edge cases."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import hard_negatives, queries, spelling, token_counts

VECTORS = "vec_id long, embedding array<double>, label int, row string, vector string, windows int"


# hard negatives


def plain_negatives(rows, anchor, low=30, high=90):
    """(anchor, positive, rank, negative, scores) over rows (id, vector, label), all pairs scored."""
    own = []
    for name, v, label in {(n, None if v is None else tuple(v), lab) for n, v, lab in rows}:
        if name is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            own.append((name, [int(np.floor(256 * x)) for x in v], label))
    out = []
    for a, v, label in own:
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), name, kind) for name, w, kind in own if name != a and len(w) == len(v)]
        for p, name, _ in sorted(s for s in scored if s[2] == label)[:5]:
            hard = sorted((s, n) for s, n, kind in scored if kind != label and 100 * -s >= low * -p and 100 * -s <= high * -p)[:10]
            out += [(a, name, i, n, -p, -s) for i, (s, n) in enumerate(hard, 1)]
    return sorted(out)


def mined(rows, spark, anchor="id % 3 = 0", **options):
    df = spark.createDataFrame([(n, v, lab, "x", "y", 1) for n, v, lab in rows], VECTORS)
    return sorted(map(tuple, hard_negatives.mine(df, F.expr(anchor), **options).collect()))


def test_op11_same_rows_as_sql(same_rows):
    same_rows(queries.op11_hard_negatives, queries.ORACLE_SQL["op11_hard_negatives"])


@pytest.mark.parametrize("part,codes,rows,anchors", [(2, 256, 1 << 16, 1 << 14), (3, 4, 37, 11), (1, 2, 50, 1)])
def test_negatives_against_brute_force(spark, monkeypatch, part, codes, rows, anchors):
    """One label has a third of the rows; coarse codes and small tiles change nothing."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((240, 7)) + 0.4
    vectors[100:110] = vectors[100]  # ties
    data = [(i, list(map(float, v)), 0 if i % 3 == 0 else i % 11) for i, v in enumerate(vectors)]
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    want = plain_negatives(data, lambda a: a % 10 == 0)
    assert want and mined(data, spark, "id % 10 = 0", part=part, codes=codes) == want


def test_negatives_edge_cases(spark):
    """Nulls, NaN, infinity, zero and huge vectors, other lengths, empty ones, repeated rows and ids, one label, an empty table."""
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.2], 2), (2, [0.5, 0.2], 2), (2, [0.4, 0.3], 1), (3, [0.0, 0.0], 2), (4, [-1.0, 0.1], 1), (5, None, 1), (6, [1.0, 1.0], None),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 2), (9, [1.0, None], 2), (10, [0.7, 0.1], 3), (11, [0.4, 0.4, 0.4], 1), (12, [0.4, 0.4, 0.5], 1), (13, [0.2, 0.4, 0.4], 2), (15, [], 1), (16, [], 1), (18, [], 2), (None, [1.0, 0.4], 1), (21, [0.3, 0.3], 2),
    ]
    want = plain_negatives(data, lambda a: a % 3 == 0)
    assert {w[0] for w in want} >= {0, 12, 15} and mined(data, spark) == want
    huge = [(30, [1e300, 1.0], 1), (33, [2.0**40, 1.0], 2), (36, [2.0**21, 2.0**20], 1), (37, [2.0**21, 2.0**19], 1), (38, [2.0**20, 2.0**19], 2)]
    assert mined(data + huge, spark) == plain_negatives(data + huge[2:], lambda a: a % 3 == 0)
    assert mined([(i, [1.0, float(i)], 1) for i in range(9)], spark) == [] and mined([], spark) == [] and mined(data, spark, "id < 0") == []


def test_bounds_hold(spark):
    rng = np.random.default_rng(6)
    v = np.floor(rng.standard_normal((500, 9)) * 1000)
    q = hard_negatives.Quantiser(v[:100], 2, 16)
    code, left = q.encode(v)
    low, high = q.intervals(v[:50], code, left)
    exact = v[:50] @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 2 * np.abs(exact).max()


# token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(queries.tokenizer())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.tokenizer())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


PARTS = ["a", "the", "ing", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'re", "'ll", "'v", "'s", "é", "ß", "漢字", "😀", "!", "...", "----", "1", "23", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\0", "　", " ", "\x0b", "ÃÂÃÂ", "A" * 13, "ı"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=12)), max_size=4))
def test_every_prefix_counts_as_the_library_says(counter, library, texts):
    steps, bounds = counter.steps(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert np.cumsum(steps[bounds[i] : bounds[i + 1]]).tolist() == [library(text[:k]) for k in range(1, len(text) + 1)]


def test_op12_against_the_library(spark, sf, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op12_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: (len(r["text"].encode()), n, n > 1024) for r in docs for n in [library(r["text"])]}


def test_budgets_and_places_without_encoding(spark, library, monkeypatch):
    """Blocks of three characters; null and empty texts, repeated ids, special tokens, clashing names, a long text."""
    monkeypatch.setattr(token_counts, "BLOCK", 3)
    texts = [None, "", "a", "one two\n\nthree  four", "don't<|endoftext|>you  <|endoftext|>", "x" * 50, "-" * 70 + " é漢字"]
    data = [(i if i != 3 else 2, t, "n", 5, "s") for i, t in enumerate([*texts, texts[3]])]
    docs = spark.createDataFrame(data, "doc_id long, text string, row string, block int, steps string").coalesce(1)
    table = token_counts.prefix_table(docs, queries.tokenizer())
    names = {r["row"]: texts[i] if i < len(texts) else texts[3] for i, r in enumerate(table.where("last").orderBy("row").collect())}
    for budget in (0, 1, 2, 3, 5, 100):
        got = {r["row"]: (r["n_chars"], r["n_tokens"]) for r in token_counts.truncated(table, budget).collect()}
        assert got == {row: max((k, library(t[:k])) for k in range(len(t) + 1) if library(t[:k]) <= budget) for row, t in ((r, x or "") for r, x in names.items())}
    with pytest.raises(ValueError):
        token_counts.truncated(table, -1)
    asked = [(row, k) for row, t in names.items() for k in [0, 1, 3, 4, 7, 12, 1000]] + [(next(iter(names)), None), (next(iter(names)), -1), (999, 1), (None, 1)]
    got = Counter((r["row"], r["n_chars"], r["tokens"]) for r in token_counts.tokens_at(table, spark.createDataFrame(asked, "row long, n_chars long")).collect())
    assert got == Counter((row, k, library((names[row] or "")[:k]) if row in names and k is not None and k >= 0 else None) for row, k in asked)
    assert token_counts.prefix_table(docs.limit(0), queries.tokenizer()).count() == 0


def test_prefix_blocks_of_a_long_text(spark, library):
    text = "word, other words\n" * 12_000
    table = token_counts.prefix_table(spark.createDataFrame([(1, text)], "doc_id long, text string"), queries.tokenizer())
    assert [(r["block"], r["start"], r["n_chars"]) for r in table.orderBy("block").collect()] == [(k, k << 16, min(1 << 16, len(text) - (k << 16))) for k in range(4)]
    assert token_counts.totals(table).first()["n_tokens"] == library(text)


def test_other_tokenizers_are_refused(tmp_path):
    (tmp_path / "t.json").write_text('{"model": {"type": "WordPiece"}, "added_tokens": []}')
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(str(tmp_path / "t.json"))


# spelling variants


def plain_variants(words):
    known = {w: n for w, n in Counter(words).items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in known.items():
        others = sorted((-m, o) for o, m in known.items() if near(w, o))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        out[w] = (n, len(others))
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), *out[w], known.get(form[w])) for w in known)


def variants(spark, words, **options):
    found = spelling.group_variants(spark.createDataFrame([(w, "x") for w in words], "word string, key string"), **options)
    return sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_op13_same_rows_as_sql(same_rows):
    same_rows(queries.op13_spelling_variants, queries.ORACLE_SQL["op13_spelling_variants"])


def test_variants_against_brute_force(spark):
    """Chains of forms, ties, repeated letters, exchanged neighbours, letters beyond ASCII."""
    rng = np.random.default_rng(7)
    bases = ["letter", "aabbaab", "straße", "garçon", "ababab", "mississippi"]
    words = []
    for base in bases:
        for _ in range(60):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                i = int(rng.integers(0, len(w)))
                kind = rng.integers(0, 4)
                if kind == 0:
                    del w[i]
                elif kind == 1:
                    w.insert(i, "abçé"[rng.integers(0, 4)])
                elif kind == 2:
                    w[i] = "abçé"[rng.integers(0, 4)]
                elif i:
                    w[i - 1], w[i] = w[i], w[i - 1]
            words += ["".join(w)] * int(rng.integers(2, 9) ** 2)
    want = plain_variants(words)
    assert any(r[1] and r[1] != r[2] for r in want) and variants(spark, words) == want


def test_variants_edge_cases(spark):
    chain = ["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96
    tied = ["cccca"] * 3 + ["ccccb"] * 6 + ["ccccd"] * 6
    rare = ["ddddd"] * 2 + ["dddd"] * 9 + ["eeeee"] * 3
    want = plain_variants(chain + tied + rare)
    assert {r[2] for r in want if r[0] == "aaaaa"} == {"bbbbb"} and ("cccca", "ccccb", "ccccb", 3, 2, 6) in want
    assert variants(spark, [*chain, *tied, *rare, None, ""]) == want
    assert variants(spark, []) == []
    with pytest.raises(ValueError):
        variants(spark, chain, ratio=1)


def test_occurrences_with_planted_deletions(spark):
    """Nulls, empty and long texts, A-Z in lower case and no other letter, hashes as zlib gives them."""
    long = " ".join(f"Wört{chr(97 + i % 26)}{'x' * (i % 7)}" for i in range(30_000))
    data = [(1, None, "a"), (2, "", "a"), (3, "ÀB cd×eĀf 'x'", "a"), (4, long, "a"), (None, "Word word", "a"), (4, "same", "a"), (4, "same", "a")]
    got = Counter(r["word"] for r in spelling.occurrences(spark.createDataFrame(data, "doc_id long, text string, run string")).collect())
    want = Counter()
    for doc, text, _ in data:
        word = ""
        for ch in [*(text or ""), " "]:
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                word += ch.lower() if ch.isascii() else ch
            elif word:
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                want[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
                word = ""
    assert got == want
