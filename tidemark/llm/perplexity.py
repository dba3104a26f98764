"""Quality rules by n-gram perplexity: a modified Kneser-Ney model counted by Spark, kept in sorted hash arrays.

The symbols are characters: a text is its words with a blank after each, and a symbol's context is the ORDER - 1 symbols
before, across words. All windows of all texts are counted and none is dropped. The model is a table with a row for each
different window, which Spark works out by joins; texts look their windows up in it block by block, a block being a
sorted hash array of bounded size. Each language has its own counts, discounts and bands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import rows_of, stage, worker_table

ORDER = 5
#: Different windows held by a task before they are given out.
HELD = 1_500_000
#: Windows in one block of the model: what is broadcast at a time is 12 bytes for each.
BLOCK = 4_000_000
#: Characters worked on at a time.
CHARACTERS = 1 << 20
#: Stands before a text; a null character in a text counts as a replacement character.
PAD = "\0"
_BLANKS = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode()) + (ORDER << 32)


def _hash(columns: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """64 bits for each window, given as its symbols' code points one after the other, of a language."""
    h = seeds.astype(np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given as words: all code points, each text after its padding; where windows end; and for each window its
    text's place."""
    pad = PAD * (ORDER - 1)
    parts = [(b" ".join([*words, b""])).decode(errors="replace").replace(PAD, "\ufffd") for words in texts]
    points = np.frombuffer("".join(pad + p for p in parts).encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(points)
    return points, ends, np.repeat(np.arange(len(parts)), list(map(len, parts)))


def _window_hashes(points: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return _hash([points[ends - k] for k in range(ORDER - 1, -1, -1)], seeds)


def _chunks(rows: Iterator[tuple], text: int) -> Iterator[list[tuple]]:
    """Rows with about CHARACTERS characters at a time in place `text`; a longer text alone or at the end of a chunk."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[text] or "")
        if size >= CHARACTERS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _noted(batches: Iterator[pa.RecordBatch], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The batches; types gets those of their columns."""
    for batch in batches:
        types[:] = batch.schema.types
        yield batch


class _Counts:
    """Different windows with their numbers, languages and symbols."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, h: np.ndarray, n: np.ndarray, lang: np.ndarray, grams: np.ndarray) -> None:
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        self.parts.append((h[first], np.bincount(which, n).astype(np.int64), lang[first], grams[first]))
        self.size += len(first)

    def merge(self) -> None:
        if len(self.parts) > 1:
            whole = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            self.add(*whole)

    def give(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        self.merge()
        for _, n, lang, grams in self.parts:
            for k in range(0, len(n), 50_000):
                own = slice(k, k + 50_000)
                text = np.ascontiguousarray(grams[own]).view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in lang[own].tolist()]), pa.array(text, pa.string()), pa.array(n[own])], ["lang", "gram", "n"])
        self.parts, self.size = [], 0


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each window of ORDER symbols occurs in all texts of a language. Tasks add up their
    windows first and give each out once, so little is shuffled and no language is one task's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        counts, names, merged = _Counts(), {}, 0
        for part in _chunks(chain.from_iterable(map(rows_of, batches)), 1):
            points, ends, own = _symbols([text.encode().split() for _, text in part])
            if not len(ends):
                continue
            langs = np.array([names.setdefault(lang, len(names)) for lang, _ in part])[own]
            h = _window_hashes(points, ends, np.array([_seed(lang) for lang, _ in part], np.uint64)[own])
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            grams = np.stack([points[ends[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1)
            counts.add(h[first], n, langs[first], grams)
            if counts.size > merged + HELD:
                counts.merge()
                merged = counts.size
                if merged > HELD:
                    yield from counts.give(list(names))
                    merged = 0
        yield from counts.give(list(names))

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): Chen and Goodman's discounts of counts 1, 2 and more, from the counts of counts of each
    language; where those are too few, their usual sizes."""
    many = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == x, 1.0).otherwise(0.0)).alias(f"t{x}") for x in (1, 2, 3, 4)])
    enough = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0) & (F.col("t4") > 0)
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    own = lambda x, usual: F.when(enough, F.greatest(F.lit(0.05), F.least(F.lit(x - 0.05), x - (x + 1) * y * F.try_divide(F.col(f"t{x + 1}"), F.col(f"t{x}"))))).otherwise(usual).alias(f"d{x}")
    return many.select(F.col("lang").alias("d_lang"), own(1, 0.5), own(2, 0.75), own(3, 0.9))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, log_p) from (lang, gram, n): the natural logarithm of the probability of each window's last symbol
    after those before it, by interpolated modified Kneser-Ney smoothing.

    Lower orders count the different symbols before an n-gram (at a text's start, its occurrences); the lowest is
    interpolated with an even share for each symbol and one that was never seen. Every suffix of a window that occurs
    occurs, so an order's table has all that the next one needs, and the orders are joined from the lowest up.
    """
    tables = {ORDER: stage(counts, f"grams-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        seen = F.when(F.col("gram").startswith(PAD), F.sum("n")).otherwise(F.count("*"))
        longer = tables[k + 1].select("lang", F.substring("gram", 2, k).alias("gram"), "n")
        tables[k] = stage(longer.groupBy("lang", "gram").agg(seen.alias("n")), f"grams-{k}")
    symbols = tables[1].groupBy("lang").agg(F.count("*").alias("symbols"))
    lower = stage(symbols.select(F.col("lang").alias("l_lang"), F.lit("").alias("l_gram"), (1 / (F.col("symbols") + 1)).alias("l_p")), "share-of-a-symbol")
    for k in range(1, ORDER + 1):
        rows = tables[k].join(stage(discounts(tables[k]), "discounts"), F.col("lang") == F.col("d_lang")).drop("d_lang")
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"), "n", off.alias("off"))
        contexts = rows.groupBy(F.col("lang").alias("c_lang"), F.col("context").alias("c_gram")).agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        rows = rows.join(contexts, (F.col("lang") == F.col("c_lang")) & (F.col("context") == F.col("c_gram")))
        rows = rows.join(lower, (F.col("lang") == F.col("l_lang")) & (F.col("suffix") == F.col("l_gram")))
        p = (F.col("n") - F.col("off") + F.col("left") * F.col("l_p")) / F.col("total")
        if k < ORDER:
            lower = stage(rows.select(F.col("lang").alias("l_lang"), F.col("gram").alias("l_gram"), p.alias("l_p")), f"probabilities-{k}")
    return rows.select("lang", "gram", F.log(p).alias("log_p"))


def hashed(model: DataFrame) -> DataFrame:
    """(hash long, log_p float) of (lang, gram, log_p)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
            langs = batch.column(0).to_pylist()
            seeds = {lang: _seed(lang) for lang in set(langs)}
            h = _hash(list(points.T), np.array([seeds[x] for x in langs], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], ["hash", "log_p"])

    return model.mapInArrow(work, "hash long, log_p float")


def _looked_up(block: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Values of the block's sorted keys, 0 for others."""
    keys, values = block
    order = np.argsort(h)
    wanted = h[order]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = np.empty(len(h))
    out[order] = np.where(keys[at] == wanted, values[at], 0)
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, perplexity) of every row, by the model
    of all texts; perplexity is that of a symbol, null without words.

    The model is dealt into blocks of about `block` windows by hash, one for most corpora. Each block is broadcast and
    all texts add up the windows that it has; sums of several blocks meet by id, language and the text's hash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    model = stage(hashed(log_probabilities(count_grams(docs, text_col, lang_col))), "model")
    blocks = max(1, -(-model.count() // block))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "lang", "own", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "total"]

    def scores(number: int) -> DataFrame:
        held = model.where(F.pmod("hash", F.lit(blocks)) == number).toArrow()
        keys, values = held.column("hash").to_numpy().view(np.uint64), held.column("log_p").to_numpy()
        order = np.argsort(keys)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], values[order]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_table()
            types: list[pa.DataType] = []
            for part in _chunks(chain.from_iterable(map(rows_of, _noted(batches, types))), 3):
                words = [(text or "").encode().split() for *_, text in part]
                points, ends, own = _symbols(words)
                sums = np.zeros(len(part))
                if len(ends):
                    h = _window_hashes(points, ends, np.array([_seed(lang) for _, lang, *_ in part], np.uint64)[own])
                    sums = np.bincount(own, _looked_up(shared.value, h), len(part))
                measures = [[None] * 5 if number else base(text or "", w) for (*_, text), w in zip(part, words, strict=True)]
                columns = [*zip(*[row[:3] for row in part], strict=True), *zip(*measures, strict=True), sums.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [types[0], pa.string(), *[pa.int64()] * 6, pa.float64()], strict=True)], names)

        return rows.mapInArrow(work, f"doc_id {kind}, lang string, own long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, total double")

    out = scores(0)
    if blocks > 1:
        keys = ["doc_id", "lang", "own"]
        more = [stage(scores(k).select(*keys, F.lit(k).alias("block"), "total"), "window-sums") for k in range(1, blocks)]
        every = more[0]
        for m in more[1:]:
            every = every.unionByName(m)
        every = every.groupBy(*keys, "block").agg(F.first("total").alias("total")).groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(F.sum("total").alias("rest"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"m_{k}"))
        out = stage(out, "window-sums").join(stage(every, "window-sums"), same).withColumn("total", F.col("total") + F.col("rest"))
    perplexity = F.when(F.col("n_words") > 0, F.exp(-F.col("total") / (F.col("word_chars") + F.col("n_words"))))
    return out.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", perplexity.alias("perplexity"))


def base(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    data = text.encode()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, _BLANKS)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_BLANKS)]
    index: dict[bytes, int] = {}
    numbers = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    again = 0
    if n >= 3:
        pairs = np.unique(numbers[:-1] * len(index) + numbers[1:], return_inverse=True)[1]  # so that three words fit in 63 bits
        keys = pairs[:-1] * len(index) + numbers[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            twice = np.zeros(n, bool)
            found = np.zeros(n - 2, bool)
            found[order[1:][same]] = True
            found[order[:-1][same]] = True
            for k in range(3):
                twice[k : n - 2 + k] |= found
            again = int(twice.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), again


def bands(measured: DataFrame, width: float = 2.0, floor: float = 0.01) -> DataFrame:
    """(lang, lower, upper): each language's quartiles of the logarithm of perplexity over texts that passed the base
    rules, moved out by `width` times their distance (taken as `floor` at least)."""
    logs = measured.where("not base_failed").groupBy("lang").agg(F.percentile_approx(F.log("perplexity"), [0.25, 0.75], 10_000).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(floor)) * width
    return logs.select(F.col("lang").alias("band_lang"), F.exp(F.col("q")[0] - spread).alias("lower"), F.exp(F.col("q")[1] + spread).alias("upper"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judge(docs: DataFrame, width: float = 2.0, block: int = BLOCK) -> DataFrame:
    """Measures, base_failed, perplexity, the language's lower and upper band, and kept, of every row of docs (doc_id,
    text, lang). kept is false for rows that fail the base rules or whose perplexity is outside of their language's band.

    A null text is like an empty one: no words, base_failed. A null language is a language of its own, named by an empty
    string. Rows that repeat an id are rows like others; an empty table gives an empty result. The columns lower and
    upper are null for languages in which no text passed the base rules; there the base rules alone decide.
    """
    measured = measure(docs, block=block)
    measured = stage(measured.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "measured")
    rows = measured.join(stage(bands(measured, width), "bands"), F.col("lang") == F.col("band_lang"), "left").drop("band_lang")
    inside = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)
