"""Exact token counts of every prefix of a text, by dynamic programming over the bytes of its pieces.

The last token of a byte-pair encoding of a prefix is the one token that ends there and may follow the last token of what
is before it; so last tokens, and with them counts, of all prefixes come from one pass, without encoding any prefix again.
What is stored is the step of the count at each character, in blocks; questions about budgets and truncation read those.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm.shared import new_path, small_batches, worker_table
from tidemark.llm.tokens import _parts, _spans

#: White space as the tokenizer's pattern knows it, for RE2 and for Python.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASS = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{m[1]:0>4}", _SPACE)
_SPACES, _UNITS = re.compile(f"[{_CLASS}]*"), re.compile(f"[{_CLASS}]*[^{_CLASS}]+|[{_CLASS}]+")
#: Units end where white space begins; the mark is put between.
_MARK, _EDGE = "\0", f"([^{_SPACE}])([{_SPACE}])"
#: The tokenizer's pattern also ends a piece between a letter and such marks, whatever follows; cut there, words repeat more.
_ENDED = r"(\pL)([.,;:!?])"
#: Contractions that the tokenizer keeps as one piece; before their last letter they are two.
_SHORT = ("'re", "'ve", "'ll")
#: After all merges.
_NEVER = 1 << 62
#: Below this code point all versions of Unicode agree on what a letter is.
_OLD_LETTERS = "\u0180"
#: Characters of one block of the table of prefixes.
BLOCK = 1 << 16


class PrefixCounter:
    """Token counts of all prefixes of texts, as the tokenizers library counts the prefix by itself with
    add_special_tokens False, for files with byte-level BPE. A prefix is a number of code points.

    A unit is white space and what follows up to the next white space, or up to a mark behind a letter. The pattern that cuts a text looks ahead only from
    white space to what follows it, so the units before the one that a prefix ends in count as in the whole text, and that
    one counts as a text by itself. Units met before come from a table of about `entries` units; it changes no result."""

    def __init__(self, path: str, entries: int = 400_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = [t for t in spec.get("added_tokens", ())]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not spec.get("normalizer") and not model.get("ignore_merges")
        if model.get("type") != "BPE" or not plain or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: prefixes are counted for byte-level BPE without a normalizer only")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.vocab = model["vocab"]
        self.longest = max(map(len, self.vocab))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(merges)))}
        self.made = {a + b: ((a, b), rank) for (a, b), rank in self.ranks.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        rank_of = lambda token: self.made[token][1] if token in self.made else -1
        # one merge for each token, made of tokens of earlier merges; else pairs are put to the library
        self.plain = len(self.made) == len(self.ranks) and all(rank > max(rank_of(a), rank_of(b)) for (a, b), rank in self.ranks.items())
        self.model = Tokenizer(models.BPE(self.vocab, merges))  # of letters that stand for bytes, without cutting
        # printable bytes stand for themselves, the others take the next code points from 256 on
        rest = iter(range(256, 512))
        self.letters = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(rest)) for b in range(256)]
        self.ascii = str.maketrans({b: self.letters[b] for b in range(128)})
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.apart = "|".join([r"\x00", *map(re.escape, names)])
        self.entries, self.pairs, self.pieces, self.young, self.old = entries, {}, {}, {}, {}

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at a token's left (0) or right (1) end while its merges are made, each with the rank of the merge
        that takes it in; the token itself last."""
        spine = self.spines[side].get(token)
        if spine is None:
            pair, rank = self.made.get(token, (None, 0))
            spine = self.spines[side][token] = [*[(x, min(r, rank)) for x, r in self._spine(pair[side], side)], (token, _NEVER)] if pair else [(token, _NEVER)]
        return spine

    def _may_follow(self, a: str, b: str) -> bool:
        """Whether the bytes of a and b together are encoded as those two tokens (a empty: b as itself).

        They aren't if, before either end is taken in by its own side, a merge across the edge has its turn: merges go by
        rank, and of equal ones the left one first. Ranks rise along a spine, since a merge's parts are made before it."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            if not a or not self.plain:
                known = self.model.encode(a + b).tokens == ([a, b] if a else [b])
            else:
                known = self._may_follow("", b)
                if known:
                    ranks, starts = self.ranks, self._spine(b, 0)
                    for x, left in self._spine(a, 1):
                        for y, right in starts:
                            rank = ranks.get((x, y))
                            if rank is not None and rank < left and rank <= right:
                                known = False
            self.pairs[a, b] = known
        return known

    def _piece(self, piece: str) -> list[int]:
        """Counts of all prefixes, in bytes, of a piece written in letters that stand for bytes; those of none first."""
        counts, last = [0], [""]
        vocab, longest, pairs = self.vocab, self.longest, self.pairs
        for stop in range(1, len(piece) + 1):
            for start in range(stop - longest if stop > longest else 0, stop):
                token = piece[start:stop]
                if token in vocab:
                    follows = pairs.get((last[start], token))
                    if self._may_follow(last[start], token) if follows is None else follows:
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
            else:
                raise ValueError("the tokenizer has no token for some byte")
        return counts

    def _letters(self, text: str) -> str:
        """text's bytes as the letters that stand for them."""
        return text.translate(self.ascii) if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))

    def _run(self, piece: str, text: str) -> bytes:
        """Steps of the counts of a piece's prefixes, `text` being the piece in its own characters."""
        steps = self.pieces.get(piece)
        if steps is None:
            counts = self._piece(piece)
            if len(text) != len(piece):
                counts = [0, *[counts[k] for k in accumulate(len(ch.encode()) for ch in text)]]
            if text in _SHORT:
                counts[2] = 2
            steps = self.pieces[piece] = array("h", map(sub, counts[1:], counts)).tobytes()
        return steps

    def _unit(self, unit: str) -> bytes:
        """Steps of the counts of the prefixes of a unit that has no special token."""
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()) and max(unit) < _OLD_LETTERS:
            return self._run(self._letters(unit), unit)  # one piece, as most are
        cut = self.cutter.pre_tokenize_str(unit)
        steps = b"".join([self._run(piece, unit[a:b]) for piece, (a, b) in cut])
        blank = _SPACES.match(unit).end()
        if blank > 1:  # white space at a prefix's end is one piece, also where more follows in the unit
            run = array("h", self._run("".join(piece for piece, _ in self.cutter.pre_tokenize_str(unit[:blank])), unit[:blank]))
            if blank < len(unit):
                run.append(sum(array("h", steps[: 2 * blank + 2])) - sum(run))
            steps = run.tobytes() + steps[2 * len(run) :]
        return steps

    def _steps(self, units: list[str]) -> list[bytes]:
        """For each unit the steps of its counts, two bytes each."""
        here = list(map(self.young.get, units))
        for i, steps in enumerate(here):
            if steps is None:
                steps = self.old.get(units[i])
                if steps is None:
                    steps = self._unit(units[i])
                self.young[units[i]] = here[i] = steps
        if len(self.young) > self.entries // 2:
            self.young, self.old = {}, self.young
        if len(self.pieces) > self.entries:
            self.pieces.clear()
        return here

    def _one(self, text: str) -> np.ndarray:
        """Steps of any text. Inside a special token's name a prefix ends in ordinary text; with its last letter it is one
        token, and what was before stands as if the text had ended there."""
        steps, at = [], 0
        for m in self.special.finditer(text):
            before = text[at : m.start()]
            own = self._ordinary(before + m.group()[:-1])
            steps += [own, np.array([1 - own[len(before) :].sum()], np.int16)]
            at = m.end()
        return np.concatenate([*steps, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self._steps(_UNITS.findall(text))), "i2")

    def steps(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(steps, bounds) of texts (null: empty): the steps of text i are steps[bounds[i]:bounds[i + 1]], one for each
        code point; their sum up to a place is the count of the prefix that ends there."""
        texts = pc.fill_null(texts, "")
        apart = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False)
        marked = pc.if_else(pa.array(apart), "", texts)
        for edge in (_ENDED, _EDGE):
            marked = pc.replace_substring_regex(marked, edge, f"\\1{_MARK}\\2")
        cut = pc.split_pattern(marked, _MARK)
        coded = pc.dictionary_encode(cut.flatten())
        found = self._steps(coded.dictionary.to_pylist())
        index, counts = coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        every = np.flatnonzero(apart)  # cut in Python; in the others' flat list each of these is one empty unit
        index = index.astype(np.int64)
        index[(np.cumsum(counts) - counts)[every]] = np.arange(len(every)) + len(found)
        found += [self._one(texts[i].as_py()).astype("i2").tobytes() for i in every]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        own = size[index]
        steps = np.frombuffer(b"".join(found), "i2")[_spans((np.cumsum(size) - size)[index], own)]
        return steps, np.r_[0, np.cumsum(own)][np.r_[0, np.cumsum(counts)]]


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of all prefixes of all whole texts, as a table in the shared folder: a row for each block of BLOCK code
    points of a text, (doc_id, row, n_bytes, block, start, n_chars, before, least, tokens, last, steps). row tells rows
    apart that repeat an id, n_bytes is the text's UTF-8 length, start the code points before the block, before the count
    there, least the smallest count of a prefix that ends in the block, tokens the count at its end, last true for a text's
    last block. steps has the change of the count at each of its n_chars code points, as integers of so many bytes as
    the largest needs: count(start + i) is before plus the first i steps.

    A null or empty text is one block without characters and 0 tokens. Counts fall as well as rise along a text, since a
    longer token can take the place of several. Texts of any length are counted whole; a block bounds what a row holds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    names = ["doc_id", "row", "n_bytes", "block", "start", "n_chars", "before", "least", "tokens", "last", "steps"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_table(f"prefixes {path}", lambda: PrefixCounter(path))
        for part in _parts(batches, 3, 4 << 20):
            steps, bounds = counter.steps(part.column(3))
            total = np.r_[0, np.cumsum(steps, dtype=np.int64)]
            n = np.diff(bounds)
            blocks = np.maximum(-(-n // BLOCK), 1)
            text = np.repeat(np.arange(len(n)), blocks)
            block = _spans(np.zeros(len(n), np.int64), blocks)
            first, stop = bounds[text] + block * BLOCK, np.minimum(bounds[text] + (block + 1) * BLOCK, bounds[text + 1])
            base = total[bounds[text]]
            least = [int(total[a + 1 : b + 1].min()) if b > a else int(total[a]) for a, b in zip(first, stop, strict=True)] - base
            packed = [_packed(steps[a:b]) for a, b in zip(first, stop, strict=True)]
            own = [part.column(k).take(pa.array(text)) for k in range(3)]
            made = [block, first - bounds[text], stop - first, total[first] - base, least, total[stop] - base, block + 1 == blocks[text]]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, made), pa.array(packed, pa.binary())], names)

    table = rows.mapInArrow(work, "doc_id long, row long, n_bytes long, block long, start long, n_chars long, before long, least long, tokens long, last boolean, steps binary")
    place = new_path(docs.sparkSession, "prefix-counts")
    with small_batches(docs.sparkSession):
        table.write.option("compression", "zstd").parquet(place)
    return docs.sparkSession.read.schema(table.schema).parquet(place)


def _packed(steps: np.ndarray) -> bytes:
    small = steps.astype(np.int8)
    return (small if (small == steps).all() else steps).tobytes()


def _counts(before: int, n: int, steps: bytes) -> np.ndarray:
    """The counts of the prefixes that end in a block, the one that ends before it first."""
    kind = f"i{len(steps) // n}" if n else "i1"
    return before + np.r_[0, np.cumsum(np.frombuffer(steps, kind), dtype=np.int64)]


def totals(table: DataFrame) -> DataFrame:
    """(doc_id, row, n_bytes, n_tokens) of each text: what its last block says."""
    return table.where("last").select("doc_id", "row", "n_bytes", F.col("tokens").alias("n_tokens"))


def truncated(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, row, n_chars, n_tokens): the longest prefix of each text that has `budget` tokens at most. Blocks whose
    every prefix has more are left out by the scan's statistics or its filter."""

    @F.pandas_udf("struct<n_chars: long, n_tokens: long>")
    def last(start, n, before, steps):
        import pandas as pd

        found = []
        for a, k, b, s in zip(start, n, before, steps, strict=True):
            counts = _counts(b, k, s)
            i = int(np.flatnonzero(counts <= budget)[-1])
            found.append((a + i, int(counts[i])))
        return pd.DataFrame(found, columns=["n_chars", "n_tokens"])

    if budget < 0:
        raise ValueError("a budget is 0 or more")
    fits = table.where(F.col("least") <= budget).select("row", last("start", "n_chars", "before", "steps").alias("p"))
    longest = fits.groupBy("row").agg(F.max("p").alias("p"))
    every = table.where("last").select("doc_id", "row").join(longest, "row", "left")
    zero = F.lit(0).cast(LongType())
    return every.select("doc_id", "row", F.coalesce("p.n_chars", zero).alias("n_chars"), F.coalesce("p.n_tokens", zero).alias("n_tokens"))


def tokens_at(table: DataFrame, places: DataFrame, at: Column | str = "n_chars") -> DataFrame:
    """places (row, and a column or expression `at` of prefix lengths) with tokens: the count of the text's prefix of so
    many code points; of the whole text where it is shorter, null where there is no such text or the length is null or
    negative. Other columns of places stay; only the blocks that places name are read into counts."""

    @F.pandas_udf("long")
    def count(n, before, steps, i):
        import pandas as pd

        return pd.Series([int(_counts(b, k, s)[min(j, k)]) for k, b, s, j in zip(n, before, steps, i, strict=True)])

    length = F.col(at) if isinstance(at, str) else at
    asked = places.withColumn("_tm_ask", F.monotonically_increasing_id()).withColumn("_tm_at", length.cast("long"))
    ends = table.where("last").select(F.col("row").alias("_tm_row"), F.col("block").alias("_tm_last"))
    wanted = asked.join(ends, F.col("row") == F.col("_tm_row")).where("_tm_at >= 0")
    wanted = wanted.select("_tm_row", "_tm_ask", "_tm_at", F.least(F.floor(F.greatest(F.col("_tm_at") - 1, F.lit(0)) / BLOCK), F.col("_tm_last")).alias("_tm_block"))
    blocks = table.select(F.col("row").alias("_tm_row"), F.col("block").alias("_tm_block"), "start", "n_chars", "before", "steps")
    found = wanted.join(blocks, ["_tm_row", "_tm_block"]).select("_tm_ask", count("n_chars", "before", "steps", F.col("_tm_at") - F.col("start")).alias("tokens"))
    return asked.join(found, "_tm_ask", "left").drop("_tm_ask", "_tm_at")
