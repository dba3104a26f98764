"""Token ids of whole texts by a public tokenizer file, encoded in pieces that repeat.

A batch of texts is cut by Arrow and its different pieces are listed once; Python looks up or encodes those, and NumPy
puts the ids of all texts together. So little is done for each word, and what the tokenizers library encodes is what is new.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tidemark.llm.shared import worker_table

#: The byte-level tokenizer cuts a text before a blank that stands between two visible characters, around any other
#: single white space, and before the last one of a run; so pieces cut there are encoded alike alone and in the text.
_PIECE = re.compile(r" ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]")
#: Beside other white space (and where this module's own marks stand) the places above are not worked out: a text with it is encoded whole.
_OTHER = r"[\x00\x01\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space that stands at an end or beside other, and tabs; a text without is cut before each blank and line end.
_RUNS = r"^[ \n]|[ \n]\z|[ \n][ \n]|[\t\r]"
#: The tokenizer also cuts between a letter and marks; words are looked up without those that end many of them.
_ENDED = r"(\pL)([.,;:!?]+)([ \n]|\z)"
#: What a piece of such a text begins with: the text's start, marks, a line end, or nothing where its blank was.
_START, _MARKS, _LINE_END = "\0", "\1", "\n"
#: Lines encoded as one text; many more take the tokenizer longer a line.
_LINES = 200


class Encoder:
    """Ids of texts as the tokenizers library gives them with add_special_tokens False, for files with the byte-level
    pre-tokenizer (add_prefix_space false); with other files every text is encoded whole. A special token's name in a
    text is its id, or with special_as_text ordinary text. Pieces met before come from a table of about `entries` pieces,
    those not met for long being dropped; the table changes no result, only the time."""

    def __init__(self, path: str, entries: int = 800_000, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.entries, self.young, self.old = entries, {}, {}
        ids = self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.line_end = ids[1] if len(ids) == 3 else None
        cuts = len(ids) == 3 and self._whole(" a b,\nc\n\n d") == b"".join(map(self._whole, (" a", " b", ",", "\n", "c", "\n\n", " d")))
        special = [] if special_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_OTHER, *special]) if cuts else "(?s)."

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        """Encodes pieces, those without a line end as lines of longer texts."""
        alone = [i for i, piece in enumerate(new) if _LINE_END in piece or piece.isspace()]
        kept = {i: self._whole(new[i]) for i in alone}
        lines = [piece for i, piece in enumerate(new) if i not in kept] if alone else new
        parts = [_LINE_END.join(lines[k : k + _LINES]) for k in range(0, len(lines), _LINES)]
        found: list[bytes] = []
        for encoding in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end)
            starts, ends = (4 * np.r_[0, ends + 1]).tolist(), (4 * np.r_[ends, len(ids)]).tolist()
            data = ids.tobytes()
            found += [data[a:b] for a, b in zip(starts, ends, strict=True)]
        for i in alone:
            found.insert(i, kept[i])
        return found

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        here = list(map(self.young.get, pieces))
        missing = [i for i, ids in enumerate(here) if ids is None]
        names = [pieces[i] for i in missing]
        if old := self.old:
            ids = list(map(old.get, names))
            new = [x for x, own in zip(names, ids, strict=True) if own is None]
            learned = iter(self._learn(new))
            ids = [next(learned) if own is None else own for own in ids]
        else:
            ids = self._learn(names)
        for i, own in zip(missing, ids, strict=True):
            here[i] = own
        self.young.update(zip(names, ids, strict=True))
        if len(self.young) > self.entries // 2:
            self.young, self.old = {}, self.young
        return here

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts (null: empty): those of text i are ids[bounds[i]:bounds[i + 1]]."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False) & ~whole
        plain = ~whole & ~runs & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        counts = np.zeros(len(texts), np.int64)
        # the pieces of all texts, plain ones first
        own = pc.replace_substring_regex(pc.binary_join_element_wise(_START, texts.filter(pa.array(plain)), ""), _ENDED, rf"\1 {_MARKS}\2\3")
        cut = pc.split_pattern(pc.replace_substring(own, _LINE_END, f" {_LINE_END} {_MARKS}"), " ")
        lists = [_PIECE.findall(t) for t in texts.filter(pa.array(runs)).to_pylist()]
        counts[plain], counts[runs] = pc.list_value_length(cut).to_numpy(zero_copy_only=False), list(map(len, lists))
        coded = pc.dictionary_encode(cut.flatten())
        pieces = [x[1:] if x[:1] in (_START, _MARKS) else x if x == _LINE_END else " " + x for x in coded.dictionary.to_pylist()]
        place = {}
        rest = np.fromiter((place.setdefault(x, len(place)) for own in lists for x in own), np.int64)
        found = self._look_up(pieces) + (self._look_up(list(place)) if place else [])
        index = np.concatenate([coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rest + len(pieces)])
        every = [self._whole(t) for t in texts.filter(pa.array(whole)).to_pylist()]
        index = np.concatenate([index, np.arange(len(every)) + len(found)])
        counts[whole] = 1
        found += every
        # the pieces' places in the order of the texts
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(runs), np.flatnonzero(whole)])
        if (np.diff(order) < 0).any():
            first = np.empty(len(texts), np.int64)
            first[order] = np.cumsum(counts[order]) - counts[order]
            index = index[_spans(first, counts)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        own = size[index]
        ids = ids[_spans((np.cumsum(size) - size)[index], own)]
        ends = np.r_[0, np.cumsum(own)]
        return ids, ends[np.r_[0, np.cumsum(counts)]]


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of first[1], and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def _parts(batches: Iterator[pa.RecordBatch], text: int, characters: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, with about so many characters at a time in column `text`; a longer text alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = done = 0
        while start < batch.num_rows:
            stop = max(start + (not held), int(np.searchsorted(size, done + characters - total, "right")))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                total += int(size[stop - 1]) - done
                start, done = stop, int(size[stop - 1])
            if start < batch.num_rows:
                yield pa.concat_batches(held)
                held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: int, end_id: int | None = None, special_as_text: bool = False, characters: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds) of batches whose column `text` has the texts, a bounded number of characters at a time; ids
    are each text's and, if given, end_id. Many texts at a time share more pieces."""
    name = f"{path} {special_as_text}"
    own = worker_table(name, lambda: Encoder(path, special_as_text=special_as_text))  # one for each worker: later tasks use its pieces
    for part in _parts(batches, text, characters):
        ids, bounds = own.encode(part.column(text))
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        yield part, ids, bounds
