"""Substring dedup by line and paragraph hashing, with runs of sentences beside."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import rows_of, stage, with_python_column, worker_table

#: The smallest units of a text, which together are the text. A line ends one, so lines are made up of them; a paragraph is
#: lines with words, up to one without.
SENTENCE = re.compile(r"[^\n]*?[.!?][ \t]+|[^\n]*\n|[^\n]+")
#: (start, stop, words, digest) of a unit.
Unit = tuple[int, int, int, int]


def _rank(id_col: str, text_col: str) -> Column:
    """A document's rank: its id, or a number above all usual ids from its text's hash where it has none."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text_col), F.lit(1 << 48)))


def _digest(parts: list[bytes]) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(parts))
    return h - (1 << 64) if h >> 63 else h


def cut(text: str, least: int = 0) -> tuple[list[Unit], list[Unit]]:
    """(sentences, blocks) of a text: all its sentences, which together are the text, and its lines and paragraphs of
    `least` words or more, and one at least. A digest is of the normalised unit: A-Z in lower case, white space at the
    ends dropped and each run of it inside one blank; so a paragraph has the same one however it is wrapped, and a line
    that is one sentence has that one's. It is 0 for a sentence without words."""
    sentences: list[Unit] = []
    blocks: list[Unit] = []
    line: list[bytes] = []  # normalised sentences so far, and number of words
    lines: list[bytes] = []  # the paragraph's normalised lines so far
    line_words = lines_words = line_start = lines_start = lines_stop = 0

    def close(parts: list[bytes], start: int, stop: int, words: int) -> None:
        if words >= max(least, 1):
            blocks.append((start, stop, words, _digest(parts)))

    for m in SENTENCE.finditer(text):
        start, stop = m.span()
        words = m.group().encode().lower().split()
        own = b" ".join(words)
        sentences.append((start, stop, len(words), _digest([own]) if words else 0))
        if words:
            line.append(own)
            line_words += len(words)
        if text[stop - 1] == "\n" or stop == len(text):
            if line:
                close(line, line_start, stop, line_words)
                if not lines:
                    lines_start = line_start
                lines += line
                lines_words, lines_stop = lines_words + line_words, stop
            if not line or stop == len(text):
                close(lines, lines_start, lines_stop, lines_words)
                lines, lines_words = [], 0
            line, line_words, line_start = [], 0, stop
    return sentences, blocks


def later_units(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, later): for each document, by rank, the digests of its units that a document before it has. Documents
    rank by id, those without an id last, by their text's hash.

    A unit found in a third of all documents is one row for each task before it is shuffled; its documents meet its
    first one in a join of two tables, which Spark can split. Rows are a digest and an id; texts aren't shuffled here.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table()
        for batch in batches:
            hashes: list[int] = []
            ids: list[int] = []
            for doc, text in rows_of(batch):
                own = {h for units in cut(text, least) for _, _, words, h in units if words}
                hashes += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(ids, pa.int64())], ["hash", "doc"])

    rows = docs.where(F.col(text_col).isNotNull()).select(_rank(id_col, text_col).alias("doc"), text_col)
    found = stage(rows.mapInArrow(work, "hash long, doc long"), "units")
    first = found.groupBy("hash").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    later = found.join(stage(first, "repeated-units"), "hash").where("doc <> first")
    return later.groupBy("doc").agg(F.collect_set("hash").alias("later")).select(F.col("doc").alias("doc_id"), "later")


def places(text: str, later: set[int], least: int) -> list[tuple[int, int]]:
    """The places (start, stop) to remove, ascending and apart: lines and paragraphs of `least` words or more that a
    document before has, or this text at an earlier place; and runs of such sentences that have as many together.
    Sentences without words neither break a run nor begin or end one."""
    sentences, blocks = cut(text, least)
    first: dict[int, int] = {}
    for start, _, words, h in sorted(blocks + sentences):
        if words:
            first.setdefault(h, start)
    found = [(start, stop) for start, stop, _, h in blocks if h in later or first[h] < start]
    run = None
    for start, stop, words, h in [*sentences, (0, 0, 1, None)]:
        if words and h is not None and (h in later or first[h] < start):
            run = (run[0], stop, run[2] + words) if run else (start, stop, words)
        elif words:
            if run and run[2] >= least:
                found.append(run[:2])
            run = None
    out: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def dedup(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text", places_col: str = "removed") -> DataFrame:
    """docs with its text cleaned, and places_col: the places (start, stop), in characters of the original text,
    ascending and apart, that went; empty if none.

    Each unit's earliest occurrence stays, by id and then by place. A later line or paragraph goes if it has min_words
    words or more, whatever its wrapping; later sentences go in runs that have as many together. So short lines and
    sentences which many documents have in common stay where they stand alone; min_words=0 removes every later unit.

    Null and empty texts stay as they are. Rows with one id are one document: what they share with each other stays; so
    are rows without an id with one text. What is repeated inside a row goes. A column of docs named like places_col is replaced.
    """
    gone = later_units(docs, min_words, id_col, text_col).select(F.col("doc_id").alias("_tm_id"), F.col("later").alias("_tm_later"))

    def clean(text: str | None, later: list[int] | None) -> dict:
        removed = places(text, set(later or ()), min_words) if text else []
        kept, at = [], 0
        for start, stop in removed:
            kept.append(text[at:start])
            at = stop
        return {"text": text if not removed else "".join([*kept, text[at:]]), "removed": [{"start": a, "stop": b} for a, b in removed]}

    rows = docs.drop(places_col).join(gone, _rank(id_col, text_col) == F.col("_tm_id"), "left")
    rows = with_python_column(rows.drop("_tm_id"), "_tm_clean", "struct<text:string,removed:array<struct<start:long,stop:long>>>", [F.col(text_col), F.col("_tm_later")], clean)
    return rows.withColumn(text_col, F.col("_tm_clean.text")).withColumn(places_col, F.col("_tm_clean.removed")).drop("_tm_later", "_tm_clean")


def oracle(documents: str, min_words: int) -> str:
    """The query in one statement; ids are taken to be distinct."""
    return rf"""
WITH u AS (SELECT doc_id, 's' AS kind, regexp_extract_all(text, '[^\n]*?[.!?][ \t]+|[^\n]*\n|[^\n]+') AS units FROM {documents}
  UNION ALL SELECT doc_id, 'l', regexp_extract_all(text, '[^\n]*\n|[^\n]+') FROM {documents}
  UNION ALL SELECT doc_id, 'p', regexp_extract_all(text, '(?:[^\n]*[^ \t-\r][^\n]*(?:\n|$))+|[^\n]*\n|[^\n]+') FROM {documents}),
l AS (SELECT doc_id, kind, unnest(units) AS unit, generate_subscripts(units, 1) AS i FROM u),
p AS (SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g')) AS own FROM l),
w AS (SELECT *, CASE WHEN own = '' THEN 0 ELSE len(string_split(own, ' ')) END AS words FROM p),
r AS (SELECT *, words > 0 AND rank() OVER (PARTITION BY own ORDER BY doc_id, start) > 1 AS later FROM w WHERE kind = 's' OR words >= {max(min_words, 1)}),
g AS (SELECT *, count(*) FILTER (WHERE words > 0 AND NOT later) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r WHERE kind = 's'),
f AS (SELECT doc_id, min(start) AS start, max(start + length(unit)) AS stop FROM g WHERE later GROUP BY doc_id, run HAVING sum(words) >= {min_words}
  UNION ALL SELECT doc_id, start, start + length(unit) FROM r WHERE kind <> 's' AND later),
m AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM f),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m),
e AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM n GROUP BY doc_id, island),
k AS (SELECT doc_id, text, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM e JOIN (SELECT doc_id, text FROM {documents}) t USING (doc_id)),
d AS (SELECT doc_id, count(*) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed, string_agg(substring(text, before + 1, start - before), '' ORDER BY start) || any_value(substring(text, (SELECT max(stop) FROM e x WHERE x.doc_id = k.doc_id) + 1)) AS kept FROM k GROUP BY doc_id),
o AS (SELECT doc_id, n_removed, removed, CASE WHEN n_removed IS NULL THEN text ELSE kept END AS own FROM (SELECT doc_id, text FROM {documents}) t LEFT JOIN d USING (doc_id))
SELECT doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, length(own)::BIGINT AS chars_left, md5(own) AS text_md5 FROM o"""
