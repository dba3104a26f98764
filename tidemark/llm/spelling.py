"""Spelling variants of a corpus' words by a symmetric-delete join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word once A-Z are in lower case.
LETTERS = "[a-zÀ-ÿ]+"


def occurrences(docs: DataFrame, planted: int | None = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): a row for each run of letters in a text, A-Z in lower case. With `planted`, a run whose crc32 with its
    document's id is divisible by it loses one letter, chosen by the same number: a table of known misspellings. A null
    text has no runs, a null id counts as an empty one."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    if planted is None:
        return runs.select(F.col("run").alias("word"))
    h = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    return h.selectExpr(f"CASE WHEN h % {planted} = 0 THEN concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2)) ELSE run END AS word")


def vocabulary(words: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of words with letters and occurrences enough. Occurrences are summed in the tasks before the shuffle, so
    a word that is a third of the corpus is one row for each task."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def near_words(known: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all ordered pairs of words that differ by exactly one inserted, deleted or replaced
    letter.

    Every word stands under itself and under each different word that it becomes by one deletion. Two near words have
    exactly one such key in common: the shorter of them, or what is left of both without the replaced letter. So pairs
    need no distinct. Others that share a key (exchanged neighbours) are two steps apart and fail the exact distance,
    inside the join. A key's words are the key itself and the key with one letter more, so their number is bounded by
    its length and the alphabet, whatever the corpus."""
    keys = known.selectExpr("word", "n", "explode(array_distinct(concat(array(word), transform(sequence(1, length(word)), i -> concat(left(word, i - 1), substring(word, i + 1)))))) AS key")
    keys = stage(keys, "deletions")
    a, b = keys.select("key", "word", "n"), keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    once = a.join(b, (a["key"] == b["key"]) & (F.col("word") < F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    return once.selectExpr("inline(array(struct(word, n, other, other_n), struct(other AS word, other_n AS n, word AS other, n AS other_n)))")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word in forms (word, form) that has a form: the end of its chain. Each round doubles the steps
    that are taken, so the rounds are the logarithm of the longest chain; it is a table in the shared folder each time."""
    now = stage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_tm_end"))
        now = stage(now.join(ahead, "root", "left").select("word", F.coalesce("_tm_end", "root").alias("root"), F.col("_tm_end").isNotNull().alias("_tm_moved")), "roots")
        if now.where("_tm_moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("_tm_moved")


def group_variants(words: DataFrame, least_letters: int = 5, least_n: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of words (word) that has `least_letters` and `least_n`
    occurrences.

    n_near is its number of near words (see near_words). form is the near word with the largest n, of equal ones the
    first in code-point order, if its n is at least `ratio` times the word's (2 or more, so that chains rise and end);
    else null. root is the end of the chain of forms, the word itself if it has none. Null words count for nothing, an
    empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or chains of forms needn't end")
    known = stage(vocabulary(words, least_letters, least_n), "vocabulary")
    best = near_words(known).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    joined = known.join(best, "word", "left").withColumn("strong", -F.col("best.m") >= ratio * F.col("n"))
    found = stage(joined.select("word", F.when(F.col("strong"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("strong"), -F.col("best.m")).alias("form_n")), "forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(documents: str, planted: int = 97) -> str:
    """The query over documents in one statement. Its crc32 goes by half bytes; near words are found by place: equal
    without the letter at one place, or one equal to the other without a letter."""
    half = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        half.append(x)
    step = lambda c: f"xor({c} >> 4, list_extract({half}::BIGINT[], ({c} & 15) + 1))"
    letters = "list_transform(string_split({}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, (unicode(ch) - 64)::BIGINT] END)".format
    return f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}')) AS run FROM {documents}),
c AS (SELECT id, run, count(*) AS times FROM r GROUP BY ALL),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({letters("id || ':' || run")})), lambda c, b: {step(step("xor(c, b)"))}), 4294967295) AS h FROM c),
w AS (SELECT CASE WHEN h % {planted} = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
d AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
x AS (SELECT DISTINCT d.word AS long, d.n AS long_n, v.word AS short, v.n AS short_n FROM d JOIN v ON v.word = d.rest),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT long, long_n, short, short_n FROM x UNION ALL SELECT short, short_n, long, long_n FROM x),
b AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS m, arg_min(other, (-other_n, other)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN best END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, g.root FROM g JOIN f ON f.form = g.word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN g USING (word)"""
