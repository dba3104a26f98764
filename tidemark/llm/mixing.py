"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import n_words, stage
from tidemark.operators.spans import running

#: Sampling weights lie between this and 1.
LEAST_QUALITY = 0.25
#: Bins of the sampling key at each of two levels.
BINS = 4096


def quality_weight(text: Column) -> Column:
    """A document's sampling weight, from LEAST_QUALITY to 1: the share of its characters that are no symbols or digits.
    Null and empty texts have the least."""
    odd = F.regexp_count(text, F.lit("[#*$%&|<>0-9]"))
    share = F.when(F.length(text) > 0, 1 - odd.cast("double") / F.length(text).cast("double"))
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(share, F.lit(0.0)))


def _bounded(quality: Column) -> Column:
    """A quality as a sampling weight: no less than LEAST_QUALITY, which nulls and NaN have too, and no more than 1."""
    least = F.lit(LEAST_QUALITY)
    return F.least(F.lit(1.0), F.greatest(least, F.coalesce(F.nanvl(quality.cast("double"), least), least)))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from sizes (source, size).

    Sources in code point order, null last, get the weights in turn and share `share` times all sizes by them; none
    gets more than `most` times its own size, and what is over goes to the others by weight until none is above. In
    order of size by weight the sources at their bound come first, so one running sum finds them. The windows run over
    one row for each source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    sources = sources.withColumn("bound", most * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumns({"all": share * F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "given": F.coalesce(F.sum("bound").over(before), F.lit(0.0)), "done": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    sources = sources.withColumn("bounded", F.col("bound") * (F.col("all_weight") - F.col("done")) <= F.col("weight") * (F.col("all") - F.col("given")))
    held = lambda c: F.sum(F.when(F.col("bounded"), F.col(c)).otherwise(0.0)).over(every)
    open_share = F.col("weight") * ((F.col("all") - held("bound")) / F.nullif(F.col("all_weight") - held("weight"), F.lit(0.0)))
    return sources.select("source", "source_size", F.when(F.col("bounded"), F.col("bound")).otherwise(F.least(open_share, F.col("bound"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, digest, size, source_size, target, times, taken) of every row of docs; digest is the text's hash.

    A source's target is its number of complete epochs (every document once) and a rest below its size. For the rest
    documents are drawn without replacement by exponential keys scaled by quality: in order of key they are taken while
    their running sum stays within the rest; one more, whose size comes nearest to what is then missing, closes the gap.
    A key is a hash of seed, id and text, so reruns agree. times counts how often a document is taken (at most
    ceil(most)), taken its words.

    The running sum needs no sort of a whole source: sums over bins of the key find the bin that the rest ends in, sums
    over its sub-bins the sub-bin, and only the latter's documents (about one in 16 million of a source) are sorted. So a
    source with a third of all rows is as parallel as the others.

    quality is any column, such as a classifier's score; it counts as LEAST_QUALITY at least (so do null and NaN) and as 1
    at most. A null text has size 0 and the least quality of its own. A null source is a source, the last. Null ids and rows that repeat
    an id are documents; of repeated rows that tie at the end of the rest any may be taken, their number is fixed. If
    all sizes are 0 targets are 0; an empty table gives an empty result.
    """
    text = F.col(text_col)
    weight = quality_weight(text) if quality is None else _bounded(quality)
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")))
    uniform = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("digest"), n_words(text).alias("size"), weight.alias("w"), uniform.alias("u"), F.md5(name).alias("tie"))
    rows = rows.withColumn("key", -F.log("u") / F.col("w")).withColumn("uid", F.monotonically_increasing_id())
    place = F.least(F.lit(BINS * BINS - 1), F.floor((1 - F.exp(-LEAST_QUALITY * F.col("key"))) * BINS * BINS)).cast("int")
    rows = stage(rows.withColumn("bin", place).drop("u", "w"), "sizes")
    targets = source_targets(rows, weights, share, most)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    targets = stage(targets.withColumn("id", F.row_number().over(Window.orderBy("source"))), "targets")
    rows = rows.join(targets.select("id", "source", "rest"), rows["source"].eqNullSafe(targets["source"])).select("id", "doc_id", "digest", "size", "key", "tie", "uid", "bin", "rest")

    def ends_in(bins: DataFrame, before: Column) -> DataFrame:
        """The first bin of each source whose running sum is over the rest, and the sum before it."""
        upto = F.sum("size").over(Window.partitionBy("id").orderBy("part"))
        over = bins.withColumn("upto", before + upto).where("upto > rest")
        return over.groupBy("id").agg(F.min(F.struct("part", (F.col("upto") - F.col("size")).alias("before"))).alias("at")).select("id", "at.*")

    level = rows.groupBy("id", F.floor(F.col("bin") / BINS).alias("part")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    ends = stage(ends_in(level, F.lit(0)), "bins").withColumnRenamed("part", "top")
    level = rows.join(ends, "id").where(F.floor(F.col("bin") / BINS) == F.col("top"))
    level = level.groupBy("id", F.col("bin").alias("part")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("base"))
    ends = stage(ends_in(level, F.col("base")).withColumnRenamed("part", "end_bin"), "sub-bins")
    placed = rows.join(ends, "id", "left")  # end_bin null: the whole source is within the rest
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("id").orderBy("key", "tie", "uid").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where("bin = end_bin").withColumn("taken", upto <= F.col("rest")).select("uid", "taken")
    edge = stage(edge.where("taken").select(F.col("uid").alias("edge_uid")), "edge")
    chosen = placed.join(edge, F.col("uid") == F.col("edge_uid"), "left")
    chosen = chosen.withColumn("drawn", F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin")) | F.col("edge_uid").isNotNull())
    chosen = stage(chosen.select("id", "doc_id", "digest", "size", "uid", "key", "tie", "rest", "drawn"), "drawn")
    gaps = chosen.groupBy("id").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("drawn"), F.col("size"))), F.lit(0))).alias("gap"))
    closing = chosen.where("not drawn").join(stage(gaps, "gaps"), "id").where("abs(gap - size) < gap")
    closing = closing.groupBy("id").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "key", "tie", "uid")).alias("c")).select("id", F.col("c.uid").alias("closing"))
    out = chosen.select("id", "doc_id", "digest", "size", "uid", "drawn").join(stage(targets.join(closing, "id", "left"), "plan"), "id")
    times = F.col("epochs") + F.when(F.col("drawn") & (F.col("rest") > 0) | (F.col("uid") == F.col("closing")), 1).otherwise(0)
    return out.select("doc_id", "digest", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others), each as often as the mix takes it."""
    taken = mix(docs, **how).groupBy(F.col("doc_id").alias("_tm_id"), F.col("digest").alias("_tm_digest")).agg(F.sum("times").alias("_tm_times"), F.count("*").alias("_tm_rows"))
    both = docs.join(stage(taken.where("_tm_times > 0"), "taken"), F.col("doc_id").eqNullSafe(F.col("_tm_id")) & (F.xxhash64("text") == F.col("_tm_digest")))
    once = both.where("_tm_rows = 1").withColumn("_tm_n", F.col("_tm_times"))
    # rows that repeat both id and text share what is taken of them; they are numbered in spans, so many are many tasks' work
    again = both.where("_tm_rows > 1").withColumns({"_tm_place": F.monotonically_increasing_id(), "_tm_one": F.lit(1).cast("long")})
    again = running(stage(again, "repeated"), ["doc_id", "_tm_digest"], ["_tm_place"], {"_tm_i": "_tm_one"}, width=1 << 16)
    more = F.floor(F.col("_tm_times") / F.col("_tm_rows")) + F.when(F.col("_tm_i") <= F.col("_tm_times") % F.col("_tm_rows"), 1).otherwise(0)
    every = once.unionByName(again.withColumn("_tm_n", more).select(*once.columns)).where("_tm_n > 0")
    return every.withColumn("_tm_n", F.explode(F.sequence(F.lit(1), F.col("_tm_n").cast("int")))).select(*docs.columns)


def oracle(documents: str, weights: Sequence[float], share: float, most: float, seed: str, quality: str | None = None) -> str:
    """The same mix in one statement, with sorts of whole sources. quality is a column of documents, without null or NaN."""
    odd = "length(text) - length(regexp_replace(text, '[#*$%&|<>0-9]', '', 'g'))"
    own = quality or f"coalesce(CASE WHEN length(text) > 0 THEN 1 - ({odd})::DOUBLE / length(text)::DOUBLE END, 0)"
    case = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS size,
         least(1::DOUBLE, greatest({LEAST_QUALITY}::DOUBLE, {own})) AS w,
         md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))) AS tie
  FROM {documents}),
k AS (SELECT *, -ln((('0x' || tie[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {case} END::DOUBLE AS weight, {float(most)}::DOUBLE * source_size AS bound FROM s),
o AS (SELECT *, {float(share)}::DOUBLE * sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
        coalesce(sum(bound) OVER b, 0) AS given, coalesce(sum(weight) OVER b, 0) AS done
      FROM w WINDOW b AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, bound * (all_weight - done) <= weight * (all_size - given) AS bounded FROM o),
t AS (SELECT source, source_size, CASE WHEN bounded THEN bound ELSE least(weight * ((all_size - sum(CASE WHEN bounded THEN bound ELSE 0 END) OVER ()) / nullif(all_weight - sum(CASE WHEN bounded THEN weight ELSE 0 END) OVER (), 0)), bound) END AS target FROM c),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
r AS (SELECT *, round(target)::BIGINT - epochs * source_size AS rest FROM e),
j AS (SELECT k.doc_id, k.size, k.key, k.tie, r.*, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.tie ROWS UNBOUNDED PRECEDING) <= rest AS drawn
      FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source),
g AS (SELECT *, rest - coalesce(sum(size) FILTER (WHERE drawn) OVER (PARTITION BY source), 0) AS gap FROM j),
f AS (SELECT *, CASE WHEN NOT drawn AND abs(gap - size) < gap THEN row_number() OVER (PARTITION BY source, NOT drawn AND abs(gap - size) < gap ORDER BY abs(gap - size), key, tie) END AS nearest FROM g)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN (drawn AND rest > 0) OR nearest = 1 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM f"""
