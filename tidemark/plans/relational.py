"""Relational queries: scans, joins, aggregations, sorts, set operations, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, json_long, ln
from tidemark.operators.aggregates import Quantiles, merged, percentiles, quantiles, states
from tidemark.operators.joins import range_join, salted_join
from tidemark.operators.nearest import nearest
from tidemark.sources import arrow_parts
from tidemark.sources.shared import kept, new_path
from tidemark.sources.tables import bucketed, buckets_for, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name, with SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    date = F.col("o_orderdate")
    return o.where((date >= F.expr("TIMESTAMP_NTZ '1996-01-01'")) & (date < F.expr("TIMESTAMP_NTZ '1997-01-01'")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity > 25 AS bulk FROM lineitem")
def project_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"), (F.col("l_quantity") > 25).alias("bulk"))


@query("""SELECT r_name, n_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_star(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name: table(spark, sf, name)
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("price"))
    rows = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("price").cast("double").alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n, coalesce(sum(l_quantity::DECIMAL(18, 2)), 0)::DOUBLE AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority")
def join_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the number and quantity of their lines, from two tables in buckets of the order: once they are
    written, neither the join nor the grouping shuffles."""
    orders, lines = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    n = buckets_for([orders, lines])
    o, x = bucketed(orders, "o_orderkey", n), bucketed(lines, "l_orderkey", n)
    rows = o.hint("merge").join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey", "o_orderpriority")
    return rows.agg(F.count("l_orderkey").alias("n"), F.coalesce(F.sum(F.col("l_quantity").cast("decimal(18, 2)")), F.lit(0)).cast("double").alias("quantity"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts)::TIMESTAMP AS since, max(value) AS most FROM events GROUP BY event_type")
def source_arrow(spark: SparkSession, sf: str) -> DataFrame:
    """Events by type, written to and read from a table of Arrow files."""
    arrow_parts.use(spark)
    path = new_path(spark, "events-arrow")
    table(spark, sf, "events").write.format("arrow_parts").mode("append").save(path)
    return spark.read.format("arrow_parts").load(path).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("since"), F.max("value").alias("most"))


def _orders_lines(spark: SparkSession, sf: str, how: str) -> DataFrame:
    o, n = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_quantity > 40")
    return o.select("o_orderkey", "o_orderstatus").join(n.select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"), how)


_LINES = "(SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 40)"


@query(f"SELECT o_orderkey, o_orderstatus, l_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN {_LINES} ON o_orderkey = l_orderkey")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_lines(spark, sf, "left")


@query(f"SELECT o_orderkey, o_orderstatus, l_orderkey, l_partkey, l_quantity FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') RIGHT JOIN {_LINES} ON o_orderkey = l_orderkey")
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    o, n = table(spark, sf, "orders").where("o_orderstatus = 'F'"), table(spark, sf, "lineitem").where("l_quantity > 40")
    return o.select("o_orderkey", "o_orderstatus").join(n.select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"), "right")


@query(f"SELECT o_orderkey, o_orderstatus, l_orderkey, l_partkey, l_quantity FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') FULL JOIN {_LINES} ON o_orderkey = l_orderkey")
def join_full(spark: SparkSession, sf: str) -> DataFrame:
    o, n = table(spark, sf, "orders").where("o_orderstatus = 'F'"), table(spark, sf, "lineitem").where("l_quantity > 40")
    return o.select("o_orderkey", "o_orderstatus").join(n.select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"), "full")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_lines(spark, sf, "left_semi")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_lines(spark, sf, "left_anti")


_BANDS = "(SELECT p_brand, min(p_size)::DOUBLE AS low, min(p_size)::DOUBLE + 5 AS high FROM part WHERE p_size > 5 GROUP BY p_brand)"


@query(f"SELECT p_partkey, b.p_brand AS band, low, high FROM part p JOIN {_BANDS} b ON p.p_size >= low AND p.p_size < high")
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    bands = part.where("p_size > 5").groupBy(F.col("p_brand").alias("band")).agg(F.min("p_size").cast("double").alias("low"), (F.min("p_size") + 5).cast("double").alias("high"))
    return range_join(part.select("p_partkey", F.col("p_size").cast("double").alias("size")), bands, "size", "low", "high", 5.0).drop("size")


@query("SELECT event_id, user_id, n FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)")
def join_salted(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id")
    return salted_join(e, e.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"]).select("event_id", "user_id", "n")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, round(avg(l_discount), 8) AS avg_disc, min(l_shipdate) AS first_ship, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def aggregate_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.min("l_shipdate").alias("first_ship"), F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def aggregate_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query()
def aggregate_approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


_GROUPED = "l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS qty, count(*) AS n"


@query(f"SELECT {_GROUPED}, grouping(l_returnflag)::INT AS all_flags FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def aggregate_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("tidemark_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, cast(grouping(l_returnflag) AS INT) AS all_flags FROM tidemark_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")


@query(f"SELECT {_GROUPED} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def aggregate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query(f"SELECT {_GROUPED} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def aggregate_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"SELECT user_id, {', '.join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)}, count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN {EVENT_TYPES}) AS other FROM events GROUP BY user_id")
def aggregate_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A column for each type that is named here, and one for all others, null ones too."""
    named = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("other")
    columns = [*EVENT_TYPES, "other"]
    rows = table(spark, sf, "events").select("user_id", named.alias("kind")).groupBy("user_id").pivot("kind", columns).agg(F.count(F.lit(1)))
    return rows.select("user_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def aggregate_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY l_returnflag""")
def percentiles_by_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of three large groups, none of which is in one task."""
    found = percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "p25": 0.25, "median": 0.5, "p999": 0.999})
    return found.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("p01", "p25", "median", "p999")])


@query("SELECT event_type, count(DISTINCT ts::DATE) AS n_days, count(value) AS n, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type")
def aggregate_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Quantile sketches of each day and type, kept as a table of bytes, and merged over days: exact while a type has no more
    different values than a sketch has ranges (8192), else the low end of a range, with the error that quantiles() gives."""
    how = Quantiles()
    events = table(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "value")
    days = kept(states(events, ["day", "event_type"], "value", how), "daily-sketches")
    whole = quantiles(merged(days, ["event_type"], how), {"median": 0.5, "p90": 0.9}, how)
    return whole.join(days.groupBy("event_type").agg(F.count("*").alias("n_days")), "event_type").select("event_type", "n_days", "n", "median", "p90")


@query("""SELECT event_type, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurt, round(sqrt(m2), 6) AS deviation
FROM (SELECT event_type, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3, avg((value - m) ** 4) AS m4 FROM events JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) USING (event_type) GROUP BY event_type)""")
def aggregate_moments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.skewness("value"), 6).alias("skew"), F.round(F.kurtosis("value"), 6).alias("kurt"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY l_returnflag")
def aggregate_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    # the filter on row_number lets Spark cut each group before the shuffle
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def sort_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT p_partkey FROM part WHERE p_size < 5")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys(spark, sf)
    return a.unionByName(b)


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys(spark, sf)
    return a.unionByName(b).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 5")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys(spark, sf)
    return a.intersect(b)


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity < 5")
def set_intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf)[0].intersectAll(table(spark, sf, "lineitem").where("l_quantity < 5").select(F.col("l_suppkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT p_partkey FROM part WHERE p_size < 5")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys(spark, sf)
    return a.subtract(b)


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 EXCEPT ALL SELECT p_partkey FROM part WHERE p_size < 5")
def set_except_all(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys(spark, sf)
    return a.exceptAll(b)


def _keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")), table(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey").alias("k"))


@query(r"""SELECT p_partkey, upper(p_name) AS upper_name, length(p_name)::INT AS n_chars, substring(p_name, 1, 3) AS head, replace(p_brand, '#', '-') AS brand, len(string_split(p_type, ' '))::INT AS n_parts,
regexp_replace(p_name, '[aeiou]', '_', 'g') AS veiled, regexp_extract(p_brand, '([0-9]+)', 1) AS brand_number, lpad(p_partkey::VARCHAR, 8, '0') AS code, concat_ws('|', p_brand, p_type) AS both, md5(p_name) AS digest FROM part""")
def scalar_strings(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("upper_name"), F.length("p_name").alias("n_chars"), F.substring("p_name", 1, 3).alias("head"), F.replace(c("p_brand"), F.lit("#"), F.lit("-")).alias("brand"), F.size(F.split("p_type", " ")).alias("n_parts"),
        F.regexp_replace("p_name", "[aeiou]", "_").alias("veiled"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand_number"), F.lpad(c("p_partkey").cast("string"), 8, "0").alias("code"), F.concat_ws("|", "p_brand", "p_type").alias("both"), F.md5("p_name").alias("digest"),
    )


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, (dayofweek(o_orderdate) + 1)::INT AS dow, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::INT AS days,
(o_orderdate + INTERVAL 90 DAY)::TIMESTAMP AS due, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def scalar_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofweek(d).alias("dow"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), (d + F.expr("INTERVAL 90 DAY")).alias("due"), F.date_format(d, "yyyy-MM-dd").alias("iso"))


@query("SELECT event_id, round(ln(value), 8) AS log_value, round(sqrt(value), 8) AS root, floor(value)::BIGINT AS whole, (event_id % 7)::BIGINT AS rest, greatest(value, 100.0) AS at_least, CASE WHEN value > 200 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END AS band FROM events")
def scalar_math(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(ln(v), 8).alias("log_value"), F.round(F.sqrt(v), 8).alias("root"), F.floor(v).alias("whole"), (F.col("event_id") % 7).alias("rest"), F.greatest(v, F.lit(100.0)).alias("at_least"), F.when(v > 200, "high").when(v > 50, "mid").otherwise("low").alias("band"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def scalar_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", json_long(F.col("props"), "$.k").alias("k"))


@query("SELECT vec_id, len(embedding)::INT AS width, list_max(embedding) AS most, embedding[1] AS first_one, len(list_filter(embedding, lambda x: x > 0))::INT AS positive FROM embeddings")
def scalar_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("width"), F.array_max("embedding").alias("most"), F.col("embedding")[0].alias("first_one"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))


@query("""SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 3""")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest vectors of the same label, for the ids that 50 divides."""
    e = table(spark, sf, "embeddings")
    rows = e.where("vec_id % 50 = 0").select("vec_id", "label", F.col("embedding").alias("own")).join(e.select(F.col("vec_id").alias("other_id"), "label", "embedding"), "label").where("vec_id <> other_id")
    rows = rows.select("vec_id", "other_id", cosine(F.col("own"), F.col("embedding")).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id"))
    return rows.withColumn("r", rank).where("r <= 3").select("vec_id", "other_id", F.round("cosine", 8).alias("cosine"))


@query("""SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 3""")
def nearest_in_cells(spark: SparkSession, sf: str) -> DataFrame:
    """nearest_vectors by cells around pivots, without a row for each pair."""
    found = nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 3)
    return found.select("vec_id", "other_id", F.round("cosine", 8).alias("cosine"))


@query("SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM documents) WHERE word <> '' GROUP BY lang, word")
def explode_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return rows.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN value * 0.9 ELSE value END AS net, event_id FROM events")
def udf_scalar(spark: SparkSession, sf: str) -> DataFrame:
    def net(kind, value):
        return value.where(kind != "purchase", value * 0.9)

    import pandas as pd

    net.__annotations__ = {"kind": pd.Series, "value": pd.Series, "return": pd.Series}
    return table(spark, sf, "events").select("event_type", F.pandas_udf(net, "double")("event_type", "value").alias("net"), "event_id")


#: A grouped map gets a frame of so many events at most.
BLOCK = 10_000


def _above_least(p):
    return p.assign(above_least=p["value"] - p["least"])[["event_type", "event_id", "above_least"]]


@query("SELECT event_type, event_id, value - min(value) OVER (PARTITION BY event_type) AS above_least FROM events")
def udf_grouped_map(spark: SparkSession, sf: str) -> DataFrame:
    """A grouped map over pandas frames of bounded size: events of a type whose ids are in one block. The least value of
    a type is aggregated before and joined; built-in windows do this better, the query shows the form."""
    rows = table(spark, sf, "events").select("event_type", "event_id", "value", F.floor(F.col("event_id") / BLOCK).alias("block"))
    least = rows.groupBy(F.col("event_type").alias("least_type")).agg(F.min("value").alias("least"))
    rows = rows.join(least, F.col("event_type").eqNullSafe(F.col("least_type"))).drop("least_type")
    return rows.groupBy("event_type", "block").applyInPandas(_above_least, "event_type string, event_id long, above_least double")


@query("SELECT doc_id, n::INT AS line_no, length(line)::INT AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)")
def udtf_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A table function called for each row (lateral)."""

    class Lines:
        def eval(self, text: str):
            for n, line in enumerate(text.split("\n") if text is not None else []):
                yield n, len(line)

    spark.udtf.register("tidemark_lines", F.udtf(Lines, returnType="line_no int, n_chars int"))
    table(spark, sf, "documents").select("doc_id", "text").createOrReplaceTempView("tidemark_documents")
    return spark.sql("SELECT doc_id, line_no, n_chars FROM tidemark_documents, LATERAL tidemark_lines(text)")
