"""Projection, filters, joins, aggregation, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.joins import asof_join, not_in_join, overlap_join, range_join, salted_join, sized_join
from millrace.operators.patterns import match_rows
from millrace.operators.windows import distinct_on, groups_sums, join_peers, percentiles, qualify, running, top_per_group
from millrace.plans.catalogue import query
from millrace.sources.tables import sql, table


def same(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is SQL on both engines."""
    query(name, oracle or text)(lambda spark, sf_dir: sql(spark, sf_dir, text))


# -- flagship, scans ------------------------------------------------------------------------


@query(
    "flagship_revenue",
    """
SELECT n_name, o_orderpriority, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
GROUP BY n_name, o_orderpriority
""",
)
def flagship_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01'")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = sized_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double")  # exact in any order
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_lines"), revenue.alias("revenue"))


same("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
same("values_rows", "SELECT CAST(a AS INT) AS a, b, CAST(a * 2 AS INT) AS twice FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
same(
    "values_generated",
    "SELECT id, id * id AS square FROM range(1, 50)",
    "SELECT range AS id, range * range AS square FROM range(1, 50)",
)

# -- projection, filter ---------------------------------------------------------------------

same("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity + 1 AS more FROM lineitem")
same("filter_cmp", "SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal > 5000 AND NOT c_nationkey = 3) OR (c_acctbal < 0 AND c_mktsegment <> 'BUILDING')")
same(
    "filter_in_like",
    """SELECT p_partkey, p_type, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type IN ('ECONOMY', 'PROMO', 'SMALL')
       AND p_name LIKE '%a%' AND p_brand IS NOT NULL AND p_brand IS DISTINCT FROM 'Brand#11' AND p_name RLIKE '[aeiou]'""",
    """SELECT p_partkey, p_type, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type IN ('ECONOMY', 'PROMO', 'SMALL')
       AND p_name LIKE '%a%' AND p_brand IS NOT NULL AND p_brand IS DISTINCT FROM 'Brand#11' AND regexp_matches(p_name, '[aeiou]')""",
)
same(
    "filter_null_logic",
    """SELECT event_id, nullif(event_type, 'click') AS kind, nullif(event_type, 'click') = 'view' AS is_view
       FROM events WHERE NOT (nullif(event_type, 'click') = 'view') OR nullif(event_type, 'view') IS NULL""",
)
same(
    "case_expr",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS band,
              coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, if(o_orderpriority = '1-URGENT', 1, 0) AS urgent FROM orders""",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS band,
              coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders""",
)
same(
    "cast_try",
    """SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, try_cast(event_type AS INT) AS no_number,
              try_cast(substring(CAST(event_id AS STRING), 1, 2) AS INT) AS digits, CAST(ts AS DATE) AS day FROM events""",
    """SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, try_cast(event_type AS INT) AS no_number,
              try_cast(substring(CAST(event_id AS VARCHAR), 1, 2) AS INT) AS digits, CAST(ts AS DATE) AS day FROM events""",
)
same("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return distinct_on(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


same(
    "unnest_array",
    "SELECT doc_id, pos, word FROM (SELECT doc_id, split(text, ' ') AS words FROM documents) LATERAL VIEW posexplode(words) t AS pos, word",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, words[i] AS word FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(words))) AS i)""",
)
same(
    "unnest_outer",
    "SELECT vec_id, x FROM embeddings LATERAL VIEW OUTER explode(filter(embedding, e -> e > 0.15)) t AS x",
    """SELECT vec_id, x FROM (SELECT vec_id, list_filter(embedding, lambda e: e > 0.15) AS xs FROM embeddings)
       LEFT JOIN LATERAL (SELECT unnest(xs) AS x) ON true""",
)
same("scalar_subq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
same("in_subq", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
same(
    "exists_subq",
    """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)
       AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""",
)
same("correlated_subq", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.2 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
same(
    "cte",
    """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT *, rank() OVER (ORDER BY total DESC, o_custkey) AS r FROM spent)
       SELECT o_custkey, round(total, 2) AS total FROM ranked WHERE r <= 25""",
)
same(
    "recursive_cte",
    "WITH RECURSIVE walk(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM walk WHERE n < 15) SELECT n, f FROM walk",
)


@query(
    "pivot_events",
    """SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS "view",
              CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchase FROM events GROUP BY user_id""",
)
def pivot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count()
    return wide.fillna(0, ["click", "view", "purchase"])


@query(
    "unpivot_stats",
    "SELECT s_suppkey, 'balance' AS k, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier",
)
def unpivot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("s_suppkey", ["balance", "nation"], "k", "v")


# -- joins ----------------------------------------------------------------------------------

same("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
same(
    "join_multikey",
    """SELECT a.user_id, a.day, a.n AS clicks, b.n AS views FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2) a
       JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.day = b.day""",
)
same("join_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
same("join_right", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
same(
    "join_full",
    """SELECT a.c_custkey AS rich, b.c_custkey AS built FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) a
       FULL OUTER JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.c_custkey = b.c_custkey""",
)
same("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
same("join_anti", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")


@query("join_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)")
def join_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_in_join(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").where("l_quantity > 10"), "p_partkey", "l_partkey")


same("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey OR a.n_name = b.n_name AND a.n_nationkey <> b.n_nationkey")
same("join_nullsafe", "SELECT a.event_id, b.k FROM (SELECT event_id, nullif(event_type, 'click') AS kind FROM events) a JOIN (VALUES ('view', 1), (NULL, 2)) b(kind, k) ON a.kind <=> b.kind", "SELECT a.event_id, b.k FROM (SELECT event_id, nullif(event_type, 'click') AS kind FROM events) a JOIN (VALUES ('view', 1), (NULL, 2)) b(kind, k) ON a.kind IS NOT DISTINCT FROM b.kind")
same("join_lateral", "SELECT n_name, t.s_suppkey, t.s_acctbal FROM nation, LATERAL (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t")


@query("join_broadcast", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("join_merge_hint", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_merge_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    joined = table(spark, sf_dir, "orders").select("o_orderkey").hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("join_hash_hint", "SELECT p_type, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def join_hash_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type").hint("shuffle_hash")
    joined = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("join_salted", "SELECT event_id, k FROM events JOIN (VALUES ('click', 1), ('view', 2), ('error', 3)) t(event_type, k) USING (event_type)")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "event_type string, k int")
    return salted_join(table(spark, sf_dir, "events"), kinds, ["event_type"]).select("event_id", "k")


_ASOF = """SELECT p.event_id, p.user_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""


def _asof(width: float | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
        found = asof_join(events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), clicks, "ts", ["user_id"], width=width)
        return found.select("event_id", "user_id", F.col("event_id_right").alias("click_id"))

    return run


query("join_asof", _ASOF)(_asof())
query("join_asof_binned", _ASOF)(_asof(width=86400.0))


@query(
    "join_range",
    """SELECT e.event_id, i.event_id AS opened FROM events e JOIN (SELECT event_id, ts AS low, ts + INTERVAL 90 MINUTE AS high FROM events WHERE event_type = 'signup') i
       ON e.ts >= i.low AND e.ts < i.high""",
)
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    opened = events.where("event_type = 'signup'").select(F.col("event_id").alias("opened"), F.col("at").alias("low"), (F.col("at") + 5400).alias("high"))
    return range_join(events.select("event_id", "at"), opened, F.col("at"), F.col("low"), F.col("high"), 3600.0).select("event_id", "opened")


@query(
    "join_overlap",
    """WITH s AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS low, epoch_us(ts) / 1e6 + 1200 + event_id % 900 AS high, event_type FROM events)
       SELECT a.id AS signup, b.id AS fault FROM (SELECT * FROM s WHERE event_type = 'signup') a JOIN (SELECT * FROM s WHERE event_type = 'error') b ON a.low < b.high AND b.low < a.high""",
)
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", at.alias("low"), (at + 1200 + F.col("event_id") % 900).alias("high"))
    a = spans.where("event_type = 'signup'").select(F.col("id").alias("signup"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = spans.where("event_type = 'error'").select(F.col("id").alias("fault"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    return overlap_join(a, b, F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"), 1800.0).select("signup", "fault")


# -- aggregation ----------------------------------------------------------------------------

same(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc,
              min(l_shipdate) AS first_ship, max(l_tax) AS max_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""".replace("TIMESTAMP '", "TIMESTAMP_NTZ '"),
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc,
              min(l_shipdate) AS first_ship, max(l_tax) AS max_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
same("agg_global", "SELECT count(*) AS n, count(nullif(event_type, 'click')) AS others, round(sum(value), 2) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
same("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers, round(avg(DISTINCT l_quantity), 6) AS avg_qty FROM lineitem GROUP BY l_returnflag")
same("agg_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS bought FROM events GROUP BY user_id")
same("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
same("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same(
    "agg_gsets",
    "SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping_id(c_mktsegment, c_nationkey) AS BIGINT) AS g FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
)
same(
    "agg_stats",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(covar_samp(l_quantity, l_extendedprice), 4) AS cv,
              round(corr(l_quantity, l_extendedprice), 8) AS cr FROM lineitem GROUP BY l_returnflag""",
)
same(
    "agg_moments",
    "SELECT o_orderstatus, round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS kurt FROM orders GROUP BY o_orderstatus",
    """SELECT o_orderstatus, round(avg(z ** 3), 6) AS skew, round(avg(z ** 4) - 3, 6) AS kurt FROM (SELECT o_orderstatus, (o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w AS z
       FROM orders WINDOW w AS (PARTITION BY o_orderstatus)) GROUP BY o_orderstatus""",
)
# Of equal prices the first order counts, as for the oracle when it reads the table in order; a price comes once to max_by.
same(
    "agg_maxby",
    """SELECT o_custkey, max_by(o_orderkey, price) AS dearest, min_by(o_orderkey, price) AS cheapest, any_value(o_custkey) AS any_key
       FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey, CASE WHEN min(o_orderkey) IS NOT NULL THEN o_totalprice END AS price FROM orders GROUP BY o_custkey, o_totalprice) GROUP BY o_custkey""",
    "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest, any_value(o_custkey) AS any_key FROM orders GROUP BY o_custkey",
)
same(
    "agg_bool",
    """SELECT user_id, bool_and(value > 0) AS every_pos, bool_or(value > 90) AS some_big, bit_and(CAST(event_id AS INT)) AS ba, bit_or(CAST(event_id AS INT)) AS bo, bit_xor(CAST(event_id AS INT)) AS bx
       FROM events GROUP BY user_id""",
)
same(
    "agg_listagg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, array_join(sort_array(collect_set(substring(n_name, 1, 1))), '') AS initials FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(list(DISTINCT substring(n_name, 1, 1))), '') AS initials FROM nation GROUP BY n_regionkey",
)
same(
    "agg_map",
    "SELECT n_regionkey, map_from_entries(sort_array(collect_list(struct(n_nationkey, n_name))))[5] AS fifth, CAST(size(collect_list(n_name)) AS BIGINT) AS n FROM nation GROUP BY n_regionkey".replace("[5]", "[n_regionkey]"),
    "SELECT n_regionkey, max(n_name) FILTER (WHERE n_nationkey = n_regionkey) AS fifth, count(*) AS n FROM nation GROUP BY n_regionkey",
)


@query(
    "agg_median",
    "SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
)
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups at any size: Spark's own median brings each one's distinct values to one task."""
    found = percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"med": 0.5, "p90": 0.9})
    return found.select("l_returnflag", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))


same(
    "agg_mode",
    "SELECT user_id, mode() WITHIN GROUP (ORDER BY event_type) AS usual FROM events GROUP BY user_id",
    "SELECT user_id, event_type AS usual FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1",
)


@query("agg_approx")
def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey").alias("orders"),
        F.percentile_approx("l_quantity", [0.25, 0.5, 0.75]).alias("quartiles"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts"),
        F.histogram_numeric("l_extendedprice", F.lit(5)).alias("histogram"),
    )


# -- windows --------------------------------------------------------------------------------


@query(
    "win_rank",
    """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt,
              round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM orders
       WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)""",
)
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partitions at any size: numbers run over stretches of the order, ranks over the dates."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    dates = running(orders.groupBy("o_orderstatus", "o_orderdate").agg(F.count("*").alias("n")), ["o_orderstatus"], ["o_orderdate"], upto=F.col("n"), dr=F.lit(1))
    dates = dates.select("o_orderstatus", "o_orderdate", (F.col("upto") - F.col("n") + 1).alias("rk"), F.col("dr").cast("long").alias("dr"), (F.col("upto") / F.col("upto_total")).alias("cd"))
    found = join_peers(running(orders, ["o_orderstatus"], ["o_totalprice", "o_orderkey"], rn=F.lit(1)), dates, ["o_orderstatus", "o_orderdate"])
    size, more = F.expr("rn_total div 4"), F.col("rn_total") % 4  # the first tiles have a row more
    tile = F.expr("(rn - 1) div (rn_total div 4 + 1) + 1")
    later = more + F.expr("(rn - 1 - rn_total % 4 * (rn_total div 4 + 1)) div greatest(rn_total div 4, 1) + 1")
    return found.select(
        "o_orderkey",
        "rn",
        "rk",
        "dr",
        F.when(F.col("rn") <= more * (size + 1), tile).otherwise(later).alias("nt"),
        F.round(F.when(F.col("rn_total") > 1, (F.col("rk") - 1) / (F.col("rn_total") - 1)).otherwise(0.0), 9).alias("pr"),
        F.round("cd", 9).alias("cd"),
    )


same(
    "win_lag",
    """SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(event_type) OVER w AS first_type, nth_value(event_id, 2) OVER w AS second,
              lag(nullif(event_type, 'view')) IGNORE NULLS OVER w AS last_act FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    """SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(event_type) OVER w AS first_type, nth_value(event_id, 2) OVER w AS second,
              lag(nullif(event_type, 'view') IGNORE NULLS) OVER w AS last_act FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
same("win_last_ignore_nulls", "SELECT event_id, last_value(nullif(event_type, 'click')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events", "SELECT event_id, last_value(nullif(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events")
same("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
same(
    "win_range",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_n,
              count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS near_n FROM events""",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n,
              count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS near_n FROM events""",
)


@query("win_groups", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
def win_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partitions at any size, of one row a date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    found = groups_sums(orders, ["o_orderstatus"], ["o_orderdate"], -1, 0, s=F.col("o_totalprice"))
    return found.select("o_orderkey", F.round("s", 2).alias("s"))


@query("win_topn_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def win_topn_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).drop("o_totalprice")


@query("win_qualify", "SELECT event_id FROM events QUALIFY value > avg(value) OVER (PARTITION BY user_id)")
def win_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean adds up in order of the events, as the oracle's does: in another order its last digits may put it beyond a value that equals it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    everyone = Window.partitionBy("user_id").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return qualify(events, F.col("value") > F.avg("value").over(everyone)).select("event_id")


@query(
    "match_recognize",
    """WITH s AS (SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' ELSE '-' END, '' ORDER BY ts) AS s, list(event_id ORDER BY ts) AS ids FROM events GROUP BY user_id),
       m AS (SELECT user_id, ids, s, regexp_extract_all(s, 'v[vc]*p') AS found FROM s),
       r AS (SELECT user_id, ids, s, found, unnest(generate_series(1, len(found))) AS k FROM m),
       e AS (SELECT user_id, ids, found, k, length(array_to_string(found[1:k], '')) AS upto, s FROM r),
       p AS (SELECT user_id, ids, found[k] AS text, k, s FROM e),
       w AS (SELECT user_id, ids, k, text, CAST(list_sum(list_transform(generate_series(1, k), lambda i: length(string_split_regex(s, 'v[vc]*p')[i]))) + (SELECT coalesce(sum(length(f)), 0) FROM (SELECT unnest(regexp_extract_all(s, 'v[vc]*p')[1:k - 1]) AS f)) AS BIGINT) AS start FROM p)
       SELECT user_id, CAST(k AS INTEGER) AS "match", CAST(length(text) AS INTEGER) AS n, ids[start + 1] AS event_id_first, ids[start + length(text)] AS event_id_last FROM w""",
)
def match_recognize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the views and clicks that lead up to them: PATTERN (view (view | click)* purchase)."""
    kind = F.col("event_type")
    define = {"v": kind == "view", "c": kind == "click", "p": kind == "purchase"}
    return match_rows(table(spark, sf_dir, "events"), ["user_id"], ["ts"], define, "v[vc]*p", ["event_id"]).drop("ts_first", "ts_last")


# -- sort, limit, set operations ------------------------------------------------------------

same("sort_multi", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal FROM customer ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_acctbal ASC NULLS FIRST, c_custkey")
same("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
same("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
same("topk_group", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) t WHERE r <= 2")
same("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
same("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return customers.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


same("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
same("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
same("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
same("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")


@query("sample_rows")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bernoulli sample: the limit is the feature."""
    return table(spark, sf_dir, "orders").sample(0.1, seed=7)
