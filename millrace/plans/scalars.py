"""Scalar functions, by family; each query holds Spark's functions against their counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.udf import Words, clipped, geometric_mean, register_sql_functions
from millrace.functions.vector import cosine, dot, norm
from millrace.plans.catalogue import query
from millrace.plans.relational import same
from millrace.sources.tables import sql, table

same(
    "fn_string",
    """SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS len, upper(c_name) AS up, lower(c_mktsegment) AS low, trim('  ' || c_name || ' ') AS tr, ltrim('  x') || rtrim('y  ') AS lr,
      lpad(CAST(c_custkey AS STRING), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, substring(c_name, 3, 5) AS sub, left(c_name, 4) AS le, right(c_name, 3) AS ri, concat(c_name, '/', c_mktsegment) AS cc,
      concat_ws('-', c_name, NULL, c_mktsegment) AS cw, replace(c_name, '0', 'o') AS rep, translate(c_name, '0123', 'abcd') AS tl, reverse(c_name) AS rv, repeat(c_mktsegment, 2) AS rt,
      split_part(c_name, '#', 2) AS sp, CAST(instr(c_name, '#') AS BIGINT) AS ins, CAST(position('0' IN c_name) AS BIGINT) AS pos, startswith(c_name, 'Cust') AS sw, endswith(c_name, '7') AS ew,
      contains(c_name, '00') AS ct, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS lev, CAST(ascii(c_name) AS INT) AS asc_, chr(65 + CAST(c_custkey % 26 AS INT)) AS ch, base64(CAST(c_name AS BINARY)) AS b64,
      hex(CAST(c_name AS BINARY)) AS hx, initcap(lower(c_mktsegment)) AS ic, format_string('%s:%d', c_name, c_custkey) AS fs, overlay(c_name PLACING 'ZZ' FROM 2 FOR 3) AS ov FROM customer""",
    """SELECT c_custkey, length(c_name) AS len, upper(c_name) AS up, lower(c_mktsegment) AS low, trim('  ' || c_name || ' ') AS tr, ltrim('  x') || rtrim('y  ') AS lr,
      lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, substring(c_name, 3, 5) AS sub, left(c_name, 4) AS le, right(c_name, 3) AS ri, concat(c_name, '/', c_mktsegment) AS cc,
      concat_ws('-', c_name, NULL, c_mktsegment) AS cw, replace(c_name, '0', 'o') AS rep, translate(c_name, '0123', 'abcd') AS tl, reverse(c_name) AS rv, repeat(c_mktsegment, 2) AS rt,
      split_part(c_name, '#', 2) AS sp, instr(c_name, '#') AS ins, position('0' IN c_name) AS pos, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '7') AS ew,
      contains(c_name, '00') AS ct, levenshtein(c_name, c_mktsegment) AS lev, ascii(c_name) AS asc_, chr(65 + CAST(c_custkey % 26 AS INT)) AS ch, base64(encode(c_name)) AS b64,
      hex(encode(c_name)) AS hx, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS ic, format('{}:{}', c_name, c_custkey) AS fs, substring(c_name, 1, 1) || 'ZZ' || substring(c_name, 5) AS ov FROM customer""",
)


@query("fn_string_more")
def fn_string_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without a counterpart in the oracle."""
    return sql(spark, sf_dir, "SELECT c_custkey, soundex(c_name) AS sx, locate('0', c_name, 5) AS lo, decode(encode(c_name, 'UTF-16'), 'UTF-16') AS en, unhex(hex(c_name)) AS un, CAST(unbase64(base64(CAST(c_name AS BINARY))) AS STRING) AS ub FROM customer")


same(
    "fn_regex",
    r"""SELECT p_partkey, regexp_like(p_name, '^[a-m]') AS early, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '_') AS masked,
        CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS vowels, CAST(size(regexp_extract_all(p_name, '[a-z]+', 0)) AS BIGINT) AS words FROM part""",
    r"""SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS early, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked,
        len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, len(regexp_extract_all(p_name, '[a-z]+')) AS words FROM part""",
)
same("fn_regex_instr", "SELECT p_partkey, CAST(regexp_instr(p_brand, '[0-9]') AS BIGINT) AS at FROM part", "SELECT p_partkey, CAST(CASE WHEN regexp_matches(p_brand, '[0-9]') THEN length(regexp_extract(p_brand, '^[^0-9]*')) + 1 ELSE 0 END AS BIGINT) AS at FROM part")
same(
    "fn_hash",
    "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha2(text, 256) AS s2 FROM documents",
    "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2 FROM documents",
)


@query("fn_hash_more")
def fn_hash_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, "SELECT doc_id, crc32(CAST(text AS BINARY)) AS c, xxhash64(text) AS x, hash(text) AS h, url_decode(url_encode(text)) = text AS same FROM documents")


same(
    "fn_url_text",
    "SELECT doc_id, url_encode(text) AS ue, url_decode(url_encode(text)) = text AS same FROM documents",
    "SELECT doc_id, replace(replace(replace(url_encode(text), '%20', '+'), '%2A', '*'), '~', '%7E') AS ue, url_decode(url_encode(text)) = text AS same FROM documents",
)


_MATH = """SELECT event_id, abs(value - 50) AS ab, CAST(ceil(value) AS BIGINT) AS ce, CAST(floor(value) AS BIGINT) AS fl, round(value, 1) AS ro, CAST(sign(value - 50) AS DOUBLE) AS sg, round(sqrt(value), 9) AS sq,
  round(cbrt(value), 9) AS cb, round(exp(value / 100), 9) AS ex, round(ln(value + 1), 9) AS lnv, round(log2(value + 1), 9) AS l2, round(log10(value + 1), 9) AS l10, round(pow(value, 1.5), 6) AS pw,
  round(sin(value), 9) AS sn, round(cos(value), 9) AS cs, round(tan(value), 6) AS tn, round(asin(value / 1000), 9) AS asn, round(acos(value / 1000), 9) AS acs, round(atan(value), 9) AS atn, round(atan2(value, 2.0), 9) AS at2,
  round(sinh(value / 100), 9) AS snh, round(cosh(value / 100), 9) AS csh, round(tanh(value / 100), 9) AS tnh, round(degrees(value), 6) AS dg, round(radians(value), 9) AS rd, greatest(value, 10.0) AS gr, least(value, 10.0) AS le_,
  CAST(factorial(CAST(event_id % 15 AS INT)) AS BIGINT) AS fa, round(pi(), 9) AS p, CAST(event_id % 7 AS BIGINT) AS md{more} FROM events"""
same(
    "fn_math",
    _MATH.format(more=", bround(2.5, 0) AS br, pmod(CAST(-event_id AS INT), 7) AS pm, try_divide(value, event_id % 2) AS td, width_bucket(value, 0, 100, 10) AS wb, round(e(), 9) AS ev, bin(event_id) AS bi, conv(CAST(event_id AS STRING), 10, 16) AS cv").replace("bround(2.5, 0)", "CAST(bround(2.5D, 0) AS DOUBLE)"),
    _MATH.format(more=", CAST(round_even(2.5, 0) AS DOUBLE) AS br, CAST(((-event_id % 7) + 7) % 7 AS INTEGER) AS pm, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value / (event_id % 2) END AS td, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE CAST(floor(value / 10) AS BIGINT) + 1 END AS wb, round(exp(1), 9) AS ev, bin(event_id) AS bi, upper(hex(event_id)) AS cv"),
)


@query("fn_random")
def fn_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.rand(3).between(0, 1).alias("r"), F.shuffle(F.array(F.lit(1), F.lit(2))).alias("s"))


same("fn_log_base", "SELECT event_id, round(log(2.0D, value + 1), 9) AS l2, round(log(10.0D, value + 1), 9) AS l10 FROM events", "SELECT event_id, round(ln(value + 1) / ln(2), 9) AS l2, round(ln(value + 1) / ln(10), 9) AS l10 FROM events")
same(
    "fn_bit",
    "SELECT event_id, shiftleft(event_id, 3) AS sl, shiftright(event_id, 2) AS sr, bit_count(event_id) AS bc, ~event_id AS nt, event_id & 12 AS an, event_id | 5 AS orr, event_id ^ 9 AS xo FROM events",
    "SELECT event_id, event_id << 3 AS sl, event_id >> 2 AS sr, CAST(bit_count(event_id) AS INTEGER) AS bc, ~event_id AS nt, event_id & 12 AS an, event_id | 5 AS orr, xor(event_id, 9) AS xo FROM events",
)
same(
    "fn_date",
    """SELECT event_id, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS hr, date_add(CAST(ts AS DATE), 10) AS da, date_sub(CAST(ts AS DATE), 3) AS ds, add_months(CAST(ts AS DATE), 1) AS am,
      datediff(CAST(ts AS DATE), DATE '2023-12-25') AS dd, last_day(CAST(ts AS DATE)) AS ld, next_day(CAST(ts AS DATE), 'MON') AS nd, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS d,
      CAST(dayofweek(ts) AS BIGINT) AS dw, CAST(dayofyear(ts) AS BIGINT) AS dy, CAST(weekofyear(ts) AS BIGINT) AS wk, CAST(quarter(ts) AS BIGINT) AS q, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi,
      CAST(second(ts) AS BIGINT) AS s, date_format(ts, 'yyyy/MM/dd HH:mm') AS df, to_date('2024-02-29', 'yyyy-MM-dd') AS td, make_date(2024, 2, CAST(1 + event_id % 28 AS INT)) AS mk,
      unix_timestamp(CAST(ts AS TIMESTAMP)) AS ut, CAST(extract(DAY FROM ts) AS BIGINT) AS ed, CAST(ts + INTERVAL '1' DAY AS TIMESTAMP_NTZ) AS plus, timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS th FROM events""",
    """SELECT event_id, date_trunc('hour', ts) AS hr, CAST(CAST(ts AS DATE) + 10 AS DATE) AS da, CAST(CAST(ts AS DATE) - 3 AS DATE) AS ds, CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS am,
      CAST(date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS INTEGER) AS dd, last_day(ts) AS ld, CAST(CAST(ts AS DATE) + CAST(8 - isodow(ts) AS INTEGER) AS DATE) AS nd, year(ts) AS y, month(ts) AS mo, day(ts) AS d,
      dayofweek(ts) + 1 AS dw, dayofyear(ts) AS dy, weekofyear(ts) AS wk, quarter(ts) AS q, hour(ts) AS h, minute(ts) AS mi,
      second(ts) AS s, strftime(ts, '%Y/%m/%d %H:%M') AS df, DATE '2024-02-29' AS td, make_date(2024, 2, CAST(1 + event_id % 28 AS INT)) AS mk,
      CAST(floor(epoch(ts)) AS BIGINT) AS ut, extract(day FROM ts) AS ed, ts + INTERVAL 1 DAY AS plus, date_sub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS th FROM events""",
)


same("fn_day_of_month", "SELECT o_orderkey, CAST(dayofmonth(o_orderdate) AS BIGINT) AS d FROM orders", "SELECT o_orderkey, dayofmonth(o_orderdate) AS d FROM orders")


@query("fn_date_more")
def fn_date_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the present moment and of time zones."""
    return sql(
        spark,
        sf_dir,
        """SELECT event_id, current_date() <= date_add(current_date(), 0) AS today, current_timestamp() >= TIMESTAMP '2020-01-01' AS now, from_unixtime(event_id) AS fu, to_timestamp('2024-01-02 03:04:05') AS tt,
        convert_timezone('UTC', 'Asia/Tokyo', ts) AS tz, months_between(CAST(ts AS DATE), DATE '2023-01-01') AS mb, CAST(make_interval(0, 0, 0, 2) AS STRING) AS iv, timestampadd(MINUTE, 5, ts) AS ta FROM events""",
    )


same(
    "fn_array",
    """SELECT vec_id, element_at(a, 1) AS first_, get(a, 1) AS second_, CAST(size(a) AS BIGINT) AS n, CAST(cardinality(a) AS BIGINT) AS c, array_contains(a, 3) AS has3, array_join(sort_array(array_distinct(a)), ',') AS dis, array_join(sort_array(array_union(a, b)), ',') AS uni,
      array_join(sort_array(array_intersect(a, b)), ',') AS inter, array_join(sort_array(array_except(a, b)), ',') AS exc, array_join(array_sort(a), ',') AS srt, array_join(sort_array(a, false), ',') AS dsc, CAST(array_position(a, 2) AS BIGINT) AS pos,
      array_join(array_remove(a, 2), ',') AS rem, array_join(array_repeat(7, 3), ',') AS rep, arrays_overlap(a, b) AS ovl, array_join(flatten(array(a, b)), ',') AS flt, array_join(slice(a, 2, 2), ',') AS sli, array_join(sequence(1, 5), ',') AS sq,
      array_join(transform(a, x -> x * 2), ',') AS tr, array_join(filter(a, x -> x > 2), ',') AS fi, exists(a, x -> x > 4) AS ex, forall(a, x -> x >= 0) AS fa, aggregate(a, 0, (s, x) -> s + x) AS ag, array_join(zip_with(a, b, (x, y) -> x + y), ',') AS zw,
      array_max(a) AS mx, array_min(a) AS mn, arrays_zip(a, b)[0].a AS az
      FROM (SELECT vec_id, array(CAST(vec_id % 5 AS INT), CAST(vec_id % 3 AS INT), 2) AS a, array(CAST(vec_id % 4 AS INT), 1, CAST(vec_id % 7 AS INT)) AS b FROM embeddings)""",
    """SELECT vec_id, a[1] AS first_, a[2] AS second_, len(a) AS n, len(a) AS c, list_contains(a, 3) AS has3, array_to_string(list_sort(list_distinct(a)), ',') AS dis, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS uni,
      array_to_string(list_sort(list_intersect(list_distinct(a), b)), ',') AS inter, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS exc, array_to_string(list_sort(a), ',') AS srt, array_to_string(list_reverse_sort(a), ',') AS dsc, CAST(coalesce(list_position(a, 2), 0) AS BIGINT) AS pos,
      array_to_string(list_filter(a, lambda x: x <> 2), ',') AS rem, '7,7,7' AS rep, list_has_any(a, b) AS ovl, array_to_string(list_concat(a, b), ',') AS flt, array_to_string(a[2:3], ',') AS sli, '1,2,3,4,5' AS sq,
      array_to_string(list_transform(a, lambda x: x * 2), ',') AS tr, array_to_string(list_filter(a, lambda x: x > 2), ',') AS fi, len(list_filter(a, lambda x: x > 4)) > 0 AS ex, len(list_filter(a, lambda x: x < 0)) = 0 AS fa, CAST(list_sum(a) AS INTEGER) AS ag,
      array_to_string([a[1] + b[1], a[2] + b[2], a[3] + b[3]], ',') AS zw, list_max(a) AS mx, list_min(a) AS mn, a[1] AS az
      FROM (SELECT vec_id, [CAST(vec_id % 5 AS INT), CAST(vec_id % 3 AS INT), 2] AS a, [CAST(vec_id % 4 AS INT), 1, CAST(vec_id % 7 AS INT)] AS b FROM embeddings)""",
)
same(
    "fn_map",
    """SELECT n_nationkey, CAST(size(m) AS BIGINT) AS n, array_join(sort_array(map_keys(m)), ',') AS k, array_join(sort_array(map_values(m)), ',') AS v, element_at(m, 'a') AS a, m['b'] AS b, map_contains_key(m, 'z') AS z,
      element_at(map_concat(m, map('c', 9)), 'c') AS c, CAST(size(map_filter(m, (k, v) -> v > 5)) AS BIGINT) AS f, element_at(transform_values(m, (k, v) -> v * 10), 'a') AS tv, element_at(transform_keys(m, (k, v) -> upper(k)), 'A') AS tk,
      element_at(map_zip_with(m, map('a', 1), (k, x, y) -> x + coalesce(y, 0)), 'a') AS zw, CAST(size(map_entries(m)) AS BIGINT) AS e, element_at(map_from_arrays(array('q'), array(n_nationkey)), 'q') AS fa, element_at(map_from_entries(array(struct('w', n_nationkey))), 'w') AS fe
      FROM (SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey) AS m FROM nation)""",
    """SELECT n_nationkey, CAST(2 AS BIGINT) AS n, 'a,b' AS k, array_to_string(list_sort([n_nationkey, n_regionkey]), ',') AS v, m['a'] AS a, m['b'] AS b, list_contains(map_keys(m), 'z') AS z, 9 AS c,
      CAST(len(list_filter(map_values(m), lambda v: v > 5)) AS BIGINT) AS f, n_nationkey * 10 AS tv, n_nationkey AS tk, n_nationkey + 1 AS zw, CAST(len(map_entries(m)) AS BIGINT) AS e, n_nationkey AS fa, n_nationkey AS fe
      FROM (SELECT n_nationkey, n_regionkey, MAP {'a': n_nationkey, 'b': n_regionkey} AS m FROM nation)""",
)
same(
    "fn_json",
    """SELECT event_id, get_json_object(props, '$.k') AS k, from_json(props, 'k INT').k AS ki, to_json(named_struct('id', event_id, 't', event_type)) AS js, CAST(json_array_length('[1,2,3]') AS BIGINT) AS jl,
      array_join(json_object_keys(props), ',') AS ks, variant_get(parse_json(props), '$.k', 'int') AS vk FROM events""",
    """SELECT event_id, props->>'$.k' AS k, CAST(props->>'$.k' AS INTEGER) AS ki, CAST(json_object('id', event_id, 't', event_type) AS VARCHAR) AS js, CAST(json_array_length('[1,2,3]') AS BIGINT) AS jl,
      array_to_string(json_keys(props), ',') AS ks, CAST(props->>'$.k' AS INTEGER) AS vk FROM events""",
)
same("fn_json_schema", """SELECT n_nationkey, schema_of_json('{"a": 1, "b": ["x"]}') AS s FROM nation""", "SELECT n_nationkey, 'STRUCT<a: BIGINT, b: ARRAY<STRING>>' AS s FROM nation")
same("fn_json_tuple", "SELECT event_id, j.k FROM events LATERAL VIEW json_tuple(props, 'k') j AS k", "SELECT event_id, props->>'$.k' AS k FROM events")
same(
    "fn_cond",
    """SELECT event_id, coalesce(n, event_type) AS c, nvl(n, 'none') AS nv, nvl2(n, 'some', 'none') AS n2, ifnull(n, 'x') AS ifn, nullif(event_type, 'view') AS nl, struct(event_id, event_type).event_type AS st, named_struct('q', value).q AS ns
      FROM (SELECT *, nullif(event_type, 'click') AS n FROM events)""",
    """SELECT event_id, coalesce(n, event_type) AS c, coalesce(n, 'none') AS nv, CASE WHEN n IS NULL THEN 'none' ELSE 'some' END AS n2, ifnull(n, 'x') AS ifn, nullif(event_type, 'view') AS nl, struct_pack(a := event_id, event_type := event_type).event_type AS st, struct_pack(q := value).q AS ns
      FROM (SELECT *, nullif(event_type, 'click') AS n FROM events)""",
)
same(
    "fn_url",
    "SELECT page_id, parse_url(url, 'PROTOCOL') AS scheme, parse_url(url, 'HOST') AS host, parse_url(url, 'REF') AS ref FROM pages",
    "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS ref FROM pages",
)


@query(
    "fn_dot",
    """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS c,
       round(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def fn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(dot("embedding", "other"), 6).alias("d"), F.round(cosine("embedding", "other"), 6).alias("c"), F.round(norm("embedding"), 6).alias("n"))


@query("udf_sql", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 40")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    return sql(spark, sf_dir, "SELECT l_orderkey, round(net_price(l_extendedprice, l_discount), 4) AS net FROM lineitem WHERE l_quantity > 40")


@query("udtf_sql", "SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-10', INTERVAL 1 DAY)) AS DATE) AS day")
def udtf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql_functions(spark)
    return spark.sql("SELECT day FROM day_span(DATE '2024-01-01', 10)")


@query("udf_vectorised", "SELECT event_id, greatest(least(value, 60.0), 20.0) AS v FROM events")
def udf_vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", clipped(F.col("value"), F.lit(20.0), F.lit(60.0)).alias("v"))


@query("udaf_python", "SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS g FROM events GROUP BY event_type")
def udaf_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(geometric_mean(F.col("value") + 1), 6).alias("g"))


@query("udtf_python", "SELECT p_partkey, w AS word, CAST(i AS INTEGER) AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) WHERE w <> ''")
def udtf_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("words_of", Words)
    return sql(spark, sf_dir, "SELECT p_partkey, word, place FROM part, LATERAL words_of(p_name)")
