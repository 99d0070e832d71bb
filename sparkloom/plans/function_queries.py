"""Queries that apply the function library to whole tables, several functions each."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom import functions as X
from sparkloom.plans.registry import query, rounded, spread


def _r(c, n, digits=6):
    return rounded(c, digits).alias(n)


@query(
    "fn_numeric_basic",
    """SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, ceil(l_tax * 100)::bigint AS c, floor(l_tax * 100)::bigint AS f, sign(l_quantity - 25) AS s,
       round(l_extendedprice, 1) AS r, greatest(10, least(30, l_quantity)) AS cl, round(sqrt(l_quantity), 6) AS sq, round(cbrt(l_quantity), 6) AS cb, round(l_quantity ** 2, 6) AS p,
       l_orderkey % 7 AS m, round(l_extendedprice / l_quantity, 6) AS d, CASE WHEN l_linenumber = 1 THEN NULL ELSE round(1 / (l_linenumber - 1.0), 6) END AS td,
       l_quantity BETWEEN 10 AND 20 AS b, bin(l_linenumber) AS bi, -l_quantity AS neg FROM lineitem""",
)
def fn_numeric_basic(t):
    q = F.col("l_quantity")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", X.abs(q - 25).alias("a"), X.ceil(F.col("l_tax") * 100).alias("c"), X.floor(F.col("l_tax") * 100).alias("f"), X.sign(q - 25).alias("s"), X.round("l_extendedprice", 1).alias("r"),
        X.clip("l_quantity", 10, 30).alias("cl"), _r(X.sqrt(q), "sq"), _r(X.cbrt(q), "cb"), _r(X.pow(q, 2), "p"), X.pmod("l_orderkey", 7).alias("m"), _r(X.true_divide("l_extendedprice", "l_quantity"), "d"),
        _r(X.try_divide(F.lit(1.0), F.col("l_linenumber") - 1), "td"), X.between("l_quantity", 10, 20).alias("b"), X.bin("l_linenumber").alias("bi"), X.negate(q).alias("neg"),
    )


_X = "(p_size / 60.0)"


@query(
    "fn_numeric_trig_log",
    f"""SELECT p_partkey, round(sin({_X}), 6) AS sin, round(cos({_X}), 6) AS cos, round(tan({_X}), 6) AS tan, round(cot({_X}), 6) AS cot, round(1 / sin({_X}), 6) AS csc, round(1 / cos({_X}), 6) AS sec,
       round(sinh({_X}), 6) AS sinh, round(cosh({_X}), 6) AS cosh, round(tanh({_X}), 6) AS tanh, round(asin({_X}), 6) AS asin, round(acos({_X}), 6) AS acos, round(atan({_X}), 6) AS atan,
       round(atan2({_X}, 2), 6) AS atan2, round(asinh({_X}), 6) AS asinh, round(acosh(1 + {_X}), 6) AS acosh, round(atanh({_X}), 6) AS atanh, round(radians(p_size), 6) AS rad, round(degrees({_X}), 6) AS deg,
       round(ln(p_size), 6) AS ln, round(log2(p_size), 6) AS l2, round(log10(p_size), 6) AS l10, round(ln(p_size) / ln(3), 6) AS l3, round(ln(1 + p_size), 6) AS l1p, round(exp({_X}), 6) AS exp, round(exp({_X}) - 1, 6) AS em1,
       round(sqrt(p_size * p_size + 9), 6) AS hyp, round(pi(), 6) AS pi, round(exp(1), 6) AS e, (p_size % 10)! AS fact FROM part""",
)
def fn_trig(t):
    x, s = F.col("p_size") / 60.0, F.col("p_size")
    one = {n: getattr(X, {"asin": "arcsin", "acos": "arccos", "atan": "arctan", "asinh": "arcsinh", "atanh": "arctanh"}.get(n, n))(x) for n in "sin cos tan cot csc sec sinh cosh tanh asin acos atan asinh atanh exp".split()}
    more = {"atan2": X.arctan2(x, F.lit(2)), "acosh": X.arccosh(1 + x), "rad": X.radians(s), "deg": X.degrees(x), "ln": X.ln(s), "l2": X.log2(s), "l10": X.log10(s), "l3": X.log(s, 3), "l1p": X.log1p(s), "em1": X.expm1(x), "hyp": X.hypot(s, F.lit(3)), "pi": X.pi(), "e": X.e()}
    return t("part").select("p_partkey", *(_r(c, n) for n, c in (one | more).items()), X.factorial(s % 10).alias("fact"))


@query(
    "fn_bitwise_columns",
    """SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, bit_count(xor(o_orderkey, o_custkey))::int AS h,
       o_orderkey + o_custkey AS s, (o_orderkey + o_custkey) / 2.0 AS m, least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi FROM orders""",
)
def fn_bitwise(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select(k, X.bitwise_and(k, 12).alias("a"), X.bitwise_or(k, 3).alias("o"), X.bitwise_xor(k, 5).alias("x"), X.shift_left(k, 2).alias("l"), X.shift_right(k, 1).alias("r"), X.hamming_distance(k, c).alias("h"), X.columns_sum(k, c).alias("s"), X.columns_mean(k, c).alias("m"), X.columns_min(k, c).alias("lo"), X.columns_max(k, c).alias("hi"))


_N = "coalesce(n_name, '')"


@query(
    "fn_strings_basic",
    """SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, reverse(p_name) AS re, upper(p_name[1:1]) || lower(p_name[2:]) AS ca, left(p_name, 4) AS le, right(p_name, 3) AS ri, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp,
       repeat(p_brand, 2) AS rep, contains(p_name, 'a') AS co, starts_with(p_type, 'S') AS st, ends_with(p_type, 'L') AS en, p_type LIKE '%A%' AS li, p_type ILIKE 's%' AS il, substring(p_name, 3, 4) AS su, (instr(p_name, 'e') - 1)::int AS fi,
       replace(p_name, 'a', 'A') AS rl, translate(p_name, 'aeiou', '12345') AS tr, length(p_name)::int AS n, strlen(p_name)::int AS nb, ascii(p_name)::int AS asc, concat_ws('-', p_brand, p_type) AS cw, p_brand || ':' || p_size AS fo, trim('  ' || p_type || ' ') AS tm FROM part""",
)
def fn_strings(t):
    n, b, y = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t("part").select(
        "p_partkey", X.lower(n).alias("lo"), X.upper(n).alias("up"), X.reverse(n).alias("re"), X.capitalize(n).alias("ca"), X.left(n, 4).alias("le"), X.right(n, 3).alias("ri"), X.lpad(b, 12, "*").alias("lp"), X.rpad(b, 12, "-").alias("rp"),
        X.repeat(b, 2).alias("rep"), X.contains(n, "a").alias("co"), X.startswith(y, "S").alias("st"), X.endswith(y, "L").alias("en"), X.like(y, "%A%").alias("li"), X.ilike(y, "s%").alias("il"), X.substr(n, 2, 4).alias("su"), X.find(n, "e").alias("fi"),
        X.replace(n, "a", "A").alias("rl"), X.translate(n, "aeiou", "12345").alias("tr"), X.length(n).alias("n"), X.length_bytes(n).alias("nb"), X.ascii_func(n).alias("asc"), X.concat_ws("-", b, y).alias("cw"), X.format("{}:{}", "p_brand", "p_size").alias("fo"), X.strip(F.concat(F.lit("  "), y, F.lit(" "))).alias("tm"),
    )


@query(
    "fn_strings_regex",
    """SELECT doc_id, regexp_matches(text, '[0-9]{2}') AS m, len(regexp_extract_all(text, '[A-Z]'))::int AS caps, nullif(regexp_extract(text, '[a-z]+ing'), '') AS ing, regexp_replace(text, '[aeiou]+', '_', 'g') AS rp,
       len(string_split_regex(text, '\\s+'))::int AS words, split_part(text, ' ', 2) AS second, len(regexp_extract_all(text, 'the|tion'))::int AS cm, levenshtein(lang, source)::int AS lev FROM documents""",
)
def fn_regex(t):
    x = F.col("text")
    return t("documents").select(
        "doc_id", X.regexp(x, "[0-9]{2}").alias("m"), X.regexp_count(x, "[A-Z]").alias("caps"), X.regexp_extract(x, "[a-z]+ing").alias("ing"), X.regexp_replace(x, "[aeiou]+", "_").alias("rp"),
        F.size(X.regexp_split(x, r"\s+")).alias("words"), X.split_part(x, " ", 2).alias("second"), X.count_matches(x, ["the", "tion"]).alias("cm"), X.levenshtein_distance("lang", "source").alias("lev"),
    )


@query("fn_string_cases", "SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS snake, upper(replace(p_type, ' ', '_')) AS usnake, lower(replace(p_type, ' ', '-')) AS kebab, upper(replace(p_type, ' ', '-')) AS ukebab FROM part")
def fn_cases(t):
    return t("part").select("p_partkey", X.to_snake_case("p_type").alias("snake"), X.to_upper_snake_case("p_type").alias("usnake"), X.to_kebab_case("p_type").alias("kebab"), X.to_upper_kebab_case("p_type").alias("ukebab"))


@query(
    "fn_string_distances",
    "SELECT n_nationkey, round(jaro_similarity(n_name, r_name), 6) AS jaro, round(jaro_winkler_similarity(n_name, r_name), 6) AS jw, damerau_levenshtein(n_name, r_name) AS dl FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def fn_distances(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", _r(X.jaro_similarity("n_name", "r_name"), "jaro"), _r(X.jaro_winkler_similarity("n_name", "r_name"), "jw"), X.damerau_levenshtein_distance("n_name", "r_name").alias("dl"))


@query(
    "fn_temporal_parts",
    """SELECT o_orderkey, o_orderdate::date::varchar AS d, day(o_orderdate)::int AS dd, month(o_orderdate)::int AS mm, quarter(o_orderdate)::int AS qq, year(o_orderdate)::int AS yy, (isodow(o_orderdate) - 1)::int AS dow, dayofyear(o_orderdate)::int AS doy,
       weekofyear(o_orderdate)::int AS woy, hour(o_orderdate)::int AS h, minute(o_orderdate)::int AS mi, second(o_orderdate)::int AS s, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f, epoch(o_orderdate)::bigint AS ep,
       (o_orderdate::date + 10)::date::varchar AS da, (o_orderdate::date - 3)::date::varchar AS ds, last_day(o_orderdate)::varchar AS ld, datediff('day', DATE '1995-01-01', o_orderdate::date)::int AS df, (o_orderdate::date + INTERVAL 2 MONTH)::date::varchar AS am,
       date_trunc('month', o_orderdate)::timestamp AS tm, date_trunc('week', o_orderdate)::timestamp AS tw, date_trunc('day', o_orderdate)::timestamp AS td FROM orders""",
)
def fn_temporal(t):
    d = F.col("o_orderdate")
    return t("orders").select(
        "o_orderkey", X.date(d).cast("string").alias("d"), X.day(d).alias("dd"), X.month(d).alias("mm"), X.quarter(d).alias("qq"), X.year(d).alias("yy"), X.day_of_week(d).alias("dow"), X.day_of_year(d).alias("doy"), X.week_of_year(d).alias("woy"),
        X.hour(d).alias("h"), X.minute(d).alias("mi"), X.second(d).alias("s"), X.strftime(d, "%Y/%m/%d %H:%M").alias("f"), X.to_unix_epoch(d, "s").alias("ep"), X.date_add(d, 10).cast("string").alias("da"), X.date_sub(d, 3).cast("string").alias("ds"), X.last_day(d).cast("string").alias("ld"),
        X.date_diff(d, F.lit("1995-01-01").cast("date")).alias("df"), X.add_months(d, 2).cast("string").alias("am"), X.date_trunc("month", d).alias("tm"), X.date_trunc("week", d).alias("tw"), X.date_trunc("day", d).alias("td"),
    )


@query(
    "fn_temporal_micro",
    """SELECT event_id, (epoch_us(ts) % 1000000)::int AS us, ((epoch_us(ts) % 1000000) // 1000)::int AS ms, epoch_us(ts) AS eu, epoch_us(ts) // 1000 AS em, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS hours, make_date(year(ts)::int, month(ts)::int, 1)::varchar AS md, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')::date::varchar AS pd FROM events""",
)
def fn_micro(t):
    s = F.col("ts")
    return t("events").select("event_id", X.microsecond(s).alias("us"), X.millisecond(s).alias("ms"), X.to_unix_epoch(s, "us").alias("eu"), X.to_unix_epoch(s, "ms").alias("em"), F.floor((X.micros(s) - X.micros(F.lit("2024-01-01").cast("timestamp_ntz"))) / 3_600_000_000).alias("hours"), X.make_date(F.year(s), F.month(s), F.lit(1)).cast("string").alias("md"), X.to_date(X.strftime(s, "%Y-%m-%d"), "%Y-%m-%d").cast("string").alias("pd"))


@query(
    "fn_lists",
    """SELECT vec_id, len(embedding)::int AS n, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) AS s, round(list_avg(list_transform(embedding, lambda x: x::double)), 6) AS a, round(list_min(embedding)::double, 6) AS lo, round(list_max(embedding)::double, 6) AS hi,
       len(list_filter(embedding, lambda x: x > 0))::int AS pos, round(embedding[1]::double, 6) AS first, round(embedding[-1]::double, 6) AS last, list_transform(embedding[2:4], lambda x: round(x::double, 4)) AS sl, list_transform(list_sort(embedding[1:3]), lambda x: round(x::double, 4)) AS so, len(embedding) // 4 AS ch FROM embeddings""",
)
def fn_lists(t):
    e = F.col("embedding")
    d = F.transform(e, lambda x: x.cast("double"))
    small = lambda c: F.transform(c, lambda x: rounded(x.cast("double"), 4))
    return t("embeddings").select(
        "vec_id", X.list_count(e).alias("n"), _r(X.list_sum(d), "s"), _r(X.list_mean(d), "a"), _r(X.list_min(e).cast("double"), "lo"), _r(X.list_max(e).cast("double"), "hi"), F.size(X.list_filter(e, lambda x: x > 0)).alias("pos"),
        _r(X.get(e, 0).cast("double"), "first"), _r(X.get(e, -1).cast("double"), "last"), small(X.list_slice(e, 1, 4)).alias("sl"), small(X.list_sort(X.list_slice(e, 0, 3))).alias("so"), F.size(X.chunk(e, 4)).cast("long").alias("ch"),
    )


@query(
    "fn_list_strings",
    """SELECT p_partkey, string_split(p_name, ' ') AS sp, array_to_string(string_split(p_name, ' '), '+') AS jo, list_contains(string_split(p_type, ' '), 'STEEL') AS c, len(list_distinct(string_split(p_name, 'a')))::int AS di, list_append(string_split(p_type, ' '), p_brand) AS ap, range(0, p_size % 4)::bigint[] AS sq FROM part""",
)
def fn_list_strings(t):
    n = X.split("p_name", " ")
    return t("part").select("p_partkey", n.alias("sp"), X.list_join(n, "+").alias("jo"), X.list_contains(X.split("p_type", " "), "STEEL").alias("c"), F.size(X.list_distinct(X.split("p_name", "a"))).alias("di"), X.list_append(X.split("p_type", " "), F.col("p_brand")).alias("ap"), X.seq(F.col("p_size") % 4).alias("sq"))


_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


@query(
    "fn_vector_distances",
    f"""SELECT vec_id, round(list_dot_product(embedding, q)::double, 4) AS dot, round(list_cosine_similarity(embedding::double[], q::double[]), 4) AS cos, round(list_distance(embedding::double[], q::double[]), 4) AS l2 FROM embeddings, {_Q}""",
)
def fn_vectors(t):
    q = t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t("embeddings").crossJoin(F.broadcast(q)).select("vec_id", _r(X.dot_product("embedding", "q"), "dot", 4), _r(X.cosine_similarity("embedding", "q"), "cos", 4), _r(X.euclidean_distance("embedding", "q"), "l2", 4))


@query(
    "fn_nulls_casts",
    """SELECT event_id, nullif(event_type, 'click') IS NULL AS isn, coalesce(nullif(event_type, 'click'), 'none') AS fi, event_type IN ('click', 'view') AS inn, event_type IS NOT DISTINCT FROM 'click' AS ens, value::bigint AS c, try_cast(event_type AS int) AS tc,
       CASE WHEN value > 50 THEN 'big' ELSE 'small' END AS w FROM (SELECT event_id, event_type, floor(value) AS value FROM events)""",
)
def fn_nulls(t):
    n = F.nullif("event_type", F.lit("click"))
    return t("events").withColumn("value", F.floor("value").cast("double")).select(
        "event_id", X.is_null(n).alias("isn"), X.fill_null(n, "none").alias("fi"), X.is_in("event_type", ["click", "view"]).alias("inn"), X.eq_null_safe("event_type", F.lit("click")).alias("ens"), X.cast("value", "long").alias("c"), X.try_cast("event_type", "int").alias("tc"), X.when(F.col("value") > 50, "big").otherwise("small").alias("w"),
    )


@query("fn_json", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS v, list_sort(json_keys(props)) AS k FROM events")
def fn_json(t):
    return t("events").select("event_id", F.expr("get_json_object(props, concat('$.', element_at(json_object_keys(props), 1)))").alias("v"), F.array_sort(X.json_object_keys("props")).alias("k"))


@query("fn_maps_structs", "SELECT n_nationkey, n_name AS got, NULL::varchar AS miss, n_regionkey AS field FROM nation")
def fn_maps(t):
    m, s = F.create_map(F.lit("name"), F.col("n_name")), X.to_struct("n_regionkey", "n_name")
    return t("nation").select("n_nationkey", X.map_get(m, "name").alias("got"), X.map_get(m, "none").alias("miss"), X.get(s, "n_regionkey").alias("field"))


@query("fn_binary_round_trip", "SELECT doc_id, text AS a, text AS b, base64(encode(text)) AS c, lower(hex(encode(source))) AS h FROM documents")
def fn_binary(t):
    x = F.col("text")
    return t("documents").select("doc_id", X.decode(X.encode(x)).alias("a"), X.decompress(X.compress(x, "gzip"), "gzip").cast("string").alias("b"), F.replace(X.encode(x, "base64").cast("string"), F.lit("\r\n"), F.lit("")).alias("c"), F.lower(X.encode("source", "hex").cast("string")).alias("h"))


@query("fn_urls", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/:?#]+')")
def fn_urls(t):
    u = X.parse_url("url")
    return t("pages").where(F.col("url").rlike("^[a-z]+://[^/:?#]+")).select("page_id", u["scheme"].alias("scheme"), u["host"].alias("host"))


@query("fn_hash_sketches", "SELECT count(*) AS n, count(DISTINCT text) AS texts FROM documents")
def fn_hash(t):
    rows = t("documents").select("text", X.hash("text").alias("h"), X.hash("text", seed=7).alias("h2"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("h", "h2").alias("texts"))


@query("fn_minhash_simhash")
def fn_minhash(t):
    return t("documents").select("doc_id", X.minhash("text", 8, 2).alias("mh"), X.simhash("text", 4).alias("sh"))


@query(
    "fn_partition_transforms",
    "SELECT o_orderkey, o_orderdate::date::varchar AS d, (epoch_us(o_orderdate) // 3600000000)::int AS h, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::int AS m, (year(o_orderdate) - 1970)::int AS y, o_orderkey - o_orderkey % 10 AS tr FROM orders",
)
def fn_partition(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", X.partition_days(d).cast("string").alias("d"), X.partition_hours(d).alias("h"), X.partition_months(d).alias("m"), X.partition_years(d).alias("y"), X.partition_iceberg_truncate("o_orderkey", 10).alias("tr"))


@query("fn_udf_row_batch", "SELECT c_custkey, c_custkey * 2 AS twice, c_custkey + 1 AS next FROM customer")
def fn_udf(t):
    from sparkloom.functions import udf

    twice = udf.func("long")(lambda k: k * 2)
    following = udf.batch("long")(lambda s: s + 1)
    return t("customer").select("c_custkey", twice("c_custkey").alias("twice"), following("c_custkey").alias("next"))


@query("fn_great_circle", "SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(10 - c_nationkey) / 2) ** 2 + cos(radians(c_nationkey)) * cos(radians(10)) * sin(radians(20 - c_custkey % 180) / 2) ** 2))), 2) AS m FROM customer")
def fn_circle(t):
    return t("customer").select("c_custkey", _r(X.great_circle_distance(F.col("c_nationkey"), F.col("c_custkey") % 180, F.lit(10), F.lit(20)), "m", 2))


@query("fn_images", "SELECT c_custkey, 4 AS w, 3 AS h, 'RGB' AS mode, 2 AS w2, 'L' AS gray FROM customer")
def fn_images(t):
    raw = F.struct(F.lit(3).alias("height"), F.lit(4).alias("width"), F.lit(3).alias("channels"), F.lit("RGB").alias("mode"), F.encode(F.rpad(F.col("c_name"), 36, "x"), "utf-8").alias("data"))
    image = X.decode_image(X.encode_image(raw))
    rows = spread(t("customer")).select("c_custkey", image.alias("i"))
    return rows.select("c_custkey", X.image_width("i").alias("w"), X.image_height("i").alias("h"), X.image_mode("i").alias("mode"), X.image_width(X.resize("i", 2, 2)).alias("w2"), X.image_mode(X.convert_image("i", "L")).alias("gray"))
