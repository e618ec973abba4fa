"""Queries over the cleaned tables: cleaning, profiles, samples, joins, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import audit, cleaning, profile, sampling
from tessera.plans.registry import query
from tessera.sources import ndjson, roles
from tessera.sources.artifacts import Tables
from tessera.sources.roles import sql


def latest(spark, sf: str, dealt: str | None = None) -> DataFrame:
    """The latest review of each pair; dealt by a column, what follows by it needs no shuffle of its own."""
    return cleaning.latest_pair(roles.reviews(spark, sf, dealt)).withColumn("text_len", F.length("text"))


def business(spark, sf: str) -> DataFrame:
    return cleaning.clean_business(roles.business(spark, sf))


def users(spark, sf: str) -> DataFrame:
    return cleaning.clean_users(roles.users(spark, sf))


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return frame.select(*[(F.round(c, places) if t == "double" else F.col(c)).alias(c) for c, t in frame.dtypes])


@query("rating_distribution", sql("latest", tail=" SELECT stars, count(*) AS n, round((SELECT avg(stars) FROM latest), 6) AS mean_stars FROM latest GROUP BY stars"))
def rating_distribution(spark, sf):
    return rounded(profile.rating_distribution(latest(spark, sf)))


@query(
    "length_histogram",
    """WITH v AS (SELECT least(CAST(n_chars AS DOUBLE), 2000) AS x, n_chars FROM documents), r AS (SELECT min(x) AS lo, max(x) AS hi, median(n_chars) AS median_length FROM v),
    b AS (SELECT least(CAST(floor((x - lo) * 50 / (hi - lo)) AS INT), 49) AS bin, count(*) AS n FROM v, r GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, round(lo + i * (hi - lo) / 50, 6) AS low, coalesce(n, 0) AS n, round(CAST(median_length AS DOUBLE), 6) AS median_length FROM range(50) t(i) CROSS JOIN r LEFT JOIN b ON b.bin = i""",
)
def length_histogram(spark, sf):
    return rounded(profile.length_histogram(roles.read(spark, sf, "documents"), "n_chars"))


@query("freq_of_freq", sql("business", tail=" SELECT review_count AS value, count(*) AS n FROM business WHERE review_count > 0 GROUP BY 1"))
def freq_of_freq(spark, sf):
    return profile.frequency_of_values(roles.business(spark, sf), "review_count")


@query("power_law_users", sql("latest", tail=" SELECT n AS value, count(*) AS n FROM (SELECT user_id, count(*) AS n FROM latest GROUP BY 1) GROUP BY 1"))
def power_law_users(spark, sf):
    return profile.activity_power_law(latest(spark, sf), "user_id")


@query("top_categories", sql("business", tail=" SELECT category, count(*) AS n FROM (SELECT unnest(categories_list) AS category FROM business) GROUP BY 1 ORDER BY n DESC, category LIMIT 15"))
def top_categories(spark, sf):
    return profile.top_categories(roles.business(spark, sf).withColumn("categories_list", cleaning.parse_categories(F.col("categories"))))


@query("geo_projection", sql("business", tail=" SELECT longitude, latitude, stars FROM business"))
def geo_projection(spark, sf):
    return profile.geography(roles.business(spark, sf))


@query(
    "monthly_series",
    sql("latest", tail=""", m AS (SELECT date_trunc('month', date) AS month, count(*) AS n FROM latest WHERE date IS NOT NULL GROUP BY 1)
    SELECT strftime(t.month, '%Y-%m-%d') AS month, coalesce(m.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month) t LEFT JOIN m ON m.month = t.month"""),
)
def monthly_series(spark, sf):
    return profile.monthly_series(latest(spark, sf)).withColumn("month", F.col("month").cast("string"))


@query(
    "degree_profile",
    sql("edges", "nodes", tail=""", d AS (SELECT id, count(dst) AS n FROM nodes LEFT JOIN edges ON src = id GROUP BY id)
    SELECT n AS value, count(*) AS n, round((SELECT avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) FROM d), 6) AS share_alone FROM d WHERE n > 0 GROUP BY 1"""),
)
def degree_profile(spark, sf):
    edges, nodes = roles.friendship(spark, sf)
    counts = edges.groupBy(F.col("src").alias("id")).count()
    return rounded(profile.degree_profile(nodes.join(counts, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("degree")), "degree"))


@query(
    "segments",
    sql("business", "users", tail=""" SELECT 'is_open' AS segment, f AS flag, round((SELECT avg(stars) FROM business WHERE is_open = f), 6) AS mean FROM (VALUES (0), (1)) t(f)
    UNION ALL SELECT 'is_elite', f, round((SELECT avg(average_stars) FROM users WHERE CAST(is_elite AS INT) = f), 6) FROM (VALUES (0), (1)) t(f)"""),
)
def segments(spark, sf):
    return rounded(profile.segments(roles.business(spark, sf), users(spark, sf)))


@query("clean_latest_pair", sql("latest", tail=" SELECT review_id, user_id, business_id, stars, CAST(text_len AS INT) AS text_len FROM latest"))
def clean_latest_pair(spark, sf):
    return latest(spark, sf).select("review_id", "user_id", "business_id", "stars", "text_len")


@query("dedupe_keep_first", "SELECT p_name AS name, min(p_partkey) AS business_id FROM part GROUP BY 1")
def dedupe_keep_first(spark, sf):
    return cleaning.first_of(roles.business(spark, sf), "name", ["business_id"]).select("name", "business_id")


@query("parse_categories", sql("business", tail=" SELECT business_id, array_to_string(categories_list, '|') AS categories, CAST(len(categories_list) AS INT) AS n_categories FROM business"))
def parse_categories(spark, sf):
    return business(spark, sf).select("business_id", F.array_join("categories_list", "|").alias("categories"), "n_categories")


@query("attribute_access", sql("business", tail=" SELECT business_id, CAST(price_range AS INT) AS price_range, CASE WHEN price_range IS NOT NULL THEN 'free' END AS wifi FROM business"))
def attribute_access(spark, sf):
    return business(spark, sf).select("business_id", "price_range", F.try_element_at("attributes_clean", F.lit("WiFi")).alias("wifi"))


@query("event_attributes", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def event_attributes(spark, sf):
    parsed = cleaning.parse_attributes(F.col("props"))
    return roles.events(spark, sf).select("event_id", cleaning.as_int(F.try_element_at(parsed, F.lit("k"))).alias("k"))


@query("json_key_count", sql("business", tail=" SELECT business_id, CAST(n_days_open AS INT) AS n_days_open FROM business"))
def json_key_count(spark, sf):
    return business(spark, sf).select("business_id", "n_days_open")


@query("elite_years", sql("users", tail=" SELECT user_id, CAST(n_elite_years AS INT) AS n_elite_years, is_elite FROM users"))
def elite_years(spark, sf):
    return users(spark, sf).select("user_id", "n_elite_years", "is_elite")


@query("csv_part_count", sql("checkins", tail=" SELECT business_id, CAST(n_checkins AS INT) AS n_checkins FROM checkins"))
def csv_part_count(spark, sf):
    return cleaning.clean_checkins(roles.checkins(spark, sf)).select("business_id", "n_checkins")


@query("clean_tips", "SELECT user_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS compliments FROM (SELECT DISTINCT user_id, event_id % 50, event_type, ts, CAST(floor(value) AS BIGINT) AS c FROM events) GROUP BY 1")
def clean_tips(spark, sf):
    return cleaning.clean_tips(roles.tips(spark, sf)).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("compliment_count").alias("compliments"))


@query("p99_outlier_flag", sql("users", tail=" SELECT user_id, review_count > (SELECT quantile_cont(review_count, 0.99) FROM users) AS rc_outlier FROM users"))
def p99_outlier_flag(spark, sf):
    return users(spark, sf).select("user_id", "rc_outlier")


@query(
    "clean_report",
    sql("reviews", "business", "users", tail=""" SELECT 'business_duplicates' AS metric, CAST(0 AS BIGINT) AS value
    UNION ALL SELECT 'business_without_category', 0 UNION ALL SELECT 'business_without_attributes', count(*) FROM business WHERE price_range IS NULL
    UNION ALL SELECT 'business_without_price', count(*) FROM business WHERE price_range IS NULL UNION ALL SELECT 'business_without_hours', count(*) FROM business WHERE n_days_open = 0
    UNION ALL SELECT 'business_outliers', count(*) FROM business WHERE review_count > (SELECT quantile_cont(review_count, 0.99) FROM business)
    UNION ALL SELECT 'reviews_raw', count(*) FROM reviews UNION ALL SELECT 'reviews_duplicates', count(*) - count(DISTINCT review_id) FROM reviews
    UNION ALL SELECT 'reviews_pairs', count(*) FROM (SELECT DISTINCT user_id, business_id FROM reviews)
    UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'users_elite', count(*) FROM users WHERE is_elite
    UNION ALL SELECT 'users_outliers', count(*) FROM users WHERE review_count > (SELECT quantile_cont(review_count, 0.99) FROM users)"""),
)
def clean_report(spark, sf):
    raw = Tables(roles.business(spark, sf), roles.reviews(spark, sf), roles.users(spark, sf), roles.checkins(spark, sf), roles.tips(spark, sf))
    return cleaning.report(raw, cleaning.clean_all(raw))


@query("impute_median", sql("business", tail=" SELECT business_id, coalesce(CAST(price_range AS DOUBLE), (SELECT median(price_range) FROM business)) AS price_range_imp FROM business"))
def impute_median(spark, sf):
    return cleaning.impute_median(business(spark, sf), "price_range", "price_range_imp").select("business_id", "price_range_imp")


@query(
    "stratified_sample_sizes",
    sql("users", tail=""" SELECT lower(trim(city)) || '|' || state AS stratum, CAST(round_even(least(1.0, 300.0 / (SELECT count(*) FROM users)) * count(*), 0) AS BIGINT) AS n
    FROM users GROUP BY 1 HAVING round_even(least(1.0, 300.0 / (SELECT count(*) FROM users)) * count(*), 0) > 0"""),
)
def stratified_sample_sizes(spark, sf):
    sample = sampling.stratified_sample(roles.users(spark, sf), "user_id", 300)
    return sample.groupBy(sampling.stratum().alias("stratum")).agg(F.count("*").alias("n"))


@query("stratified_representativity")
def stratified_representativity(spark, sf):
    rows = roles.users(spark, sf)
    return sampling.sample_report(rows, sampling.stratified_sample(rows, "user_id", 300), ["review_count", "average_stars"])


@query("per_group_head", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 50")
def per_group_head(spark, sf):
    return sampling.head_per_group(roles.read(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 50)


@query(
    "friends_within",
    sql("pairs", "nodes", tail=""" SELECT id AS user_id, CAST(count(b) AS INT) AS n_friends_total, CAST(count(b) FILTER (b IN (SELECT id FROM nodes WHERE community = 'BUILDING')) AS INT) AS n_friends_subset,
    coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FILTER (b IN (SELECT id FROM nodes WHERE community = 'BUILDING')), '') AS friends_subset FROM nodes LEFT JOIN pairs ON a = id GROUP BY id"""),
)
def friends_within(spark, sf):
    rows = roles.users_with_friends(spark, sf)
    ids = rows.where("state = 'BUILDING'").select("user_id")
    return ndjson.friends_within(rows, ids).select("user_id", "n_friends_total", "n_friends_subset", "friends_subset")


@query("semi_sample", sql("reviews", "users", tail=" SELECT business_id, count(*) AS n FROM reviews WHERE business_id IN (SELECT business_id FROM reviews JOIN users USING (user_id) WHERE stars = 5 AND is_elite) GROUP BY 1"))
def semi_sample(spark, sf):
    rows = roles.reviews(spark, sf)
    praised = rows.where("stars = 5").join(users(spark, sf).where("is_elite").select("user_id"), "user_id", "left_semi")
    return ndjson.keep_known(rows, praised, "business_id").groupBy("business_id").agg(F.count("*").alias("n"))


@query("left_enrich", sql("business", "checkins", tail=" SELECT b.business_id, b.name, coalesce(c.n_checkins, 0) AS n_checkins FROM business b LEFT JOIN checkins c ON c.business_id = b.business_id"))
def left_enrich(spark, sf):
    counts = cleaning.clean_checkins(roles.checkins(spark, sf)).groupBy("business_id").agg(F.sum("n_checkins").alias("n_checkins"))
    return roles.business(spark, sf).join(counts, "business_id", "left").select("business_id", "name", F.coalesce("n_checkins", F.lit(0)).alias("n_checkins"))


@query("seen_items", sql("latest", "business", tail=" SELECT l.business_id, b.name, l.stars FROM latest l JOIN business b ON b.business_id = l.business_id WHERE l.user_id = (SELECT user_id FROM latest GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)"))
def seen_items(spark, sf):
    rows = latest(spark, sf)
    most = rows.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).select("user_id")
    return rows.join(F.broadcast(most), "user_id", "left_semi").join(roles.business(spark, sf).select("business_id", "name"), "business_id").select("business_id", "name", "stars")


@query("existence_flag", sql("latest", "users", tail=" SELECT u.is_elite, count(*) AS n FROM latest l JOIN users u ON u.user_id = l.user_id GROUP BY 1"))
def existence_flag(spark, sf):
    elite = users(spark, sf).where("is_elite").select("user_id").distinct().withColumn("_e", F.lit(True))
    flag = F.col("_e").isNotNull()
    return latest(spark, sf).join(elite, "user_id", "left").groupBy(flag.alias("is_elite")).agg(F.count("*").alias("n"))


@query("lookup_fill_zero", sql("latest", "nodes", tail=" SELECT id AS user_id, count(review_id) AS n FROM nodes LEFT JOIN latest ON user_id = id GROUP BY id"))
def lookup_fill_zero(spark, sf):
    counts = latest(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return roles.users(spark, sf).select("user_id").join(counts, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "corr_matrix",
    sql("latest", "users", tail=""" SELECT round(corr(n, review_count), 6) AS corr_reviews, round(corr(n, average_stars), 6) AS corr_stars, round(corr(review_count, average_stars), 6) AS corr_profile
    FROM users u JOIN (SELECT user_id, count(*) AS n FROM latest GROUP BY 1) c ON c.user_id = u.user_id"""),
)
def corr_matrix(spark, sf):
    rows = roles.users(spark, sf).join(latest(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    return rounded(rows.agg(F.corr("n", "review_count").alias("corr_reviews"), F.corr("n", "average_stars").alias("corr_stars"), F.corr("review_count", "average_stars").alias("corr_profile")))


@query("rank_min", sql("latest", tail=" SELECT business_id, n, rank() OVER (ORDER BY n DESC) AS rank FROM (SELECT business_id, count(*) AS n FROM latest GROUP BY 1)"))
def rank_min(spark, sf):
    from tessera.operators.graph import ranks

    return ranks(latest(spark, sf).groupBy("business_id").agg(F.count("*").alias("n")), "n")


@query("topk_limit", sql("latest", tail=" SELECT business_id, count(*) AS n FROM latest GROUP BY 1 ORDER BY n DESC, business_id LIMIT 15"))
def topk_limit(spark, sf):
    return latest(spark, sf).groupBy("business_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "business_id").limit(15)


@query(
    "intersect_top",
    sql("latest", tail=""" SELECT business_id FROM (SELECT business_id FROM latest GROUP BY 1 ORDER BY count(*) DESC, business_id LIMIT 100)
    INTERSECT SELECT business_id FROM (SELECT business_id FROM latest GROUP BY 1 ORDER BY sum(stars) DESC, business_id LIMIT 100)"""),
)
def intersect_top(spark, sf):
    rows = latest(spark, sf).groupBy("business_id").agg(F.count("*").alias("n"), F.sum("stars").alias("s"))
    return rows.orderBy(F.desc("n"), "business_id").limit(100).select("business_id").intersect(rows.orderBy(F.desc("s"), "business_id").limit(100).select("business_id"))


@query("gini", sql("latest", tail=""" , v AS (SELECT count(*) AS x FROM latest GROUP BY user_id), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM v)
    SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM r"""))
def gini(spark, sf):
    return rounded(audit.gini(latest(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")), "n"))


@query(
    "concentration",
    sql("latest", "users", "business", tail=""" , pu AS (SELECT user_id, count(*) AS n FROM latest GROUP BY 1), pb AS (SELECT business_id, count(*) AS n FROM latest GROUP BY 1),
    ab AS (SELECT coalesce(n, 0) AS n FROM business LEFT JOIN pb USING (business_id))
    SELECT 'single_review_users' AS metric, round((SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) FROM pu), 6) AS value
    UNION ALL SELECT 'top_users_share', round((SELECT sum(n) FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM pu) WHERE k <= greatest(1, (SELECT count(*) // 100 FROM pu))) / (SELECT sum(n) FROM pu), 6)
    UNION ALL SELECT 'top_business_share', round((SELECT sum(n) FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM pb) WHERE k <= greatest(1, (SELECT count(*) // 100 FROM pb))) / (SELECT sum(n) FROM pb), 6)
    UNION ALL SELECT 'elite_users', round((SELECT avg(CAST(is_elite AS INT)) FROM users), 6)
    UNION ALL SELECT 'elite_reviews', round((SELECT avg(CAST(is_elite AS INT)) FROM latest JOIN users USING (user_id)), 6)
    UNION ALL SELECT 'small_business', round((SELECT avg(CASE WHEN n < 10 THEN 1.0 ELSE 0.0 END) FROM ab), 6)
    UNION ALL SELECT 'gini_users', round((SELECT 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM pu)), 6)
    UNION ALL SELECT 'gini_business', round((SELECT 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM ab)), 6)"""),
)
def concentration(spark, sf):
    return rounded(audit.concentration(latest(spark, sf), users(spark, sf), roles.business(spark, sf)))


@query(
    "chains_vs_small",
    sql("latest", "business", tail=""" , c AS (SELECT name FROM business GROUP BY 1 HAVING count(*) >= 5), n AS (SELECT business_id, count(*) AS n FROM latest GROUP BY 1)
    SELECT CASE WHEN name IN (SELECT name FROM c) THEN 'chain (>= 5 locations)' ELSE 'independent' END AS kind, count(*) AS n, round_even(avg(stars), 2) AS mean_stars,
    round_even(CAST(median(review_count) AS DOUBLE), 2) AS median_review_count, round_even(avg(coalesce(n.n, 0)), 2) AS mean_reviews, round_even(avg(is_open), 2) AS share_open
    FROM business b LEFT JOIN n ON n.business_id = b.business_id GROUP BY 1"""),
)
def chains_vs_small(spark, sf):
    return audit.chains_vs_small(roles.business(spark, sf), latest(spark, sf))


@query("multi_agg_chain", sql("business", tail=" SELECT name, count(*) AS n FROM business GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, name LIMIT 8"))
def multi_agg_chain(spark, sf):
    return audit.chains(roles.business(spark, sf)).orderBy(F.desc("n"), "name").limit(8)


@query("complexity_table", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{c}'" for c in row) + ")" for row in audit.COSTS) + ") AS t(part, algorithm, time, space, scaling)")
def complexity_table(spark, sf):
    return audit.complexity_table(spark)


@query("cumcount", sql("latest", tail=" SELECT user_id, review_id, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS size FROM latest"))
def cumcount(spark, sf):
    mine = Window.partitionBy("user_id")
    place = (F.row_number().over(mine.orderBy("date", "review_id")) - 1).cast("long")
    return latest(spark, sf).select("user_id", "review_id", place.alias("place"), F.count("*").over(mine).alias("size"))
