"""Catalogue, keyed-table, manifest and lookup-string queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.numeric import half_up
from tallycast.functions.timing import days
from tallycast.operators.trends import TREND_COLUMNS
from tallycast.plans.feature_queries import clean, newest_event, stored_clean
from tallycast.plans.metric_queries import long_scores
from tallycast.plans.oracle_views import r, with_views
from tallycast.plans.registry import query
from tallycast.session import cut
from tallycast.sources import catalogue as C
from tallycast.sources import manifest as MF
from tallycast.sources import tables as TB
from tallycast.sources import views as V

HOST = "markets.example.org"
SCOPE_START = "2023-06-01"
MICRO_TEXT, SECOND_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'"


def catalogue_lines(spark, d) -> DataFrame:
    """One catalogue record, as a line of JSON text, per event; with the flaws a real listing has."""
    e = F.col("event_id")
    price = half_up(F.least(F.col("value"), F.lit(100.0)) / 100.0, 4)
    span = days((F.floor("value") - 20).cast("int"))
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")

    def at(c, pattern):
        return F.date_format(c, pattern)

    key, keyless = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(e)), 64, "0")), (e % 41 == 0) | (e % 43 == 0)
    record = F.struct(
        F.when(e % 41 == 0, None).when(e % 43 == 0, "").otherwise(key).alias("conditionId"),
        F.when(keyless, key).otherwise(e.cast("string")).alias("id"),
        F.concat(F.lit("Question "), e.cast("string")).alias("question"),
        F.when(e % 6 == 0, " ").when(e % 6 == 1, "Legacy").when(e % 6 == 2, " Crypto ").otherwise(
            F.element_at(F.array(*[F.lit(c) for c in C.CATEGORIES]), (e % 9 + 1).cast("int"))).alias("category"),
        F.when(e % 10 != 0, F.concat(F.lit("m-"), e.cast("string"))).alias("slug"),
        F.when(e % 11 == 0, '["A","B","C"]').when(e % 13 == 0, "broken").when(e % 17 == 0, None).otherwise('["Yes","No"]').alias("outcomes"),
        F.when(e % 7 == 0, F.concat(F.lit('["'), price.cast("string"), F.lit('"]')))
        .when(e % 31 == 0, '["x","y"]')
        .otherwise(F.concat(F.lit('["'), price.cast("string"), F.lit('","'), (1 - price).cast("string"), F.lit('"]'))).alias("outcomePrices"),
        F.when(e % 9 == 0, "[]").otherwise(F.concat(F.lit('["tok'), e.cast("string"), F.lit('","no"]'))).alias("clobTokenIds"),
        F.when(e % 19 == 0, None).when(e % 23 == 0, "soon").when(e % 2 == 0, at("ts", MICRO_TEXT)).otherwise(at("ts", SECOND_TEXT)).alias("createdAt"),
        F.when(e % 37 == 0, None).when(e % 5 == 0, at(F.col("ts") - days(300), SECOND_TEXT)).otherwise(at("ts", SECOND_TEXT)).alias("startDate"),
        F.when(e % 29 == 0, None).otherwise(at(second + span, SECOND_TEXT)).alias("endDate"),
        F.when(e % 3 == 0, at(second + span, SECOND_TEXT)).alias("closedTime"),
        (F.col("value") * 100).alias("volumeNum"),
        (e % 3 == 0).alias("closed"),
        F.when(e % 4 == 0, F.array().cast("array<struct<slug:string>>")).otherwise(
            F.array(F.struct(F.concat(F.lit("ev-"), F.col("user_id").cast("string")).alias("slug")))).alias("events"),
    )
    return V.table(spark, d, "events").select(F.to_json(record).alias("record"))


def catalogue(spark, d) -> DataFrame:
    return C.from_lines(catalogue_lines(spark, d))


PRICE = r("least(value, 100.0) / 100.0", 4)
CATEGORY_SQL = "CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'Legacy' WHEN 2 THEN ' Crypto ' ELSE [{c}][event_id % 9 + 1] END".format(
    c=", ".join(f"'{c}'" for c in C.CATEGORIES))
CATALOGUE_SQL = f"""SELECT event_id AS e, '0x' || lpad(lower(to_hex(event_id)), 64, '0') AS market_id, 'Question ' || event_id AS question,
    {CATEGORY_SQL} AS category, CASE WHEN event_id % 10 <> 0 THEN 'm-' || event_id END AS slug,
    CASE WHEN event_id % 4 <> 0 THEN 'ev-' || user_id END AS event_slug,
    CAST(CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_outcomes,
    CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_prices_listed,
    CASE WHEN event_id % 7 = 0 OR event_id % 31 <> 0 THEN {PRICE} END AS yes_price,
    CASE WHEN event_id % 9 <> 0 THEN 'tok' || event_id END AS clob_token_id,
    CAST(CASE WHEN event_id % 9 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_tokens,
    CASE WHEN event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('second', ts) END AS created_at,
    CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 5 = 0 THEN date_trunc('second', ts) - to_days(300) ELSE date_trunc('second', ts) END AS scope_date,
    CASE WHEN event_id % 29 <> 0 THEN date_trunc('second', ts) + to_days(CAST(floor(value) - 20 AS INTEGER)) END AS end_date,
    CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) + to_days(CAST(floor(value) - 20 AS INTEGER)) END AS closed_time,
    value * 100 AS volume, event_id % 3 = 0 AS closed FROM events"""
DURATION_SQL = "CAST(floor((epoch_us(end_date) - epoch_us(created_at)) / 86400000000.0) AS BIGINT)"
REASON_SQL = f"""CASE WHEN n_outcomes <> 2 THEN 'not_binary' WHEN created_at IS NULL OR end_date IS NULL THEN 'bad_dates'
    WHEN {DURATION_SQL} <= 0 THEN 'negative_duration' WHEN {DURATION_SQL} < 30 THEN 'too_short'
    WHEN n_prices_listed < 2 OR yes_price IS NULL THEN 'no_outcome_field' WHEN yes_price < 0.95 AND yes_price > 0.05 THEN 'ambiguous_outcome'
    WHEN n_tokens = 0 THEN 'no_clob_token' END"""
CAT = {"cat": CATALOGUE_SQL}
CAT_COLUMNS = """market_id, question, category, slug, event_slug, n_outcomes, n_prices_listed, yes_price, clob_token_id, n_tokens,
    created_at, scope_date, end_date, closed_time, volume, closed"""
META_SQL = f"""SELECT market_id, clob_token_id, question, category, created_at AS start_date, end_date, {DURATION_SQL} AS duration_days,
    volume AS total_volume, round(yes_price, 6) AS yes_final_price, CASE WHEN yes_price >= 0.95 THEN 1 ELSE 0 END AS outcome
    FROM cat WHERE {REASON_SQL} IS NULL"""


@query("a_catalogue_parse", with_views(f"SELECT {CAT_COLUMNS} FROM cat", extra=CAT))
def a_catalogue_parse(spark, d):
    return catalogue(spark, d)


@query("b_market_filter", with_views(f"SELECT coalesce({REASON_SQL}, 'passed') AS reason, count(*) AS n FROM cat GROUP BY 1", extra=CAT))
def b_market_filter(spark, d):
    return catalogue(spark, d).groupBy(F.coalesce(C.reject_reason(), F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("b_qualifying_markets", with_views(META_SQL, extra=CAT))
def b_qualifying_markets(spark, d):
    return C.qualifying(catalogue(spark, d))


@query("b_outcome_label", with_views(
    "SELECT CASE WHEN yes_price >= 0.95 THEN 1 WHEN yes_price <= 0.05 THEN 0 END AS outcome, count(*) AS n FROM cat GROUP BY 1", extra=CAT))
def b_outcome_label(spark, d):
    return catalogue(spark, d).groupBy(C.outcome_of(F.col("yes_price")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("b_scope_filter", with_views(
    f"SELECT market_id, scope_date FROM cat WHERE scope_date >= TIMESTAMP '{SCOPE_START}'", extra=CAT))
def b_scope_filter(spark, d):
    return catalogue(spark, d).filter(C.in_scope(SCOPE_START)).select("market_id", "scope_date")


@query("b_month_windows", with_views(
    """SELECT window_start, least(window_start + INTERVAL 1 MONTH, hi) AS window_end FROM (
         SELECT hi, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS window_start FROM span) WHERE window_start < hi""",
    extra={"span": "SELECT CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP) AS lo, CAST(max(o_orderdate) AS TIMESTAMP) AS hi FROM orders"}))
def b_month_windows(spark, d):
    span = V.table(spark, d, "orders").agg(
        F.date_trunc("month", F.min("o_orderdate")).cast("timestamp_ntz").alias("lo"), F.max("o_orderdate").alias("hi"))
    return C.month_windows(span)


@query("b_needs_category", with_views(
    "SELECT market_id, category FROM cat WHERE lower(trim(coalesce(category, ''))) NOT IN ({})".format(", ".join(f"'{c}'" for c in C.CATEGORIES)), extra=CAT))
def b_needs_category(spark, d):
    return catalogue(spark, d).filter(C.needs_category()).select("market_id", "category")


@query("b_clean_text", with_views(
    "SELECT nullif(trim(category), '') AS category, count(*) AS n, count(created_at) AS dated FROM cat GROUP BY 1", extra=CAT))
def b_clean_text(spark, d):
    return catalogue(spark, d).groupBy(C.clean_text("category").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.count("created_at").alias("dated"))


@query("b_market_urls", with_views(
    f"""SELECT market_id, CASE WHEN event_slug IS NOT NULL AND slug IS NOT NULL THEN 'https://{HOST}/event/' || event_slug || '/' || slug
          WHEN slug IS NOT NULL THEN 'https://{HOST}/market/' || slug END AS url FROM cat""", extra=CAT))
def b_market_urls(spark, d):
    return catalogue(spark, d).select("market_id", C.market_url(HOST).alias("url"))


@query("b_listing_summary", with_views(
    "SELECT market_id, question, slug, end_date, yes_price AS price, n_outcomes = 2 AS is_binary, closed FROM cat", extra=CAT))
def b_listing_summary(spark, d):
    return C.listing_summary(catalogue(spark, d))


@query("b_open_event_markets", """SELECT 'ev-' || user_id AS event_slug, 'm-' || event_id || '-' || k AS market_slug, (event_id + k) % 2 = 0 AS closed
    FROM events, (SELECT unnest([0, 1, 2]) AS k) WHERE (event_id + k) % 2 <> 0""")
def b_open_event_markets(spark, d):
    e = F.col("event_id")
    nested = F.array(*[F.struct(F.concat(F.lit("m-"), e.cast("string"), F.lit(f"-{k}")).alias("market_slug"), ((e + k) % 2 == 0).alias("closed"))
                       for k in range(3)])
    events = V.table(spark, d, "events").select(F.concat(F.lit("ev-"), F.col("user_id").cast("string")).alias("event_slug"), nested.alias("markets"))
    return C.open_markets_of_events(events)


LOOKUP_SQL = f"""SELECT event_id, CASE event_id % 7
    WHEN 0 THEN '0x' || lpad(lower(to_hex(event_id)), 64, '0') WHEN 1 THEN 'https://{HOST}/event/ev-' || user_id
    WHEN 2 THEN 'https://{HOST}/event/ev-' || user_id || '/m-' || event_id || '?tid=1' WHEN 3 THEN 'see {HOST}/market/m-' || event_id || '#top'
    WHEN 4 THEN 'https://{HOST}/fr/event/ev-' || user_id WHEN 5 THEN '  m-' || event_id || '-' || event_type || ' '
    ELSE 'Will ' || event_type || ' happen' END AS q FROM events"""
URL_RE = r"markets\.example\.org" + C.PATH_PATTERN


@query("b_lookup_strings", with_views(
    f"""SELECT event_id, kind, CASE WHEN kind = 'event' THEN regexp_extract(q, '{URL_RE}', 2)
          WHEN kind = 'market' THEN coalesce(nullif(regexp_extract(q, '{URL_RE}', 3), ''), regexp_extract(q, '{URL_RE}', 2)) ELSE q END AS target
        FROM (SELECT event_id, trim(q) AS q, CASE WHEN regexp_matches(trim(q), '{C.ID_PATTERN}') THEN 'id'
            WHEN regexp_extract(q, '{URL_RE}', 1) = 'event' AND regexp_extract(q, '{URL_RE}', 3) = '' THEN 'event'
            WHEN regexp_matches(q, '{URL_RE}') THEN 'market' WHEN regexp_matches(trim(q), '{C.SLUG_PATTERN}') THEN 'slug' ELSE 'text' END AS kind FROM lookups)""",
    extra={"lookups": LOOKUP_SQL}))
def b_lookup_strings(spark, d):
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    ev = F.concat(F.lit("ev-"), F.col("user_id").cast("string"))
    base = f"https://{HOST}"
    q = (
        F.when(e % 7 == 0, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(e)), 64, "0")))
        .when(e % 7 == 1, F.concat(F.lit(f"{base}/event/"), ev))
        .when(e % 7 == 2, F.concat(F.lit(f"{base}/event/"), ev, F.lit("/m-"), s, F.lit("?tid=1")))
        .when(e % 7 == 3, F.concat(F.lit(f"see {HOST}/market/m-"), s, F.lit("#top")))
        .when(e % 7 == 4, F.concat(F.lit(f"{base}/fr/event/"), ev))
        .when(e % 7 == 5, F.concat(F.lit("  m-"), s, F.lit("-"), "event_type", F.lit(" ")))
        .otherwise(F.concat(F.lit("Will "), "event_type", F.lit(" happen")))
    )
    return V.table(spark, d, "events").select("event_id", q.alias("q")).select("event_id", *C.classify_lookup("q", HOST))


PAGE_RE = r"example\.com" + C.PATH_PATTERN


@query("b_page_urls", f"""SELECT page_id, CASE WHEN regexp_matches(url, '{PAGE_RE}') THEN 'url' WHEN regexp_matches(trim(url), '{C.SLUG_PATTERN}') THEN 'slug' ELSE 'text' END AS kind,
    trim(url) AS target FROM pages""")
def b_page_urls(spark, d):
    kind, target = C.classify_lookup("url", "example.com")
    out = V.table(spark, d, "pages").select("page_id", kind, target)
    return out.withColumn("kind", F.when(F.col("kind").isin("event", "market"), "url").otherwise(F.col("kind")))


@query("a_price_history", with_views(
    """SELECT token, timestamp, price FROM rec WHERE price IS NOT NULL AND token IN (SELECT token FROM rec WHERE price IS NOT NULL GROUP BY token HAVING count(*) >= 20)""",
    extra={"rec": """SELECT 'tok-' || user_id AS token, CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp, CASE WHEN event_id % 8 <> 0 THEN value END AS price FROM events"""}))
def a_price_history(spark, d):
    e = V.table(spark, d, "events")
    rec = F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
                             F.when(F.col("event_id") % 8 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("p")))
    lines = e.select(F.concat(F.lit("tok-"), F.col("user_id").cast("string")).alias("token"), rec.alias("j"))
    parsed = lines.select("token", F.from_json("j", "t long, p string").alias("x")).select("token", "x.t", "x.p")
    return C.price_history(parsed, 20)


@query("a_projected_scan", "SELECT l_orderkey, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'")
def a_projected_scan(spark, d):
    return V.table(spark, d, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1999-01-01'").select("l_orderkey", "l_discount")


@query("a_rows_of_markets", with_views("SELECT event_id, market_id, price FROM prices WHERE market_id IN (SELECT market_id FROM markets_unsplit WHERE closed_time IS NULL)", "markets_unsplit"))
def a_rows_of_markets(spark, d):
    ids = V.markets_unsplit(spark, d).filter("closed_time IS NULL").select("market_id")
    return V.prices(spark, d).select("event_id", "market_id", "price").join(ids, "market_id", "left_semi")


@query("a_distinct_values", "SELECT DISTINCT l_partkey AS value FROM lineitem")
def a_distinct_values(spark, d):
    return V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("value")).distinct()


@query("a_staged_rewrite", """SELECT 'first' AS step, count(*) AS rows_in, count(*) FILTER (value <= 100) AS rows_out FROM events UNION ALL
    SELECT 'in place', count(*) FILTER (value <= 100), count(*) FILTER (value <= 100 AND value > 1) FROM events""")
def a_staged_rewrite(spark, d):
    path = TB.scratch_path(spark, "rewrite")
    first = TB.rewrite(spark, f"{d}/events.parquet", path, lambda t: t.filter("value <= 100"))
    second = TB.rewrite(spark, path, path, lambda t: t.filter("value > 1"))
    return spark.createDataFrame([("first", *first), ("in place", *second)], "step string, rows_in long, rows_out long")


@query("a_resume_append", with_views(
    "SELECT market_id, category FROM markets_unsplit WHERE market_id % 3 <> 0 AND market_id NOT IN (SELECT user_id FROM events WHERE event_id % 400 = 0)", "markets_unsplit"))
def a_resume_append(spark, d):
    events = V.table(spark, d, "events")
    stored = events.select(F.col("user_id").alias("market_id")).filter("market_id % 3 = 0")
    in_progress = events.filter("event_id % 400 = 0").select(F.col("user_id").alias("market_id"))
    return TB.not_yet_built(V.markets_unsplit(spark, d).select("market_id", "category"), in_progress, stored)


@query("a_replace_markets", with_views(
    """SELECT event_id, market_id, price FROM prices WHERE market_id NOT IN (SELECT market_id FROM prices WHERE market_id % 4 = 1)
       UNION ALL SELECT event_id, market_id, price + 1 FROM prices WHERE market_id % 4 = 1 AND event_id % 2 = 0""", "prices"))
def a_replace_markets(spark, d):
    old = V.prices(spark, d).select("event_id", "market_id", "price")
    new = old.filter("market_id % 4 = 1 AND event_id % 2 = 0").withColumn("price", F.col("price") + 1)
    touched = old.filter("market_id % 4 = 1")
    return TB.replace_markets(old.join(touched.select("market_id").distinct(), "market_id", "left_anti"), new)


@query("a_newest_evidence", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def a_newest_evidence(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return TB.newest_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("a_newest_evidence_files", """SELECT user_id AS market_id, CASE WHEN user_id % 3 = 0 THEN max(event_id) WHEN user_id % 2 = 0 THEN count(*) ELSE min(event_id) END AS evidence
    FROM events GROUP BY user_id""")
def a_newest_evidence_files(spark, d):
    """Three files of evidence, written one after the other; for each key the one written last counts."""
    per = cut(V.table(spark, d, "events").groupBy(F.col("user_id").alias("market_id")).agg(
        F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")))
    base = TB.scratch_path(spark, "evidence")
    for name, column, share in (("c", "first", 1), ("b", "n", 2), ("a", "last", 3)):
        per.filter(F.col("market_id") % share == 0).select("market_id", F.col(column).alias("evidence")).write.option("header", True).csv(f"{base}/{name}")
    return TB.read_evidence(spark, f"{base}/*", "market_id long, evidence long")


@query("a_file_versions", """SELECT 'apart' AS folder, max(n)::INT AS versions FROM (
        SELECT count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus)
    UNION ALL SELECT 'together', count(DISTINCT o_orderstatus)::INT FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def a_file_versions(spark, d):
    """The most versions that a real file of each folder holds: two builds in files of their own, and both in one write."""
    o = cut(V.table(spark, d, "orders").filter("o_orderstatus IN ('F', 'O')").select("o_orderkey", F.col("o_orderstatus").alias("dataset_version")))
    base = TB.scratch_path(spark, "versions")
    for status in ("F", "O"):
        o.filter(F.col("dataset_version") == status).write.mode("append").parquet(f"{base}/apart")
    o.write.parquet(f"{base}/together")
    return TB.file_versions(spark, f"{base}/*").groupBy(F.element_at(F.split("file", "/"), -2).alias("folder")).agg(F.max("versions").cast("int").alias("versions"))


@query("d_dedupe_first", "SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_shipdate) AS first_ship FROM lineitem GROUP BY ALL")
def d_dedupe_first(spark, d):
    line = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return line.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"), F.min("l_shipdate").alias("first_ship"))


FIRST_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]


@query("d_keep_first_rows", f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(FIRST_ORDER)}) AS place
    FROM lineitem) WHERE place = 1""")
def d_keep_first_rows(spark, d):
    """Duplicate keys lose all rows but the first, with all its columns."""
    return TB.first_wins(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], FIRST_ORDER)


@query("a_upsert", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)
    UNION ALL SELECT l_orderkey, 'X', max(l_extendedprice) FROM lineitem WHERE l_linenumber = 7 GROUP BY l_orderkey""")
def a_upsert(spark, d):
    old = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = V.table(spark, d, "lineitem").filter("l_linenumber = 7").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.lit("X").alias("o_orderstatus"), F.max("l_extendedprice").alias("o_totalprice"))
    return TB.upsert(old, new, ["o_orderkey"])


OLD_MARKETS_SQL = "SELECT market_id, CASE WHEN market_id % 3 <> 0 THEN category END AS category, question, CASE WHEN market_id % 2 = 0 THEN 'train' END AS split FROM markets_unsplit WHERE market_id % 5 <> 4"
NEW_MARKETS_SQL = "SELECT user_id AS market_id, 'new' AS category, 'Q' || max(event_id) AS question FROM events WHERE user_id % 7 <> 0 GROUP BY user_id"


def lookup_tables(spark, d):
    old = V.markets_unsplit(spark, d).filter("market_id % 5 <> 4").select(
        "market_id", F.when(F.col("market_id") % 3 != 0, F.col("category")).alias("category"), "question",
        F.when(F.col("market_id") % 2 == 0, "train").alias("split"))
    new = V.table(spark, d, "events").filter("user_id % 7 <> 0").groupBy(F.col("user_id").alias("market_id")).agg(
        F.lit("new").alias("category"), F.concat(F.lit("Q"), F.max("event_id").cast("string")).alias("question"))
    return old, new


@query("a_conditional_upsert", with_views(
    """SELECT coalesce(o.market_id, n.market_id) AS market_id,
         CASE WHEN o.market_id IS NULL THEN n.category WHEN n.market_id IS NOT NULL AND o.split IS NULL THEN coalesce(o.category, n.category) ELSE o.category END AS category,
         CASE WHEN o.market_id IS NULL THEN n.question WHEN n.market_id IS NOT NULL AND o.split IS NULL THEN n.question ELSE o.question END AS question, o.split
       FROM o FULL JOIN n ON o.market_id = n.market_id""", "markets_unsplit", extra={"o": OLD_MARKETS_SQL, "n": NEW_MARKETS_SQL}))
def a_conditional_upsert(spark, d):
    old, new = lookup_tables(spark, d)
    return TB.upsert_lookups(old, new, fresh=["question"], keep_if_set=["category"])


@query("c_merge_fresh", with_views(
    """SELECT coalesce(o.market_id, n.market_id) AS market_id, CASE WHEN o.market_id IS NOT NULL THEN o.category ELSE n.category END AS category,
         coalesce(n.question, o.question) AS question, CASE WHEN o.market_id IS NULL THEN 'test' ELSE o.split END AS split,
         CASE WHEN o.market_id IS NULL THEN 'added' WHEN n.market_id IS NULL THEN 'kept' ELSE 'updated' END AS merge_kind
       FROM o FULL JOIN n ON o.market_id = n.market_id""", "markets_unsplit", extra={"o": OLD_MARKETS_SQL, "n": NEW_MARKETS_SQL}))
def c_merge_fresh(spark, d):
    return TB.merge_fresh(*lookup_tables(spark, d))


@query("a_markets_from_snapshots", with_views(
    """SELECT market_id, category, question, outcome, total_volume FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY snapshot_timestamp) AS rn FROM snapshots) WHERE rn = 1""", "snapshots"))
def a_markets_from_snapshots(spark, d):
    return TB.markets_from_snapshots(V.snapshots(spark, d), ["category", "question", "outcome", "total_volume"])


@query("c_map_values", with_views(
    """SELECT e.event_id, coalesce(m.split, 'none') AS split, coalesce(m.category, 'other') AS category FROM events e
       LEFT JOIN (SELECT * FROM markets WHERE market_id % 3 <> 1) m ON m.market_id = e.user_id""", "markets"))
def c_map_values(spark, d):
    rows = V.table(spark, d, "events").select("event_id", F.col("user_id").alias("market_id"))
    known = V.markets(spark, d).filter("market_id % 3 <> 1")
    return TB.map_values(rows, known, "market_id", {"split": "none", "category": "other"}).drop("market_id")


PREDICTION_SQL = """SELECT row_key, snapshot_timestamp, model, p AS pred_prob, CASE WHEN model = 'model_b' AND market_id % 50 = 0 THEN 'v1' ELSE 'v2' END AS dataset_version
    FROM long_scores WHERE NOT (model = 'model_a' AND market_id % 7 = 0)"""


def predictions(spark, d, *more: str) -> DataFrame:
    p = long_scores(spark, d, "row_key", "snapshot_timestamp").filter("NOT (model = 'model_a' AND market_id % 7 = 0)")
    old = (F.col("model") == "model_b") & (F.col("market_id") % 50 == 0)
    return p.select(*more, "row_key", "snapshot_timestamp", "model", F.col("p").alias("pred_prob"), F.when(old, "v1").otherwise("v2").alias("dataset_version"))


@query("a_prediction_sink", with_views(
    "SELECT dataset_version, model, count(*) AS n, count(DISTINCT row_key) AS keys FROM pred GROUP BY ALL", "long_scores", extra={"pred": PREDICTION_SQL}))
def a_prediction_sink(spark, d):
    path = TB.scratch_path(spark, "predictions")
    rows = TB.write_predictions(predictions(spark, d), path)
    return TB.distinct_keys(spark.read.parquet(path), ["dataset_version", "model"], "row_key", rows)


@query("a_prediction_scan", with_views(
    """SELECT w.model, n AS rows, CASE WHEN n IS NULL THEN 'no predictions found' WHEN old > 0 THEN 'trained on another dataset version' END AS skipped
       FROM (SELECT unnest(['market', 'model_a', 'model_b', 'model_c']) AS model) w
       LEFT JOIN (SELECT model, count(*) AS n, count(*) FILTER (dataset_version <> 'v2') AS old FROM pred GROUP BY model) p ON p.model = w.model""",
    "long_scores", extra={"pred": PREDICTION_SQL}))
def a_prediction_scan(spark, d):
    return TB.usable_predictions(predictions(spark, d), ["market", "model_a", "model_b", "model_c"], "v2")


@query("a_prediction_sources", with_views(
    f"""SELECT w.model, CASE WHEN skipped IS NULL THEN source END AS source, CASE WHEN skipped IS NULL THEN col END AS prob_column, skipped, n, mean_prob
       FROM (SELECT 'market' AS model, 'later' AS source, 'pred_prob' AS col, NULL::VARCHAR AS skipped
             UNION ALL SELECT 'model_a', 'later', 'prob', NULL
             UNION ALL SELECT 'model_b', 'rows_b', 'pred_prob', CASE WHEN EXISTS (SELECT 1 FROM pred WHERE model = 'model_b' AND dataset_version <> 'v2')
                 THEN 'rows_b was not trained on dataset v2' END
             UNION ALL SELECT 'model_c', NULL, NULL, 'no prediction file found') w
       LEFT JOIN (SELECT model, count(*) AS n, {r('avg(pred_prob)', 6)} AS mean_prob FROM pred GROUP BY 1) p ON p.model = w.model AND skipped IS NULL""",
    "long_scores", extra={"pred": PREDICTION_SQL}))
def a_prediction_sources(spark, d):
    """Folders with different columns: the first usable one of each model counts."""
    base = TB.scratch_path(spark, "sources")
    p = cut(predictions(spark, d))
    market, a, b = (p.filter(F.col("model") == m) for m in ("market", "model_a", "model_b"))
    market.write.parquet(f"{base}/market/later")
    a.drop("snapshot_timestamp").withColumnRenamed("pred_prob", "prob").write.parquet(f"{base}/a/undated")
    a.withColumnRenamed("pred_prob", "prob").write.parquet(f"{base}/a/later")
    b.drop("pred_prob").write.parquet(f"{base}/b/no_scores")
    b.write.parquet(f"{base}/b/rows_b")
    at = lambda path, *names: TB.Source(f"{base}/{path}", names)
    rows, report = TB.predictions_in_order(spark, {
        "market": [at("market/missing", "pred_prob"), at("market/later", "score", "pred_prob")],
        "model_a": [at("a/undated", "prob"), at("a/later", "pred_prob", "prob")],
        "model_b": [at("b/no_scores", "pred_prob"), at("b/rows_b", "pred_prob")],
        "model_c": [at("c/missing", "pred_prob")]}, ["row_key", "snapshot_timestamp"], "v2")
    totals = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("pred_prob"), 6).alias("mean_prob"))
    return report.join(totals, "model", "left")


@query("c_same_rows", with_views(
    """SELECT row_key, max(pred_prob) FILTER (model = 'market') AS market, max(pred_prob) FILTER (model = 'model_a') AS model_a,
         max(pred_prob) FILTER (model = 'model_b') AS model_b FROM pred GROUP BY row_key HAVING count(DISTINCT model) = 3""", "long_scores", extra={"pred": PREDICTION_SQL}))
def c_same_rows(spark, d):
    return TB.common_rows(predictions(spark, d, "market_id"), ["market", "model_a", "model_b"], ["market_id", "row_key"]).drop("market_id")


@query("c_wide_models", with_views(
    """SELECT row_key, max(pred_prob) FILTER (model = 'market') AS market, max(pred_prob) FILTER (model = 'model_a') AS model_a,
         max(pred_prob) FILTER (model = 'model_b') AS model_b FROM pred GROUP BY row_key""", "long_scores", extra={"pred": PREDICTION_SQL}))
def c_wide_models(spark, d):
    # a row key names one market, and rows are dealt by market
    return TB.pivot_models(predictions(spark, d, "market_id"), ["market", "model_a", "model_b"], ["market_id", "row_key"]).drop("market_id")


@query("a_manifest", with_views(
    f"""SELECT (SELECT count(DISTINCT market_id) FROM markets) AS markets_fetched, (SELECT min(start_date) FROM markets) AS market_start_min,
          (SELECT max(start_date) FROM markets) AS market_start_max, count(*) AS clean_snapshots, count(DISTINCT market_id) AS clean_markets,
          {r('avg(outcome)', 4)} AS clean_yes_rate, min(snapshot_timestamp) AS snapshot_min, max(snapshot_timestamp) AS snapshot_max FROM clean""", "clean"))
def a_manifest(spark, d):
    return MF.dataset_summary(V.markets_unsplit(spark, d), clean(spark, d))


@query("d_split_summary", with_views(
    f"""SELECT split, count(*) AS snapshots, count(DISTINCT market_id) AS markets, min(snapshot_timestamp) AS first_ts, max(snapshot_timestamp) AS last_ts,
          {r('avg(outcome)', 6)} AS yes_rate FROM clean GROUP BY split""", "clean"))
def d_split_summary(spark, d):
    return MF.split_summary(clean(spark, d))


@query("a_file_checksums")
def a_file_checksums(spark, d):
    """Every file of every table."""
    files = MF.file_checksums(spark, f"{d}/*.parquet")
    return files.join(MF.file_rows(spark, f"{d}/*.parquet"), "path", "left").select("file", "bytes", "sha256", "rows")


@query("a_integrity")
def a_integrity(spark, d):
    now = MF.file_checksums(spark, f"{d}/*.parquet")
    stale = F.when(F.col("file") == "orders.parquet", "0").otherwise(F.col("sha256"))
    return MF.integrity(now.filter("file <> 'part.parquet'"), now.filter("file <> 'nation.parquet'").withColumn("sha256", stale))


@query("a_sql_over_files", with_views(
    f"SELECT category, count(*) AS snapshots, {r('avg(outcome)', 6)} AS yes_rate FROM snapshots GROUP BY category", "snapshots"))
def a_sql_over_files(spark, d):
    V.snapshots(spark, d).createOrReplaceTempView("tallycast_snapshots")
    return spark.sql("""SELECT category, count(*) AS snapshots, floor(avg(outcome) * 1000000D + 0.500001D) / 1000000D AS yes_rate
                        FROM tallycast_snapshots GROUP BY category""")


@query("a_append_builds", """SELECT o_custkey AS market_id, min(o_orderkey % 3) AS build, count(*) FILTER (o_orderkey % 3 = first) AS n_rows
    FROM (SELECT *, min(o_orderkey % 3) OVER (PARTITION BY o_custkey) AS first FROM orders) GROUP BY o_custkey""")
def a_append_builds(spark, d):
    """Three builds append the markets that no build before them has; the second breaks off and runs again."""
    orders = V.table(spark, d, "orders").select(F.col("o_custkey").alias("market_id"), "o_orderkey", (F.col("o_orderkey") % 3).alias("arrives"))
    path = TB.scratch_path(spark, "builds")
    for build, share in ((0, 1), (1, 2), (1, 1), (2, 1)):
        rows = orders.filter(F.col("arrives") == build)
        TB.append_build(rows.filter(F.col("market_id") % share == 0).drop("arrives"), path, build)
    return spark.read.parquet(path).groupBy("market_id").agg(F.min("build").cast("long").alias("build"), F.count(F.lit(1)).alias("n_rows"))
