"""Market catalogue: parsing, filter chain, scope, lookup strings, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.functions.timing import whole_days
from tallycast.operators.live import SETTLED_HIGH, SETTLED_LOW, outcome_of

# Rejection reasons in the order they are tested
REJECT_REASONS = ["not_binary", "bad_dates", "negative_duration", "too_short", "no_outcome_field",
                  "ambiguous_outcome", "no_clob_token"]
# What a lookup string may look like
ID_PATTERN = "^0x[0-9a-fA-F]{64}$"
SLUG_PATTERN = "^[a-z0-9]+(?:-[a-z0-9]+)+$"
PATH_PATTERN = r"/(?:[a-z]{2}/)?(?:(event|market)/)([^/?#]+)(?:/([^/?#]+))?"
MIN_DURATION_DAYS = 30

# List fields are read as text: a real JSON list arrives as its own text, a quoted one as it is.
CATALOGUE_SCHEMA = T.StructType([
    T.StructField("conditionId", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("outcomes", T.StringType()),
    T.StructField("outcomePrices", T.StringType()),
    T.StructField("clobTokenIds", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("startDate", T.StringType()),
    T.StructField("endDate", T.StringType()),
    T.StructField("closedTime", T.StringType()),
    T.StructField("volumeNum", T.DoubleType()),
    T.StructField("closed", T.BooleanType()),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField("slug", T.StringType())]))),
])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalogue(spark.read.schema(CATALOGUE_SCHEMA).json(path))


def from_lines(lines: DataFrame, text: str = "record") -> DataFrame:
    return parse_catalogue(once(lines, F.from_json(text, CATALOGUE_SCHEMA)))


def once(df: DataFrame, row: Column) -> DataFrame:
    """The fields of the struct `row` as columns, made once a row. Fields of a plain projection are made anew in every
    filter and column that names them, so a record would be read once for each."""
    return df.select(F.inline(F.array(row)))


def text_list(c: str) -> Column:
    """A JSON list of strings; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))


def when_text(c: str) -> Column:
    return F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")


def first_number(c: Column) -> Column:
    return F.get(c, 0).try_cast("double")


def parse_catalogue(raw: DataFrame) -> DataFrame:
    prices, tokens = text_list("outcomePrices"), text_list("clobTokenIds")
    return once(raw, F.struct(
        F.coalesce(F.nullif("conditionId", F.lit("")), "id").alias("market_id"), "question", "category", "slug",
        F.get(F.col("events"), 0)["slug"].alias("event_slug"),
        F.size(text_list("outcomes")).alias("n_outcomes"),
        F.size(prices).alias("n_prices_listed"),
        first_number(prices).alias("yes_price"),
        F.get(tokens, 0).alias("clob_token_id"),
        F.size(tokens).alias("n_tokens"),
        when_text("createdAt").alias("created_at"), when_text("startDate").alias("scope_date"),
        when_text("endDate").alias("end_date"), when_text("closedTime").alias("closed_time"),
        F.col("volumeNum").alias("volume"), "closed",
    ))


def reject_reason(min_days: int = MIN_DURATION_DAYS) -> Column:
    """First failing rule of a parsed catalogue row; NULL passes."""
    duration, price = whole_days("created_at", "end_date"), F.col("yes_price")
    tests = [
        F.col("n_outcomes") != 2,
        F.col("created_at").isNull() | F.col("end_date").isNull(),
        duration <= 0,
        duration < min_days,
        (F.col("n_prices_listed") < 2) | price.isNull(),
        (price < SETTLED_HIGH) & (price > SETTLED_LOW),
        F.col("n_tokens") == 0,
    ]
    out = F.lit(None).cast("string")
    for test, reason in reversed(list(zip(tests, REJECT_REASONS))):
        out = F.when(test, reason).otherwise(out)
    return out


def qualifying(parsed: DataFrame, min_days: int = MIN_DURATION_DAYS) -> DataFrame:
    """Metadata rows of the markets that pass every rule."""
    return parsed.filter(reject_reason(min_days).isNull()).select(
        "market_id", "clob_token_id", "question", "category",
        F.col("created_at").alias("start_date"), "end_date",
        whole_days("created_at", "end_date").alias("duration_days"),
        F.coalesce("volume", F.lit(0.0)).alias("total_volume"),
        F.round("yes_price", 6).alias("yes_final_price"),
        outcome_of(F.col("yes_price")).alias("outcome"),
    )


def in_scope(first_day: str) -> Column:
    return F.coalesce(F.col("scope_date") >= F.lit(first_day).cast("timestamp_ntz"), F.lit(False))


def month_windows(span: DataFrame, months: int = 1) -> DataFrame:
    """Windows of whole months from `lo`, covering [lo, hi); the last one ends at `hi`. One row in."""
    step = F.make_ym_interval(F.lit(0), F.lit(months))
    return (
        span.select("lo", "hi", F.posexplode(F.sequence("lo", "hi", step)).alias("k", "window_start"))
        .filter(F.col("window_start") < F.col("hi"))
        .select("window_start", F.least(F.col("window_start") + step, F.col("hi")).alias("window_end"))
    )


def classify_lookup(text: str, host: str) -> list[Column]:
    """[kind, target] of a lookup string: id, event page, market page, slug, or free text."""
    q = F.trim(F.col(text))
    pattern = host.replace(".", r"\.") + PATH_PATTERN
    part = lambda i: F.regexp_extract(q, pattern, i)
    is_url = q.rlike(pattern)
    kind = (
        F.when(q.rlike(ID_PATTERN), "id")
        .when(is_url & (part(1) == "event") & (part(3) == ""), "event")
        .when(is_url, "market")
        .when(q.rlike(SLUG_PATTERN), "slug")
        .otherwise("text")
    )
    target = F.when(kind == "event", part(2)).when(kind == "market", F.when(part(3) != "", part(3)).otherwise(part(2))).otherwise(q)
    return [kind.alias("kind"), target.alias("target")]


def market_url(host: str) -> Column:
    base = F.lit(f"https://{host}")
    return (
        F.when(F.col("event_slug").isNotNull() & F.col("slug").isNotNull(), F.concat(base, F.lit("/event/"), "event_slug", F.lit("/"), "slug"))
        .when(F.col("slug").isNotNull(), F.concat(base, F.lit("/market/"), "slug"))
    )


def listing_summary(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "market_id", "question", "slug", "end_date", F.col("yes_price").alias("price"),
        (F.col("n_outcomes") == 2).alias("is_binary"), F.coalesce("closed", F.lit(False)).alias("closed"),
    )


def open_markets_of_events(events: DataFrame) -> DataFrame:
    """Events with a nested list of markets, flattened to the markets still open."""
    return events.select("event_slug", F.inline("markets")).filter(~F.coalesce(F.col("closed"), F.lit(False)))


# Category labels
CATEGORIES = ["politics_us", "politics_global", "crypto", "sports", "finance", "geopolitics",
              "science_tech", "entertainment", "other"]


def needs_category(c: str = "category", valid: list[str] = CATEGORIES) -> Column:
    return ~F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin(*valid)


def clean_text(c: str) -> Column:
    """Blank text becomes NULL."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def price_history(records: DataFrame, min_obs: int = 20) -> DataFrame:
    """(token, timestamp, price) from `{t, p}` records; non-numeric prices and short histories drop out."""
    rows = records.select(
        "token", F.timestamp_seconds("t").cast("timestamp_ntz").alias("timestamp"), F.col("p").try_cast("double").alias("price")
    ).filter(F.col("price").isNotNull())
    enough = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_obs)
    return rows.join(enough.select("token"), "token", "left_semi")
