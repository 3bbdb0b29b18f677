"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is `WINDOW` consecutive words of an item (all words of a shorter one); a document is hit where it has the
words of a window in a row. Documents and windows are sets of positioned shingles of `SHINGLE` words (fewer, where a
window is shorter):

1. One pass over the texts keeps the positions of shingles whose hash some window has, and one row a document. The
   hashes of the benchmark are broadcast if they are at most `BROADCAST_ROWS`, else joined by a shuffle. This is at
   most a row for each word, and in practice few; it is written once. All later joins are by the shingles themselves,
   so one that shares no more than its hash with the benchmark meets nothing.
2. These rows give the rarity of every benchmark shingle over the whole corpus. A window must be contained whole, so
   its necessary prefix is one token, its rarest shingle: only that is joined. A window with a shingle that no
   document has is never joined at all.
3. Position and length bounds drop candidates that would begin before or end after the document.
4. A candidate is verified exactly: shingles, as strings, that cover the window must stand at their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import whole_text, written

WINDOW, SHINGLE = 10, 3
BROADCAST_ROWS = 500_000
#: What is left of a lower-cased text without its other ASCII characters. Java takes five times as long for the class that excludes those.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: Java applies ^ to the whole intersection, so nearly every text has a match; only op11 still asks for one.
CASED = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with only A-Z lower-cased: lower() does that for texts in ASCII, and in less time than translate()."""
    low = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it is small, which its caller has counted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, n, words): the windows of each item; none for null texts and texts without words."""
    items = benchmark.select("item_id", words(whole_text()).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    at = items.select("item_id", "words", F.explode(starts).alias("i"))
    return at.select("item_id", F.slice("words", F.col("i"), F.lit(window)).alias("words")).select(
        "item_id", F.array_join("words", " ").alias("win"), F.size("words").alias("n"), "words").distinct()


def window_shingles(distinct: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(win, n, k, off, shingle) of each different window."""
    k = F.least(F.col("n"), F.lit(shingle))
    at = distinct.withColumn("k", k).select("win", "n", "k", "words", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("off"))
    return at.select("win", "n", "k", "off", F.array_join(F.slice("words", F.col("off") + 1, F.col("k")), " ").alias("shingle"))


def shingle_hash(shingle: Column) -> Column:
    """The hash that `positions` gives the words of a shingle: an array's hash is that of its elements in turn."""
    return F.xxhash64(F.split(shingle, " "))


def positions(docs: DataFrame, lengths: list[int], shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, n_words, pos, hash, shingle): a row with an empty shingle at place -1 for each document, and its
    shingles of the given lengths. `h` tells rows of one id with different texts apart."""
    base = docs.select("doc_id", whole_text().alias("text")).select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    at = base.select("*", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "first")).withColumn("pos", F.col("at") - 1)
    at = at.withColumn("k", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    # further words are read from the text's array, so that no place needs a copy of them; nulls are left out of hashes and joined texts
    said = [F.col("first"), *(F.when((F.col("pos") >= 0) & (F.col("k") > i), F.get("w", F.col("pos") + i)) for i in range(1, shingle))]
    whole = F.when(F.col("pos") < 0, F.col("k") == lengths[0]).otherwise(F.col("pos") + F.col("k") <= F.col("n_words"))
    return at.where(whole).select("doc_id", "h", "n_words", "pos", F.xxhash64(*said).alias("hash"), F.concat_ws(" ", *said).alias("shingle"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and `h`, a row for each row of `docs`; other
    columns are ignored.

    Null texts have no words; a null doc_id is an id of its own; null item ids do not count as items, but their
    windows hit. Repeated rows give equal rows; with an empty benchmark nothing is hit."""
    wins = written(windows(benchmark, window), "windows")
    shingles = written(window_shingles(wins.dropDuplicates(["win"]).select("win", "n", "words")), "shingles")
    lengths = sorted((r.k for r in shingles.select("k").distinct().collect()), reverse=True) or [SHINGLE]
    every_shingle = shingles.select("shingle").union(docs.sparkSession.range(1).select(F.lit("").alias("shingle")))
    looked_for = every_shingle.select(shingle_hash(F.col("shingle")).alias("hash")).distinct()
    n_shingles = looked_for.count()
    found = written(positions(docs, lengths).join(sized(looked_for, n_shingles), "hash", "left_semi").drop("hash"), "positions")
    hits = found.where("shingle <> ''").withColumn("id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))).drop("doc_id")

    rarity = hits.groupBy("shingle").agg(F.count("*").alias("freq"))
    prefix = shingles.join(rarity, "shingle", "left").groupBy("win", "n").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "shingle", "off")).alias("rare"))
    prefix = written(prefix.where("rare.freq > 0").select("win", "n", F.col("rare.shingle").alias("shingle"), "rare.off"), "prefix")
    n_prefix = prefix.count()
    begun = hits.join(sized(prefix, n_prefix), "shingle").withColumn("start", F.col("pos") - F.col("off"))
    begun = begun.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))

    last = F.col("off") == F.col("n") - F.col("k")
    cover = shingles.where((F.col("off") % F.col("k") == 0) | last).select("win", F.col("off").alias("at"), F.col("shingle").alias("part"))
    count = cover.groupBy("win").agg(F.count("*").alias("needed"))
    cover = written(prefix.select("win").join(count, "win").join(cover, "win"), "cover")
    wanted = begun.select("id", "h", "win", "n", "start").distinct().join(sized(cover, n_prefix * WINDOW), "win")
    wanted = wanted.select("id", "h", "win", "n", "start", "needed", (F.col("start") + F.col("at")).alias("pos"), F.col("part").alias("shingle"))
    there = hits.select("id", "h", "pos", "shingle").distinct()
    seen = wanted.join(there, ["id", "h", "pos", "shingle"]).groupBy("id", "h", "win", "n", "start").agg(F.count("*").alias("got"), F.first("needed").alias("needed"))
    seen = written(seen.where("got = needed").select("id", "h", "win", "n", "start"), "occurrences")

    hit = seen.select("id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).distinct().groupBy("id", "h").agg(F.count("*").alias("n_hit"))
    named = seen.select("id", "h", "win").distinct().join(wins.where(F.col("item_id").isNotNull()).select("win", F.col("item_id").cast("string").alias("item")), "win")
    items = named.select("id", "h", "item").distinct().groupBy("id", "h").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    every = found.where("shingle = ''").select("doc_id", "h", "n_words", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("id"))
    out = every.join(hit, ["id", "h"], "left").join(items, ["id", "h"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "h",
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).drop("h")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT doc_id, item_id, p, n FROM (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS win FROM places) JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
