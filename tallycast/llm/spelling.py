"""Spelling variants: words at one edit from each other, by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter changes a word's letter counts by a vector of squared length 1 or 2, so
near words are among the pairs whose squared distance |x|^2 + |y|^2 - 2 x.y is at most two, and x.y for all pairs of
two blocks is one matrix product. Blocks keep that from being all pairs of words:

1. Words are counted over all texts (a map-side combined aggregate), those of `SHORTEST` letters that occur `LEAST`
   times stay, each once.
2. The letters are dealt to a few classes of about equal weight. A block holds the words of one length and one
   vector of class counts; it is split by digest into parts of at most about `BLOCK` words. Merging letters never
   makes an edit larger, so near words lie in one block, in blocks whose class counts differ by one letter moved
   from a class to another, or, in the adjacent length, by one letter more. The number of classes follows the number
   of words, so blocks stay small at any size.
3. A row for each pair of neighbouring parts goes to some task, which multiplies their letter counts, keeps pairs at
   distance two or less and verifies the edit letter by letter. Only near pairs leave the task.
4. Forms are least elements of those pairs, and roots follow forms by pointer doubling: a form is `RATIO` times as
   frequent, so a chain is at most as long as the logarithm of the largest count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import whole_text, written
from tallycast.llm.decontaminate import CASED, LOWER, UPPER

SHORTEST, LEAST, EVERY, RATIO = 7, 2, 31, 10
BLOCK, BLOCK_LETTERS = 1024, 1 << 22
#: Words of up to so many letters have squared lengths that 32-bit floats hold exactly.
EXACT = 4096
#: Class counts are folded into one number modulo this prime; blocks that fall together cost work, not results.
PRIME = (1 << 31) - 1
LETTERS = 26 + 64
PAIR_SCHEMA = "word string, n long, near string, near_n long"


def altered(doc_id: Column, run: Column, every: int = EVERY) -> Column:
    """The run, or where `every` divides the CRC-32 of `<doc_id>:<run>`, the run without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n) of the runs of letters of all texts, of at least `SHORTEST` letters and `LEAST` occurrences."""
    text = whole_text()
    low = F.when(text.rlike(CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    runs = F.regexp_extract_all(low, F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run")).select(altered(F.col("doc_id"), F.col("run"), every).alias("word"))
    return found.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def classes(words: DataFrame, n_words: int) -> list[str]:
    """The letters of each class: heaviest letters first, each to the lightest class. A row a letter is collected."""
    weights = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    k = max(2, min(12, 2 + round(math.log(max(n_words, 1) / 20_000, 3))))
    load, members = [0] * k, [""] * k
    for weight, letter in sorted(((-r["count"], r["letter"]) for r in weights if r["letter"])):
        i = load.index(min(load))
        load[i] -= weight
        members[i] += letter
    return members


def factors(k: int) -> list[int]:
    return [pow(5, 9 + 4 * i, PRIME) for i in range(k)]


def blocks(words: DataFrame, groups: list[str]) -> DataFrame:
    """(len, code, part, words, ns): parts of blocks; `words` and `ns` are bounded by the split into parts."""
    counts = [F.length("word") - F.length(F.translate("word", g, "")) if g else F.lit(0) for g in groups]
    code = sum((c.cast("long") * f) % PRIME for c, f in zip(counts, factors(len(groups)))) % PRIME
    placed = words.select("word", "n", F.length("word").alias("len"), code.alias("code"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(BLOCK_LETTERS) / F.col("len")))
    sizes = placed.groupBy("len", "code").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / most))
    split = placed.join(sizes, ["len", "code"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    return split.groupBy("len", "code", "part").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rows")).select(
        "len", "code", "part", F.col("rows.word").alias("words"), F.col("rows.n").alias("ns"))


def neighbouring(parts: DataFrame, k: int) -> DataFrame:
    """(llen, lcode, lpart, rlen, rcode, rpart): each unordered pair of parts that may hold near words, slim."""
    f = factors(k)
    one_moved = [f[i] - f[j] for i in range(k) for j in range(i + 1, k)]
    steps = [(0, 0), *((0, s) for s in one_moved), *((1, s) for s in f)]
    left = parts.select(F.col("len").alias("llen"), F.col("code").alias("lcode"), F.col("part").alias("lpart"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("longer"), F.lit(s).cast("long").alias("by")) for a, s in steps])).alias("s")
    aimed = left.select("*", step).select("llen", "lcode", "lpart", (F.col("llen") + F.col("s.longer")).alias("rlen"), F.pmod(F.col("lcode") + F.col("s.by"), F.lit(PRIME)).alias("rcode"))
    right = parts.select(F.col("len").alias("rlen"), F.col("code").alias("rcode"), F.col("part").alias("rpart"))
    same = (F.col("llen") == F.col("rlen")) & (F.col("lcode") == F.col("rcode"))
    return aimed.distinct().join(right, ["rlen", "rcode"]).where(~same | (F.col("lpart") <= F.col("rpart")))


def letters(words: list[str]) -> np.ndarray:
    """Letter numbers, a row a word; all words have one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return np.where(points < 0xC0, points - 97, points - 0xC0 + 26).astype(np.uint8)


def letter_counts(rows: np.ndarray) -> np.ndarray:
    n, length = rows.shape
    cells = (np.arange(n)[:, None] * LETTERS + rows).ravel()
    return np.bincount(cells, minlength=n * LETTERS).reshape(n, LETTERS).astype(np.float32 if length <= EXACT else np.float64)


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of letter numbers, y as long as x or longer by one: whether one edit turns x into y."""
    length = x.shape[1]
    if y.shape[1] == length:
        return (x != y).sum(1) == 1
    ahead = np.logical_and.accumulate(x == y[:, :-1], 1).sum(1)
    behind = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], 1).sum(1)
    return ahead + behind >= length


def near_pairs(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words in two parts; within one part each pair once."""
    x, y = letters(left), letters(right)
    a, b = letter_counts(x), letter_counts(y)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    close = square <= 2
    i, j = np.nonzero(np.triu(close, 1) if same else close)
    step = max(1, BLOCK_LETTERS // x.shape[1])
    ok = [one_edit(x[i[s:s + step]], y[j[s:s + step]]) for s in range(0, len(i), step)]
    kept = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[kept], j[kept]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each row's two parts, in both directions."""
    for batch in batches:
        for r in batch.to_pylist():
            same = (r["llen"], r["lcode"], r["lpart"]) == (r["rlen"], r["rcode"], r["rpart"])
            i, j = near_pairs(r["lwords"], r["rwords"], same)
            if len(i):
                first, second = pa.array(r["lwords"]).take(pa.array(i)), pa.array(r["rwords"]).take(pa.array(j))
                n, m = pa.array(r["lns"], pa.int64()).take(pa.array(i)), pa.array(r["rns"], pa.int64()).take(pa.array(j))
                for columns in ([first, n, second, m], [second, m, first, n]):
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words at one edit, in both directions. `words` has each word once, of
    a-z and U+00C0 to U+00FF; it is read several times, so it should be a written table."""
    groups = classes(words, words.count())
    parts = written(blocks(words, groups), "blocks")
    pairs = neighbouring(parts, len(groups))
    for side in ("l", "r"):
        pairs = pairs.join(parts.select(*[F.col(c).alias(side + c) for c in parts.columns]), [f"{side}len", f"{side}code", f"{side}part"])
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "llen", "lcode", "lpart", "rlen", "rcode", "rpart").mapInArrow(compare, PAIR_SCHEMA).distinct()


def roots(forms: DataFrame, largest: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) of (word, form) by pointer doubling; `largest` is the largest count of a word."""
    longest = 1 + int(math.log(max(largest, ratio), ratio))
    jump = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(longest)))):
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jump = written(jump.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return jump


def group_variants(docs: DataFrame, every: int = EVERY, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts have no words, a null doc_id is written as the empty text, repeated rows count as often as
    they occur, and an empty table gives no rows. Of near words with one count the first in code-point order is the
    form. Texts and words of any length are taken whole; a word of over `BLOCK_LETTERS` letters is a part of its own."""
    words = written(word_counts(docs, every), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("top"))
    wide = written(words.join(near, "word", "left").select("word", "n", "n_near", "top.near", (-F.col("top.m")).alias("near_n")), "near")
    frequent = F.col("near_n") >= ratio * F.col("n")
    forms = wide.where(frequent).select("word", F.col("near").alias("form"))
    largest = wide.agg(F.max("n")).first()[0] or 1
    return wide.join(roots(forms, largest, ratio), "word", "left").select(
        "word", F.when(frequent, F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("near_n")).alias("form_n"))
