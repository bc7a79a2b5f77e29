"""Spelling variants of a vocabulary by a symmetric-delete join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Work, small, table

#: Between runs of letters.
GAPS = r"[^A-Za-zÀ-ÿ]+"
#: Code points of a word up to which its keys carry it; a longer one's keys carry its number, as they are as many as its letters.
LONG = 128


def without(word: Column, at: Column) -> Column:
    """word less its code point at place at, from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def runs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, word) of each run of letters with least code points or more, A-Z as a-z; a null text has none, a null id is the empty text."""
    lowered = F.translate(F.col("_word"), UPPER, LOWER)
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(F.split(F.col(text_col), GAPS)).alias("_word"))
    return each.filter(F.length("_word") >= least).select("doc", lowered.alias("word"))


def damaged(words: DataFrame, every: int = 31) -> DataFrame:
    """(word): where the crc32 of "doc:word" is a multiple of every, the code point at that number modulo the word's length is gone."""
    h = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
    hashed = words.select("word", h.alias("h"))
    return hashed.select(F.when(F.col("h") % every == 0, without(F.col("word"), (F.col("h") % F.length("word")).cast("int"))).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least: int, times: int) -> DataFrame:
    """(word, n) of the words (word) with least code points or more and that many occurrences or more; counted before they are shuffled."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def deletions(words: DataFrame, kept: list[str]) -> DataFrame:
    """(kept..., key): every word itself and its distinct single deletions.

    In a run of equal letters every deletion is the same, so the first place of each run gives each once; places are rows,
    not an array, so a long word is never held as all its deletions.
    """
    at, word = F.col("_at"), F.col("word")
    places = words.withColumn("_at", F.explode(F.sequence(F.lit(-1), F.length("word") - 1)))
    first = (at <= 0) | (F.substr(word, at + 1, F.lit(1)) != F.substr(word, at, F.lit(1)))
    return places.filter(first).select(*kept, F.when(at < 0, word).otherwise(without(word, at)).alias("key"))


def near_words(work: Work, words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words (word, n; each once, staged) at distance exactly one.

    Words that differ by one code point share exactly one key: the shorter word, or what both leave without the letters
    that differ.  So pairs need no deduplication, only a check, as words that share a key may differ by two.  The words of a
    key differ from it by one letter, so a group has at most alphabet times length words, whatever the corpus.
    Words longer than ``long`` are joined by hashes of their keys and looked up for the check.
    """
    a, b = F.col("a.word"), F.col("b.word")
    one = (a != b) & (F.levenshtein(a, b, 1) == 1)
    keys = deletions(words.filter(F.length("word") <= long), ["word", "n"])
    short = keys.alias("a").join(keys.alias("b"), F.col("a.key") == F.col("b.key")).filter(one).select(a.alias("word"), F.col("a.n").alias("n"), b.alias("other"), F.col("b.n").alias("other_n"))
    big = work.stage(words.filter(F.length("word") >= long).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "big")
    ids = deletions(big, ["id"]).select("id", F.xxhash64("key").alias("key"))
    met = ids.alias("x").join(ids.alias("y"), F.col("x.key") == F.col("y.key")).filter("x.id <> y.id").select(F.col("x.id").alias("x"), F.col("y.id").alias("y")).distinct()
    pairs = met.join(big.toDF("x", "word", "n").alias("a"), "x").join(big.toDF("y", "word", "n").alias("b"), "y")
    pairs = pairs.filter(one & (F.greatest(F.length(a), F.length(b)) > long))
    return short.unionAll(pairs.select(a.alias("word"), F.col("a.n").alias("n"), b.alias("other"), F.col("b.n").alias("other_n")))


def spelling_forms(words: DataFrame, factor: int = 10, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n), each word once.

    n_near counts the words at distance exactly one; the form is the one of largest n (ties: the smallest by code
    points), if that is at least factor times the word's n, else null; root is where the forms lead in the end, the word
    itself if it has none.  Forms grow by the factor at each step, so roots are joined in a few doubling rounds.
    A null word is left out; an empty vocabulary gives no rows; words of any length are compared whole.
    """
    work = Work(words.sparkSession, "variants")
    words = work.stage(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.when(F.col("other_n") >= factor * F.col("n"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))))
    near = near_words(work, words, long).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = work.stage(near.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "near")
    root = work.stage(near.filter("form is not null").select("word", F.col("form").alias("root")), "root0")
    step = 0
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = root.join(small(on), "root", "left")
        step += 1
        jumped = work.stage(jumped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"root{step}")
        work.drop(f"root{step - 1}")
        root = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    work.drop("big")
    found = words.join(near, "word", "left").join(small(root), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of documents, some damaged as stated, of 7 code points and 2 occurrences or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_forms(vocabulary(damaged(runs(docs, 7)), 7, 2))


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8: half a byte at a time over a table of 16 by rule."""
    steps = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        steps.append(k)
    digits = f"hex(encode({text}))"
    halves = f"list_transform(range(0, length({digits})), lambda i: CAST('0x' || substr({digits}, CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1) AS BIGINT))"
    return f"xor(list_reduce({halves}, lambda c, b: xor({steps}[(xor(c, b) & 15) + 1], c >> 4), 4294967295::BIGINT), 4294967295::BIGINT)"


OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
 t AS (SELECT doc, translate(w, '{UPPER}', '{LOWER}') AS w, count(*) AS c FROM d WHERE length(w) >= 7 GROUP BY 1, 2),
 h AS (SELECT w, c, {_crc32("doc || ':' || w")} AS h FROM t),
 m AS (SELECT CASE WHEN h % 31 = 0 THEN w[: CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2 :] ELSE w END AS w, c FROM h),
 v AS MATERIALIZED (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(w) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
 places AS (SELECT w, n, unnest(range(0, length(w))) AS i FROM v),
 holes AS (SELECT w, n, w[: i] || '_' || w[i + 2 :] AS g FROM places),
 cut AS (SELECT DISTINCT w, n, w[: i] || w[i + 2 :] AS g FROM places),
 near AS (SELECT a.w, a.n, b.w AS o, b.n AS o_n FROM holes a JOIN holes b ON a.g = b.g AND a.w <> b.w
   UNION ALL SELECT c.w, c.n, v.w, v.n FROM cut c JOIN v ON c.g = v.w UNION ALL SELECT v.w, v.n, c.w, c.n FROM cut c JOIN v ON c.g = v.w),
 best AS (SELECT w, o, o_n FROM (SELECT w, n, o, o_n, row_number() OVER (PARTITION BY w ORDER BY o_n DESC, o) AS k FROM near) WHERE k = 1 AND o_n >= 10 * n),
 path(w, x, step) AS (SELECT w, w, 0 FROM v UNION ALL SELECT p.w, b.o, p.step + 1 FROM path p JOIN best b ON b.w = p.x)
SELECT v.w AS word, b.o AS form, p.root, v.n, coalesce(c.n_near, 0) AS n_near, b.o_n AS form_n FROM v LEFT JOIN best b USING (w)
  LEFT JOIN (SELECT w, count(*) AS n_near FROM near GROUP BY 1) c USING (w) JOIN (SELECT w, arg_max(x, step) AS root FROM path GROUP BY 1) p USING (w)
"""
