"""Benchmark decontamination on a positional inverted index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, ascii_lower, fresh, kept, small, table

#: Between words: everything below 0x80 but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A document in the index: 96 bits of its id and text.
DOC = ["doc", "doc2"]


def words_of(text: Column) -> Column:
    r"""The words ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` of a text, case as it stands."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


class PositionalIndex:
    """Postings (tid, doc, doc2, pos) of the words of texts, written once to the shared folder.

    tid is a 64-bit hash of the lower-cased word.  Each file is a segment: the postings of one
    partition of the documents, sorted by term, document and position, so that a term's list is a
    run that Parquet's statistics find, and takes few bytes.  Documents stay in their partition:
    building shuffles nothing, and the list of a frequent word is spread over all segments.
    """

    def __init__(self, work: Work, docs: DataFrame, text_col: str, terms: DataFrame | None = None):
        """docs: doc, doc2 and the text.  terms: (tid), the only words whose lists will be asked for, or None for all."""
        tokens = docs.select(*DOC, F.posexplode(words_of(F.col(text_col))).alias("pos", "w")).select(F.xxhash64(ascii_lower(F.col("w"))).alias("tid"), *DOC, "pos")
        if terms is not None:
            tokens = tokens.join(small(terms), "tid", "left_semi")
        self.work = work
        self.postings = work.stage(tokens.sortWithinPartitions("tid", *DOC, "pos"), "postings")

    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("tid").agg(F.count("*").alias("df"))

    def phrases(self, items: DataFrame, width: int) -> DataFrame:
        """(doc, doc2, item, start, end): the maximal runs of item words that stand in a document and hold a window.

        items: (item, words).  A window is width consecutive words of an item, or the item if it has
        fewer.  Each window asks for its two rarest words first: their lists, less the words' places
        in the item, are intersected into diagonals (item, document, offset).  The other words'
        lists are then intersected with the diagonals that are left, and runs of matched places that
        are as long as a window are the answer.
        """
        items = items.withColumn("need", F.least(F.size("words"), F.lit(width)))
        places = items.select("item", "need", F.size("words").alias("len"), F.posexplode("words").alias("ip", "w")).withColumn("tid", F.xxhash64("w")).drop("w")
        places = self.work.stage(places.join(self.frequencies(), "tid", "left").fillna(0, ["df"]), "places")
        starts = F.sequence(F.greatest(F.lit(0), F.col("ip") - F.col("need") + 1), F.least(F.col("ip"), F.col("len") - F.col("need")))
        windows = places.select("item", "need", "ip", "tid", "df", F.explode(starts).alias("s")).groupBy("item", "s", "need").agg(F.array_sort(F.collect_list(F.struct("df", "ip", "tid"))).alias("rare"))
        windows = self.work.stage(windows.filter(F.col("rare")[0]["df"] > 0).select("item", "s", "need", F.slice("rare", 1, 2).alias("rare")), "windows")
        anchors = self.work.stage(windows.select("item", F.explode("rare").alias("a")).select("item", F.col("a.tid").alias("tid"), F.col("a.ip").alias("ip")).distinct(), "anchors")
        adjusted = self.postings.join(small(anchors), "tid").select("item", *DOC, (F.col("pos") - F.col("ip")).alias("delta"), "ip")
        diagonals = adjusted.groupBy("item", *DOC, "delta").agg(F.collect_set("ip").alias("at"))
        pairs = windows.groupBy("item").agg(F.collect_set(F.transform("rare", lambda r: r["ip"])).alias("pairs"), F.min(F.size("rare")).alias("least"))
        pairs = self.work.stage(pairs, "pairs")
        found = diagonals.join(small(pairs), "item").filter((F.size("at") >= F.col("least")) & F.exists("pairs", lambda p: F.size(F.array_except(p, F.col("at"))) == 0))
        self.diagonals = self.work.stage(found.select("item", *DOC, "delta"), "diagonals")
        asked = self.diagonals.join(small(places.select("item", "need", "ip", "tid")), "item").select("item", "need", *DOC, "delta", "ip", "tid", (F.col("delta") + F.col("ip")).alias("pos"))
        lists = self.postings.join(small(self.diagonals.select(*DOC).distinct()), DOC, "left_semi")
        matched = lists.join(asked, ["tid", *DOC, "pos"])
        by = ["item", "need", *DOC, "delta"]
        runs = matched.withColumn("run", F.col("ip") - F.dense_rank().over(Window.partitionBy(*by).orderBy("ip"))).groupBy(*by, "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
        return runs.filter(F.col("end") - F.col("start") + 1 >= F.col("need")).select(*DOC, "item", "start", "end")

    def near(self, items: DataFrame, span: int) -> DataFrame:
        """(doc, doc2, item): documents in which all distinct words of an item stand within span words.

        items: (item, words).  The rarest word's list gives the centres; the other words' postings
        meet them by document and stretch of span places, never by document alone.
        """
        terms = items.select("item", F.explode(F.array_distinct("words")).alias("w")).select("item", F.xxhash64("w").alias("tid"))
        terms = terms.join(self.frequencies(), "tid", "left").fillna(0, ["df"])
        terms = self.work.stage(terms.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("df", "tid"))).withColumn("m", F.count("*").over(Window.partitionBy("item"))), "near")
        stretch = F.floor(F.col("pos") / span)
        posted = self.postings.join(small(terms), "tid").select("item", "tid", "r", "m", *DOC, "pos")
        centres = posted.filter("r = 1").select("item", "m", *DOC, F.col("pos").alias("centre"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
        met = centres.join(posted.select("item", "tid", *DOC, "pos", stretch.alias("stretch")), ["item", *DOC, "stretch"]).filter(F.abs(F.col("pos") - F.col("centre")) < span)
        # A span that holds the centre starts at one of the places met; each start asks for the words after it.
        starts = met.select("item", "m", *DOC, "centre", F.col("pos").alias("start")).filter(F.col("start") <= F.col("centre")).distinct()
        inside = starts.join(met.select("item", *DOC, "centre", "tid", "pos"), ["item", *DOC, "centre"]).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + span))
        return inside.groupBy("item", "m", *DOC, "centre", "start").agg(F.count_distinct("tid").alias("n")).filter("n = m").select(*DOC, "item").distinct()


def items_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, words) of the distinct items that have words; item_id may be null."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.transform(words_of(F.col(text_col)), ascii_lower).alias("words")).filter(F.size("words") > 0).distinct()
    return rows.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, part: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    A document word is hit if a window of an item (``PositionalIndex.phrases``) covers it;
    contaminated: at least one word in part is hit.  A null or empty text has no words and is clean;
    items without words are none, those without id count as one in n_items and aren't listed; rows with equal id and text get equal results; either table
    may be empty.  Columns of the names added are replaced.
    """
    added = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    work = Work(docs.sparkSession, "index")
    id_, text = F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))
    ids = [F.xxhash64(id_, text).alias("doc"), F.hash(id_, text).alias("doc2")]
    known = work.stage(items_of(items), "items")
    terms = work.stage(known.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("tid")).distinct(), "terms")
    index = PositionalIndex(work, docs.select(*ids, text.alias("text")), "text", terms)
    runs = work.stage(index.phrases(known.select("item", "words"), width), "runs")
    work.drop("terms", "postings", "diagonals", "windows", "places", "anchors", "pairs")
    hit = runs.select(*DOC, F.explode(F.sequence("start", "end")).alias("pos")).distinct().groupBy(*DOC).agg(F.count("*").alias("hit"))
    names = runs.select(*DOC, "item").distinct().join(small(known.select("item", "item_id")), "item").groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    found = work.stage(hit.join(names, DOC).select(*DOC, F.struct("hit", "items", "unnamed").alias("found")), "found")
    work.drop("runs", "items")
    d, d2, f, n = fresh(docs, "_doc"), fresh(docs, "_doc2"), fresh(docs, "_found"), fresh(docs, "_words")
    base = docs.select(*kept(docs), ids[0].alias(d), ids[1].alias(d2), F.size(words_of(F.col(text_col))).cast("long").alias(n))
    out = base.join(small(found.toDF(d, d2, f)), [d, d2], "left")
    n_hit, got = F.coalesce(F.col(f)["hit"], F.lit(0)).cast("long"), F.coalesce(F.col(f)["items"], F.array().cast("array<string>"))
    n_items = (F.size(got) + F.coalesce(F.col(f)["unnamed"], F.lit(0))).cast("long")
    return out.select(*kept(docs), F.col(n).alias("n_words"), n_hit.alias("n_hit"), n_items.alias("n_items"), got.alias("item_ids"), ((n_hit > 0) & (part * n_hit >= F.col(n))).alias("contaminated"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rn,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), grams AS (
  SELECT rn, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT rn, s, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.phrase = windows.phrase
), hits AS (
  SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(s, s + n)) AS p FROM found) GROUP BY rn
), names AS (
  SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rn, item_id FROM found) GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (rn) LEFT JOIN names USING (rn)
"""
