"""Line dedup on levelled sorted runs of line hashes; DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STRIP, Work, ascii_lower, bytes_of, fresh, kept, parts_of, row_key, table

#: Bytes of the batches' files for each bucket of a run.
RUN_BYTES = 64 << 20


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(STRIP)))


class LineRuns:
    """Line hashes with the number of documents they stand in, as sorted runs on levels.

    A run is a table in the shared folder, dealt by hash into ``buckets`` files that are sorted by hash; the files of one
    bucket hold the same hashes in every run.  So a batch that is dealt alike meets the runs bucket by bucket in merge
    joins, and a run is never shuffled.  Hashes found in min_docs documents are settled: a batch is first
    merge-anti-joined with the settled hashes of every run, and only what is left becomes its run, on level 0.  When a
    level holds ``fanout`` runs they are merged, counts summed, into one a level up, so the runs to read stay
    logarithmic in the batches and a hash is rewritten once a level.  A hash is 128 bits of the line's key; of one document a key counts once.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, min_docs: int = 10, buckets: int | None = None):
        self.spark, self.fanout, self.min_docs, self.buckets, self.work = spark, fanout, min_docs, buckets or parts_of(spark), Work(spark, "lineruns")
        self.levels: list[list[str]] = []

    def _put(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        df.select("h", "n").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.work.path}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        self.work.drop(*names)

    def _without(self, keys: DataFrame, least: int) -> DataFrame:
        """The rows of a batch whose h has no count of least or more in any run, by merge joins bucket by bucket."""
        keys = keys.repartition(self.buckets, "h")
        for name in [x for level in self.levels for x in level]:
            keys = keys.join(self.spark.table(name).filter(F.col("n") >= least).select("h").hint("merge"), "h", "left_anti")
        return keys

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose h is settled in no run."""
        return self._without(keys, self.min_docs)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose h is in no run."""
        return self._without(keys, 1)

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: (h, n), each h once."""
        name, level = self._put(self.unsettled(keys)), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            name, self.levels[level] = self._merge(self.levels[level]), []
            level += 1

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, by a merge join."""
        both = a.join(b.withColumnRenamed("n", "m").hint("merge"), "h", "full_outer")
        return both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _merge(self, names: list[str]) -> str:
        name = names[0]
        for other in names[1:]:
            both = self._put(self.merged(self.spark.table(name), self.spark.table(other)))
            self._drop([name, other])
            name = both
        return name

    def compact(self) -> None:
        """All runs as one."""
        names = [x for level in self.levels for x in level]
        self.levels = [[self._merge(names)]] if names else []

    def counts(self) -> DataFrame:
        """(h, n) over all runs; n is exact under min_docs, and min_docs or more for settled hashes."""
        self.compact()
        return self.spark.table(self.levels[0][0]) if self.levels else self.spark.createDataFrame([], "h binary, n long")

    def frequent(self) -> DataFrame:
        return self.counts().filter(F.col("n") >= self.min_docs).select("h")

    def drop(self) -> None:
        self._drop([x for level in self.levels for x in level])
        self.levels = []


def _with_lines(docs: DataFrame, text_col: str, lines: str) -> DataFrame:
    return docs.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", id_col: str = "doc_id", batches: int = 4) -> DataFrame:
    """docs with ``kept_text`` (its other lines, joined by newlines), ``n_lines`` and ``n_dropped``.

    A line goes if its key (line_key) has min_chars characters or more and stands in min_docs
    documents or more; every copy goes.  The table is dealt into batches by a hash of its rows; each
    batch's keys are merge-anti-joined with the sorted runs of the levelled store, whose settled keys need no more
    counting, and what is left becomes a run.  The compacted store's settled keys are the verdict: lines are
    merge-anti-joined with them.  Only (row key, line number, hash) rows move for that; texts move
    once, to their list of kept lines, joined by a key of id and text, on which rows are even even if
    a source or a text is hot.

    A null or empty text is one empty line (kept: it has no character).  Rows with equal id and text
    each count as a document and each get the result.  An empty table gives an empty result.  Columns
    called kept_text, n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    key = fresh(docs, "_row")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    slim = _with_lines(keyed.select(key, F.col(text_col).alias("t")), "t", "l")
    work = Work(spark, "lines")
    parts = slim.select(F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch"), F.array_distinct(F.filter(F.transform("l", line_key), lambda k: F.length(k) >= min_chars)).alias("k"))
    counted = parts.select("batch", F.explode("k").alias("k")).groupBy("batch", F.unhex(F.md5("k")).alias("h")).agg(F.count("*").alias("n"))
    heads = work.stage(counted, "batches")
    runs = LineRuns(spark, min_docs=min_docs, buckets=max(parts_of(spark), -(-bytes_of(heads) // RUN_BYTES)))
    for b in range(batches):
        runs.add(heads.filter(F.col("batch") == b).select("h", "n"))
    frequent = work.stage(runs.frequent(), "frequent")
    runs.drop()
    work.drop("batches")
    lines = slim.select(key, F.posexplode("l").alias("i", "line")).withColumn("line", line_key(F.col("line")))
    # A key that is too short takes the row's own key for a hash: it matches no line and is spread like rows.
    lines = lines.select(key, "i", F.when(F.length("line") >= min_chars, F.unhex(F.md5("line"))).otherwise(F.col(key)).alias("h"))
    stay = lines.join(frequent.hint("merge"), "h", "left_anti").groupBy(key).agg(F.collect_set("i").alias("stay"))
    lined, staying = fresh(docs, "_lines"), fresh(docs, "_stay")
    out = _with_lines(keyed, text_col, lined).join(stay.withColumnRenamed("stay", staying), key, "left")
    at = F.array_sort(F.coalesce(F.col(staying), F.array().cast("array<int>")))
    return out.select(
        *kept(docs),
        F.array_join(F.transform(at, lambda i: F.get(F.col(lined), i)), "\n").alias("kept_text"),
        F.size(lined).cast("long").alias("n_lines"),
        (F.size(lined) - F.size(at)).cast("long").alias("n_dropped"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the lines that stand in 10 documents or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, rn, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, rn, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rn) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k
GROUP BY doc_id, rn
"""
