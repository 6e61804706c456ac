"""Commit logs: raw text to changes of files, changes to the files' present names, and churn by file.

A log is what `git log --name-status -M` prints, with any of its date formats that name a zone. A file of it is read by Spark's text reader
with the border between commits as line end, so tasks read parts of one large file and begin at a border; texts in a table
are cut in the same places.

A rename hands a path's history on. Between two renames away from it a path has one life; a change belongs to the life in
which it falls, and a life that ends by a rename goes on in a life of the new path. Lives are few (as many as renames), so their
chains are resolved by doubling, in as many joins as the longest chain has binary digits, and changes are joined with
them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.plans.tables import held

from .readers import churn

_BORDER = r"(?m)^(?=commit [0-9a-f]{7,64}\b)"
_CHANGE = r"(?m)^[AMDTRC][0-9]*\t[^\n]+$"
_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss Z", "MMM d HH:mm:ss yyyy Z", "d MMM yyyy HH:mm:ss Z"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text), one for each commit of the log files at path."""
    rows = spark.read.option("lineSep", "\ncommit ").text(path)
    return rows.select(F.concat(F.lit("commit "), F.regexp_replace("value", "^commit ", "")).alias("text")).where("trim(text) <> 'commit'")


def split_log(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows (text), one for each commit, of rows whose text is a log of any number of them."""
    return rows.select(F.explode(F.split(F.coalesce(text, F.lit("")), _BORDER)).alias("text")).where(F.startswith("text", F.lit("commit ")))


def _date(text: Column) -> Column:
    plain = F.regexp_replace(F.trim(text), r"^[A-Z][a-z]{2},? ", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in _FORMATS])


def _path(text: Column) -> Column:
    """A path without the quotes that it has if some of its characters are escaped."""
    return F.when(text.rlike('^".*"$'), text.substr(F.lit(2), F.length(text) - 2)).otherwise(text)


def changes(commits: DataFrame) -> DataFrame:
    """(commit, author, ts, status, file, old) of each file that commits (text) change; author is the address, or the name without one."""
    line = lambda name: F.regexp_extract("text", rf"(?m)^{name}:[ \t]*(.*)$", 1)
    who = line("Author")
    author = F.coalesce(F.nullif(F.regexp_extract(who, "<([^<>]*)>", 1), F.lit("")), F.trim(F.regexp_replace(who, "<.*$", "")))
    when = F.coalesce(F.nullif(line("AuthorDate"), F.lit("")), line("Date"))
    each = commits.select(F.regexp_extract("text", "^commit ([0-9a-f]+)", 1).alias("commit"), author.alias("author"), _date(when).alias("ts"), F.explode(F.regexp_extract_all("text", F.lit(_CHANGE), F.lit(0))).alias("line"))
    parts = F.split("line", "\t")
    to = F.coalesce(F.get(parts, 2), F.get(parts, 1))
    return each.select("commit", "author", "ts", F.substring("line", 1, 1).alias("status"), _path(to).alias("file"), F.when(F.get(parts, 2).isNotNull(), _path(F.get(parts, 1))).alias("old"))


def renamed(rows: DataFrame) -> DataFrame:
    """changes with `now`, the name that the file of each has at last. Changes of one moment are ordered by their commits."""
    at = F.struct("ts", "commit")
    moves = held(rows.where("status = 'R' AND old IS NOT NULL AND old <> file").select(F.col("old").alias("from"), F.col("file").alias("to"), at.alias("at")).distinct())
    away = moves.groupBy("from").agg(F.array_sort(F.collect_list("at")).alias("moves")).withColumnRenamed("from", "path")

    def life(path: str, when: Column, strict: Column) -> Column:
        """How many moves away from a path are before a moment; one of the same moment is if not strict."""
        return F.coalesce(F.size(F.filter("moves", lambda m: F.when(strict, m < when).otherwise(m <= when))), F.lit(0)).alias(path)

    # where the life that a move ends goes on: in the new path's life of that moment
    ended = moves.join(away, F.col("from") == F.col("path")).select("from", life("life", F.col("at"), F.lit(True)), "to", "at")
    links = ended.join(away, F.col("to") == F.col("path"), "left").select(F.col("from").alias("path"), "life", F.col("to").alias("next"), life("next_life", F.col("at"), F.lit(True)))
    links = held(links)
    while True:
        far = links.select(F.col("path").alias("p"), F.col("life").alias("n"), F.col("next").alias("far"), F.col("next_life").alias("far_life"))
        step = links.join(far, (F.col("next") == F.col("p")) & (F.col("next_life") == F.col("n")), "left")
        step = held(step.select("path", "life", F.coalesce("far", "next").alias("next"), F.coalesce("far_life", "next_life").alias("next_life"), F.col("far").isNotNull().alias("went")))
        links = step.drop("went")
        if step.where("went AND NOT (next = path AND next_life = life)").isEmpty():
            break
    # a file that is made anew at the moment of a move begins the next life
    of = rows.join(away, F.col("file") == F.col("path"), "left").drop("path").withColumn("life", life("life", at, F.col("status") != "A")).drop("moves")
    ends = links.select(F.col("path").alias("_path"), F.col("life").alias("_life"), F.col("next"))
    return of.join(ends, (F.col("file") == F.col("_path")) & (F.col("life") == F.col("_life")), "left").select(*rows.columns, F.coalesce("next", "file").alias("now"))


def log_churn(commits: DataFrame, now: Column) -> DataFrame:
    """Churn by file (see readers.churn) of commits (text), under the files' present names; commits without a date do not count."""
    rows = renamed(changes(commits).where("ts IS NOT NULL"))
    return churn(rows.select(F.col("now").alias("file"), "author", "ts", "commit").distinct(), now)
