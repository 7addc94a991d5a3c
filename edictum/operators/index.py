"""An inverted index of rules or other texts: who says a word, and who compares with a number.

Two tables beside the rows themselves. Postings have a row for each word of a row (as a stem) with the weight of the best place
it stands in; numbers a row for each literal that a row compares with. Both are written in folders by a hash of the
word or number, so a question reads the folders of its words alone, and sums weights by row. Pages go on
after the last row of the page before (its score and id), not by counting rows from the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.operators import search
from edictum.workspace import discard, materialize, spread

#: Folders of a table.
FOLDERS = 64


def _folder(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


def postings(rows: DataFrame) -> DataFrame:
    """``stem``, ``id``, ``weight`` of each different word of each row (rule_id, title, concepts, body): made in the row, nothing is shuffled."""
    places = [(F.concat_ws(" ", "concepts"), search.CONCEPT), (F.coalesce("title", F.lit("")), search.TITLE), (F.coalesce("body", F.lit("")), search.BODY)]
    stems = rows.select(F.col("rule_id").alias("id"), *(search.stemmed_words(text).alias(f"w{weight}") for text, weight in places))
    # the best place counts: words of a better one are taken out of the others
    better, own = F.array().cast("array<string>"), []
    for _, weight in places:
        own.append(F.struct(F.lit(weight).alias("weight"), F.array_except(f"w{weight}", better).alias("stems")))
        better = F.concat(better, F.col(f"w{weight}"))
    each = stems.select("id", F.explode(F.array(*own)).alias("p"))
    return each.select(F.explode("p.stems").alias("stem"), "id", "p.weight")


def numbers(rows: DataFrame) -> DataFrame:
    """``value``, ``op``, ``id`` of each different literal that a row's tests compare with."""
    each = F.flatten(F.transform("tests", lambda t: F.transform(t["values"], lambda v: F.struct(v.alias("value"), t["op"].alias("op")))))
    return rows.select(F.col("rule_id").alias("id"), F.explode(F.array_distinct(each)).alias("t")).select("t.value", "t.op", "id")


@dataclass(frozen=True)
class Index:
    """A written index, to be asked."""

    spark: SparkSession
    path: str

    @staticmethod
    def write(rows: DataFrame, path: str) -> Index:
        """Index ``rows``: rule_id, title, concepts, body and tests as search.rule_rows() gives them, an id once. Nulls say nothing."""
        rows = materialize(spread(rows, "rule_id"), "indexed")  # both tables come from it; making rows may be dear
        Index._put(rows, path, "overwrite")
        discard(rows)
        return Index(rows.sparkSession, path)

    @staticmethod
    def _put(rows: DataFrame, path: str, mode: str) -> None:
        """Both tables in their folders. A folder's rows are dealt to tasks by their id too, so a word that all rows say is no task's alone."""
        lots = max(1, -(-rows.sparkSession.sparkContext.defaultParallelism * 2 // FOLDERS))
        for name, made, by in (("postings", postings(rows), F.col("stem")), ("numbers", numbers(rows), F.round("value", 6))):
            lot = F.pmod(F.xxhash64("id"), F.lit(lots))
            made.withColumn("folder", _folder(by)).repartition("folder", lot).write.partitionBy("folder").mode(mode).parquet(f"{path}/{name}")

    def add(self, rows: DataFrame) -> None:
        """Rows with new ids; nothing that is there is rewritten."""
        Index._put(rows, self.path, "append")

    def _read(self, name: str, values: list, kind: str) -> DataFrame:
        """Rows of a table in the folders of the values."""
        at = [r["f"] for r in self.spark.createDataFrame([(v,) for v in values], f"v {kind}").select(_folder(F.col("v")).alias("f")).distinct().collect()]
        schema = {"postings": "stem string, id string, weight int, folder int", "numbers": "value double, op string, id string, folder int"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("folder").isin(at))

    def scores(self, question: str) -> DataFrame:
        """``id`` and ``score`` of every row that a question finds: each word counts by its best place, each number by the best comparison with it."""
        terms, asked = search.read_question(question)
        found = self.spark.createDataFrame([], "id string, part double")
        if terms:
            own = self._read("postings", sorted(terms), "string").filter(F.col("stem").isin(sorted(terms)))
            found = found.unionByName(own.groupBy("stem", "id").agg(F.max("weight").cast("double").alias("part")).select("id", "part"))
        for relations, n in asked:
            near = self._read("numbers", [round(n, 6)], "double").filter(F.abs(F.col("value") - n) < 1e-9)
            part = F.when(F.col("op").isin(*relations), search.SAME_COMPARISON).when(F.col("op").isin("between", "==", "<", "<=", ">", ">="), search.SAME_NUMBER)
            found = found.unionByName(near.groupBy("id").agg(F.max(part).cast("double").alias("part")).filter("part > 0"))
        return found.groupBy("id").agg(F.sum("part").alias("score"))

    def page(self, question: str, size: int, after: tuple[float, str] | None = None) -> DataFrame:
        """The best rows, by score, then id; those behind the row ``after`` (its score and id), if it is given."""
        found = self.scores(question)
        if after is not None:
            score, at = after
            found = found.filter((F.col("score") < score) | ((F.col("score") == score) & (F.col("id") > at)))
        return found.orderBy(F.desc("score"), "id").limit(size)
