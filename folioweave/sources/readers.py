"""Readers of benchmark files, books and stored artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave import schemas
from folioweave.operators.ranking import placed
from folioweave.session import cut

LETTERS = ("A", "B", "C", "D")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, context, input, options, answer) of a JSON-lines benchmark; blank and broken lines are skipped. line_no is
    the order of file, place and offset of the rows: unique, rising, without a sort of the texts."""
    rows = spark.read.schema(schemas.BENCHMARK_LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    numbered = rows.withColumn("line_no", F.monotonically_increasing_id())
    return numbered.where("_corrupt IS NULL AND context IS NOT NULL").drop("_corrupt")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `read_lines` skips because they are no JSON, for a warning."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where((F.trim("line") != "") & F.expr("try_parse_json(line) IS NULL"))


def variant_text(answer: Column) -> Column:
    """A variant answer as text: itself, or its first element if it is a list."""
    return F.coalesce(F.try_variant_get(answer, "$[0]", "string"), F.try_variant_get(answer, "$", "string"))


def answer_letter(options: Column, answer: Column, first: Column | None = None) -> Column:
    """The letter of the first option equal to the answer, or to `first` (a list answer's first element); null if none is.
    Options beyond the fourth have no letter."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    place = F.array_position(options, answer)
    if first is not None:
        place = F.coalesce(F.nullif(place, F.lit(0).cast("bigint")), F.array_position(options, first))
    return F.when(place.between(1, len(LETTERS)), F.element_at(letters, place.cast("int")))


def number_books(lines: DataFrame, context: str, order: str) -> DataFrame:
    """(digest, book_no): the distinct contexts in the order of their first line, from 0. Contexts are compared by digest,
    so their texts are neither shuffled nor sorted; the numbering runs over one row a book."""
    return _numbered(lines.select(F.sha2(F.col(context), 256).alias("digest"), order), order)


def _numbered(lines: DataFrame, order: str) -> DataFrame:
    firsts = lines.groupBy("digest").agg(F.min(order).alias("first"))
    return placed(firsts, [], [F.col("first"), F.col("digest")]).select("digest", (F.col("place") - 1).alias("book_no"))


def infinite_choice(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(books, qa) of a multiple-choice benchmark file; questions whose answer is none of the options are dropped."""
    lines = read_lines(spark, path).withColumn("digest", F.sha2("context", 256))
    questions = cut(lines.drop("context"), "lines")  # without the text of their book, which every line repeats
    numbers = _numbered(questions, "line_no").select("digest", F.col("book_no").cast("string").alias("book_id"), "book_no")
    firsts = questions.groupBy("digest").agg(F.min("line_no").alias("line_no"))
    books = lines.select("line_no", "context").join(firsts.join(numbers, "digest"), "line_no").select("book_id", F.col("context").alias("book_text"))  # one line a book
    lettered = questions.join(numbers, "digest").withColumn("answer", answer_letter(F.col("options"), variant_text(F.col("answer")))).where("answer IS NOT NULL")
    qid = F.row_number().over(Window.partitionBy("book_id").orderBy("line_no")) - 1
    return books, lettered.select("book_id", qid.alias("question_id"), F.col("input").alias("question"), "options", "answer")


def novel_books(spark: SparkSession, root: str) -> DataFrame:
    """Books/<category>/B<id>.txt, one row a file."""
    files = spark.read.text(f"{root}/Books/*/B*.txt", wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"/B([^/]*)\.txt$", 1).alias("book_id"), F.col("value").alias("book_text"))


def novel_questions(spark: SparkSession, root: str) -> DataFrame:
    """Data/<category>/B<id>.json: an object of questions by id."""
    from pyspark.sql import types as T

    files = spark.read.text(f"{root}/Data/*/B*.json", wholetext=True)
    parsed = files.select(F.regexp_extract(F.input_file_name(), r"/B([^/]*)\.json$", 1).alias("book_id"), F.from_json("value", T.MapType(T.StringType(), schemas.NOVEL_QUESTION)).alias("q"))
    rows = parsed.select("book_id", F.explode("q").alias("key", "item"))
    qid = F.row_number().over(Window.partitionBy("book_id").orderBy("key")) - 1
    return rows.select("book_id", qid.alias("question_id"), F.col("item.Question").alias("question"), options_array(F.col("item.Options")).alias("options"), F.col("item.Gold").alias("answer"))


def options_array(options: Column) -> Column:
    """A struct of A to D as an array, an empty text for a missing option."""
    return F.array(*[F.coalesce(options[x], F.lit("")) for x in LETTERS])


def with_questions(books: DataFrame, qa: DataFrame) -> DataFrame:
    """The books that have questions."""
    return books.join(qa.select("book_id").distinct(), "book_id", "left_semi")


def without_questions(books: DataFrame, qa: DataFrame) -> DataFrame:
    return books.join(qa.select("book_id").distinct(), "book_id", "left_anti")


def novel_qa(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    books, qa = novel_books(spark, root), novel_questions(spark, root)
    return with_questions(books, qa), qa.join(books.select("book_id"), "book_id", "left_semi")


LOADERS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {"InfiniteChoice": infinite_choice, "NovelQA": novel_qa}


def load(spark: SparkSession, dataset: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(books, qa) of a dataset by name; ValueError for an unknown one."""
    if dataset not in LOADERS:
        raise ValueError(f"unknown dataset: {dataset}")
    return LOADERS[dataset](spark, path)


def in_order(books: DataFrame, column: str = "book_id") -> DataFrame:
    """Ids with their place: numeric ids by number, before all others by text."""
    number = F.expr(f"try_cast({column} AS int)")
    return placed(books.select(column).distinct(), [], [number.asc_nulls_last(), F.col(column)])


def run_range(rows: DataFrame, mode: str, start: int = 0, end: int = 0, column: str = "book_no") -> DataFrame:
    """Rows of one book ('single'), of a range of books ('range', both ends included) or all ('all'): a plain filter, which
    prunes partitions where the column is one."""
    if mode == "all":
        return rows
    if mode == "single":
        return rows.where(F.col(column) == start)
    if mode == "range":
        return rows.where(F.col(column).between(start, end))
    raise ValueError(f"unknown mode: {mode}")


def artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table, with its declared schema where it has one."""
    declared = {"books": schemas.BOOKS, "qa": schemas.QA, "chunks": schemas.CHUNKS, "edges": schemas.EDGES, "mentions": schemas.MENTIONS, "node_entities": schemas.NODE_ENTITIES, "tree_edges": schemas.TREE_EDGES, "node_leaves": schemas.NODE_LEAVES, "relations": schemas.RELATIONS}
    reader = spark.read.schema(declared[name]) if name in declared else spark.read
    return reader.parquet(f"{root}/{name}")
