"""The star-schema test tables read as repositories, commits, functions and files.

Only these views know the test tables; the operators know nothing of them.
Every view reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import rollup, scoring
from ..sources.tables import stored_copy

# extension by id % 17: all known ones, then an unknown one
EXTENSIONS = (
    ".java", ".cs", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".ts", ".tsx",
    ".js", ".jsx", ".mjs", ".cjs", ".rs", ".py", ".md",
)
# directory by id % 20; other ids keep their own
DIRECTORIES = {0: "node_modules", 1: "Bin", 2: "tools"}
UTILITY_PATTERNS = ["tools", "scripts", "*.sh"]
EXCLUDE_PATTERNS = ["*.md", "small*", ".tsx", "Economy", "a*b"]
INCLUDE_PATTERNS = ["*.cs", "RED*", ".py", "blue_bolt_2.c"]
BASELINE, CURRENT, START = "1996-03", "1998-02", "1996-03"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extension(key: Column) -> Column:
    names = ", ".join(f"'{e}'" for e in EXTENSIONS)
    return F.element_at(F.expr(f"array({names})"), (key % len(EXTENSIONS)).cast("int") + 1)


def _directory(key: Column, own: Column) -> Column:
    directory = own
    for remainder, name in DIRECTORIES.items():
        directory = F.when(key % 20 == remainder, F.lit(name)).otherwise(directory)
    return directory


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> (file_id, path)."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key.cast("string"), _extension(key))
    return part.select(
        key.alias("file_id"), F.concat_ws("/", _directory(key, F.lower("p_type")), name).alias("path")
    )


def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return files(spark, sf_dir).select(
        "file_id",
        "path",
        paths.language_of(path).alias("language"),
        paths.kind_of(path, UTILITY_PATTERNS).alias("kind"),
    )


def functions_by_id(lineitem: DataFrame, *kept: str) -> DataFrame:
    """lineitem -> one function per row; file and commit are named by narrow keys.  Columns ``kept`` stay beside."""
    return lineitem.select(
        F.col("l_returnflag").alias("repo"),
        F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"),
        F.col("l_partkey").alias("file_id"),
        F.col("l_quantity").alias("ccn"),
        F.col("l_quantity").cast("int").alias("nloc"),
        F.col("l_suppkey").alias("import"),
        *kept,
    )


def _commit_hash() -> Column:
    return F.date_format("month", "yyyy-MM").alias("commit_hash")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the paths of part; every third function spells its path in capitals."""
    rows = functions_by_id(table(spark, sf_dir, "lineitem"))
    path = F.when(F.col("nloc") % 3 == 0, F.upper("path")).otherwise(F.col("path"))
    joined = rows.join(files(spark, sf_dir), "file_id")
    return joined.select("repo", _commit_hash(), path.alias("path"), "ccn", "nloc")


def parts_of(scan: DataFrame) -> int:
    """Into how many partitions steps over a whole scan are cut: several for each of its splits, so that what one task
    holds stays the same however large the table is."""
    return max(int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * scan.rdd.getNumPartitions())


def to_file_metrics(function_rows: DataFrame, classified: DataFrame, parts: int | None = None) -> DataFrame:
    """Roll functions up to files on their narrow numeric key, then name the files; in so many ``parts``, if given."""
    if parts:
        function_rows = function_rows.repartition(parts, "repo", "month", "file_id")
    rolled = rollup.function_rollup(
        function_rows,
        ("repo", "month"),
        F.sum("nloc").cast("bigint").alias("sloc"),
        F.count_distinct("import").cast("bigint").alias("coupling"),
        file=F.col("file_id"),
    )
    if parts:
        rolled = rolled.repartition(parts, "path_key")
    joined = rolled.join(classified, rolled.path_key == classified.file_id)
    return rollup.add_maintainability(joined).select(
        "repo", _commit_hash(), "path", "language", "sloc", "cc", "mi",
        "smells_high", "smells_medium", "smells_low", "coupling", "kind",
    )


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return to_file_metrics(functions_by_id(lineitem), classified_files(spark, sf_dir), parts_of(lineitem))


def _month_start(commit_hash: Column) -> Column:
    return F.to_timestamp(commit_hash, "yyyy-MM")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, commit_hash, ts, parents, tagged): one commit per repository and ship month.

    The parent is the month before; every sixth commit also merges the one before that.
    """
    months = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_returnflag").alias("repo"), F.date_format("l_shipdate", "yyyy-MM").alias("commit_hash"))
        .distinct()
    )
    # calendar months bound this window: twelve rows per repository and year
    order = Window.partitionBy("repo").orderBy("commit_hash")
    number = F.row_number().over(order)
    previous, before = F.lag("commit_hash", 1).over(order), F.lag("commit_hash", 2).over(order)
    linked = months.select(
        "repo", "commit_hash", number.alias("number"), previous.alias("previous"), before.alias("before")
    )
    merges = F.col("number") % 6 == 0
    parents = (
        F.when(F.col("previous").isNull(), F.array().cast("array<string>"))
        .when(merges, F.array("previous", "before"))
        .otherwise(F.array("previous"))
    )
    return linked.select(
        "repo",
        "commit_hash",
        _month_start(F.col("commit_hash")).alias("ts"),
        parents.alias("parents"),
        (F.col("number") % 12 == 0).alias("tagged"),
    )


def commit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits(spark, sf_dir).drop("tagged")


def branched_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commits as a graph with side branches, some with a clock 100 days ahead.

    Of every six, the third and the fourth both follow the second; the fifth
    follows the fourth, and the sixth merges it into the third.
    """
    order = Window.partitionBy("repo").orderBy("commit_hash")  # months, as above
    number, back = F.row_number().over(order), [F.lag("commit_hash", k).over(order) for k in (1, 2, 3)]
    rows = commits(spark, sf_dir).select("repo", "commit_hash", "ts", number.alias("number"), *[c.alias(f"back{k}") for k, c in enumerate(back, 1)])
    sixth = F.col("number") % 6
    first = F.when(sixth == 4, F.col("back2")).when(sixth == 0, F.col("back3")).otherwise(F.col("back1"))
    parents = F.array_compact(F.array(first, F.when(sixth == 0, F.col("back1"))))
    ts = F.when(F.col("number") % 7 == 3, F.col("ts") + F.expr("interval 100 days")).otherwise(F.col("ts"))
    return rows.select("repo", "commit_hash", ts.alias("ts"), parents.alias("parents"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = commits(spark, sf_dir).where("tagged")
    return tagged.select("repo", F.upper("commit_hash").alias("commit_hash"))


def commit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.entropy_by_commit(file_metrics(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored commit metrics with their times.

    Scoring reads every function; histories look at its small result several
    times over.  So the result is stored once and read back, as a scan would.
    """
    stored = stored_copy(commit_metrics(spark, sf_dir))
    return stored.withColumn("ts", _month_start(F.col("commit_hash")))


def snapshot(spark: SparkSession, sf_dir: str, commit_hash: str) -> DataFrame:
    """Scored files of one month of every repository.

    The month is a range of ship dates that reaches the Parquet scan: commits
    are scored apart from each other, so nothing else is read.
    """
    start = F.lit(f"{commit_hash}-01").cast("timestamp_ntz")
    shipped = F.col("l_shipdate")
    month = table(spark, sf_dir, "lineitem").where(
        (shipped >= start) & (shipped < start + F.expr("interval 1 month"))
    )
    return scoring.badness_by_file(to_file_metrics(functions_by_id(month), classified_files(spark, sf_dir)))


def _source_path(key: Column) -> Column:
    name = F.concat(F.lit("doc_"), key.cast("string"), _extension(key))
    return F.concat_ws("/", _directory(key, F.lit("src")), name)


def _import_line(language: Column, number: Column, line: Column) -> Column:
    dotted = F.replace(line, F.lit(" "), F.lit("."))
    forms = number % 5
    using = (
        F.when(forms == 0, F.concat(F.lit("using "), dotted, F.lit(";")))
        .when(forms == 1, F.concat(F.lit("using var x = "), line, F.lit(";")))
        .when(forms == 2, F.concat(F.lit("  using static "), dotted, F.lit(" ; ")))
        .when(forms == 3, F.concat(F.lit("using A ="), line, F.lit(";")))
        .otherwise(F.concat(F.lit("using (x "), line, F.lit(");")))
    )
    return (
        F.when(language == "CSharp", using)
        .when(language.isin("C", "Cpp"), F.concat(F.lit("\t#include <"), dotted, F.lit(">")))
        .when(language == "Rust", F.concat(F.lit("use "), dotted, F.lit(";")))
        .when(
            language.isin("TypeScript", "JavaScript") & (forms == 0),
            F.concat(F.lit("const x = require('"), dotted, F.lit("')")),
        )
        .otherwise(F.concat(F.lit("import "), line, F.lit(";")))
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (repo, commit_hash, path, content); prose gets comments, imports and blank lines."""
    documents = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    path = _source_path(key)
    language = paths.language_of(path)

    def decorate(line: Column, number: Column) -> Column:
        form = F.pmod(key * 7 + number, F.lit(11))
        return (
            F.when(form == 0, F.concat(F.lit("/* "), line))
            .when(form.isin(1, 6), F.concat(F.lit("  // "), line))
            .when(form == 2, F.concat(line, F.lit(" */")))
            .when(form == 3, _import_line(language, number, line))
            .when(form == 4, F.concat(F.lit("# "), line))
            .when(form == 5, F.lit("  "))
            .when(form == 8, F.concat(F.lit("/* "), line, F.lit(" */")))
            .otherwise(F.concat(line, F.lit("\r")))
        )

    content = F.array_join(F.transform(F.split("text", "\n"), decorate), "\n")
    return documents.select(
        F.concat(F.lit("repo_"), F.col("lang")).alias("repo"),
        F.col("source").alias("commit_hash"),
        path.alias("path"),
        content.alias("content"),
    )


def document_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> functions of the document files, path in capitals for every third."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("l_partkey"),
        F.concat(F.lit("repo_"), F.col("lang")).alias("repo"),
        F.col("source").alias("commit_hash"),
        _source_path(F.col("doc_id")).alias("_path"),
    )
    # parts and documents differ in number: parts take the documents in turn, so that every line item has a file
    count = table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).scalar()
    rows = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", count).alias("l_partkey"), F.col("l_quantity").alias("ccn"))
    path = F.when(F.col("ccn").cast("int") % 3 == 0, F.upper("_path")).otherwise(F.col("_path"))
    return rows.join(documents, "l_partkey").select("repo", "commit_hash", path.alias("path"), "ccn")


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> remote URLs; a third in SSH form, every second with '.git'."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_extract("url", "^https?://([^/]+)/([^?#]*)", 1)
    rest = F.regexp_extract("url", "^https?://([^/]+)/([^?#]*)", 2)
    tail = F.concat(rest, F.when(F.col("page_id") % 2 == 0, ".git").otherwise(""))
    ssh = F.concat(F.lit("git@"), bare, F.lit(":"), tail)
    url = F.when(F.col("page_id") % 3 == 0, ssh).otherwise(
        F.concat(F.regexp_extract("url", "^https?://", 0), bare, F.lit("/"), tail)
    )
    return pages.select("page_id", url.alias("remote_url"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log: a file with functions in a month was touched there, or deleted when its lines divide by 7."""
    lineitem = table(spark, sf_dir, "lineitem")
    parts = parts_of(lineitem)
    rows = functions_by_id(lineitem).repartition(parts, "repo", "month", "file_id")
    touched = rows.groupBy("repo", "month", "file_id").agg(F.sum("nloc").cast("bigint").alias("sloc"))
    return touched.repartition(parts, "file_id").join(files(spark, sf_dir), "file_id").select(
        "repo",
        _commit_hash(),
        "path",
        F.concat(F.lit("v"), (F.col("sloc") % 10).cast("string")).alias("content_hash"),
        (F.col("sloc") % 7 == 0).alias("is_deleted"),
    )
