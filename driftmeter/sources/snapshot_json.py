"""The snapshot document: summary, history and latest files of a repository as JSON.

Reading takes one document per row.  Writing never builds a document in one
place: each history entry and each file is rendered on its own line by the task
that holds it, and a range sort puts the lines of a document in order.  The part
files of a repository, concatenated by name, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import history as hist
from ..operators import scoring, skew
from ..operators.rollup import COMMIT
from . import schemas
from .tables import stored_copy


# --- reading -----------------------------------------------------------------------------

def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: (document, snapshot struct)."""
    texts = spark.read.text(path, wholetext=True)
    rows = texts.select(F.col("_metadata.file_path").alias("document"), F.col("value").alias("json"))
    return parse_snapshots(rows, "json")


def parse_snapshots(documents: DataFrame, json_column: str) -> DataFrame:
    """Replace a JSON text column by the column ``snapshot``, parsed with the declared schema."""
    others = [c for c in documents.columns if c != json_column]
    return documents.select(*others, F.from_json(json_column, schemas.SNAPSHOT).alias("snapshot"))


def _or_default(value: Column, kind) -> Column:
    default = {"string": F.lit(""), "double": F.lit(0.0), "bigint": F.lit(0).cast("bigint")}[kind.simpleString()]
    return F.coalesce(value, default)


def snapshot_summary(snapshots: DataFrame) -> DataFrame:
    """(…, generated, commits, entropy, files, sloc); a missing summary reads as zeros."""
    others = [c for c in snapshots.columns if c != "snapshot"]
    summary = [
        _or_default(F.col(f"snapshot.summary.{f.name}"), f.dataType).alias(f.name)
        for f in schemas.SNAPSHOT_SUMMARY
    ]
    return snapshots.select(
        *others,
        F.coalesce("snapshot.generated", F.lit("")).alias("generated"),
        F.coalesce("snapshot.commitCount", F.lit(0)).alias("commits"),
        F.col("snapshot.summary").isNotNull().alias("has_summary"),
        *summary,
    )


def _entries(snapshots: DataFrame, field: str) -> DataFrame:
    others = [c for c in snapshots.columns if c != "snapshot"]
    return snapshots.select(*others, F.posexplode(f"snapshot.{field}").alias("position", "_entry"))


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    """(…, position, commit_hash, date, entropy, total_files, total_sloc), one row per history entry."""
    rows = _entries(snapshots, "history")
    names = {"hash": "commit_hash", "date": "date", "entropy": "entropy", "files": "total_files", "sloc": "total_sloc"}
    return rows.select(
        *[c for c in rows.columns if c != "_entry"],
        *[
            _or_default(F.col(f"_entry.{f.name}"), f.dataType).alias(names[f.name])
            for f in schemas.SNAPSHOT_HISTORY
        ],
    )


_FILE_COLUMNS = {
    "path": "path", "language": "language", "sloc": "sloc", "cyclomaticComplexity": "cc",
    "maintainabilityIndex": "mi", "smellsHigh": "smells_high", "smellsMedium": "smells_medium",
    "smellsLow": "smells_low", "couplingProxy": "coupling", "badness": "badness", "kind": "kind",
}


def snapshot_files(snapshots: DataFrame) -> DataFrame:
    """(…, file columns with ``badness``), one row per latest file."""
    rows = _entries(snapshots, "latestFiles")
    columns = []
    for field in schemas.SNAPSHOT_FILE:
        value = F.col(f"_entry.{field.name}")
        filled = F.coalesce(value, F.lit(fixed.PRODUCTION)) if field.name == "kind" else _or_default(value, field.dataType)
        columns.append(filled.alias(_FILE_COLUMNS[field.name]))
    return rows.select(*[c for c in rows.columns if c not in ("_entry", "position")], *columns)


# --- writing -----------------------------------------------------------------------------

def snapshot_lines(history: DataFrame, latest_files: DataFrame, generated: Column | None = None) -> DataFrame:
    """The documents as text: (repo, section, position, name, line), in document order when sorted by these.

    ``history`` is (repo, commit_hash, ts, entropy, total_files, total_sloc);
    ``latest_files`` the file metrics of each repository's newest commit.
    """
    numbered = hist.number_commits(history)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX") if generated is None else generated
    newest = numbered.where(F.col("commit_seq") == F.col("commit_count"))

    def line(rows: DataFrame, section: int, position, name, content: Column) -> DataFrame:
        return rows.select(
            "repo",
            F.lit(section).alias("section"),
            position.cast("bigint").alias("position"),
            name.alias("name"),
            content.alias("line"),
        )

    nothing, zero = F.lit(""), F.lit(0)
    summary = F.to_json(
        F.struct(F.col("entropy"), F.col("total_files").alias("files"), F.col("total_sloc").alias("sloc"))
    )
    head = line(
        newest, 0, zero, nothing,
        F.concat(
            F.lit('{"generated":"'), stamp, F.lit('","commitCount":'), F.col("commit_count").cast("string"),
            F.lit(',"summary":'), summary, F.lit(',"history":['),
        ),
    )
    entry = F.to_json(
        F.struct(
            F.col("commit_hash").alias("hash"),
            F.date_format("ts", "yyyy-MM-dd").alias("date"),
            "entropy",
            F.col("total_files").alias("files"),
            F.col("total_sloc").alias("sloc"),
        )
    )
    comma = F.when(F.col("commit_seq") < F.col("commit_count"), ",").otherwise("")
    entries = line(numbered, 1, F.col("commit_seq"), nothing, F.concat(entry, comma))
    middle = line(newest, 2, zero, nothing, F.lit('],"latestFiles":['))

    # the greatest path closes the list: known from one aggregation, so no file waits for another.
    # The scores are read twice, by it and by the lines, hence stored.
    scored = stored_copy(scoring.badness_by_file(latest_files))
    last = scored.groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("_files"), F.max("path").alias("_last"))
    marked = skew.attach(scored, last, COMMIT)
    fields = [F.col(column).alias(name) for name, column in _FILE_COLUMNS.items()]
    file_line = F.concat(F.to_json(F.struct(*fields)), F.when(F.col("path") < F.col("_last"), ",").otherwise(""))
    files = line(marked, 3, zero, F.col("path"), file_line)
    tail = line(newest, 4, zero, nothing, F.lit("]}"))
    return head.unionByName(entries).unionByName(middle).unionByName(files).unionByName(tail)


def snapshot_of_files(files: DataFrame, snapshot_hash: str, taken: Column) -> DataFrame:
    """Lines of an ad-hoc snapshot: the files stand under one made-up commit."""
    own = files.withColumn("commit_hash", F.lit(snapshot_hash))
    history = scoring.entropy_by_commit(own).withColumn("ts", taken)
    return snapshot_lines(history, own)


def write_snapshots(lines: DataFrame, path: str) -> None:
    """One directory per repository; part files in name order hold the documents' lines in order."""
    ordered = lines.orderBy("repo", "section", "position", "name")
    ordered.select("repo", "line").write.mode("errorifexists").partitionBy("repo").text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``write_snapshots`` left below ``path``: (repo, section, line), whatever the number of part files.

    Every line says by its first property which section it belongs to, so no document is assembled.
    """
    lines = spark.read.schema("value string, repo string").text(path).withColumnRenamed("value", "line")
    starts = ('{"generated":', '{"hash":', "],", '{"path":', "]}")
    section = None
    for number, start in enumerate(starts):
        hit = F.startswith("line", F.lit(start))
        section = F.when(hit, number) if section is None else section.when(hit, number)
    # to_json leaves out what is null: such an entry is told by the properties it has
    rest = F.when(F.col("line").contains('"badness":') | F.col("line").contains('"kind":'), 3).otherwise(1)
    return lines.select("repo", section.otherwise(rest).alias("section"), "line")


def parse_snapshot_heads(lines: DataFrame) -> DataFrame:
    """(repo, generated, commits, entropy, files, sloc) straight from the lines, one row per document."""
    head = F.from_json(F.regexp_replace("line", r',"history":\[$', "}"), schemas.SNAPSHOT)
    return lines.where(F.col("section") == 0).select("repo", head.alias("_head")).select(
        "repo", "_head.generated", F.col("_head.commitCount").alias("commits"), "_head.summary.*"
    )


def parse_snapshot_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History entries and files straight from ``snapshot_lines``, without assembling a document."""
    def rows(section: int, schema) -> DataFrame:
        text = F.regexp_replace("line", ",$", "")
        return lines.where(F.col("section") == section).select(
            "repo", F.from_json(text, schema).alias("_entry")
        )

    history = rows(1, schemas.SNAPSHOT_HISTORY).select("repo", "_entry.*")
    files = rows(3, schemas.SNAPSHOT_FILE).select("repo", "_entry.*")
    return history, files
