"""Test inputs in foreign formats, derived from the test tables by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import snapshot_json


def write_tree(source_files: DataFrame, root: str) -> None:
    """Write every row as a file below ``root``; each task writes its own rows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = f"{base}/{path}"
                target.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with target.open_output_stream(name) as stream:
                    stream.write(content.encode("utf-8"))
            yield pd.DataFrame({"written": [len(batch)]})

    full = F.concat_ws("/", "repo", "commit_hash", "path").alias("path")
    source_files.select(full, "content").mapInPandas(write, "written long").agg(F.sum("written")).collect()


#: Rows of one arriving file, about.
FILE_ROWS = 4_000_000


def write_in_files(rows: DataFrame, folder: str, batches: int) -> int:
    """Rows dealt in turn to Parquet files, whatever commit they belong to: one for each of so many batches, several
    where a table is large, so that no task writes more than some FILE_ROWS.  Gives the files of a batch."""
    each = max(1, -(-rows.count() // (batches * FILE_ROWS)))
    rows.repartition(each * batches).write.parquet(folder)
    return each


def write_function_csv(functions: DataFrame, folder: str, root: str) -> None:
    """Function metrics as CSV text; every seventh line has a broken number, every eleventh too few fields."""
    n = F.col("nloc")
    path = F.concat(F.lit(f"{root}/"), F.col("path"))
    ccn = F.when(n % 7 == 0, "n/a").otherwise(F.col("ccn").cast("string"))
    start = F.concat_ws(",", n.cast("string"), ccn, F.lit("40"), F.lit("2"), n.cast("string"))
    line = F.when(n % 11 == 0, start).otherwise(
        F.concat(start, F.lit(',"f@1-9@x, y","'), path, F.lit('","f","f(a, b)",1,9'))
    )
    functions.select(line.alias("value")).write.text(folder)


def file_documents(files: DataFrame) -> DataFrame:
    """One snapshot document per file row, with gaps that the reader has to fill.

    No summary where SLOC divides by 5, no coupling where it divides by 3, no
    kind where it divides by 4, no history where it divides by 7.
    """
    sloc = F.col("sloc")
    summary = F.when(
        sloc % 5 != 0, F.struct(F.col("cc").alias("entropy"), F.lit(1).alias("files"), sloc.alias("sloc"))
    )
    entry = F.struct(
        F.col("commit_hash").alias("hash"),
        F.concat(F.col("commit_hash"), F.lit("-01")).alias("date"),
        F.col("mi").alias("entropy"),
        F.lit(1).alias("files"),
        sloc.alias("sloc"),
    )
    file = F.struct(
        "path",
        "language",
        "sloc",
        F.col("cc").alias("cyclomaticComplexity"),
        F.col("mi").alias("maintainabilityIndex"),
        F.col("smells_high").alias("smellsHigh"),
        F.col("smells_medium").alias("smellsMedium"),
        F.col("smells_low").alias("smellsLow"),
        F.when(sloc % 3 != 0, F.col("coupling")).alias("couplingProxy"),
        F.when(sloc % 4 != 0, F.col("kind")).alias("kind"),
    )
    document = F.struct(
        F.lit("2024-01-01").alias("generated"),
        F.lit(1).alias("commitCount"),
        summary.alias("summary"),
        F.when(sloc % 7 != 0, F.array(entry)).alias("history"),
        F.array(file).alias("latestFiles"),
    )
    name = F.concat_ws("/", "repo", "commit_hash", "path")
    return files.select(name.alias("document"), F.to_json(document).alias("json"))


def year_documents(past: DataFrame) -> DataFrame:
    """One snapshot document per repository and year, with an entry for each commit of the year.

    No summary where the year divides by 5, no hash of an entry where its SLOC divides by 3, no date where it divides
    by 4, no score where it divides by 5.
    """
    sloc = F.col("total_sloc")
    entry = F.struct(
        F.when(sloc % 3 != 0, F.col("commit_hash")).alias("hash"),
        F.when(sloc % 4 != 0, F.concat("commit_hash", F.lit("-01"))).alias("date"),
        F.when(sloc % 5 != 0, F.col("entropy")).alias("entropy"),
        F.col("total_files").alias("files"),
        sloc.alias("sloc"),
    )
    dated = F.struct("commit_hash", entry.alias("entry"))
    year = F.substring("commit_hash", 1, 4)
    years = past.groupBy(F.concat_ws("_", "repo", year).alias("document"), year.cast("int").alias("year")).agg(
        F.transform(F.array_sort(F.collect_list(dated)), lambda e: e["entry"]).alias("history"),
        F.max("entropy").alias("entropy"),
        F.sum("total_files").alias("files"),
        F.sum("total_sloc").alias("sloc"),
    )
    summary = F.when(F.col("year") % 5 != 0, F.struct("entropy", "files", "sloc"))
    document = F.struct(
        F.lit("2024-01-01").alias("generated"),
        F.size("history").alias("commitCount"),
        summary.alias("summary"),
        "history",
        F.array().cast("array<string>").alias("latestFiles"),
    )
    return years.select("document", F.to_json(document).alias("json"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Each document as a file of its own, in a folder of its name."""
    documents.repartition("document").select("document", F.col("json").alias("value")).write.partitionBy("document").text(folder)


def document_rows(snapshots: DataFrame) -> DataFrame:
    """Summary and all history entries of documents read from files, as rows of one shape."""
    name = F.url_decode(F.regexp_extract("document", "document=([^/]*)/", 1))
    named = snapshots.withColumn("document", name)
    summary = snapshot_json.snapshot_summary(named).select(
        "document",
        F.when(F.col("has_summary"), "summary").otherwise("no summary").alias("section"),
        F.col("commits").cast("long").alias("position"), F.lit("").alias("name"), F.lit("").alias("date"),
        "entropy", "files", "sloc",
    )
    entries = snapshot_json.snapshot_history(named).select(
        "document", F.lit("history").alias("section"), F.col("position").cast("long"), F.col("commit_hash").alias("name"),
        "date", "entropy", F.col("total_files").alias("files"), F.col("total_sloc").alias("sloc"),
    )
    return summary.unionByName(entries)


def flatten_documents(summary: DataFrame) -> DataFrame:
    """Summary and first history entry of each document side by side."""
    entry = F.get("s.history", F.lit(0))
    return summary.select(
        "document", "commits", "has_summary", "entropy", "files", "sloc",
        F.coalesce(entry["hash"], F.lit("")).alias("first_hash"),
        F.coalesce(entry["entropy"], F.lit(0.0)).alias("first_entropy"),
    )


def brand_pattern_files(part: DataFrame) -> DataFrame:
    """One exclusion file per brand: it names an extension and a word by the brand's number."""
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    content = F.concat(
        F.lit("# skip\n\n  *"),
        F.element_at(F.array(F.lit(".cs"), F.lit(".py"), F.lit(".md")), number % 3 + 1),
        F.lit("\r\n"),
        F.element_at(F.array(F.lit("red*"), F.lit("tools"), F.lit(".tsx"), F.lit("a+b")), number % 4 + 1),
        F.lit("\nwrong/pattern\n"),
    )
    return part.select(F.col("p_brand").alias("repo"), content.alias("content")).distinct()

