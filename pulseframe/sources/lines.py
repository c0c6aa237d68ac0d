"""Lines of text files with dense numbers, and CSV cells by each file's own header.

Spark doesn't keep the place of a line across the pieces of a split file, but it reads a piece in order. So one pass counts
the lines of every piece, and running sums over pieces, a small row each, number all lines of a file and of all files of a
subject: no window holds a file's lines, and no header comes to the driver. A file's header travels with its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.functions import labels
from pulseframe.sources.tables import settled

GLOB = r"\{}[]*?"
#: Pieces are broadcast to the lines up to so many pieces and characters of headers; beyond, both are shuffled.
BROADCAST_PIECES, BROADCAST_CHARS = 50_000, 1 << 24


def literal(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Paths as Spark's readers want them: of those that exist as they are, characters of patterns are escaped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def one(path: str) -> str:
        if not set(GLOB) & set(path):
            return path
        target = jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(conf).exists(target):
            return path
        return "".join("\\" + c if c in GLOB else c for c in path)

    return [one(p) for p in ([paths] if isinstance(paths, str) else paths)]


def plain_path(encoded: Column) -> Column:
    """A file's path without the percent signs that stand for other characters in Spark's metadata."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, piece (where it begins in the file), id (rises by one with the lines of a piece), value."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"), "value")


def _pieces(lines: DataFrame) -> DataFrame:
    """Of each piece: its first id, the ids of its blank lines, the lines before it in its file and, headers aside, in its
    subject's files in order of their names; and the file's header."""
    blank = F.trim("value") == ""
    counts = lines.groupBy("file", "piece").agg(
        F.min("id").alias("first_id"), F.array_sort(F.collect_list(F.when(blank, F.col("id")))).alias("blanks"), F.count_if(~blank).alias("n"), F.min_by(F.when(~blank, F.col("value")), F.when(~blank, F.col("id"))).alias("start"),
    )
    counts = counts.withColumn("subject", F.upper(labels.path_subject(plain_path(F.col("file")))))
    in_file, in_subject = Window.partitionBy("file").orderBy("piece"), Window.partitionBy("subject").orderBy("file", "piece")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(earlier(in_file)), F.lit(0)), "header": F.first("start", ignorenulls=True).over(whole)})
    data = counts.withColumn("rows", F.col("n") - F.when((F.col("before") == 0) & (F.col("n") > 0), 1).otherwise(0))
    data = data.withColumn("seq_before", F.coalesce(F.sum("rows").over(earlier(in_subject)), F.lit(0)))
    return data.select("file", "piece", "first_id", "blanks", "before", "seq_before", "header", "subject")


def csv_cells(spark: SparkSession, paths: str | list[str], columns: dict[str, str | int]) -> DataFrame:
    """CSV files with a header (a byte-order mark aside) -> the columns asked for, as text, with file, subject, row (from 0 in
    the file) and seq (from 0 over the subject's files in order of their names).

    A column is asked for by its name in the header, wherever it stands in a file, or by its place, -1 for the header's
    last. What a file or a line lacks, and empty cells, are null. Blank lines don't count. Files without a line have no row.
    A cell ends with its line, quoted or not."""
    lines = _read(spark, literal(spark, paths))
    pieces = settled(_pieces(lines), "pieces")
    size = pieces.agg(F.count("*").alias("n"), F.sum(F.length("header")).alias("chars"), F.max(F.size(F.split("header", ","))).alias("width")).first()
    width = max(size.width or 1, 1 + max((c for c in columns.values() if isinstance(c, int)), default=0))
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda parsed: F.array(*[F.col(f"{parsed}.c{i}") for i in range(width)])
    known = pieces.withColumn("parsed", F.from_csv(F.ltrim(F.col("header"), F.lit("\ufeff")), F.lit(schema)))
    known = known.withColumn("names", F.transform(cells("parsed"), lambda c: F.trim(c))).drop("header", "parsed")
    small = size.n <= BROADCAST_PIECES and (size.chars or 0) <= BROADCAST_CHARS
    met = lines.where(F.trim("value") != "").join(F.broadcast(known) if small else known, ["file", "piece"], "left")
    # pieces that the counts don't know would be lost lines
    first = F.coalesce("first_id", F.raise_error(F.lit("files were split otherwise when they were counted")).cast("long"))
    place = F.col("id") - first - F.size(F.filter("blanks", lambda b: b < F.col("id"))) + F.col("before")
    row = F.when(F.col("before") == 0, F.col("seq_before") + (place - 1)).otherwise(F.col("seq_before") + (place - F.col("before")))
    data = met.withColumns({"line": place, "seq": row}).where("line > 0").withColumn("parsed", F.from_csv("value", F.lit(schema)))
    data = data.withColumn("cells", cells("parsed"))
    last = F.lit(width) - F.array_position(F.transform(F.reverse("names"), lambda c: c.isNotNull()), True)

    def cell(asked: str | int) -> Column:
        at = F.array_position("names", asked) - 1 if isinstance(asked, str) else F.lit(asked) if asked >= 0 else last
        return F.when(at >= 0, F.get("cells", at.cast("int")))

    found = [cell(asked).alias(name) for name, asked in columns.items()]
    return data.select(*found, plain_path(F.col("file")).alias("file"), "subject", (F.col("line") - 1).alias("row"), "seq")
