"""Files that each hold one JSON array, read in parallel ranges.

A file is cut at every closing brace, so ranges of it can be read by many tasks.  Whether a
piece starts inside a string follows from the number of quotes ahead of it, and how deep it starts from the brackets outside strings;
both are sums over the pieces before, within a range and then over ranges.  A piece that comes back to the depth of
the array ends an element, and elements are put together from their pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

_LEAD = r"^[\s,]+"
_TAIL = r"[\s,]+$"


def _before(by: str, *keys: str, own: bool = False) -> WindowSpec:
    """The rows ahead of a row among those of equal ``keys``, and with ``own`` the row itself."""
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def _pieces(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    """``file, block, at, value``: the pieces of files, in the order of block and at."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _sum(column: str, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _scanned(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The pieces with what is known inside their range, once for a range that starts outside a string (0) and once for one that starts inside (1).

    ``odd``: quotes up to the end of the piece; ``d0, d1``: depth after the piece and its brace; ``last``: whether it is the last
    of its range; ``opens``, on the first of a range alone: whether it starts with a bracket.
    """
    bare = F.replace(F.replace("value", F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    count = lambda text, signs: F.length(text) - F.length(F.translate(text, signs, ""))
    # What is counted is counted in the few signs of a piece, ahead of the shuffle.
    pieces = _pieces(spark, path, "}").withColumn("signs", F.regexp_replace(bare, r'[^"\[\]{}]+', ""))
    for start, signs in enumerate((F.col("signs"), F.concat(F.lit('"'), "signs"))):
        pieces = pieces.withColumn(f"_out{start}", F.regexp_replace(signs, '"[^"]*("|$)', ""))
    steps = [(count(F.col(f"_out{start}"), "{[") - count(F.col(f"_out{start}"), "]}")).alias(f"_step{start}") for start in (0, 1)]
    counted = pieces.select("file", "block", "at", "value", count(F.col("signs"), '"').alias("quotes"), *steps)
    upto, place = _before("at", "file", "block", own=True), Window.partitionBy("file", "block").orderBy("at")
    local = counted.select(
        "*",
        F.sum("quotes").over(upto).alias("odd"),
        F.lead("at").over(place).isNull().alias("last"),
        F.when(F.lag("at").over(place).isNull(), F.col("value").rlike(r"^\s*\[")).alias("opens"),
    )
    for start in (0, 1):
        inside = (F.col("odd") - F.col("quotes") + start) % 2 == 1
        step = F.when(inside, F.col("_step1")).otherwise(F.col("_step0")) - F.when(_outside(start), 1).otherwise(0)
        local = local.withColumn(f"_deep{start}", step)
    deep = [F.sum(f"_deep{start}").over(upto).alias(f"d{start}") for start in (0, 1)]
    local.select("file", "block", "at", "value", "odd", *deep, "last", "opens").write.mode("errorifexists").parquet(table)
    return spark.read.parquet(table)


def _outside(start: int | Column) -> Column:
    """Whether the brace after a piece is outside strings, for a range with that start."""
    return (F.col("odd") + start) % 2 == 0


def _ranges(scanned: DataFrame, table: str) -> DataFrame:
    """A row a range: ``start`` and ``depth`` it begins with, ``end``, the last piece of its file if it is there, and the ``kind`` of the file.

    The last piece of a file has no brace after it.
    """
    own = lambda name: F.max(F.when(F.col("last"), F.col(name))).alias(name)
    found = scanned.filter("last OR opens IS NOT NULL").groupBy("file", "block").agg(*[own(c) for c in ("odd", "d0", "d1", "at")], F.max("opens").alias("opens"))
    by_block, whole = _before("block", "file"), Window.partitionBy("file")
    ranges = found.withColumn("start", _sum("odd", by_block) % 2)
    ranges = ranges.withColumn("end", F.when(F.lead("block").over(whole.orderBy("block")).isNull(), F.col("at")))
    unclosed = F.when(F.col("end").isNotNull() & _outside(F.col("start")), 1).otherwise(0)
    ranges = ranges.withColumn("deep", F.when(F.col("start") == 1, F.col("d1")).otherwise(F.col("d0")) + unclosed)
    ranges = ranges.withColumn("depth", _sum("deep", by_block))
    is_array = F.first("opens").over(_before("block", "file", own=True).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    closed = (F.sum("odd").over(whole) % 2 == 0) & (F.sum("deep").over(whole) == 0)
    kind = F.when(~is_array, "other").when(closed, "array").otherwise("broken")
    ranges.select("file", "block", "start", "depth", "end", kind.alias("kind")).write.mode("errorifexists").parquet(table)
    return scanned.sparkSession.read.parquet(table)


def _offsets(marks: DataFrame) -> DataFrame:
    """Ranges with ``offset``, the number of marks in those before, from the number ``n`` of their own."""
    return marks.withColumn("offset", _sum("n", _before("block", "file"))).drop("n")


def _joined(pieces: DataFrame, sign: str, starts: bool = False) -> DataFrame:
    """Elements put together from pieces ``file, block, at, text, mark, offset``: a mark ends one, or with ``starts`` begins one.

    Pieces are joined inside their range first, so that few rows are dealt by element; these are dealt into as many
    partitions as the session shuffles into, since what follows is costly for their bytes.
    """
    local = pieces.withColumn("pos", F.col("offset") + _sum("mark", _before("at", "file", "block", own=starts)))
    put = lambda by: F.array_join(F.sort_array(F.collect_list(F.struct(by, "text")))["text"], sign).alias("text")
    inside = local.groupBy("file", "block", "pos").agg(put("at"))
    dealt = inside.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "pos")
    return dealt.groupBy("file", "pos").agg(put("block"))


def _recovered(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Elements of files with an unclosed string or bracket: each starts at a line with a brace that is indented as little as any."""
    lines = _pieces(spark, path, None).join(files, "file", "left_semi")
    # The bracket of the array may stand on the line of the first element.
    text = F.regexp_replace("value", r"^(\s*)\[(\s*\{)", "$1$2")
    brace = lines.withColumn("text", text).withColumn("indent", F.when(F.col("text").rlike(r"^\s*\{"), F.length(F.regexp_extract("text", r"^\s*", 0))))
    indents = brace.groupBy("file", "block", "indent").agg(F.count("*").alias("_rows"))
    indents = indents.withColumn("least", F.min("indent").over(Window.partitionBy("file")))
    marks = indents.groupBy("file", "block", "least").agg(F.coalesce(F.sum(F.when(F.col("indent") == F.col("least"), F.col("_rows"))), F.lit(0)).alias("n"))
    mark = F.coalesce((F.col("indent") == F.col("least")).cast("long"), F.lit(0)).alias("mark")
    marked = brace.join(_offsets(marks), ["file", "block"]).select("file", "block", "at", "text", mark, "offset")
    joined = _joined(marked, "\n", starts=True).filter("pos > 0 OR NOT text RLIKE '^\\\\s*\\\\[?\\\\s*$'")
    # After the last element the array is closed.
    kept = F.regexp_replace(F.regexp_replace("text", _TAIL, ""), r"\s*\]$", "")
    return joined.select("file", "pos", F.regexp_replace(kept, _TAIL, "").alias("text"))


def elements(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``file, pos, text``: the elements of the arrays in the files at ``path``, by their place; ``table`` is a new folder for the scanned pieces.

    A broken element is one row of its own: as long as its brackets and strings are closed, or else if elements
    start lines of their own (indented or not); in a file of one line everything from an unclosed
    one on is one row.  A file that is no array is one row without text, an empty array none.
    """
    scanned = _scanned(spark, path, f"{table}/pieces")
    ranges = _ranges(scanned, f"{table}/ranges")
    of_kind = lambda kind: ranges.filter(F.col("kind") == kind)
    broken = of_kind("broken").select("file").distinct()
    other = of_kind("other").select("file").distinct().select("file", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"))

    placed = scanned.join(of_kind("array").drop("kind"), ["file", "block"])
    closed = F.col("end").isNull() | (F.col("at") != F.col("end"))
    after = F.col("depth") + F.when(F.col("start") == 1, F.col("d1")).otherwise(F.col("d0"))
    ends = (closed & _outside(F.col("start")) & (after == 1)).cast("long").alias("mark")
    marked = placed.select("file", "block", "at", F.when(closed, F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("text"), ends)
    offsets = _offsets(marked.groupBy("file", "block").agg(F.sum("mark").alias("n")))
    joined = _joined(marked.join(offsets, ["file", "block"]), "")
    text = F.regexp_replace(F.when(F.col("pos") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text")), _LEAD, "")
    # What follows the last object, and other elements than objects.
    rest = joined.select("file", "pos", F.regexp_replace(text, r"^(\s*)\]\s*$", "").alias("text"))
    listed = F.from_json(F.concat(F.lit("["), F.regexp_replace("text", r"\]\s*$", ""), F.lit("]")), "array<string>")
    texts = F.when(F.col("text") == "", F.array().cast("array<string>")).when(F.col("text").startswith("{"), F.array("text")).otherwise(F.coalesce(listed, F.array("text")))
    strict = rest.select("file", "pos", F.explode(texts).alias("text")).unionByName(other)
    return strict if broken.isEmpty() else strict.unionByName(_recovered(spark, path, broken))
