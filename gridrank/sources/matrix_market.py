"""Matrix Market files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrank.operators import coo
from gridrank.schema import FIELDS, LAYOUTS, SYMMETRIES, MatrixInfo


def _is_comment(line: Column) -> Column:
    return F.trim(line).startswith("%") | F.trim(line).startswith("//") | (F.trim(line) == "")


def _head(spark: SparkSession, file) -> Iterator[str]:
    """Lines of a file from its beginning, through the file system that Spark has for its path; only what is asked for is read."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        while (line := lines.readLine()) is not None:
            yield line
    finally:
        stream.close()


def _files(spark: SparkSession, path: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise ValueError(f"{path} has no files")
    out = []
    for status in found:
        if status.isDirectory():
            out += [s.getPath() for s in status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(status.getPath()) if not s.isDirectory() and s.getPath().getName()[0] not in "_."]
        else:
            out.append(status.getPath())
    return out


def _numbered(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.text(file).select("value", F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_block_start").alias("block"))


def header(spark: SparkSession, path: str) -> MatrixInfo:
    """What the banner and the size line say; nothing after them is read."""
    return _header(spark, path)[0]


def _header(spark: SparkSession, path: str) -> tuple[MatrixInfo, str, int]:
    """The matrix, the file that begins with the banner (a matrix may be a folder of parts) and the place of the size line in it."""
    banners = []
    for file in _files(spark, path):
        first = next(_head(spark, file), "")
        if first.lower().startswith("%%matrixmarket"):
            banners.append((file, first.lower().split()))
    if len(banners) != 1:
        raise ValueError(f"{path} has {'no' if not banners else 'more than one'} Matrix Market banner")
    file, banner = banners[0]
    if len(banner) != 5 or banner[1] != "matrix" or banner[2] not in LAYOUTS or banner[3] not in FIELDS or banner[4] not in SYMMETRIES:
        raise ValueError(f"not a Matrix Market banner: {' '.join(banner)}")
    for at, line in enumerate(_head(spark, file)):
        if line.strip() and not line.strip().startswith(("%", "//")):
            break
    else:
        raise ValueError(f"{path} has no size line")
    size = [int(x) for x in line.split()]
    if len(size) != (3 if banner[2] == "coordinate" else 2):
        raise ValueError(f"not a size line: {line}")
    n, m, nnz = size if len(size) == 3 else (*size, size[0] * size[1])
    return MatrixInfo(banner[2], banner[3], banner[4], n, m, nnz), file.toString(), at


def read(spark: SparkSession, path: str, *, values: str = "real", offset: int = -1, transpose: bool = False, expand: bool = True) -> DataFrame:
    """(i, j, v). The size line is skipped by its place, so that entries in the last row stay.

    values='pattern' makes every value 1. Symmetric and skew-symmetric matrices
    are expanded; complex and hermitian ones are rejected. Malformed lines fail.
    """
    info, file, size_line = _header(spark, path)
    if info.field == "complex" or info.symmetry == "hermitian":
        raise ValueError("complex matrices are not supported")
    # The line numbers are those of the file alone; the other parts need none.
    # The file's first block begins a partition, so there the lower bits count lines.
    head = (F.col("block") == 0) & (F.col("line").bitwiseAND((1 << 33) - 1) == size_line)
    lines = _numbered(spark, file).where(~head).select("value", "line")
    parts = spark.read.text(path).where(F.element_at(F.split("_metadata.file_path", "/"), -1) != file.rsplit("/", 1)[-1]).select("value", F.lit(None).cast("bigint").alias("line"))
    rows = lines.unionByName(parts).where(~_is_comment(F.col("value")))
    token = F.split(F.trim("value"), r"\s+")
    if info.layout == "array":
        return _array(rows, info, token, transpose, expand)
    value = F.lit(1.0) if values == "pattern" or info.field == "pattern" else token[2].cast("double")
    entries = rows.select((token[0].cast("bigint") + offset).alias("i"), (token[1].cast("bigint") + offset).alias("j"), value.alias("v"))
    # Indices of files begin at 1.
    inside = F.col("i").between(1 + offset, info.n + offset) & F.col("j").between(1 + offset, info.m + offset)
    entries = entries.select(F.when(inside, F.col("i")).otherwise(F.raise_error(F.lit("index beyond the matrix")).cast("bigint")).alias("i"), "j", "v")
    if expand:
        entries = coo.symmetrize(entries, info.symmetry)
    return coo.transpose(entries) if transpose else entries


def _array(rows: DataFrame, info: MatrixInfo, token: Column, transpose: bool, expand: bool) -> DataFrame:
    """Dense columns one after another, of lower triangles if symmetric. Positions follow line order, so this layout is read from one file."""
    from pyspark.sql import Window

    # Lines of a partition are counted where they are; only the counts of partitions are added up in one place.
    own = rows.where("line is not null").select(token[0].cast("double").alias("v"), "line", F.shiftright("line", 33).alias("part"))
    inside = own.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("line")) - 1)
    before = own.groupBy("part").count().select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = inside.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("pos", F.col("k") + F.col("before"))
    n = info.n
    if info.symmetry == "general":
        found = placed.select((F.col("pos") % n).alias("i"), F.floor(F.col("pos") / n).alias("j"), "v")
    else:
        # Column j of the lower triangle begins at j (2 h - j + 1) / 2, where h rows are stored of the first one; roots of doubles are put right by one column.
        shift = 1 if info.symmetry == "skew-symmetric" else 0
        h = n - shift
        begin = lambda j: (j * (2 * h + 1 - j) / 2).cast("bigint")
        near = F.floor((2 * h + 1 - F.sqrt(F.lit(float((2 * h + 1) ** 2)) - 8.0 * F.col("pos"))) / 2)
        column = F.when(begin(near) > F.col("pos"), near - 1).when(begin(near + 1) <= F.col("pos"), near + 1).otherwise(near)
        found = placed.withColumn("j", column.cast("bigint"))
        found = found.select((F.col("pos") - begin(F.col("j")) + F.col("j") + shift).alias("i"), "j", "v")
        if expand:
            found = coo.symmetrize(found, info.symmetry)
    found = found.where("v <> 0")
    return coo.transpose(found) if transpose else found


def write(matrix: DataFrame, path: str, n: int, m: int, *, symmetry: str = "general", comment: str = "written by gridrank", single_file: bool = False) -> None:
    """A folder of text parts whose concatenation by name is a Matrix Market file with 1-based entries by column, then row."""
    entries = matrix if symmetry == "general" else matrix.where("i >= j" if symmetry != "skew-symmetric" else "i > j")
    nnz = entries.count()
    spark = matrix.sparkSession
    head = spark.createDataFrame([(-1, 0, f"%%MatrixMarket matrix coordinate real {symmetry}"), (-1, 1, f"% {comment}"), (-1, 2, f"{n} {m} {nnz}")], "j bigint, i bigint, line string")
    body = entries.select("j", "i", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("line"))
    lines = head.unionByName(body).orderBy("j", "i").select("line")
    (lines.coalesce(1) if single_file else lines).write.text(path)


def detect_symmetry(matrix: DataFrame) -> str:
    """symmetric, skew-symmetric or general, by one join of the matrix with its mirror."""
    a, b = coo.canonical(matrix), coo.transpose(coo.canonical(matrix))
    both = a.alias("a").join(b.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")), "full")
    same = F.coalesce(F.col("a.v") == F.col("b.v"), F.lit(False))
    skew = F.coalesce(F.col("a.v") == -F.col("b.v"), F.lit(False))
    found = both.agg(F.coalesce(F.bool_and(same), F.lit(True)), F.coalesce(F.bool_and(skew), F.lit(False))).first()
    return "symmetric" if found[0] else "skew-symmetric" if found[1] else "general"
