"""Readers and writers of the text formats: surfaces, typed rows, matrices, MOL blocks, SDF tags, named intervals.

Files are read whole by Spark, one file to a task's row at a time, so that paths may lie in any store that it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetspark.operators.numbering import numbered

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: Fixed endings of the files of a set of objects, and the stage table that stands for each.
STAGES = {
    "wrl": "surface", "tr": "triangles", "ch": "charges", "wdv": "radii", "sgm": "segments", "tps": "types", "tps_lev": "types_levels",
    "dbl": "values", "dbl_lev": "values_levels", "sng": "points", "sngnmt": "point_types", "sngnml": "point_labels",
    "sngnmt_lev": "point_types_levels", "sngnml_lev": "point_labels_levels", "hist": "histogram",
    "prs": "pairs", "prs_lev": "pairs_levels", "trps": "triples", "pmd": "pair_matrix", "pmd_lev": "pair_matrix_levels",
    "tmd": "triple_matrix", "tmd_lev": "triple_matrix_levels", "pkr": "pair_kernels", "tkr": "triple_kernels",
    "lbs": "labels", "clbs": "counted_labels", "props": "properties", "qlt": "quality",
}


def numbers(line: Column) -> Column:
    """All numbers of a line, whatever stands between them, as doubles."""
    return F.transform(F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.try_cast("double"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, mol_id (the number before the ending), i, line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    split = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    return split.withColumn("mol_id", F.regexp_extract("file", r"(\d+)\.[^./]+$", 1).try_cast("long"))


def section(all_lines: DataFrame, marker: str, start: str, width: int = 3) -> DataFrame:
    """mol_id, n, values: the rows of numbers after a line with start, itself after one with marker, up to the first line
    with fewer than width numbers."""
    file = Window.partitionBy("file").orderBy("i")
    seen = all_lines.withColumn("_m", F.max(F.col("line").contains(marker)).over(file)).withColumn("_s", F.max(F.col("_m") & F.col("line").contains(start)).over(file))
    after = seen.where(F.col("_s")).withColumn("_k", F.row_number().over(file) - 2).withColumn("values", numbers(F.col("line")))
    bad = F.min(F.when((F.col("_k") >= 0) & (F.size("values") < width), F.col("_k"))).over(Window.partitionBy("file"))
    rows = after.withColumn("_end", bad).where((F.col("_k") >= 0) & (F.col("_end").isNull() | (F.col("_k") < F.col("_end"))))
    return rows.select("mol_id", F.col("_k").alias("n"), F.slice("values", 1, width).alias("values"))


def read_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(mol_id, v, x, y, z, nx, ny, nz) and triangles(mol_id, t, a, b, c) of VRML files."""
    all_lines = lines(spark, path)
    part = lambda m, s, names: section(all_lines, m, s).select("mol_id", F.col("n").alias("v"), *[F.get("values", F.lit(k)).alias(x) for k, x in enumerate(names)])
    vertices = part("Triangle", "point", "xyz").join(part("# Normal definition", "vector", ("nx", "ny", "nz")), ["mol_id", "v"], "left")
    faces = part("IndexedFaceSet", "coordIndex", "abc")
    return vertices, faces.select("mol_id", F.col("v").alias("t"), *[F.col(c).cast("int").alias(c) for c in "abc"])


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """mol_id, n and the columns of schema ("x double, ...") from typed rows "a b c ;", up to each file's first bad row."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    plain = lines(spark, path).where(F.length(F.trim("line")) > 0).withColumn("parts", F.array_remove(F.split(F.regexp_replace("line", r"[\[\](){},;\s]+", " "), " "), ""))
    typed = plain.select("file", "mol_id", "i", F.size("parts").alias("_n"), *[F.get("parts", F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(fields)])
    whole = (F.col("_n") == len(fields)) & F.expr(" and ".join(f"`{n}` is not null" for n, _ in fields))
    first_bad = F.min(F.when(~whole, F.col("i"))).over(Window.partitionBy("file"))
    good = typed.withColumn("_bad", first_bad).where(F.col("_bad").isNull() | (F.col("i") < F.col("_bad")))
    return good.select("mol_id", (F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1).alias("n"), *[n for n, _ in fields])


def write_rows(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """Typed rows "a b c ;", one folder for each mol_id."""
    text = df.select("mol_id", *order, F.concat_ws(" ", *[F.col(c).cast("string") for c in columns], F.lit(";")).alias("value"))
    text.repartition("mol_id").sortWithinPartitions("mol_id", *order).select("mol_id", "value").write.partitionBy("mol_id").text(path)


def read_matrix(spark: SparkSession, path: str, drop_last: bool = False) -> DataFrame:
    """mol_id (row), type (column), cnt of a dense text matrix whose width is its first row's; ragged rows are refused."""
    rows = lines(spark, path).where(F.length(F.trim("line")) > 0).select("i", F.array_remove(F.split(F.trim("line"), r"\s+"), "").alias("parts"))
    widths = rows.agg(F.min(F.size("parts")), F.max(F.size("parts"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"rows of {widths[0]} to {widths[1]} columns")
    if drop_last:
        rows = rows.withColumn("parts", F.expr("slice(parts, 1, size(parts) - 1)"))
    return rows.select(F.col("i").cast("long").alias("mol_id"), F.posexplode("parts").alias("type", "cell")).select("mol_id", "type", F.col("cell").cast("double").alias("cnt"))


def write_matrix(md: DataFrame, path: str, types: Sequence[int]) -> None:
    """A line of blank-separated counts (and a trailing blank) for each object, in the order of mol_id."""
    wide = md.groupBy("mol_id").pivot("type", list(types)).agg(F.first("cnt")).na.fill(0).orderBy("mol_id")
    wide.select(F.concat(F.concat_ws(" ", *[F.col(f"`{t}`").cast("string") for t in types]), F.lit(" ")).alias("value")).write.text(path)


def count_objects(spark: SparkSession, path: str) -> int:
    """How many numbered files there are without a gap from 0."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).try_cast("long").alias("n")).where("n is not null").distinct()
    return numbered(files, ["n"], "k").where("n = k").count()


def read_mol(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """atoms(mol_id, i, x, y, z, elem) and bonds(mol_id, i, j, order), from 1, of MOL files: fixed-width fields."""
    every = lines(spark, path)
    header = every.where("i = 3").select("file", F.trim(F.substring("line", 1, 3)).cast("int").alias("n_atoms"), F.trim(F.substring("line", 4, 3)).cast("int").alias("n_bonds"))
    body = every.join(header, "file").withColumn("k", F.col("i") - 3)
    field = lambda a, n: F.trim(F.substring("line", a, n))
    atoms = body.where(F.col("k").between(1, F.col("n_atoms"))).select("mol_id", F.col("k").alias("i"), *[field(1 + 10 * j, 10).cast("double").alias(c) for j, c in enumerate("xyz")], field(32, 3).alias("elem"))
    bonds = body.where((F.col("k") > F.col("n_atoms")) & (F.col("k") <= F.col("n_atoms") + F.col("n_bonds"))).select("mol_id", *[field(1 + 3 * j, 3).cast("int").alias(c) for j, c in enumerate(("i", "j", "order"))])
    return atoms, bonds


def tag_values(all_lines: DataFrame, tag: str, value: str = "line") -> DataFrame:
    """file, n, value: the number on the line after each line that holds tag, in order."""
    after = F.lead(value).over(Window.partitionBy("file").orderBy("i"))
    found = all_lines.withColumn("_next", after).where(F.col("line").contains(tag))
    return found.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1).alias("n"), F.get(numbers(F.col("_next")), F.lit(0)).alias("value"))


def tag_classes(all_lines: DataFrame, active: str, inactive: str) -> DataFrame:
    """file, n, y: 1 or -1 by which of two tags a line holds."""
    y = F.when(F.col("line").contains(active), 1).when(F.col("line").contains(inactive), -1)
    hit = all_lines.withColumn("y", y).where("y is not null")
    return hit.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1).alias("n"), "y")


def threshold_classes(values: DataFrame, threshold: float) -> DataFrame:
    return values.withColumn("y", F.when(F.col("value") < threshold, -1).otherwise(1))


def write_libsvm(md: DataFrame, labels: DataFrame, path: str) -> None:
    """Lines "label index:value ...", indices from 1 in ascending order, of md(mol_id, type from 0, cnt) and integer labels."""
    cells = md.where("cnt <> 0").select("mol_id", F.struct(F.col("type"), F.concat_ws(":", (F.col("type") + 1).cast("string"), F.col("cnt").cast("string")).alias("cell")).alias("x"))
    rows = cells.groupBy("mol_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["cell"]).alias("cells"))
    text = labels.select("mol_id", F.col("y").cast("int").cast("string").alias("y")).join(rows, "mol_id", "left")
    text.select(F.concat_ws(" ", "y", F.array_join("cells", " ")).alias("value")).write.text(path)


def connections(bonds: DataFrame) -> DataFrame:
    """The symmetric connection table (mol_id, i, j, order) of bonds given once."""
    return bonds.select("mol_id", "i", "j", "order").unionByName(bonds.select("mol_id", F.col("j").alias("i"), F.col("i").alias("j"), "order"))


def surface_with_property(triangles: DataFrame, values: DataFrame) -> DataFrame:
    """Triangles with each corner's value as value_a, value_b and value_c."""
    out = triangles
    for corner in "abc":
        out = out.join(values.select("mol_id", F.col("v").alias(corner), F.col("value").alias(f"value_{corner}")), ["mol_id", corner], "left")
    return out


def stage_table(spark: SparkSession, path: str, name: str, make, reload: bool = False) -> DataFrame:
    """The stage's table: read from path if it is to be reloaded, else made, written there by object and read back."""
    at = f"{path}/{STAGES.get(name, name)}"
    if not reload:
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_predictions(predictions: DataFrame, path: str, run: str) -> None:
    """Appends mol_id, activity of a run to the table of predictions."""
    predictions.select("mol_id", "activity", F.lit(run).alias("run")).write.mode("append").parquet(path)
