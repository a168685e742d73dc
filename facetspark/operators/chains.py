"""Chains: descriptors of ordered sequences and of simple paths in small graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.operators.numbering import numbered


def atom_codes(atoms: DataFrame, bonds: DataFrame, ring: DataFrame | None = None, markers: str = "DBR") -> DataFrame:
    """mol_id, i, code: element, degree digit, bond class and ring class, "_" where a marker is off.

    Bond class: t with a triple bond, w with more than one double bond, d with one, else s. Ring class, by the bonds of
    ring(mol_id, i, j, in_ring): r without chain bonds, s with two ring bonds or more beside some, else c.
    """
    both = bonds.select("mol_id", "i", "order").unionByName(bonds.select("mol_id", F.col("j").alias("i"), "order"))
    per = both.groupBy("mol_id", "i").agg(F.count("*").alias("degree"), F.count_if(F.col("order") == 3).alias("t"), F.count_if(F.col("order") == 2).alias("d"))
    out = atoms.join(per, ["mol_id", "i"], "left").na.fill(0, ["degree", "t", "d"])
    if ring is not None:
        hit = ring.where("in_ring")
        rings = hit.select("mol_id", "i").unionByName(hit.select("mol_id", F.col("j").alias("i"))).groupBy("mol_id", "i").agg(F.count("*").alias("n_ring"))
        out = out.join(rings, ["mol_id", "i"], "left").na.fill(0, ["n_ring"])
    else:
        out = out.withColumn("n_ring", F.lit(0))
    bond = F.when(F.col("t") > 0, "t").when(F.col("d") > 1, "w").when(F.col("d") == 1, "d").otherwise("s")
    rings_ = F.when(F.col("degree") == F.col("n_ring"), "r").when(F.col("n_ring") >= 2, "s").otherwise("c")
    mark = lambda m, c: c if m in markers else F.lit("_")
    return out.select("mol_id", "i", F.concat("elem", mark("D", F.col("degree").cast("string")), mark("B", bond), mark("R", rings_)).alias("code"))


def paths(bonds: DataFrame, length: int) -> DataFrame:
    """mol_id, path: simple paths of length atoms, each in one direction (the lesser end first)."""
    step = bonds.select("mol_id", "i", "j").unionByName(bonds.select("mol_id", F.col("j").alias("i"), F.col("i").alias("j")))
    if length == 1:
        return step.select("mol_id", F.array("i").alias("path")).distinct()
    out = step.select("mol_id", F.array("i", "j").alias("path"), F.col("j").alias("i"))
    for _ in range(length - 2):
        out = out.join(step, ["mol_id", "i"]).where(~F.array_contains("path", F.col("j"))).select("mol_id", F.concat("path", F.array("j")).alias("path"), F.col("j").alias("i"))
    return out.where(F.get("path", F.lit(0)) < F.element_at("path", -1)).select("mol_id", "path")


def path_codes(found: DataFrame, codes: DataFrame) -> DataFrame:
    """mol_id, code of paths: the codes along it, read in whichever direction is lesser."""
    spread = found.withColumn("_id", F.xxhash64("mol_id", "path")).select("mol_id", "path", "_id", F.posexplode("path").alias("k", "i")).join(codes, ["mol_id", "i"])
    joined = spread.groupBy("mol_id", "path").agg(F.sort_array(F.collect_list(F.struct("k", "code"))).alias("own")).withColumn("own", F.transform("own", lambda x: x["code"]))
    return joined.select("mol_id", F.least(F.array_join("own", "-"), F.array_join(F.reverse("own"), "-")).alias("code"))


def windows_of(sequence: DataFrame, order: Sequence[str], item: str, length: int) -> DataFrame:
    """mol_id, chain: every run of length items in order, as an array."""
    w = Window.partitionBy("mol_id").orderBy(*order)
    items = [F.lead(item, k).over(w) for k in range(length)]
    return sequence.select("mol_id", F.array(*items).alias("chain"), F.lead(F.lit(1), length - 1).over(w).alias("_whole")).where("_whole = 1").drop("_whole")


def counts(chains: DataFrame, code: Column) -> DataFrame:
    """mol_id, code, cnt."""
    return chains.groupBy("mol_id", code.alias("code")).agg(F.count("*").alias("cnt"))


def vocabulary(counted: DataFrame) -> DataFrame:
    """code and its number from 1 in ascending order, over the distinct codes."""
    return numbered(counted.select("code").distinct(), ["code"], "n", 1).withColumn("n", F.col("n").cast("int"))


def reverse_dedupe(chains: DataFrame, row: str = "i") -> DataFrame:
    """chains(i, chain) without rows whose reverse stands in a later row."""
    last = chains.groupBy(F.col("chain").alias("_back")).agg(F.max(row).alias("_last"))
    joined = chains.join(last, F.reverse("chain") == F.col("_back"), "left")
    return joined.where(F.col("_last").isNull() | (F.col("_last") <= F.col(row))).drop("_back", "_last")


def first_match(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """wanted(key) with the number (from 1, in the table's sorted order) of its first equal row, 0 if there is none."""
    ranked = numbered(table.select(key), [key], "_n", 1).groupBy(key).agg(F.min("_n").alias("n"))
    return wanted.join(ranked, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


#: Fixed sets of markers that a sweep goes through, and its lengths of chains.
MARKERS = ("", "R", "B", "D", "BR", "DR", "DB", "DBR")
LENGTHS = (2, 3, 4)


def sweep(atoms: DataFrame, bonds: DataFrame, ring: DataFrame | None = None, markers: Sequence[str] = MARKERS, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """markers, length, mol_id, code, cnt: the chain counts of every set of markers with every length.

    Paths are found once for each length, whatever the markers.
    """
    out = None
    for length in lengths:
        found = paths(bonds, length)
        for own in markers:
            one = counts(path_codes(found, atom_codes(atoms, bonds, ring, own)), F.col("code"))
            one = one.select(F.lit(own).alias("markers"), F.lit(length).alias("length"), "mol_id", "code", "cnt")
            out = one if out is None else out.unionByName(one)
    return out
