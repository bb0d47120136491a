"""Run parameters held in file and folder names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trees import number_text

# The name formats of the input files.
SPECIES_TREE = r"t_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)"
RUN_NAME = r"(t_\d.*)_(WAG|LG)_[PROTCA]*(LG|WAG)[+G]*[._](ds\d+\.)?"
SITE_RUN_NAME = r"(t_\d.*)_(WAG|LG)[._](?:ds(\d+))?"
BLOCK_FOLDER = r"(\d+)bp_b(\d+)_g(\d+)"
LENGTH_FOLDER = r"(\d+)bp"
GENE_TREE_NAME = r"(.*)_(\d+)\.([WAGL+FTR]+)\.treefile$"
FRACTION_FOLDER = r"^g(\d+)_l(\d+)_f([\d.]+)_(?!b)"
BLOCKS_FOLDER = r"^g(\d+)_l(\d+)_f0+.5_b([\d.]+)_"


def _part(column, pattern: str, group: int) -> Column:
    text = F.regexp_extract(column, pattern, group)
    return F.when(text != "", text)


def base_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def file_name(path) -> Column:
    """Name of a file; of one part of a file kept as a folder (``key=name`` or ``name``), the folder's."""
    folder = F.url_decode(F.regexp_replace(folder_name(path), "^[^=]*=", ""))
    return F.when(base_name(path).startswith("part-"), folder).otherwise(base_name(path))


def species_tree(df: DataFrame, name: str) -> DataFrame:
    """Branch lengths and canonical text of the species tree named ``t_<ta>_<tb>_<tc>``."""
    ta, tb, tc = (_part(name, SPECIES_TREE, i).cast("double") for i in (1, 2, 3))
    df = df.withColumns({
        "ta": ta, "tb": tb, "tc": tc, "ibl": tb - ta, "outgroup_bl": tc - tb})
    half = (F.col("tc") + F.col("outgroup_bl")) / 2
    text = F.concat(
        F.lit("(4:"), number_text(half), F.lit(",(3:"), number_text(F.col("tb")),
        F.lit(",(1:"), number_text(F.col("ta")), F.lit(",2:"), number_text(F.col("ta")),
        F.lit("):"), number_text(F.col("ibl")), F.lit("):"), number_text(half), F.lit(");"),
    )
    return df.withColumn("newick", text)


def run_parameters(df: DataFrame, name: str) -> DataFrame:
    """Species tree, both models and the 0-based data set (NULL when the name has none)."""
    ds = F.regexp_extract(F.regexp_extract(name, RUN_NAME, 4), r"(\d+)", 1)
    return df.withColumns({
        "stree": _part(name, RUN_NAME, 1), "sim_model": _part(name, RUN_NAME, 2),
        "infer_model": _part(name, RUN_NAME, 3),
        "ds_no": F.when(ds != "", ds).cast("int") - 1,
    })


def site_run_parameters(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns({
        "stree": _part(name, SITE_RUN_NAME, 1), "sim_model": _part(name, SITE_RUN_NAME, 2),
        "ds_no": _part(name, SITE_RUN_NAME, 3).cast("int") - 1,
    })


def data_set(df: DataFrame, folder: str) -> DataFrame:
    """Table a folder belongs to, its sequence length, blocks and genes."""
    f = F.col(folder)
    fixed = f.contains("hetero") | f.contains("1_rate")
    blocked = f.contains("bp_b")
    return df.withColumns({
        "dataset": F.when(f.contains("hetero"), "heterotachy").when(f.contains("1_rate"), "one_rate")
        .when(blocked, "rec").otherwise("nonrec"),
        "seq_length": F.when(fixed, F.lit(500)).otherwise(
            _part(folder, LENGTH_FOLDER, 1).cast("int")),
        "nblocks": F.when(blocked & ~fixed, _part(folder, BLOCK_FOLDER, 2).cast("int"))
        .otherwise(F.lit(1)),
        "ngenes": F.when(blocked & ~fixed, _part(folder, BLOCK_FOLDER, 3).cast("int")),
    })


def gene_parameters(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns({
        "prefix": _part(name, GENE_TREE_NAME, 1), "gene": _part(name, GENE_TREE_NAME, 2),
        "infer_model": _part(name, GENE_TREE_NAME, 3),
    })


def recombination_parameters(df: DataFrame, folder: str, kind: str = "Fraction") -> DataFrame:
    """Genes, length and the fraction or block count of a prediction folder; others drop out."""
    rx = {"Fraction": FRACTION_FOLDER, "Blocks": BLOCKS_FOLDER}[kind]
    return df.where(F.col(folder).rlike(rx)).withColumns({
        "Genes": F.regexp_extract(folder, rx, 1).cast("int"),
        "Length": F.regexp_extract(folder, rx, 2).cast("int"),
        kind: F.regexp_extract(folder, rx, 3).cast("double" if kind == "Fraction" else "int"),
    })


def clade(name) -> Column:
    """Clade part of ``Clade@Species`` or ``Clade_Species``."""
    return F.split(name, "[@_]")[0]


def clade_number(name, clades) -> Column:
    """1-based number of the clade a taxon name starts with, '0' for any other."""
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit("0")
    for i, c in reversed(list(enumerate(clades, 1))):
        out = F.when(name.startswith(c), F.lit(str(i))).otherwise(out)
    return out
