"""Column catalogue: one row per (table, column) with its repeated-name group, role and data checks.

Names are metadata, so the catalogue is small however large the tables are; the counts joined to it
come from one pass over each table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulake.functions.numeric import is_infinite, is_missing
from emulake.operators.scale import WIDE
from emulake.spec import DatasetSpec

# Name prefixes that decide roles when nothing else does.
OUTPUT_PREFIXES = ("y", "out", "output", "target", "gamma", "beta", "profile", "stability", "growth")
INPUT_PREFIXES = ("x", "inp", "input", "feature", "eq", "geom", "basis")
PROFILE_PREFIXES = ("gamma", "profile", "mode", "fourier", "harmonic", "spectrum", "psi", "rho")
# Numbered-name forms, tried in this order.
NUMBERED = (r"^(.+?)[\-_](\d+)$", r"^(.+?)\[(\d+)\]$", r"^(.+?)(\d+)$")
NUMBERED_OLD = (r"^(.+?)_(\d+)_?$", r"^(.+?)(\d+)$")

NAMES = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()), T.StructField("ord", T.LongType()),
])


def names_frame(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString(), i) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, NAMES)


def _starts(name: Column, prefixes: Sequence[str]) -> Column:
    return F.lower(name).rlike("^(" + "|".join(prefixes) + ")")


def _numbered(name: Column, forms: Sequence[str], group: int) -> Column:
    out = F.lit(None).cast("string")
    for form in reversed(forms):
        out = F.when(name.rlike(form), F.regexp_extract(name, form, group)).otherwise(out)
    return out


def with_groups(names: DataFrame, forms: Sequence[str] = NUMBERED) -> DataFrame:
    """Add ``base``, ``pos`` and ``n_group``; a single numbered name is not a group."""
    c = F.col("column")
    parts = names.withColumn("base", _numbered(c, forms, 1)).withColumn("pos", _numbered(c, forms, 2).cast("bigint"))
    size = F.count(F.lit(1)).over(Window.partitionBy("table", "base"))
    sized = parts.withColumn("n_group", F.when(F.col("base").isNotNull(), size).otherwise(F.lit(0)))
    grouped = F.col("n_group") > 1
    return sized.withColumns({
        "base": F.when(grouped, F.col("base")), "pos": F.when(grouped, F.col("pos")),
        "n_group": F.when(grouped, F.col("n_group")).otherwise(F.lit(0)),
    })


def _listed(name: Column, values: Sequence[str]) -> Column:
    return name.isin(*values) if values else F.lit(False)


def infer_roles(names: DataFrame, metadata: Mapping | None = None, hints: Mapping | None = None) -> DataFrame:
    """Add ``role``: listed names, then listed groups, then numbered groups, then single-name prefixes.

    A name that qualifies as both is an output; a name nothing applies to is an input.
    """
    given_in, given_out = [], []
    for source in (metadata or {}, hints or {}):
        given_in += list(source.get("inputs", []))
        given_out += list(source.get("outputs", []))
        for kind in ("output_groups", "profile_groups"):
            for members in source.get(kind, {}).values():
                given_out += list(members)
    g = with_groups(names)
    bases = g.where("base IS NOT NULL").select("table", F.col("base").alias("column")).distinct()
    g = g.join(bases.withColumn("is_base", F.lit(True)), ["table", "column"], "left")
    c, base = F.col("column"), F.col("base")
    out_base = F.coalesce(_starts(base, OUTPUT_PREFIXES) & ~_starts(base, INPUT_PREFIXES), F.lit(False))
    in_base = F.coalesce(_starts(base, INPUT_PREFIXES), F.lit(False))
    role = (
        F.when(_listed(c, given_out) | out_base, "output")
        .when(_listed(c, given_in) | in_base, "input")
        .when(_starts(c, OUTPUT_PREFIXES), "output")
        .when(_starts(c, INPUT_PREFIXES), "input")
        .when(F.col("is_base"), "output")
        .otherwise("input")
    )
    profile = F.when(out_base & _starts(base, PROFILE_PREFIXES), base)
    return g.withColumns({"role": role, "output_group": F.when(out_base, base), "profile_group": profile}).drop("is_base")


def infer_roles_by_repetition(names: DataFrame) -> DataFrame:
    """Older rule: members of any numbered group are outputs, everything else is an input."""
    g = with_groups(names, NUMBERED_OLD)
    return g.withColumn("role", F.when(F.col("n_group") > 1, "output").otherwise("input"))


def case_roles(names: DataFrame) -> DataFrame:
    """Roles for tables made from nested case records, by their fixed column names."""
    c = F.col("column")
    is_in = (
        (c.startswith("eq_") & (c != "eq_id")) | c.startswith("input_") | c.startswith("eigenmode_amp_")
        | c.isin("q0", "q95", "qmin", "p0")
    )
    return names.withColumn("role", F.when(is_in, "input").when(c.startswith("output_p_"), "output"))


def cell_counts(df: DataFrame, label: str) -> DataFrame:
    """(table, column, n_rows, n_missing, n_inf) in one pass."""
    fields = df.schema.fields
    floats = {f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def miss(name: str) -> Column:
        return (is_missing(name) if name in floats else F.col(name).isNull()).cast("bigint")

    def inf(name: str) -> Column:
        return is_infinite(name).cast("bigint") if name in floats else F.lit(0).cast("bigint")

    if len(fields) > WIDE:
        cells = F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), miss(f.name).alias("m"), inf(f.name).alias("i")) for f in fields]))
        return df.select(cells).groupBy("column").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("m").alias("n_missing"), F.sum("i").alias("n_inf")).select(F.lit(label).alias("table"), "*")
    flags = df.select(*[miss(f.name).alias(f"m{i}") for i, f in enumerate(fields)], *[inf(f.name).alias(f"f{i}") for i, f in enumerate(fields)])
    sums = flags.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in flags.columns])
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("n_missing"), F.col(f"f{i}").alias("n_inf"))
        for i, f in enumerate(fields)])
    return sums.select(F.lit(label).alias("table"), F.inline(rows))


def catalogue(spark: SparkSession, tables: Mapping[str, DataFrame], metadata: Mapping | None = None, hints: Mapping | None = None) -> DataFrame:
    """Roles, groups and data checks for every column of several tables."""
    counts = None
    for label, df in tables.items():
        one = cell_counts(df, label)
        counts = one if counts is None else counts.unionByName(one)
    roles = infer_roles(names_frame(spark, tables), metadata, hints)
    return roles.join(counts, ["table", "column"]).select(
        "table", "column", "dtype", "base", "pos", "n_group", "role", "output_group", "profile_group", "n_rows", "n_missing", "n_inf")


def completeness(counts: DataFrame) -> DataFrame:
    """Percent of cells present per table, two decimals."""
    cells, lost = F.sum("n_rows"), F.sum("n_missing")
    return counts.groupBy("table").agg(F.round((cells - lost) / cells * 100, 2).alias("completeness_percent"), lost.alias("n_missing"))


def group_sizes(cat: DataFrame) -> DataFrame:
    """(table, output_group, n_columns, is_largest) from a catalogue."""
    sizes = cat.where("output_group IS NOT NULL").groupBy("table", "output_group").agg(F.count(F.lit(1)).alias("n_columns"))
    top = Window.partitionBy("table").orderBy(F.col("n_columns").desc(), "output_group")
    return sizes.withColumn("is_largest", F.row_number().over(top) == 1)


def dataset_spec(df: DataFrame, metadata: Mapping | None = None, hints: Mapping | None = None, key: Sequence[str] = ()) -> DatasetSpec:
    """Roles of one table as lists. Metadata lists replace inference exactly and keep their order."""
    metadata = dict(metadata or {})
    have = [c for c in df.columns if c not in key]
    rows = infer_roles(names_frame(df.sparkSession, {"t": df.select(*have)}), metadata, hints).collect()
    inputs = sorted(r["column"] for r in rows if r["role"] == "input")
    outputs = sorted(r["column"] for r in rows if r["role"] == "output")
    groups: dict[str, list] = {}
    for r in sorted((r for r in rows if r["output_group"]), key=lambda r: r["pos"]):
        groups.setdefault(r["output_group"], []).append(r["column"])
    for source in (metadata, hints or {}):
        for name, members in {**source.get("output_groups", {}), **source.get("profile_groups", {})}.items():
            groups[name] = [c for c in members if c in have]
    if metadata.get("inputs"):
        inputs = [c for c in metadata["inputs"] if c in have]
    if metadata.get("outputs"):
        outputs = [c for c in metadata["outputs"] if c in have]
    return DatasetSpec(inputs=inputs, outputs=outputs, groups=groups, key=list(key))


def pack_groups(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace the columns of each group by one array column in the order given."""
    members = {c for cols in groups.values() for c in cols}
    packed = [F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias(name) for name, cols in groups.items()]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in members], *packed)
