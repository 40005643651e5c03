"""Delimited-text sources.

Sensor exports are ``;``-separated text with decimal commas; they are read
as all-string columns (no schema inference pass over the data) and typed
afterwards by ``operators.schema``. Everything is a file scan split by
block, so reading grows with the cluster, not with one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sinter.functions import clean as C

TEXT_OPTIONS = {
    "header": "true", "inferSchema": "false", "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_text_table(spark: SparkSession, path, sep: str = ";", **options) -> DataFrame:
    """Header + all-string columns."""
    return spark.read.options(**{**TEXT_OPTIONS, "sep": sep, **options}).csv(path)


def read_typed(spark: SparkSession, path, schema, sep: str = ",", **options) -> DataFrame:
    """Comma CSV with a declared schema (no inference)."""
    return spark.read.options(**{**TEXT_OPTIONS, "sep": sep, **options}).schema(schema).csv(path)


def read_indexed(spark: SparkSession, path, sep: str = ",", ts: str = "ts",
                 formats=C.TS_FORMATS_INFERRED, numeric: bool = True) -> DataFrame:
    """S3: the first column is an unnamed time index: rename it ``ts`` and
    parse it (bad -> null); other columns become doubles when ``numeric``."""
    df = read_text_table(spark, path, sep)
    first = df.columns[0]
    out = [C.parse_ts_any(F.col(f"`{first}`"), formats).alias(ts)]
    for c in df.columns[1:]:
        out.append(C.clean_number(F.col(f"`{c}`")).alias(c) if numeric else F.col(f"`{c}`"))
    return df.select(*out)


def read_many(frames) -> DataFrame:
    """Bag union by column name; a column missing in one input is null."""
    frames = list(frames)
    if not frames:
        raise ValueError("no inputs")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _contains_any(name, table: dict, default: str):
    expr = None
    for needle, value in table.items():
        cond = name.contains(needle)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


# File-name markers and labels used by the reference.
METHOD_MARKERS = {"dbscan": "DBSCAN", "kmeans": "KMEANS"}
PERIOD_MARKERS = {"ago_set": "ago_set", "mar_jun": "mar_jun"}
MODEL_MARKERS = {"tabpfn": "TabPFN", "xgb": "XGB", "randomforest": "RandomForest"}
DATASET_MARKERS = {"iqr": "IQR"}
UNKNOWN = "desconhecido"


def with_provenance(df: DataFrame) -> DataFrame:
    """Method, period, model and dataset read off the name of the file,
    or, for the part files of a written dataset, of the dataset's folder.
    Folders above don't count, nor do the ``key=value`` ones of partitions.
    Method and period markers match in any case, model and dataset markers
    as written."""
    parts = F.filter(F.split("_metadata.file_path", "/"), lambda x: ~x.contains("="))
    file = F.element_at(parts, -1)
    name = F.when(file.startswith("part-"), F.element_at(parts, -2)).otherwise(file)
    return df.withColumns({
        "method": _contains_any(F.lower(name), METHOD_MARKERS, UNKNOWN.upper()),
        "period": _contains_any(F.lower(name), PERIOD_MARKERS, UNKNOWN),
        "model": _contains_any(name, MODEL_MARKERS, "Outro"),
        "dataset": _contains_any(name, DATASET_MARKERS, "padrao"),
    })


def _lines(skip: int, header: bool):
    """The header line of every file (with its path), or all lines after it.
    Rows of a block arrive in file order; the only state is a line counter
    per file whose first block is in this partition."""
    def run(batches):
        seen: dict[str, int] = {}
        for pdf in batches:
            first = (pdf["_block"] == 0).to_numpy()
            pos = np.full(len(pdf), skip + 1, np.int64)
            if first.any():
                paths = pdf["_path"][first]
                start = paths.map(seen).fillna(0).to_numpy(dtype=np.int64)
                pos[first] = start + paths.groupby(paths, sort=False).cumcount().to_numpy()
                for p, n in paths.value_counts(sort=False).items():
                    seen[p] = seen.get(p, 0) + int(n)
            keep = pos == skip if header else pos > skip
            yield pd.DataFrame({"value": pdf["value"].to_numpy()[keep], "_path": pdf["_path"].to_numpy()[keep]})
    return run


MAX_LAYOUTS = 100


def read_with_preamble(spark: SparkSession, path, skip: int = 5, sep: str = ";") -> DataFrame:
    """Delimited exports with ``skip`` junk lines before their header.

    Every file's own header names its columns, so files may order them
    differently; a column that a file lacks is null there. The headers come
    from the first blocks; the body drops the leading lines in a
    ``mapInPandas`` over the text scan and is parsed with ``from_csv`` into
    string columns, once per distinct header (at most ``MAX_LAYOUTS``).
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"))
    heads = raw.filter(F.col("_block") == 0).mapInPandas(_lines(skip, True), "value string, _path string")
    layouts = [r["value"] for r in heads.select("value").distinct().limit(MAX_LAYOUTS + 1).collect()]
    if not layouts:
        raise ValueError(f"fewer than {skip + 1} lines in the first block")
    if len(layouts) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers")
    body = raw.mapInPandas(_lines(skip, False), "value string, _path string")
    if len(layouts) > 1:
        body = body.join(heads.select("_path", F.col("value").alias("_head")), "_path")
    out = None
    for head in sorted(layouts):
        names = head.split(sep)
        ddl = ", ".join(f"`{n}` STRING" for n in names)
        rows = body.filter(F.col("_head") == head) if len(layouts) > 1 else body
        parsed = rows.select(F.from_csv("value", ddl, {"sep": sep}).alias("r"))
        one = parsed.select(*[F.col("r").getField(n).alias(n) for n in names])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
