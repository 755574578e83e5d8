"""What a table of variants holds: the leaves of its info column and the annotator behind its records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def leaves(df: DataFrame, root: str = "info") -> list[tuple[str, str]]:
    """(name with slashes, column path) of all leaves below ``root``; all columns where there is no such struct."""
    out: list[tuple[str, str]] = []

    def walk(t: T.DataType, name: str, path: str) -> None:
        inner = t.elementType if isinstance(t, T.ArrayType) else t
        if isinstance(inner, T.StructType):
            for f in inner.fields:
                walk(f.dataType, f"{name}/{f.name}" if name else f.name, f"{path}.{f.name}")
        else:
            out.append((name, path))

    if root in df.columns:
        walk(df.schema[root].dataType, "", root)
        return out
    return [(c, c) for c in df.columns]


def annotation_list(df: DataFrame) -> DataFrame:
    """(name, type, trait, description) of every leaf of info."""

    def find(path: str) -> T.StructField:
        parts = path.split(".")
        field = df.schema[parts[0]]
        for p in parts[1:]:
            t = field.dataType
            field = (t.elementType if isinstance(t, T.ArrayType) else t)[p]
        return field

    rows = []
    for name, path in leaves(df):
        f = find(path)
        is_list = isinstance(f.dataType, T.ArrayType) or any(isinstance(find(".".join(path.split(".")[: i + 1])).dataType, T.ArrayType) for i in range(path.count(".") + 1))
        t = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        rows.append((name, t.simpleString(), "list" if is_list else "vector", f.metadata.get("comment")))
    return df.sparkSession.createDataFrame(rows, "name string, type string, trait string, description string")


# Where the annotators keep what the statistics ask for.
SLOTS = {
    "CSQ": {"consequence": "Consequence", "impact": "IMPACT", "gene": "SYMBOL", "gene_id": "Gene", "feature": "Feature", "feature_type": "Feature_type", "biotype": "BIOTYPE", "sift": "SIFT", "polyphen": "PolyPhen"},
    "ANN": {"consequence": "Annotation", "impact": "Annotation_Impact", "gene": "Gene_Name", "gene_id": "Gene_ID", "feature": "Feature_ID", "feature_type": "Feature_Type", "biotype": "Transcript_BioType", "errors": "ERRORS-WARNINGS-INFO"},
}


def profile(df: DataFrame) -> tuple[str | None, dict[str, str]]:
    """Which annotator's records a table holds (CSQ before ANN), and the slots it fills."""
    for root, slots in SLOTS.items():
        if root in df.columns:
            t = df.schema[root].dataType
            t = t["list"].dataType if isinstance(t, T.StructType) and "list" in t.names else t
            names = t.elementType.names if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) else []
            return root, {s: n for s, n in slots.items() if n in names}
    return None, {}
