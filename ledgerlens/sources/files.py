"""JSON lines, snapshots, tables behind a query, binary files, reports, ledgers and content-addressed objects."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerlens.functions.values import sniff
from ledgerlens.session import materialize

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines of a schema; malformed lines are left out, or fail the read if ``strict``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return split_jsonl(spark.read.text(path), schema)[0]


def split_jsonl(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of the well-formed lines, and the malformed lines themselves."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select("value", F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return parsed.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), parsed.filter(F.col(f"r.{CORRUPT}").isNotNull()).select("value")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_once(spark: SparkSession, df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the ledger yet; returns how many. Repeats within ``df`` go in once."""
    new = df.dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti").select(*df.columns)
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan_directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, format and sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", sniff(F.col("content")).alias("format"), F.sha2("content", 256).alias("sha256"))


def content_key(digest: Column, name: Column) -> Column:
    """Where an object lies: by its content, so that storing it again changes nothing."""
    return F.concat(F.lit("objects/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("/"), name)


def read_snapshot(spark: SparkSession, folder: str, manifest: str, schema: T.StructType) -> DataFrame:
    """A local snapshot's JSON lines, if the file lies in its folder and has the manifest's checksum."""
    base = Path(folder).resolve()
    said = json.loads((base / manifest).read_text())
    path = (base / said["file"]).resolve()
    if base not in path.parents:
        raise ValueError("the snapshot's file is outside its folder")
    if hashlib.sha256(path.read_bytes()).hexdigest() != said["sha256"]:
        raise ValueError("the snapshot's checksum doesn't match")
    return spark.read.schema(schema).json(f"file://{path}")


def check_select(query: str) -> str:
    """The query, if it is one SELECT and nothing else."""
    text = query.strip().rstrip(";").strip()
    if ";" in text or not re.match(r"(?is)^select\b", text) or re.search(r"(?i)\b(insert|update|delete|drop|alter|create|grant|truncate)\b", text):
        raise ValueError("only a single SELECT is allowed")
    return text


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of a single SELECT over JDBC."""
    return spark.read.format("jdbc").option("url", url).option("query", check_select(query)).options(**options).load()


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that a source lacks; it is ready if there are none."""
    return [c for c in required if c not in df.columns]


def finalized_fields(table: DataFrame, claims: DataFrame, claim: str, finalized: str, columns: list[str]) -> DataFrame:
    """Finalised rows of the claims, projected; lacking columns are an error."""
    if lacking := missing_columns(table, [claim, finalized, *columns]):
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return table.filter(F.col(finalized).isNotNull()).join(claims.select(claim).distinct(), claim, "left_semi").select(claim, *columns)


def combine_sources(sources: list[tuple[DataFrame, bool, bool]]) -> DataFrame | None:
    """The rows of all sources that are enabled and authorised."""
    taken = [df for df, enabled, authorised in sources if enabled and authorised]
    out = taken[0] if taken else None
    for df in taken[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_reports(df: DataFrame, folder: str) -> None:
    """A table as CSV with header and as JSON lines, one file each; it is written once before, so only that is one task."""
    df = materialize(df, "report")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/json")


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """A JSON document of the columns with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A worksheet's cells as text, the first row giving names. The file is small driver metadata."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space)]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", space):
            cells = {}
            for c in row.findall("m:c", space):
                column = 0
                for letter in re.match("[A-Z]+", c.get("r")).group():
                    column = column * 26 + ord(letter) - 64
                v = c.find("m:v", space)
                inline = c.find("m:is/m:t", space)
                cells[column - 1] = inline.text if inline is not None else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            rows.append(cells)
    width = max((max(r, default=-1) + 1 for r in rows), default=0)
    names = [str(rows[0].get(k) or f"c{k}") for k in range(width)] if rows else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(r.get(k) for k in range(width)) for r in rows[1:]], schema)


def ledger_decision(base: DataFrame, candidate: DataFrame, metrics: dict[str, bool], most_loss: float = 0.0) -> DataFrame:
    """Differences of a candidate's metrics to the base's and PROMOTE if none is worse than allowed and one is better."""
    both = base.select(*[F.col(m).alias(f"b_{m}") for m in metrics]).crossJoin(candidate.select(*metrics))
    gains = {m: (F.col(m) - F.col(f"b_{m}")) * (1 if up else -1) for m, up in metrics.items()}
    values = F.array(*gains.values())
    good = F.forall(values, lambda g: F.coalesce(g >= -most_loss, F.lit(False))) & F.exists(values, lambda g: g > 0)
    return both.select(*[F.round(F.col(m) - F.col(f"b_{m}"), 6).alias(f"d_{m}") for m in metrics], F.when(F.coalesce(good, F.lit(False)), "PROMOTE").otherwise("REJECT").alias("decision"))
