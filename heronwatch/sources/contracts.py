"""Data contracts: what a source must look like, from its columns to the rules of each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"text": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "date": T.DateType(), "period": T.StringType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Field:
    kind: str
    required: bool = False
    pattern: str | None = None
    domain: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None
    least_length: int | None = None

    @property
    def comment(self) -> str:
        rules = [("required", self.required), (f"like {self.pattern}", self.pattern), (f"one of {', '.join(self.domain or ())}", self.domain), (f"from {self.low} to {self.high}", self.low is not None or self.high is not None), (f"{self.least_length} characters or more", self.least_length)]
        return "; ".join(text for text, there in rules if there)


@dataclass(frozen=True)
class Contract:
    name: str
    key: tuple[str, ...]
    fields: dict[str, Field]
    headers: dict[str, str] = field(default_factory=dict)  # as written by hand -> column

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, KINDS[f.kind], not f.required, {"comment": f.comment}) for n, f in self.fields.items()])


class ContractError(ValueError):
    """A source that must not go on."""


def conform(raw: DataFrame, contract: Contract, row: str = "_row") -> DataFrame:
    """Headers trimmed and renamed, only declared columns kept (and ``row``, the order in the file)."""
    trimmed = {c: contract.headers.get(c.strip(), c.strip()) for c in raw.columns}
    out = raw.withColumnsRenamed(trimmed)
    if missing := [c for c in contract.fields if c not in out.columns]:
        raise ContractError(f"{contract.name} lacks {missing}")
    return out.select(*([row] if row in out.columns else []), *[F.col(c).cast("string").alias(c) for c in contract.fields])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of JSON objects, one to a line, typed by a given schema."""
    return spark.read.schema(schema).json(path)


def read_json_files(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """Files of indented JSON objects (one to a file, or a list of them), typed by a given schema,
    with their ``file`` and a ``reject_reason``: what is no JSON of this schema, or an object
    without its ``required`` field. A file that breaks off is one rejected row."""
    fields = T._parse_datatype_string(schema)
    raw = spark.read.schema(T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())]))
    raw = raw.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    reason = F.when(F.col("_corrupt").isNotNull(), "not readable").when(F.col(required).isNull(), f"{required}: missing")
    return raw.select(*fields.names, F.col("_metadata.file_path").alias("file"), reason.alias("reject_reason"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A sheet as text only: schema given by position, nothing inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True, enforceSchema=True)
