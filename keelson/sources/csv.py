"""CSV in and out: a header, instants in `_TS`, for tables a flag (+ or -) in `_FL`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.tokens import LanguageError

#: Fixed: the language's types.
TYPES = {"INTEGER": "bigint", "FLOAT": "double", "STRING": "string"}


def read_csv(spark: SparkSession, path: str, attributes: list[tuple[str, str]], table: bool, delimiter: str = ",") -> DataFrame:
    """`_TS`, `_FL` for tables, the attributes in upper case, and `_ORD`, the order of the file.

    Columns are found by their names in the header, in any order and case. White space around
    fields goes; fields are not quoted. A value that is not of its type is an error."""
    options = {"header": "true", "sep": delimiter, "quote": "", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    head = spark.read.options(**{**options, "header": "false"}).csv(path).first()
    if head is None:
        raise LanguageError(f"{path} has no header")
    names = [(x or "").strip().upper() for x in head]
    wanted = [("_TS", "INTEGER"), *([("_FL", "STRING")] if table else []), *attributes]
    if missing := [n for n, _ in wanted if n not in names]:
        raise LanguageError(f"{path} lacks {', '.join(missing)}")
    raw = spark.read.options(**options).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    return raw.select(*(F.trim(f"`{n}`").cast(TYPES[t]).alias(n) for n, t in wanted), F.monotonically_increasing_id().alias("_ORD")).filter("_TS IS NOT NULL")


def write_csv(result: DataFrame, path: str, delimiter: str = ",") -> None:
    """A folder of CSV parts. Instants are kept in order within and across parts."""
    result.orderBy("_TS", *(["_FL"] if "_FL" in result.columns else [])).write.mode("overwrite").options(header="true", sep=delimiter, emptyValue="", quote="").csv(path)
