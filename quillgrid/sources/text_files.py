"""Text tables in and out: CSV, TSV, fixed width, with the inference of cells; Markdown, HTML, JSON."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def infer_cell(text: Column) -> Column:
    """kind, num, txt, bool of a field: empty is absent, TRUE/FALSE booleans, numbers numbers.

    A field that starts with a zero and goes on with digits stays text, so codes keep their zeros.
    """
    s = F.trim(text)
    kept = s.rlike(r"^0[0-9]")
    plain = F.when(s.rlike(r"^[+-]?[0-9]+(_[0-9]+)+(\.[0-9]*)?$"), F.replace(s, F.lit("_"), F.lit(""))).otherwise(s)
    number = F.when(~kept, plain.try_cast("double"))
    flag = F.upper(s).isin("TRUE", "FALSE")
    kind = F.when(text.isNull() | (s == ""), F.lit(None)).when(flag, "b").when(number.isNotNull(), "n").otherwise("t")
    return F.struct(
        kind.alias("kind"), F.when(kind == "n", number).alias("num"), F.when(kind == "t", text).alias("txt"), F.when(kind == "b", F.upper(s) == "TRUE").alias("bool"),
    )


def read_csv(spark: SparkSession, path: str, separator: str = ",", quoted: bool = True) -> DataFrame:
    """All columns as text, named by the header; no pass over the data to guess types."""
    return spark.read.csv(path, sep=separator, header=True, inferSchema=False, quote='"' if quoted else "", escape='"' if quoted else "\\", ignoreLeadingWhiteSpace=not quoted, ignoreTrailingWhiteSpace=not quoted)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t", quoted=False)


def infer_columns(df: DataFrame) -> DataFrame:
    """Every text column as a struct of its kind and value."""
    return df.select(*[infer_cell(F.col(f"`{c}`")).alias(c) for c in df.columns])


def import_report(df: DataFrame) -> DataFrame:
    """Numbers, texts, booleans, blanks, and codes whose zeros were kept, in one pass over text columns."""
    cells = F.array(*[F.struct(infer_cell(F.col(f"`{c}`"))["kind"].alias("kind"), F.trim(F.col(f"`{c}`")).rlike("^0[0-9]").alias("zero")) for c in df.columns])
    long = df.select(F.explode(cells).alias("c"))
    return long.agg(F.count_if(F.col("c.kind") == "n").alias("numbers"), F.count_if(F.col("c.kind") == "t").alias("texts"), F.count_if(F.col("c.kind") == "b").alias("booleans"), F.count_if(F.col("c.kind").isNull()).alias("blanks"), F.count_if(F.col("c.zero") & (F.col("c.kind") == "t")).alias("zeros_protected"))


@dataclass(frozen=True)
class FixedColumn:
    name: str
    start: int
    width: int


def read_fixed(spark: SparkSession, path: str, columns: list[FixedColumn]) -> DataFrame:
    """Fields by position; a line longer than the columns stops the job and is shown."""
    taken = sorted(columns, key=lambda c: c.start)
    if any(a.start + a.width > b.start for a, b in zip(taken, taken[1:])) or len({c.name for c in columns}) < len(columns):
        raise ValueError("columns overlap or share a name")
    end = max(c.start + c.width for c in columns)
    line = spark.read.text(path)
    value = F.when(F.char_length(F.rtrim("value")) > end, F.raise_error(F.concat(F.lit("line too long: "), F.col("value")))).otherwise(F.col("value"))
    return line.select(*[F.nullif(F.trim(F.substring(value, c.start + 1, c.width)), F.lit("")).alias(c.name) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def records(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def _shown(df: DataFrame, limit: int) -> tuple[list[str], list[list], list[bool]]:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows: write a file instead")
    numeric = [f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal") for f in df.schema]
    text = lambda v: "" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) and abs(v) < 1e15 else str(v).upper() if isinstance(v, bool) else str(v)
    return df.columns, [[text(v) for v in r] for r in rows], numeric


def to_markdown(df: DataFrame, limit: int = 1000) -> str:
    """A pipe table of a short, ordered frame; numbers to the right."""
    names, rows, numeric = _shown(df, limit)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(names), "| " + " | ".join("---:" if n else "---" for n in numeric) + " |", *map(line, rows)])


def to_html(df: DataFrame, limit: int = 1000) -> str:
    names, rows, numeric = _shown(df, limit)
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f'<td class="num">{html.escape(c)}</td>' if n else f"<td>{html.escape(c)}</td>" for c, n in zip(r, numeric)) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
