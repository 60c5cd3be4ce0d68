"""Reading edition files and turning each into the common panel schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators.joins import lookup


@dataclass(frozen=True)
class EditionSource:
    """An edition's student file, its value labels and, where there is one, its school file."""

    students: DataFrame
    labels: DataFrame
    schools: DataFrame | None = None


def read_edition(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    pattern: str | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """An edition's table, with named columns plus those whose whole name matches a pattern."""
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    df = reader.format(file_format).load(path)
    if columns is None and pattern is None:
        return df
    return df.select(*(columns or []), *(C.matching_columns(df, pattern) if pattern else []))


def read_optional(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame | None:
    """A table that may be absent."""
    try:
        return spark.read.format(file_format).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def select_any(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist."""
    return df.select(*[n for n in names if n in df.columns])


def require(df: DataFrame, columns: Iterable[str] = (), pattern: str | None = None, count: int | None = None) -> DataFrame:
    """The frame itself, or an error when a column is missing or a pattern matches another number."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if pattern is not None:
        C.matching_columns(df, pattern, count)
    return df


def require_levels(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Fails, while running, on a value outside the declared levels."""
    ok = F.col(column).isNull() | F.col(column).isin(*levels)
    checked = F.when(ok, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} has an undeclared level: "), F.col(column)))
    )
    return df.withColumn(column, checked)


def region_dimension(spark: SparkSession, editions: Sequence[int] = (2022, 2025)) -> DataFrame:
    """Region name by edition and code, 19 rows an edition; codes are text."""
    rows = [(e, str(code), name) for e in editions for code, name in V.REGION_CODES[e].items()]
    return spark.createDataFrame(rows, "year int, region_code string, ccaa string")


def stratum_dimension(spark: SparkSession) -> DataFrame:
    """Sampling stratum label of 2018 to region, ownership and language model, 43 rows."""
    return spark.createDataFrame(
        list(V.STRATUM_2018),
        "stratum_label string, ccaa string, public_private_chr string, modelo_linguistico_pv string",
    )


def decode(df: DataFrame, column: str, labels: DataFrame, variable: str, into: str) -> DataFrame:
    """Adds the label of a coded column; ``labels`` holds (variable, code, label) of a file header."""
    one = labels.filter(F.col("variable") == variable).select(
        F.col("code").alias(column), F.col("label").alias(into)
    )
    return lookup(df, one, column)


def keep_code(df: DataFrame, column: str, code) -> DataFrame:
    """Rows whose raw code, not label, equals the given one."""
    return df.filter(F.col(column) == code)


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


POOLED_SCHEMA = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("school_id", T.StringType()),
        T.StructField("student_id", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("immig", T.StringType()),
        T.StructField("parent_educ", T.StringType()),
        T.StructField("escs", T.DoubleType()),
        T.StructField("stu_wgt", T.DoubleType()),
        T.StructField("lang_test", T.StringType()),
        T.StructField("lang_home", T.StringType()),
        T.StructField("modelo_linguistico_pv", T.StringType()),
        T.StructField("math", T.DoubleType()),
        T.StructField("read", T.DoubleType()),
        T.StructField("science", T.DoubleType()),
        T.StructField("ccaa", T.StringType()),
        T.StructField("ccaa_source", T.StringType()),
        T.StructField("public_private", T.StringType()),
    ]
)


def integer_code(c: str) -> Column:
    """A code as an integer, NULL where the text or number is not one."""
    return F.col(c).try_cast("int")


def gender_column(df: DataFrame) -> Column:
    """Gender from its coded column, else from the male flag where the file has one."""
    main = C.recode(integer_code("ST004D01T"), V.GENDER_CODES)
    if "MALE" not in df.columns:
        return main
    return F.coalesce(main, C.recode(integer_code("MALE"), V.MALE_FLAG_CODES))


EDUCATION_SCALES = {2018: V.EDUCATION_BANDS_10, 2022: V.EDUCATION_BANDS_10, 2025: V.EDUCATION_BANDS_9}


def harmonise(df: DataFrame, year: int, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One edition's decoded file in the common columns, plus edition-specific ones."""
    edition = F.lit(year)
    common: dict[str, Column] = {
        "year": edition.cast("int"),
        "school_id": F.col("CNTSCHID").cast("string"),
        "student_id": F.col("CNTSTUID").cast("string"),
        "gender": gender_column(df),
        "immig": C.recode(integer_code("IMMIG"), V.IMMIG_CODES),
        "parent_educ": C.band_by_edition(integer_code("HISCED"), edition, EDUCATION_SCALES),
        "escs": C.clean("ESCS"),
        "stu_wgt": C.clean("W_FSTUWT"),
        "lang_test": F.col("LANGTEST_LABEL"),
        "lang_home": F.col("LANGN_LABEL"),
    }
    for domain, suffix in V.DOMAIN_SUFFIX.items():
        common[domain] = C.row_mean(df, rf"PV\d+{suffix}", V.N_PLAUSIBLE_VALUES)
    common.update(extra or {})
    return df.select(*[c.alias(n) for n, c in common.items()])


def school_ownership(schools: DataFrame) -> DataFrame:
    """Ownership by school from whichever of its two columns the file has."""
    ownership = C.coalesce_optional(
        schools, ["PRIVATESCH", "SC013Q01TA"], lambda c: C.normalise_enum(c, V.OWNERSHIP_SYNONYMS)
    )
    return schools.select(F.col("CNTSCHID").cast("string").alias("school_id"), ownership.alias("public_private"))


def with_optional(
    df: DataFrame, source: DataFrame | None, key: str, column: str, type_name: str, join: Callable
) -> DataFrame:
    """Adds a column from an optional table, or a typed NULL when the table is absent."""
    if source is None:
        return df.withColumn(column, F.lit(None).cast(type_name))
    return join(df, source.select(key, column), [key])


def union_editions(frames: Sequence[DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """Union by name; a column some edition lacks is NULL there, differing types are an error."""
    seen: dict[str, T.DataType] = {}
    for frame in frames:
        for field in frame.schema:
            known = seen.setdefault(field.name, field.dataType)
            if known != field.dataType:
                raise TypeError(f"column {field.name} is {known.simpleString()} and {field.dataType.simpleString()}")
    if schema is not None:
        wrong = [f.name for f in schema if f.name in seen and seen[f.name] != f.dataType]
        if wrong:
            raise TypeError(f"columns with another type than declared: {', '.join(wrong)}")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    if schema is None:
        return result
    return result.select(
        *[F.col(f.name) if f.name in seen else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )
