"""Three edition files in the shapes of the real ones, derived from the order tables.

Orders up to 1996, of 1997 and 1998, and from 1999 on stand for the students of 2018, 2022 and 2025, so
every order is a student; customers' nations stand for schools and regions, documents' languages for test and home languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.sources.editions import EditionSource, read_edition
from estratia.sources.workspace import stage_path

#: First and last order year of each edition; None is open.
ORDER_YEARS = {2018: (None, 1996), 2022: (1997, 1998), 2025: (1999, None)}

# region index 0..7: name, regional test language, code in 2022, code in 2025, first 2018 stratum
REGIONS = (
    ("País Vasco", "Basque", 72416, 72405, 34),
    ("Cataluña", "Catalan", 72409, 72410, 17),
    ("Galicia", "Galician", 72411, 72414, 21),
    ("Comunidad Valenciana", "Valencian", 72417, 72412, 38),
    ("Illes Balears", "Catalan", 72404, 72404, 7),
    ("Navarra", "Basque", 72415, 72419, 32),
    ("Madrid", "Catalan", 72413, 72416, 30),
    ("Aragón", "Catalan", 72402, 72402, 3),
)
LANGUAGE_CODES = {"Spanish": 1, "Basque": 2, "Catalan": 3, "Galician": 4, "Valencian": 5, "Arabic": 6, "Romanian": 7}
LANGUAGE_SUFFIXES = {
    "Spanish": "spa", "Basque": "eus", "Catalan": "cat", "Galician": "glg", "Valencian": "val",
    "Arabic": "ara", "Romanian": "ron",
}
STRATUM_LABELS_2022 = (
    (1, "ESP - stratum 01: Other"),
    (31, "ESP - stratum 31: País Vasco,Public,Public"),
    (32, "ESP - stratum 32: País Vasco,Private,Private AB"),
    (33, "ESP - stratum 33: País Vasco,Private,Private D"),
)


def value_labels(spark: SparkSession, edition: int) -> DataFrame:
    """(variable, code, label) as a file header would hold them."""
    suffix = (lambda n: f" ({LANGUAGE_SUFFIXES[n]})") if edition == 2025 else (lambda n: "")
    rows = [("LANGTEST_QQQ", code, name) for name, code in LANGUAGE_CODES.items()]
    rows += [("LANGN", code, name + suffix(name)) for name, code in LANGUAGE_CODES.items()]
    if edition == 2018:
        rows += [("STRATUM", i + 1, row[0]) for i, row in enumerate(V.STRATUM_2018)]
    if edition == 2022:
        rows += [("STRATUM", code, label) for code, label in STRATUM_LABELS_2022]
    return spark.createDataFrame(rows, "variable string, code int, label string")


def _by_region(values) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({listed}), g + 1)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str, edition: int) -> DataFrame:
    first, last = ORDER_YEARS[edition]
    orders = _table(spark, sf_dir, "orders")
    if first:
        orders = orders.filter(f"o_orderdate >= timestamp'{first}-01-01'")
    if last:
        orders = orders.filter(f"o_orderdate < timestamp'{last + 1}-01-01'")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey as k",
        "c_nationkey * 4 + o_custkey % 4 as sch",
        "c_nationkey % 8 as g",
        "o_orderstatus",
        "o_totalprice",
        "c_acctbal",
    )


def _language_code(name: str) -> str:
    cases = " ".join(f"when '{n}' then {code}" for n, code in LANGUAGE_CODES.items())
    return f"case {name} {cases} end"


def _edition_columns(edition: int) -> list[str]:
    """The columns whose presence or coding differs between editions."""
    if edition == 2025:
        return [
            "cast(null as int) as ST004D01T",
            "1 + cast(floor(o_totalprice) as int) % 9 as HISCED_ALL",
            "if(k % 37 = 0, 'PRT', 'ESP') as CNT",
            "cast(k % 2 as int) as MALE",
            f"{_by_region([str(r[3]) for r in REGIONS])} as REGION",
        ]
    shared = ["cast(1 + k % 2 as int) as ST004D01T", "1 + cast(floor(o_totalprice) as int) % 10 as HISCED_ALL"]
    if edition == 2022:
        private = "if(sch % 4 < 2, 32, 33)"
        return shared + [
            f"{_by_region([r[2] for r in REGIONS])} as REGION",
            f"case when g <> 0 then 1 when sch % 2 = 0 then 31 else {private} end as STRATUM",
        ]
    basque = "34 + 2 * (sch % 2) + if(sch % 4 < 2, 0, 1)"
    first = _by_region([r[4] for r in REGIONS])
    return shared + [
        f"cast(case when k % 211 = 0 then 99 when g = 0 then {basque} else {first} + sch % 2 end as int) as STRATUM"
    ]


def student_file(spark: SparkSession, sf_dir: str, edition: int) -> DataFrame:
    """One edition's student file with coded languages and ten plausible values per domain."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    n_docs = documents.count()
    languages = (
        _base(spark, sf_dir, edition)
        .selectExpr("*", f"k % {n_docs} as d1", f"(k * 7 + 3) % {n_docs} as d2")
        .join(documents.selectExpr("doc_id as d1", "lang as l1"), "d1")
        .join(documents.selectExpr("doc_id as d2", "lang as l2"), "d2")
        .selectExpr("*", f"{_by_region([r[1] for r in REGIONS])} as regional")
        .selectExpr("*", "if(l1 = 'en', 'Spanish', regional) as own", "k % (5 + sch % 40) = 0 as odd")
        .selectExpr(
            "*",
            """if(k % 61 = 0, null, case sch % 3
                 when 0 then if(odd, own, 'Spanish')
                 when 1 then if(odd, 'Spanish', regional)
                 else own end) as test""",
            """if(k % 59 = 0, null, case l2
                 when 'en' then 'Spanish' when 'es' then regional
                 when 'fr' then 'Arabic' else 'Romanian' end) as home""",
        )
        .selectExpr("*", "coalesce(cast(test <> home as int), 0) as inc")
        .selectExpr(
            "*",
            """cast(inc * ((sch * 13) % 7 - 3) * 5 - inc * 15 + ((sch * 37) % 11 - 5) * 4 + (g - 2) * 5
                 + if(o_orderstatus = 'F', 10, 0) as double) as effect""",
            *_edition_columns(edition),
        )
    )
    # Ten values from one function: written out one by one, thirty make a generated method that the JVM no longer compiles
    values = {
        "MATH": "if(k % (100 + i) = 0, null, 400 + o_totalprice / 5000 + ((k * i) % 21 - 10) + effect)",
        "READ": "450 + c_acctbal / 100 + ((k * i + 3) % 23 - 11) + effect",
        "SCIE": "420 + o_totalprice / 6000 + ((k * i + 7) % 19 - 9) + effect",
    }
    languages = languages.selectExpr(
        "*", *[f"transform(sequence(1, {V.N_PLAUSIBLE_VALUES}), i -> {value}) as {suffix}" for suffix, value in values.items()]
    )
    scores = [f"{suffix}[{i}] as PV{i + 1}{suffix}" for i in range(V.N_PLAUSIBLE_VALUES) for suffix in values]
    own_columns = [c.rsplit(" as ", 1)[1] for c in _edition_columns(edition) if not c.endswith("HISCED_ALL")]
    return languages.selectExpr(
        "cast(sch as int) as CNTSCHID",
        "k as CNTSTUID",
        "if(k % 53 = 0, null, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end) as IMMIG",
        "if(k % 47 = 0, null, HISCED_ALL) as HISCED",
        "if(k % 41 = 0, null, c_acctbal / 1000) as ESCS",
        "if(k % 997 = 0, null, 1 + o_totalprice / 10000) as W_FSTUWT",
        f"{_language_code('test')} as LANGTEST_QQQ",
        f"{_language_code('home')} as LANGN",
        *own_columns,
        *scores,
    )


def school_file(spark: SparkSession, sf_dir: str, edition: int) -> DataFrame | None:
    """School attributes, one row a school; there is no such file for 2018."""
    if edition == 2018:
        return None
    schools = _base(spark, sf_dir, edition).select("sch").distinct()
    if edition == 2022:
        return schools.selectExpr(
            "cast(sch as int) as CNTSCHID",
            "if(sch % 17 = 0, null, if(sch % 2 = 0, 'public', ' Private')) as PRIVATESCH",
        )
    return schools.selectExpr(
        "'ESP' as CNT",
        "cast(sch as int) as CNTSCHID",
        "if(sch % 17 = 0, null, cast(1 + sch % 2 as int)) as SC013Q01TA",
    )


def edition_source(spark: SparkSession, sf_dir: str, edition: int) -> EditionSource:
    """The edition's files, written once per application as the stage tables they stand for."""
    students = stage_path(spark, f"{sf_dir}/students-{edition}", lambda: student_file(spark, sf_dir, edition))
    schools = None
    if edition != 2018:
        path = stage_path(spark, f"{sf_dir}/schools-{edition}", lambda: school_file(spark, sf_dir, edition))
        schools = read_edition(spark, path)
    return EditionSource(read_edition(spark, students), value_labels(spark, edition), schools)
