"""Missing values, ties and text rules on small literal frames."""

import pytest
from pyspark.sql import functions as F

from estratia import fixed_values as V
from estratia.functions import columns as C
from estratia.operators import aggregates as A
from estratia.operators import factors
from estratia.plans import panel
from estratia.sources import editions as E


def values(df, column):
    return [r[column] for r in df.collect()]


def test_recode_takes_missing_as_no_match(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "x int")
    assert values(df.select(C.recode("x", {"one": [1]}, "other").alias("y")), "y") == ["one", "other", "other"]
    assert values(df.select(C.recode("x", {"one": [1]}).alias("y")), "y") == ["one", None, None]


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert values(df.select(C.in_set("x", ["a"]).alias("y")), "y") == [True, False]
    assert values(df.filter(~C.in_set("x", ["a"])), "x") == [None]


def test_composite_key_spells_missing_parts(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    key = C.composite_key(["x", F.lit(2018), "y"], "_", {0: "none"})
    assert values(df.select(key.alias("k")), "k") == ["a_2018_NA", "none_2018_b"]


def test_distinct_count_with_and_without_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    row = df.agg(A.distinct_count("x").alias("known"), A.distinct_count("x", na_rm=False).alias("all")).first()
    assert (row["known"], row["all"]) == (2, 3)


def test_weighted_mean_and_missing_weights(spark):
    df = spark.createDataFrame(
        [("g", 1.0, 1.0), ("g", None, 2.0), ("g", 3.0, None), ("h", 1.0, 1.0), ("h", 3.0, 0.0), ("e", None, 1.0)],
        "g string, x double, w double",
    )
    out = {r["g"]: r for r in df.groupBy("g").agg(
        A.weighted_mean("x", "w").alias("m"), A.weighted_mean("x", "w", drop_null_weights=True).alias("d"),
        A.strict_sum("w").alias("s"),
    ).collect()}
    assert out["g"]["m"] is None and out["g"]["d"] is not None and out["g"]["s"] is None
    assert out["h"]["m"] == 1.0 and out["h"]["s"] == 1.0
    assert out["e"]["m"] is None


def test_predicate_share_leaves_out_unknown(spark):
    df = spark.createDataFrame([("nativo", 1.0), ("x", 1.0), (None, 5.0)], "immig string, w double")
    assert df.agg(A.weighted_percent(F.col("immig") != "nativo", "w").alias("p")).first()["p"] == 50.0


def test_share_within_zero_total_and_missing_weight(spark):
    df = spark.createDataFrame([("p", "a", 0.0), ("q", "a", 1.0), ("q", "b", None)], "p string, c string, w double")
    out = {(r["p"], r["c"]): r["share"] for r in A.share_within(df, ["p"], ["c"], "w", "share").collect()}
    assert out == {("p", "a"): None, ("q", "a"): None, ("q", "b"): None}


def test_missing_group_is_a_group(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "x string")
    assert {(r["x"], r["n"]) for r in A.frequency(df, ["x"]).collect()} == {(None, 2), ("a", 1)}


def test_dominant_category_ties_and_bounds(spark):
    rows = [("tie", "Spanish")] * 2 + [("tie", "Catalan")] * 2 + [("none", None)] * 2
    rows += [("nine", "Spanish")] * 9 + [("nine", "Basque")] + [("ten", "Basque")] * 10 + [("ten", None)]
    df = spark.createDataFrame([(2018, *r) for r in rows], "year int, global_school_id string, lang_test string")
    out = {r["global_school_id"]: r for r in panel.school_type(panel.school_language(df)).collect()}
    assert set(out) == {"tie", "nine", "ten"}
    assert out["tie"]["lang_dominante_colegio"] == "Catalan" and out["tie"]["centro_especializacion"] == "mixto"
    assert out["nine"]["centro_especializacion"] == "monolingue_espanol" and out["nine"]["n_colegio_lang"] == 10
    assert out["ten"]["centro_especializacion"] == "monolingue_regional" and out["ten"]["n_colegio_lang"] == 10


def test_first_row_per_key_by_order(spark):
    df = spark.createDataFrame([(1, "science", None), (1, "math", 2.0), (1, "read", 3.0)], "k int, domain string, v double")
    row = A.first_per_key(df, ["k"], [C.level_index("domain", V.DOMAINS)]).first()
    assert (row["domain"], row["v"]) == ("math", 2.0)
    row = A.first_per_key(df, ["k"], [-C.level_index("domain", V.DOMAINS)]).first()
    assert (row["domain"], row["v"]) == ("science", None)


def test_strata_need_every_part_and_first_varies_fastest(spark):
    rows = [(g, e, "Q2", "nativo", c) for g in V.GENDER for e in V.PARENT_EDUC for c in V.CONGRUENCE]
    rows.append(("male", None, "Q2", "nativo", "congruente"))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in panel.STRATA_COLUMNS))
    from estratia.plans.design import strata_codes

    labelled = df.withColumn("strata", C.strata_label(panel.STRATA_COLUMNS))
    assert labelled.filter("strata is null").count() == 1
    codes = {r["strata"]: r["strata_id"] for r in strata_codes(labelled).collect()}
    assert len(codes) == 12
    assert codes["female.baja.Q2.nativo.congruente"] == 1
    assert codes["male.baja.Q2.nativo.congruente"] == 2
    assert codes["female.media.Q2.nativo.congruente"] == 3
    assert codes["female.baja.Q2.nativo.incongruente"] == 7


def test_language_suffix_and_classes(spark):
    df = spark.createDataFrame([("Spanish",), ("Spanish (spa)",), ("Aranes",), ("Arabic",), (None,)], "x string")
    plain = C.strip_suffix("x", V.LANGUAGE_SUFFIX)
    out = values(df.select(C.collapse(plain, V.LANGUAGE_CLASSES, V.OTHER_LANGUAGE).alias("y")), "y")
    assert out == ["espanol", "espanol", "cooficial", "otro_idioma", None]


def test_congruence_is_missing_with_either_side(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert values(df.select(C.congruence("x", "y", "same", "diff").alias("z")), "z") == ["same", "diff", None, None]


def test_row_mean_of_ten_columns(spark):
    names = [f"PV{i}MATH" for i in range(1, 11)]
    rows = [tuple(float(i) for i in range(10)), (None,) * 9 + (4.0,), (None,) * 10, (float("nan"),) * 9 + (2.0,)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    assert values(df.select(C.row_mean(df, r"PV\d+MATH", 10).alias("m")), "m") == [4.5, 4.0, None, 2.0]
    with pytest.raises(ValueError):
        C.row_mean(df.drop("PV1MATH"), r"PV\d+MATH", 10)


def test_significance_forms_differ_at_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-2.0, -1.0), (-1.0, 1.0), (0.0, 1.0)], "lo double, hi double")
    assert values(df.select(C.significance("lo", "hi").alias("s")), "s") == ["positivo", "negativo", "n.s.", "n.s."]
    assert values(df.select(C.excludes_zero("lo", "hi").alias("s")), "s") == [True, True, False, True]


def test_formats(spark):
    df = spark.createDataFrame([(1.26, -0.5, 3.0), (-2.0, -3.0, -1.0)], "e double, lo double, hi double")
    assert values(df.select(C.format_effect("e", "lo", "hi").alias("t")), "t") == ["+1.3 [-0.5, +3.0] (n.s.)", "-2.0 [-3.0, -1.0]"]
    share = spark.createDataFrame([(0.171, 0.1, 0.25)], "m double, lo double, hi double")
    assert values(share.select(C.format_percent_interval("m", "lo", "hi").alias("t")), "t") == ["17.1% [10.0%, 25.0%]"]
    assert values(share.select(C.format_percent("m").alias("t")), "t") == ["17.1%"]


def test_union_rejects_mixed_types_and_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "k int, only_a string")
    b = spark.createDataFrame([("1",)], "k string")
    with pytest.raises(TypeError):
        E.union_editions([a, b])
    out = E.union_editions([a, b.select(F.col("k").cast("int").alias("k"))])
    assert sorted(values(out, "only_a"), key=str) == [None, "x"]


def test_require(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert E.require(df, ["x"]) is df
    with pytest.raises(ValueError):
        E.require(df, ["y"])
    with pytest.raises(Exception, match="undeclared"):
        E.require_levels(df, "x", ["b"]).collect()


def test_casts_and_ownership_synonyms(spark):
    df = spark.createDataFrame([("72401", " Public"), ("x", "2"), (None, None), ("1", "PRIVADO")], "c string, o string")
    assert values(df.select(E.integer_code("c").alias("v")), "v") == [72401, None, None, 1]
    assert values(df.select(C.normalise_enum("o", V.OWNERSHIP_SYNONYMS).alias("v")), "v") == ["publico", "privado", None, "privado"]


def test_education_scale_depends_on_edition(spark):
    df = spark.createDataFrame([(2022, 3), (2025, 3), (2018, 10), (2025, 10), (2022, None)], "year int, h int")
    out = values(df.select(C.band_by_edition("h", "year", E.EDUCATION_SCALES).alias("b")), "b")
    assert out == ["baja", "media", "alta", None, None]


def test_missing_optional_source(spark, tmp_path):
    assert E.read_optional(spark, str(tmp_path / "none.parquet")) is None
    df = spark.createDataFrame([("s1",)], "school_id string")
    out = E.with_optional(df, None, "school_id", "public_private", "string", None)
    assert values(out, "public_private") == [None]
    assert dict(out.dtypes)["public_private"] == "string"


def test_scale_uses_known_scores_only(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "score double")
    mean, sd = factors.score_scale(df, "score")
    assert mean == 2.0 and abs(sd - 2**0.5) < 1e-12


def test_csv_edition_and_stage_partitions(spark, tmp_path):
    from estratia.sources.workspace import read_stage, write_stage

    df = spark.createDataFrame([("1", 2018), ("2", 2022)], "k string, year int")
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert E.read_edition(spark, str(tmp_path / "c"), ["k"], "y.*", "csv").columns == ["k", "year"]
    path = str(tmp_path / "stage")
    write_stage(df, path, ["year"])
    write_stage(spark.createDataFrame([("3", 2022)], "k string, year int"), path, ["year"], only_these_partitions=True)
    assert sorted(values(read_stage(spark, path), "k")) == ["1", "3"]
    assert read_stage(spark, str(tmp_path / "absent"), optional=True) is None
