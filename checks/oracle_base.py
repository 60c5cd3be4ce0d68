"""DuckDB text of the edition files and panels, written apart from the Spark code."""

from __future__ import annotations

from estratia import fixed_values as V

# region index: name, regional language, code 2022, code 2025, first 2018 stratum
_REGIONS = """(VALUES
    (0, 'País Vasco', 'Basque', 72416, 72405, 34),
    (1, 'Cataluña', 'Catalan', 72409, 72410, 17),
    (2, 'Galicia', 'Galician', 72411, 72414, 21),
    (3, 'Comunidad Valenciana', 'Valencian', 72417, 72412, 38),
    (4, 'Illes Balears', 'Catalan', 72404, 72404, 7),
    (5, 'Navarra', 'Basque', 72415, 72419, 32),
    (6, 'Madrid', 'Catalan', 72413, 72416, 30),
    (7, 'Aragón', 'Catalan', 72402, 72402, 3))"""
_LANGS = """(VALUES (1, 'Spanish', 'spa'), (2, 'Basque', 'eus'), (3, 'Catalan', 'cat'), (4, 'Galician', 'glg'),
    (5, 'Valencian', 'val'), (6, 'Arabic', 'ara'), (7, 'Romanian', 'ron'))"""
_N = range(1, 11)
_PV = ",\n".join(
    [f"CASE WHEN k % {100 + i} <> 0 THEN 400 + o_totalprice / 5000 + ((k * {i}) % 21 - 10) + effect END AS PV{i}MATH" for i in _N]
    + [f"450 + c_acctbal / 100 + ((k * {i} + 3) % 23 - 11) + effect AS PV{i}READ" for i in _N]
    + [f"420 + o_totalprice / 6000 + ((k * {i} + 7) % 19 - 9) + effect AS PV{i}SCIE" for i in _N]
)


def _text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _pv_mean(suffix: str) -> str:
    total = " + ".join(f"coalesce(PV{i}{suffix}, 0)" for i in _N)
    present = " + ".join(f"(PV{i}{suffix} IS NOT NULL)::INTEGER" for i in _N)
    return f"({total}) / nullif({present}, 0)"


_REGION_ROWS = ", ".join(f"({e}, {c}, {_text(n)})" for e, d in V.REGION_CODES.items() for c, n in d.items())
_STRATUM_ROWS = ", ".join(
    f"({i + 1}, {', '.join(_text(x) for x in row)})" for i, row in enumerate(V.STRATUM_2018)
)

RAW = f"""
regs(g, rname, rlang, c22, c25, s18) AS (SELECT * FROM {_REGIONS} t),
langs(code, lname, iso) AS (SELECT * FROM {_LANGS} t),
base AS (
  SELECT CASE WHEN year(o_orderdate) <= 1996 THEN 2018 WHEN year(o_orderdate) <= 1998 THEN 2022 ELSE 2025 END AS ed,
         o_orderkey AS k, c_nationkey * 4 + o_custkey % 4 AS sch, c_nationkey % 8 AS g,
         o_orderstatus, o_totalprice, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey),
worded AS (
  SELECT b.*, rlang, c22, c25, s18,
         CASE WHEN a.lang = 'en' THEN 'Spanish' ELSE rlang END AS own,
         CASE z.lang WHEN 'en' THEN 'Spanish' WHEN 'es' THEN rlang WHEN 'fr' THEN 'Arabic' ELSE 'Romanian' END AS h,
         k % (5 + sch % 40) = 0 AS odd
  FROM base b JOIN regs USING (g)
  JOIN documents a ON a.doc_id = k % (SELECT count(*) FROM documents)
  JOIN documents z ON z.doc_id = (k * 7 + 3) % (SELECT count(*) FROM documents)),
tested AS (
  SELECT *, CASE WHEN k % 61 = 0 THEN NULL
                 WHEN sch % 3 = 0 THEN CASE WHEN odd THEN own ELSE 'Spanish' END
                 WHEN sch % 3 = 1 THEN CASE WHEN odd THEN 'Spanish' ELSE rlang END
                 ELSE own END AS test,
            CASE WHEN k % 59 <> 0 THEN h END AS home
  FROM worded),
planted AS (
  SELECT *, coalesce((test <> home)::INTEGER, 0) AS inc FROM tested),
effects AS (
  SELECT *, (inc * ((sch * 13) % 7 - 3) * 5 - inc * 15 + ((sch * 37) % 11 - 5) * 4 + (g - 2) * 5
             + CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END)::DOUBLE AS effect
  FROM planted),
raw AS (
  SELECT ed, k AS CNTSTUID, sch::INTEGER AS CNTSCHID,
         CASE WHEN ed <> 2025 THEN (1 + k % 2)::INTEGER END AS ST004D01T,
         CASE WHEN ed = 2025 THEN (k % 2)::INTEGER END AS MALE,
         CASE WHEN k % 53 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END END AS IMMIG,
         CASE WHEN k % 47 <> 0 THEN
           (1 + floor(o_totalprice)::BIGINT % (CASE WHEN ed = 2025 THEN 9 ELSE 10 END))::INTEGER END AS HISCED,
         CASE WHEN k % 41 <> 0 THEN c_acctbal / 1000 END AS ESCS,
         CASE WHEN k % 997 <> 0 THEN 1 + o_totalprice / 10000 END AS W_FSTUWT,
         test, home,
         (SELECT code FROM langs WHERE lname = test) AS LANGTEST_QQQ,
         (SELECT code FROM langs WHERE lname = home) AS LANGN,
         CASE WHEN ed = 2025 THEN home || ' (' || (SELECT iso FROM langs WHERE lname = home) || ')' ELSE home END AS home_label,
         CASE WHEN k % 37 = 0 THEN 'PRT' ELSE 'ESP' END AS CNT,
         CASE ed WHEN 2022 THEN c22 WHEN 2025 THEN c25 END AS REGION,
         (CASE WHEN ed = 2018 THEN
            CASE WHEN k % 211 = 0 THEN 99
                 WHEN g = 0 THEN 34 + 2 * (sch % 2) + CASE WHEN sch % 4 < 2 THEN 0 ELSE 1 END
                 ELSE s18 + sch % 2 END
               WHEN ed = 2022 THEN
            CASE WHEN g <> 0 THEN 1 WHEN sch % 2 = 0 THEN 31 WHEN sch % 4 < 2 THEN 32 ELSE 33 END END)::INTEGER AS STRATUM,
         {_PV}
  FROM effects)"""

POOLED = f"""{RAW},
region_names(ed, code, ccaa) AS (SELECT * FROM (VALUES {_REGION_ROWS}) t),
strata18(code, label, ccaa, owner, model) AS (SELECT * FROM (VALUES {_STRATUM_ROWS}) t),
everyone AS (
  SELECT raw.ed::INTEGER AS year, CNTSCHID::VARCHAR AS school_id, CNTSTUID::VARCHAR AS student_id,
         CASE WHEN ST004D01T = 1 OR MALE = 0 THEN 'female' WHEN ST004D01T = 2 OR MALE = 1 THEN 'male' END AS gender,
         CASE IMMIG WHEN 1 THEN 'nativo' WHEN 2 THEN 'segunda_gen' WHEN 3 THEN 'primera_gen' END AS immig,
         CASE WHEN raw.ed = 2025 THEN
           CASE WHEN HISCED <= 2 THEN 'baja' WHEN HISCED <= 5 THEN 'media' WHEN HISCED <= 9 THEN 'alta' END
         ELSE CASE WHEN HISCED <= 3 THEN 'baja' WHEN HISCED <= 6 THEN 'media' WHEN HISCED <= 10 THEN 'alta' END END AS parent_educ,
         ESCS AS escs, W_FSTUWT AS stu_wgt, test AS lang_test, home_label AS lang_home,
         CASE WHEN raw.ed = 2018 THEN s.model
              WHEN raw.ed = 2022 AND STRATUM = 32 THEN 'AB' WHEN raw.ed = 2022 AND STRATUM = 33 THEN 'D' END AS modelo_linguistico_pv,
         {_pv_mean('MATH')} AS math, {_pv_mean('READ')} AS read, {_pv_mean('SCIE')} AS science,
         CASE WHEN raw.ed = 2018 THEN s.ccaa ELSE r.ccaa END AS ccaa,
         CASE WHEN raw.ed = 2018 THEN 'stratum_2018' ELSE 'region_oficial' END AS ccaa_source,
         CASE WHEN raw.ed = 2018 THEN s.owner WHEN CNTSCHID % 17 = 0 THEN NULL
              WHEN CNTSCHID % 2 = 0 THEN 'publico' ELSE 'privado' END AS public_private,
         s.label AS stratum_label, CNT
  FROM raw LEFT JOIN strata18 s ON raw.ed = 2018 AND s.code = STRATUM
  LEFT JOIN region_names r ON r.ed = raw.ed AND r.code = REGION),
pooled AS (
  SELECT * EXCLUDE (stratum_label, CNT), ccaa || '_' || year || '_' || school_id AS global_school_id
  FROM everyone WHERE ccaa IN {_in(V.BILINGUAL_REGIONS)} AND (year <> 2025 OR CNT = 'ESP'))"""

_CLASS3 = "CASE WHEN {0} = 'Spanish' THEN 'espanol' WHEN {0} IN " + _in(V.COOFFICIAL_LANGUAGES) + " THEN 'cooficial' WHEN {0} IS NOT NULL THEN 'otro_idioma' END"

PREP = f"""{POOLED},
spoken AS (
  SELECT *, {_CLASS3.format('lang_test')} AS lang_test_3cat,
         {_CLASS3.format("regexp_replace(lang_home, ' [(][a-z]+[)]$', '')")} AS lang_home_3cat
  FROM pooled),
congr AS (
  SELECT *,
    CASE WHEN lang_test_3cat = lang_home_3cat AND lang_test_3cat IN ('espanol', 'cooficial') THEN 'congruente_' || lang_test_3cat
         WHEN lang_test_3cat IN ('espanol', 'cooficial') AND lang_home_3cat IS NOT NULL THEN
           'incongruente_examen_' || lang_test_3cat || '_casa_' || replace(lang_home_3cat, '_idioma', '') END AS congruencia_detalle,
    CASE WHEN lang_test_3cat IS NULL OR lang_home_3cat IS NULL THEN NULL
         WHEN lang_test_3cat = lang_home_3cat THEN 'congruente' ELSE 'incongruente' END AS congruencia_linguistica
  FROM spoken),
spoken_counts AS (
  SELECT year, global_school_id, lang_test, count(*) AS n FROM pooled WHERE lang_test IS NOT NULL GROUP BY ALL),
centro_lang AS (
  SELECT year, global_school_id, lang_test AS lang_dominante_colegio, n / total AS pct_dominante_colegio, total AS n_colegio_lang
  FROM (SELECT *, (sum(n) OVER w)::BIGINT AS total,
               row_number() OVER (PARTITION BY global_school_id ORDER BY n DESC, lang_test) AS rn
        FROM spoken_counts WINDOW w AS (PARTITION BY global_school_id)) WHERE rn = 1),
centro AS (
  SELECT *, CASE WHEN pct_dominante_colegio < CAST(0.9 AS DOUBLE) THEN 'mixto'
                 WHEN lang_dominante_colegio = 'Spanish' THEN 'monolingue_espanol' ELSE 'monolingue_regional' END AS centro_especializacion
  FROM centro_lang),
banded AS (
  SELECT c.*, lang_dominante_colegio, pct_dominante_colegio, n_colegio_lang, centro_especializacion,
         CASE WHEN escs IS NOT NULL THEN
           (['Q1_bajo', 'Q2', 'Q3', 'Q4_alto'])[ntile(4) OVER (PARTITION BY c.year, escs IS NULL ORDER BY escs, student_id)] END AS escs_q
  FROM congr c LEFT JOIN centro z ON z.global_school_id = c.global_school_id),
prep AS (
  SELECT *, gender || '.' || parent_educ || '.' || escs_q || '.' || immig || '.' || congruencia_linguistica AS strata,
         gender || '.' || parent_educ || '.' || escs_q || '.' || immig AS strata_4dim
  FROM banded)"""

_LONG_IDS = (
    "year, ccaa, ccaa_source, school_id, student_id, global_school_id, gender, immig, parent_educ, escs_q, "
    "congruencia_linguistica, congruencia_detalle, centro_especializacion, pct_dominante_colegio, public_private, "
    "strata, strata_4dim, stu_wgt"
)
LONG = f"""{PREP},
longp AS (
  SELECT {_LONG_IDS}, 'math' AS domain, math AS score FROM prep
  UNION ALL SELECT {_LONG_IDS}, 'read', read FROM prep
  UNION ALL SELECT {_LONG_IDS}, 'science', science FROM prep)"""


def over_raw(sql: str) -> str:
    return f"WITH {RAW}\n{sql}"


def over_pooled(sql: str) -> str:
    return f"WITH {POOLED}\n{sql}"


def over_prep(sql: str) -> str:
    return f"WITH {PREP}\n{sql}"


def over_long(sql: str) -> str:
    return f"WITH {LONG}\n{sql}"
