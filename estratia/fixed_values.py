"""Category names, code lists and lookup tables that results must reproduce."""

from __future__ import annotations

# --- fixed values: editions, domains and category levels (order is the level order) ---
EDITIONS = (2018, 2022, 2025)
DOMAINS = ("math", "read", "science")
DOMAIN_SUFFIX = {"math": "MATH", "read": "READ", "science": "SCIE"}
GENDER = ("female", "male")
PARENT_EDUC = ("baja", "media", "alta")
ESCS_Q = ("Q1_bajo", "Q2", "Q3", "Q4_alto")
IMMIG = ("nativo", "primera_gen", "segunda_gen")
CONGRUENCE = ("congruente", "incongruente")
SCHOOL_TYPE = ("monolingue_espanol", "monolingue_regional", "mixto")
OWNERSHIP = ("publico", "privado")
PROFILE = ("Congruente", "Incongruente, no migrante", "Incongruente, migrante")

# --- fixed values: regions kept in the pool ---
BILINGUAL_REGIONS = (
    "País Vasco",
    "Cataluña",
    "Galicia",
    "Comunidad Valenciana",
    "Illes Balears",
    "Navarra",
)

# --- fixed values: source codes ---
GENDER_CODES = {"female": [1], "male": [2]}
MALE_FLAG_CODES = {"male": [1], "female": [0]}
IMMIG_CODES = {"nativo": [1], "segunda_gen": [2], "primera_gen": [3]}
EDUCATION_BANDS_10 = {"baja": [1, 2, 3], "media": [4, 5, 6], "alta": [7, 8, 9, 10]}
EDUCATION_BANDS_9 = {"baja": [1, 2], "media": [3, 4, 5], "alta": [6, 7, 8, 9]}
OWNERSHIP_SYNONYMS = {
    "publico": ["1", "public", "publico", "público"],
    "privado": ["2", "private", "privado"],
}
COUNTRY_CODE = "ESP"
BASE_LANGUAGE = "Spanish"
COOFFICIAL_LANGUAGES = ["Basque", "Catalan", "Galician", "Valencian", "Aranese", "Aranes"]
LANGUAGE_CLASSES = {"espanol": [BASE_LANGUAGE], "cooficial": COOFFICIAL_LANGUAGES}
OTHER_LANGUAGE = "otro_idioma"
LANGUAGE_SUFFIX = r" \([a-z]+\)$"
LANGUAGE_MODEL_2022 = {
    "AB": ["ESP - stratum 32: País Vasco,Private,Private AB"],
    "D": ["ESP - stratum 33: País Vasco,Private,Private D"],
}
MISSING_REGION = "sin_ccaa"

# --- fixed values: (test language class, home language class) -> detail class ---
CONGRUENCE_DETAIL = {
    ("espanol", "espanol"): "congruente_espanol",
    ("cooficial", "cooficial"): "congruente_cooficial",
    ("cooficial", "espanol"): "incongruente_examen_cooficial_casa_espanol",
    ("espanol", "cooficial"): "incongruente_examen_espanol_casa_cooficial",
    ("espanol", "otro_idioma"): "incongruente_examen_espanol_casa_otro",
    ("cooficial", "otro_idioma"): "incongruente_examen_cooficial_casa_otro",
}
PROFILE_OF_DETAIL = {
    "Congruente": ["congruente_espanol", "congruente_cooficial"],
    "Incongruente, no migrante": [
        "incongruente_examen_espanol_casa_cooficial",
        "incongruente_examen_cooficial_casa_espanol",
    ],
    "Incongruente, migrante": [
        "incongruente_examen_espanol_casa_otro",
        "incongruente_examen_cooficial_casa_otro",
    ],
}

# --- fixed values: thresholds ---
BASE_THRESHOLD = 0.90
SWEEP_THRESHOLDS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00)
ALTERNATIVE_THRESHOLDS = (0.80, 0.95)
HOMOGENEOUS_SHARE = 0.999
SMALL_SCHOOL = 10
MIN_INCONGRUENT = 5
TOP_SCHOOLS = 15
EDUCATION_NULL_ALARM = 0.30
N_PLAUSIBLE_VALUES = 10

# --- fixed values: priors and draws of the multilevel model ---
N_DRAWS = 4000
STRATA_PRIOR_DF = 7
STRATA_PRIOR_SCALE = 1.0
SD_PRIOR_BOUND = 1.0
SD_PRIOR_TAIL = 0.01
FIXED_PRECISION = 0.001
RESIDUAL_PRIOR = (1.0, 5e-5)

# --- fixed values: display labels ---
SCHOOL_TYPE_LABELS = {
    "monolingue_espanol": "Monolingüe castellano",
    "monolingue_regional": "Monolingüe cooficial",
    "mixto": "Mixto",
}
LEVEL_LABELS = ("Estrato interseccional", "Colegio", "CCAA")
TABLE_LEVEL_LABELS = ("Colegio", "Comunidad autónoma")

# --- fixed values: region names by edition and region code ---
REGION_CODES = {
    2022: {
        72401: "Andalucía",
        72402: "Aragón",
        72403: "Asturias",
        72404: "Illes Balears",
        72405: "Canarias",
        72406: "Cantabria",
        72407: "Castilla y León",
        72408: "Castilla-La Mancha",
        72409: "Cataluña",
        72410: "Extremadura",
        72411: "Galicia",
        72412: "La Rioja",
        72413: "Madrid",
        72414: "Murcia",
        72415: "Navarra",
        72416: "País Vasco",
        72417: "Comunidad Valenciana",
        72418: "Ceuta",
        72419: "Melilla",
    },
    2025: {
        72401: "Andalucía",
        72402: "Aragón",
        72403: "Asturias",
        72404: "Illes Balears",
        72405: "País Vasco",
        72406: "Canarias",
        72407: "Cantabria",
        72408: "Castilla y León",
        72409: "Castilla-La Mancha",
        72410: "Cataluña",
        72411: "Ceuta",
        72412: "Comunidad Valenciana",
        72413: "Extremadura",
        72414: "Galicia",
        72415: "La Rioja",
        72416: "Madrid",
        72417: "Melilla",
        72418: "Murcia",
        72419: "Navarra",
    },
}

# --- fixed values: 2018 sampling stratum label, region, ownership, language model ---
STRATUM_2018 = (
    ("ESP - stratum 01: Andalusia, public", "Andalucía", "publico", None),
    ("ESP - stratum 02: Andalusia, private", "Andalucía", "privado", None),
    ("ESP - stratum 03: Aragon, public", "Aragón", "publico", None),
    ("ESP - stratum 04: Aragon, private", "Aragón", "privado", None),
    ("ESP - stratum 05: Asturias, public", "Asturias", "publico", None),
    ("ESP - stratum 06: Asturias, private", "Asturias", "privado", None),
    ("ESP - stratum 07: Balearic Islands, public", "Illes Balears", "publico", None),
    ("ESP - stratum 08: Balearic Islands, private", "Illes Balears", "privado", None),
    ("ESP - stratum 09: Canary Islands, public", "Canarias", "publico", None),
    ("ESP - stratum 10: Canary Islands, private", "Canarias", "privado", None),
    ("ESP - stratum 11: Cantabria, public", "Cantabria", "publico", None),
    ("ESP - stratum 12: Cantabria, private", "Cantabria", "privado", None),
    ("ESP - stratum 13: Castile and Leon, public", "Castilla y León", "publico", None),
    ("ESP - stratum 14: Castile and Leon, private", "Castilla y León", "privado", None),
    ("ESP - stratum 15: Castile – La Mancha, public", "Castilla-La Mancha", "publico", None),
    ("ESP - stratum 16: Castile – La Mancha, private", "Castilla-La Mancha", "privado", None),
    ("ESP - stratum 17: Catalonia, public", "Cataluña", "publico", None),
    ("ESP - stratum 18: Catalonia, private", "Cataluña", "privado", None),
    ("ESP - stratum 19: Extremadura, public", "Extremadura", "publico", None),
    ("ESP - stratum 20: Extremadura, private", "Extremadura", "privado", None),
    ("ESP - stratum 21: Galicia, public", "Galicia", "publico", None),
    ("ESP - stratum 22: Galicia, private", "Galicia", "privado", None),
    ("ESP - stratum 23: La Rioja, public", "La Rioja", "publico", None),
    ("ESP - stratum 24: La Rioja, private", "La Rioja", "privado", None),
    ("ESP - stratum 25: Madrid, Bilingual Public", "Madrid", "publico", None),
    ("ESP - stratum 26: Madrid, Non-Bilingual Public", "Madrid", "publico", None),
    ("ESP - stratum 27: Madrid, Bilingual Private (Publicly Funded)", "Madrid", "privado", None),
    ("ESP - stratum 28: Madrid, Non-Bilingual Private (Publicly Funded)", "Madrid", "privado", None),
    ("ESP - stratum 29: Madrid, private", "Madrid", "privado", None),
    ("ESP - stratum 30: Murcia, public", "Murcia", "publico", None),
    ("ESP - stratum 31: Murcia, private", "Murcia", "privado", None),
    ("ESP - stratum 32: Navarra, public", "Navarra", "publico", None),
    ("ESP - stratum 33: Navarra, private", "Navarra", "privado", None),
    ("ESP - stratum 34: Basque Country, public, AB", "País Vasco", "publico", "AB"),
    ("ESP - stratum 35: Basque Country, public, D", "País Vasco", "publico", "D"),
    ("ESP - stratum 36: Basque Country, private, AB", "País Vasco", "privado", "AB"),
    ("ESP - stratum 37: Basque Country, private, D", "País Vasco", "privado", "D"),
    ("ESP - stratum 38: Valencia, public", "Comunidad Valenciana", "publico", None),
    ("ESP - stratum 39: Valencia, private", "Comunidad Valenciana", "privado", None),
    ("ESP - stratum 40: Ceuta, public", "Ceuta", "publico", None),
    ("ESP - stratum 41: Ceuta, private", "Ceuta", "privado", None),
    ("ESP - stratum 42: Melilla, public", "Melilla", "publico", None),
    ("ESP - stratum 43: Melilla, private", "Melilla", "privado", None),
)
