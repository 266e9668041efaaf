"""Column names, codes and schemas of the case-notification data model.

The values below are fixed: they must equal the source data's layout and the
curated table's column names for results to line up.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the 24 relevant columns of the raw notification file, in file order ---
RAW_COLUMNS = (
    "DT_NOTIFIC", "DT_SIN_PRI", "SG_UF", "CO_MUN_RES", "CS_SEXO", "NU_IDADE_N",
    "TP_IDADE", "EVOLUCAO", "UTI", "DT_ENTUTI", "DT_SAIDUTI", "VACINA",
    "VACINA_COV", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF", "CLASSI_FIN",
    "DT_EVOLUCA", "DT_INTERNA", "HOSPITAL", "FEBRE", "TOSSE", "DISPNEIA",
    "SATURACAO",
)

# --- fixed values: the nine date columns parsed during cleaning ---
DATE_COLUMNS = (
    "DT_NOTIFIC", "DT_SIN_PRI", "DT_EVOLUCA", "DT_INTERNA", "DT_ENTUTI",
    "DT_SAIDUTI", "DOSE_1_COV", "DOSE_2_COV", "DOSE_REF",
)

# Columns that stay text (state and municipality codes).
TEXT_COLUMNS = ("SG_UF", "CO_MUN_RES")

# Optional symptom columns: NULL when the source file lacks them.
OPTIONAL_COLUMNS = ("FEBRE", "TOSSE", "DISPNEIA", "SATURACAO")

# --- fixed values: coded answers (1 = yes, 2 = no, 9 = unknown) ---
YES, NO, UNKNOWN = 1, 2, 9
DEATH = 2  # EVOLUCAO: 1 cure, 2 death, 3 death by another cause

# --- fixed values: TP_IDADE age units ---
AGE_HOURS, AGE_DAYS, AGE_MONTHS, AGE_YEARS = 1, 2, 3, 4

# --- fixed values: curated table columns (lower case), in table order, with source column ---
CURATED_COLUMNS = (
    ("dt_notific", "DT_NOTIFIC"), ("dt_sin_pri", "DT_SIN_PRI"), ("sg_uf", "SG_UF"),
    ("co_mun_res", "CO_MUN_RES"), ("cs_sexo", "CS_SEXO"), ("idade_anos", "IDADE_ANOS"),
    ("evolucao", "EVOLUCAO"), ("obito", "OBITO"), ("uti", "UTI"),
    ("internou_uti", "INTERNOU_UTI"), ("dt_entuti", "DT_ENTUTI"),
    ("dt_saiduti", "DT_SAIDUTI"), ("vacina", "VACINA"), ("vacina_cov", "VACINA_COV"),
    ("vacinado", "VACINADO"), ("dt_evoluca", "DT_EVOLUCA"), ("dt_interna", "DT_INTERNA"),
    ("hospitalizado", "HOSPITALIZADO"), ("febre", "FEBRE"), ("tosse", "TOSSE"),
    ("dispneia", "DISPNEIA"), ("saturacao", "SATURACAO"),
)

# Raw files are read with every column as text; typing happens in cleaning.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Types of cleaned columns (lower-case names of raw, derived and curated ones) for sources that hold text only.
PROCESSED_TYPES = (
    {c.lower(): "int" for c in RAW_COLUMNS} | {c: "int" for c, _ in CURATED_COLUMNS}
    | {c.lower(): "date" for c in DATE_COLUMNS} | {c.lower(): "string" for c in TEXT_COLUMNS} | {"idade_anos": "double", "nu_idade_n": "double"}
)

# --- fixed values: job status enumeration ---
JOB_STATUSES = ("queued", "running", "succeeded", "failed")

# --- fixed values: metric names of the metrics record ---
M_GROWTH = "taxa_aumento_casos"
M_MORTALITY = "taxa_mortalidade"
M_ICU = "taxa_ocupacao_uti"
M_VACCINATION = "taxa_vacinacao"
M_TOTAL = "total_casos"
METRIC_COLUMNS = (M_GROWTH, M_MORTALITY, M_ICU, M_VACCINATION, M_TOTAL)

AUDIT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("execution_id", T.StringType()),
    T.StructField("data", T.StringType()),
])
