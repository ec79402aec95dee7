"""Names, maps and bounds that results depend on."""

# Yearly score indicators, each on a 0-10 scale.
SCORE_INDICATORS = ("INDE", "IAA", "IEG", "IPS", "IDA", "IPP", "IPV")

# The other yearly columns of a panel.
AGE = "IDADE_ALUNO"
ORDINAL = "PEDRA"
PHASE = "FASE"
GROUP = "TURMA"
TURNING_POINT = "PONTO_VIRADA"
SCHOLARSHIP = "BOLSISTA"
TENURE = "ANOS_PM"
TARGET = "DEFASAGEM"

# Identifier names, and names that leak the target.
IDENTIFIER_NAMES = ("NOME", "NOME_COMPLETO", "ID", "MATRICULA")
LEAKAGE_NAMES = ("IAN", "NIVEL_IDEAL")

# Ordinal levels, with and without accents.
ORDINAL_LEVELS = {
    "Quartzo": 1,
    "Ágata": 2,
    "Agata": 2,
    "Ametista": 3,
    "Topázio": 4,
    "Topazio": 4,
}

# Closed ranges a record has to respect, by column stem.
CONTRACT_BOUNDS = {
    **{name: (0, 10) for name in SCORE_INDICATORS},
    AGE: (5, 25),
    PHASE: (0, 8),
    TURNING_POINT: (0, 1),
    SCHOLARSHIP: (0, 1),
    TENURE: (0, 15),
}

# Class names in reports and risk levels in predictions.
CLASS_NAMES = {0: "Sem Risco (0)", 1: "Em Risco (1)"}
RISK_LEVELS = {0: "LOW", 1: "HIGH"}

# Texts that a CSV reader takes as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "#NULL!", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Defaults of splits, folds and year detection.
SEED = 42
TEST_SIZE = 0.2
FOLDS = 5
YEAR_RANGE = (2000, 2030)
