"""Values that results depend on: label names, patterns, thresholds and formats.

Nothing here is logic. Each block is a fixed value; change it only when the
expected results change.
"""

# The four combined labels, in canonical order.
LABELS = ("Neither", "Cancer Only", "Diabetes Only", "Both")

# Share of each class held out by the per-label split.
HOLD_OUT_FRACTIONS = {
    "Neither": 0.25,
    "Cancer Only": 0.30,
    "Diabetes Only": 0.67,
    "Both": 0.50,
}

# Seed, stratified hold-out share and three-way split ratios.
SEED = 42
VALIDATION_FRACTION = 0.2
SPLIT_RATIOS = {"train": 0.6, "validation": 0.2, "test": 0.2}

# Strings that a CSV cell may hold to say "missing".
MISSING_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Keyword patterns of the routing model.
DIABETES_KEYWORDS = (
    r"\bT2DM\b",
    r"\bT1DM\b",
    r"\btype\s*[12]\s*diabetes(?:\s*mellitus)?\b",
    r"\bdiabetes\s*mellitus\b",
    r"\bhistory\s*of\s*diabetes\b",
    r"\bdiabetic\b",
    r"\binsulin\s*(?:aspart|therapy|dependent|glargine|lispro)\b",
    r"\bmetformin\b",
    r"\bglipizide\b",
    r"\bglyburide\b",
)
CANCER_KEYWORDS = (
    r"\bcancer\b",
    r"\bcarcinoma\b",
    r"\bsarcoma\b",
    r"\bmelanoma\b",
    r"\blymphoma\b",
    r"\bleukemia\b",
    r"\bmalignancy\b",
    r"\bmalignant\b",
    r"\bneoplasm\b",
    r"\bchemotherapy\b",
    r"\boncolog(?:y|ist)\b",
    r"\bmetastatic\b",
    r"\btumor\b",
    r"\bMDS\s*with\s*excess\s*blasts\b",
)

# Looser, left-bounded patterns of the keyword prevalence table.
DIABETES_PREVALENCE = (
    r"\bdiabetes",
    r"\bdiabetic",
    r"\bglucose",
    r"\binsulin",
    r"\bmetformin",
    r"\bHbA1c",
)
CANCER_PREVALENCE = (
    r"\bcancer",
    r"\bcarcinoma",
    r"\bmalignant",
    r"\bchemotherapy",
    r"\boncology",
    r"\btumor",
    r"\bneoplasm",
)

# Rule votes.
ABSTAIN, NEGATIVE, POSITIVE = -1, 0, 1

# Voting rules as (rule, vote, patterns).
DIABETES_VOTING_RULES = (
    ("dm_explicit", POSITIVE, (
        r"\bdiabetes mellitus\b", r"\btype\s*(1|2)\s*diabetes\b", r"\bT2DM\b", r"\bT1DM\b")),
    ("dm_insulin_dependent", POSITIVE, (
        r"\binsulin[-\s]?dependent diabetes\b", r"\bIDDM\b")),
    ("dm_complication", POSITIVE, (
        r"\bdiabetic neuropathy\b", r"\bdiabetic retinopathy\b", r"\bdiabetic nephropathy\b")),
    ("dm_negation", NEGATIVE, (
        r"\bno (history of )?diabetes\b", r"\bdenies diabetes\b")),
    ("dm_insipidus_guard", NEGATIVE, (
        r"\bdiabetes insipidus\b", r"\bDI\b")),
)
CANCER_VOTING_RULES = (
    ("cancer_pathology_terms", POSITIVE, (
        r"\bcarcinoma\b", r"\badenocarcinoma\b", r"\bsarcoma\b", r"\blymphoma\b",
        r"\bleukemia\b", r"\bmyeloma\b")),
    ("cancer_metastatic", POSITIVE, (
        r"\bmetastatic\b", r"\bmetastasis\b")),
    ("cancer_history", POSITIVE, (
        r"\bhistory of (.* )?cancer\b", r"\bhx of (.* )?cancer\b")),
    ("cancer_negation", NEGATIVE, (
        r"\bno evidence of malignancy\b", r"\bmalignancy ruled out\b", r"\bbenign\b")),
    ("cancer_histiocytic", POSITIVE, (
        r"\bLCH\b", r"\bLangerhans\b", r"\bhistiocytosis\b")),
)

# A vote model's label threshold, and "high confidence" for it.
VOTE_LABEL_THRESHOLD = 0.80
VOTE_EPOCHS = 500

# Headers kept as columns, and the synonym merged into its twin.
NOTE_HEADERS = (
    "Age", "Gender", "Sex",
    "Diagnosis", "Admitting Diagnosis", "Discharge Diagnosis",
    "Admission Diagnosis", "Final Diagnosis",
    "Hospital Course", "History of Present Illness", "Chief Complaint",
    "Medical History",
    "Discharge Medications",
    "Treatment",
    "Follow-up",
)
HEADER_SYNONYM = ("Gender", "Sex")

# Pseudo-labelling thresholds and sample size.
POSITIVE_AT_LEAST = 0.6
NEITHER_BELOW = 0.2
RELAXED_NEITHER_BELOW = 0.3
NEITHER_SAMPLE = 200

# Names of where a training label came from.
SOURCE_LABELED = "labeled"
SOURCE_MODEL = "ml_synthetic"
SOURCE_RULES = "regex"
SOURCE_NEITHER = "ml_neither"

# Reasons given by the routing model.
REASON_BOTH_KEYWORDS = "REGEX: Both keywords found"
REASON_DIABETES_KEYWORD = "REGEX: Diabetes keyword found"
REASON_CANCER_KEYWORD = "REGEX: Cancer keyword found"
REASON_AGREEMENT = "AGREEMENT: Both predict %s"
REASON_BASELINE = "BASELINE strength: Trained on balanced 'Neither' data"
REASON_SEMISUP = "SEMI-SUP strength: More training data for diseases"
REASON_VOTE = "WEIGHTED VOTE: %s wins"

# Vote weights of the last routing tier.
BASELINE_NEITHER_WEIGHT = 1.5
SEMISUP_POSITIVE_WEIGHT = 2.0

# Retrieval size, prompt text limit and snippet length.
TOP_K = 5
PROMPT_TEXT_CHARS = 2000
SNIPPET_CHARS = 200

# How a retrieved case is shown, from its number, score, label, both flags and snippet.
CASE_FORMAT = (
    "Similar Case %d (Similarity: %.3f):\n"
    "  Label: %s\n"
    "  Has Cancer: %s\n"
    "  Has Diabetes: %s\n"
    "  Text snippet: %s\n"
)

# Lines of the readable report.
REPORT_RULE = "=" * 80
REPORT_TOTAL = "Total predictions: %d"
REPORT_CORRECT = "Correct predictions: %d"
REPORT_ACCURACY = "Accuracy: "
REPORT_CLASSES = "Per-class performance:"
REPORT_CLASS = "  {label:20s}: %d/%d = "
REPORT_CONFIDENCE = "Confidence statistics:"
REPORT_INITIAL = "  Average Initial Confidence: %.3f"
REPORT_FINAL = "  Average Final Confidence:   %.3f"
REPORT_CHANGES = "Decision changes:"
REPORT_CHANGED = "  Cases where final differed from initial: %d ("

# Embedding size and batch.
EMBEDDING_DIM = 1536
EMBEDDING_BATCH = 100

# Metadata of a stored case that lacks it.
DEFAULT_CASE = {"flag": 0.0, "label": "Neither", "id": "unknown"}

# Fields of a first answer as (column, line prefix, kind).
FIRST_ANSWER_FIELDS = (
    ("classification", "Classification:", "text"),
    ("has_cancer", "Has Cancer:", "flag"),
    ("has_diabetes", "Has Diabetes:", "flag"),
    ("confidence", "Confidence:", "confidence"),
    ("reasoning", "Reasoning:", "text"),
)
# Fields of a final answer.
FINAL_ANSWER_FIELDS = (
    ("final_classification", "Final Classification:", "text"),
    ("has_cancer", "Has Cancer:", "flag"),
    ("has_diabetes", "Has Diabetes:", "flag"),
    ("final_confidence", "Final Confidence:", "confidence"),
    ("decision_rationale", "Decision Rationale:", "text"),
)
# Extra field of a strictly parsed first answer.
KEY_EVIDENCE_FIELD = ("key_evidence", "Key Evidence:", "text")

# Defaults by column for fields an answer leaves out.
ANSWER_DEFAULTS = {
    "classification": "Neither",
    "final_classification": "Neither",
    "has_cancer": 0.0,
    "has_diabetes": 0.0,
    "confidence": 0.5,
    "final_confidence": 0.5,
    "reasoning": "",
    "decision_rationale": "",
}
MISSING_REASONING = "N/A"

# Confidence above which a disagreement is a strong one.
HIGH_CONFIDENCE = 0.8
# Confidence below which retrieval outweighs the first answer.
LOW_CONFIDENCE = 0.6

# Columns of the routing prediction table.
ROUTING_COLUMNS = (
    "patient_identifier", "text", "has_cancer", "has_diabetes", "true_label",
    "predicted_label", "correct", "decision_reason", "confidence",
    "baseline_pred", "baseline_conf", "semisup_pred", "semisup_conf",
    "has_diabetes_kw", "has_cancer_kw",
)
# Columns of the retrieval prediction table.
RETRIEVAL_COLUMNS = (
    "patient_id", "text", "true_label", "true_has_cancer", "true_has_diabetes",
    "initial_classification", "final_classification", "pred_has_cancer",
    "pred_has_diabetes", "initial_confidence", "final_confidence", "correct",
    "correct_cancer", "correct_diabetes", "decision_rationale",
)

# Settings of the declared text features and estimators.
TFIDF = {"max_features": 5000, "ngrams": (1, 2), "min_df": 2, "max_df": 0.95}
LOGISTIC = {"max_iter": 1000, "C": 1.0}
FOREST = {"trees": 100, "depth": 20}
SPREADING = {"neighbours": 5, "rounds": 10}
SOFT_VOTE_WEIGHTS = {"logistic": 0.4, "random_forest": 0.4, "semisup": 0.2}
