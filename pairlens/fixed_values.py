"""Word lists, patterns, thresholds and text formats that results depend on.

Everything that a caller may want to replace is also a parameter of the operator using it.
"""

# Labels.
LABELS = ("masculine", "feminine", "ambiguous")
PARSE_ERROR = "parse_error"
NOT_FOUND = "not_found"
PREDICTION_LABELS = LABELS + (PARSE_ERROR, NOT_FOUND)
VARIANTS = ("source", "masculine", "feminine")
EXPECTED_LABEL = {"source": "ambiguous", "masculine": "masculine", "feminine": "feminine"}

# Column names of the wide corpus, variant -> (sentence, referent).
VARIANT_COLUMNS = {
    "source": ("EN_source_sentence", "referent"),
    "masculine": ("EN_masculine_sentence", "masc_referent"),
    "feminine": ("EN_feminine_sentence", "fem_referent"),
}

# Rewrite strategies, display names and cue groups.
STRATEGY_NAMES = {
    "referent_swap": ("lexical swap", "local"),
    "pronoun_swap": ("pronoun rewrite", "local"),
    "pronoun_insertion": ("possessive tag", "local"),
    "context_modifier": ("distal noun cue", "local"),
    "relational_insertion": ("kin appositive", "cross"),
    "title_insertion": ("title appositive", "cross"),
    "sir_maam": ("vocative address", "cross"),
    "adjective": ("gender adjective", "local"),
    "appositive_dash": ("dashed appositive", "local"),
}
STRATA_NAMES = {"local": "LOCAL (all)", "cross": "CROSS-CLAUSE (all)"}
STRATA_TOTAL = "TOTAL"
POOLED_SOURCE = "(source rows - ambiguous)"

# Pronoun and marker lists.
GENDERED_PRONOUNS = ("he", "she", "his", "her", "him", "himself", "herself", "hers")
NEUTRAL_PRONOUNS = ("they", "their", "them", "themselves", "theirs")
FIRST_PERSON_MARKERS = ("i'm", "i am", "i've", "i'll", "i had", "i was", "as a ")
VOCATIVE_OPENERS = ("Yes", "Hey", "Look", "Listen", "Oh", "No", "Well", "Please")
SECOND_PERSON = ("you", "you're", "you've", "you'll", "you'd")
FORBIDDEN_SWAP_PAIRS = (("hero", "heroine"), ("master", "mistress"), ("confidant", "confidante"))

# Windows and thresholds.
MULTI_SENTENCE_TOKENS = 30
PRE_GENDERED_WINDOW = 5
NEUTRAL_PRONOUN_WINDOW = 10
FIRST_PERSON_DISTANCE = 50
LOW_GRAMMATICALITY = 2
EDIT_HARD_LIMIT = 8
EDIT_SOFT_LIMIT = 5
ACCEPT_THRESHOLD = 4.0
MAX_RETRIES = 5
CONFIDENT = 4
APPOSITIVE_WARNING_SHARE = 0.15

# Validation patterns.
TITLE_ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "St")
PERSON_SUFFIXES = ("man", "woman", "boy", "girl", "lady", "gentleman")
CONTRACTIONS = (("I", "m"), ("you", "re"), ("don", "t"), ("won", "t"), ("can", "t"), ("I", "ve"), ("I", "ll"))

# Rotation pools.
SURNAMES = ("Smith", "Davis", "Chen", "Fitzgerald", "Johnson", "Garcia",
            "Kim", "Patel", "Thompson", "Nguyen", "Brown", "Martinez")
MALE_FIRST_NAMES = ("James", "David", "Michael", "Robert", "Thomas", "William",
                    "Charles", "Daniel", "Matthew", "Andrew", "Joseph", "Kevin")
FEMALE_FIRST_NAMES = ("Sarah", "Emma", "Jennifer", "Maria", "Jessica", "Laura",
                      "Elizabeth", "Rebecca", "Anna", "Amanda", "Rachel", "Catherine")
KIN_PAIRS = (("brother", "sister"), ("uncle", "aunt"), ("father", "mother"),
             ("son", "daughter"), ("nephew", "niece"))

# Rubric criteria, evaluation columns and review column order.
RUBRIC = ("referent_disambiguated", "correctness", "naturalness", "no_extra_sentence", "consistency")
RUBRIC_COLUMNS = tuple(f"eval_{k}" for k in RUBRIC)
SAMPLE_RUBRIC = ("minimality", "naturalness", "semantic_preservation", "gender_clarity", "consistency")
CLEARED_ON_RETRY = RUBRIC_COLUMNS + (
    "eval_issues", "accepted", "eval_strategy_label", "eval_reject", "eval_pos_change", "eval_suggestion")
REVIEW_COLUMNS = (
    "referent", "EN_source_sentence", "masc_referent", "EN_masculine_sentence",
    "fem_referent", "EN_feminine_sentence", "disambiguation_strategy", "eval_strategy_label",
    "recommended_strategy", "eval_issues", "eval_suggestion", "eval_referent_disambiguated",
    "eval_correctness", "eval_naturalness", "eval_no_extra_sentence", "eval_consistency",
    "eval_pos_change", "eval_reject", "symbolic_checks_passed", "symbolic_check_failures",
    "accepted", "retry_count")

# Canned reasoning per gold label.
CANNED_REASON = {
    "masculine": "the sentence contains a male-marking signal (title, pronoun, or gendered noun) bound to the referent",
    "feminine": "the sentence contains a female-marking signal (title, pronoun, or gendered noun) bound to the referent",
    "ambiguous": "no gendered title, pronoun, or noun in the sentence reveals the referent's gender",
}
CANNED_CONFIDENCE = 5

# Classification conditions; the open one asks for a list of referents.
CONDITIONS = ("zero_shot", "few_shot", "few_shot_full", "few_shot_v3", "few_shot_v4",
              "few_shot_v5", "few_shot_v6", "few_shot_v7", "zero_shot_identify")
OPEN_CONDITIONS = ("zero_shot_identify",)

# Human review ratings.
RATINGS = ("good", "meh", "bad")
OK_RATINGS = ("good", "meh")
UNRATED = "(unrated)"

# Request token budgets.
MAX_TOKENS = {"gen": 1024, "eval": 256, "retry": 1024, "gram": 64, "cls": 200}

# Reasoning texts that show a neutral reading.
NEUTRAL_READING = ("gender-neutral", "neutral", "no gendered")
