"""Closed vocabularies and numeric constants shared by every job.

Everything in this module is a fixed value: results are only right when these
words and numbers are exactly these.
"""

# --- enums ---------------------------------------------------------------
PROCESSING_STATUS = ("queued", "processing", "ready", "partially_ready", "failed")
SECTION_ROLE = (
    "abstract", "introduction", "related_work", "method", "experiments", "results",
    "discussion", "conclusion", "references", "appendix", "unknown",
)
ACTIVITY = ("FREE", "EXPLAINING", "QUIZ_PENDING", "AWAITING_CLARIFICATION")
EXPLANATION_STYLE = (
    "formal", "intuitive", "numerical", "analogical", "visual_verbal", "code", "contrastive",
)
SIGNAL_TYPE = (
    "explicit_confusion", "implicit_confusion", "explicit_understanding", "quiz_correct",
    "quiz_partial", "quiz_incorrect", "applied_correctly", "user_stated_known",
    "user_stated_unknown", "reinforcement",
)
SIGNAL_SOURCE = ("explicit", "implicit", "quiz", "user_stated", "system")
RELATIONSHIP_TYPE = (
    "prerequisite_of", "component_of", "specialisation_of", "contrasts_with",
    "equivalent_notation", "co_occurs_with",
)
DISCOVERY_METHOD = ("embedding", "model", "user_stated")
GRADE = ("correct", "partial", "incorrect")
FEEDBACK_TYPE = (
    "helpful", "not_helpful", "too_basic", "too_advanced", "wrong", "style_preference",
)
GROUNDING_STATUS = ("grounded", "no_evidence", "degraded", "n/a")
MESSAGE_ROLE = ("user", "assistant", "summary")
VERDICT = ("same", "related", "distinct")
DIFFICULTY = ("easy", "medium", "hard")

# --- learner state -------------------------------------------------------
SOURCE_OF_SIGNAL = {
    "explicit_confusion": "explicit", "explicit_understanding": "explicit",
    "implicit_confusion": "implicit", "applied_correctly": "implicit",
    "quiz_correct": "quiz", "quiz_partial": "quiz", "quiz_incorrect": "quiz",
    "user_stated_known": "user_stated", "user_stated_unknown": "user_stated",
    "reinforcement": "system",
}
WEIGHT_OF_SOURCE = {
    "quiz": 1.0, "user_stated": 0.9, "explicit": 0.8, "implicit": 0.4, "system": 0.0,
}
WEIGHT_OF_PAIR = {("applied_correctly", "implicit"): 0.75}
TARGET_OF_SIGNAL = {
    "explicit_confusion": 0.0, "implicit_confusion": 0.15, "explicit_understanding": 1.0,
    "quiz_correct": 1.0, "quiz_partial": 0.5, "quiz_incorrect": 0.0,
    "applied_correctly": 1.0, "user_stated_known": 1.0, "user_stated_unknown": 0.0,
    "reinforcement": 0.6,
}
ASSISTED_TARGET = 0.70
ASSISTED_SIGNALS = ("explicit_understanding", "user_stated_known")
UNKNOWN_TARGET = 0.50
RESOLVING = ("explicit_understanding", "user_stated_known", "quiz_correct", "applied_correctly")
STRUGGLES = (
    "explicit_confusion", "implicit_confusion", "user_stated_unknown", "quiz_incorrect",
    "quiz_partial",
)
CONFIDENCE_HALF_WEIGHT = 0.70
CONFIDENCE_FLOOR = 0.30
HALF_LIFE_DAYS = 30.0
DECAY_FLOOR = 0.25
WEAK_BELOW = 0.40
SMALLINT_MAX = 32767
SIGNAL_OF_GRADE = {
    "correct": "quiz_correct", "partial": "quiz_partial", "incorrect": "quiz_incorrect",
}

# --- gates ---------------------------------------------------------------
GAP_MULTIPLIER = {"low": 2.0, "normal": 1.0, "high": 0.5}
CALLBACK_MIN_GAP = 5
CHECK_MIN_GAP = 4
CHECK_SKIP_SCORE = 0.85
DEPTH_LEVELS = ("introductory", "normal", "detailed", "expert")
PREFERENCE_FEEDBACK = ("too_basic", "too_advanced", "style_preference")

# --- canonicalisation ----------------------------------------------------
AMBIGUOUS_FROM = 0.72
MERGE_FROM = 0.85
RELATE_FROM = 0.70
PREREQUISITE_CONFIDENCE = 0.7

# --- documents -----------------------------------------------------------
MAX_UPLOAD_BYTES = 30 * 1024 * 1024
MAX_PAGES = 200
MIN_FONT = 4.0
HIDDEN_RENDER_MODE = 3
WHITE_DISTANCE = 24
READABLE_CHARS = 40
MIN_READABLE_RATIO = 0.10
PERMANENT_ERRORS = (
    "pdf_encrypted", "pdf_corrupt", "pdf_not_extractable", "original_missing",
    "no_sections", "no_chunks",
)
INJECTION_PATTERNS = (
    r"ignore (?:all |the )?(?:previous|prior|above) instructions",
    r"disregard (?:all |the )?(?:previous|prior|above)",
    r"you are now",
    r"system prompt",
    r"reveal (?:your|the) (?:prompt|instructions)",
    r"grant (?:me |the user )?access",
    r"</?(?:system|assistant|user)>",
)
HEADING_NUMBERED = r"^\s{0,3}((?:\d+|[A-Z])(?:\.\d+){0,3})\.?\s+([^\n]{2,120})$"
HEADING_ROMAN = r"^\s{0,3}([IVXLC]{1,6})\.\s+([^\n]{2,120})$"
HEADING_NUMBER_ONLY = r"^\s{0,3}(\d+(?:\.\d+){0,3})\.?\s*$"
BARE_HEADINGS = (
    "abstract", "introduction", "background", "related work", "method", "methods",
    "methodology", "approach", "experiments", "experimental setup", "evaluation", "results",
    "discussion", "analysis", "conclusion", "conclusions", "references", "bibliography",
    "acknowledgements", "acknowledgments", "appendix",
)
MATH_SYMBOLS = "=≤≥∑∏∫√±∈≈∼"
MATH_LETTER_SHARE = 0.75
HEADING_WORDS = 14
ROLE_PATTERNS = (
    (r"related\s+work|prior\s+work|background", "related_work"),
    (r"experimental\s+setup|experiments?|evaluation|setup", "experiments"),
    (r"results?|findings", "results"),
    (r"discussion|analysis|ablation", "discussion"),
    (r"conclusions?|future\s+work|summary", "conclusion"),
    (r"references?|bibliography", "references"),
    (r"appendix|supplementary|supplemental", "appendix"),
    (r"introduction", "introduction"),
    (r"abstract", "abstract"),
    (r"methods?|methodology|approach|model|architecture|our\s+\w+", "method"),
)
CHUNK_TARGET = 1400
CHUNK_MAX = 8000
CHUNK_MIN = 120
CHUNK_OVERLAP = 180
ABBREVIATIONS = (
    "et al", "e.g", "i.e", "cf", "Fig", "Eq", "Sec", "Tab", "vs", "approx", "Dr", "Prof",
)
ROLE_WEIGHT = {"abstract": 3, "introduction": 2, "method": 3, "results": 1}
STOP_WORDS = tuple(
    """
    a about above after again all also an and any approach are as at
    based be been before being below between both but by can could did
    do does down during each few for from further had has have he her
    here his how i if in into is it its just may me method might model
    models more most must my no not of off on once only or other our out
    over own paper results same she should show shows so some such than
    that the their then there these they this those to too under up use
    used using very was we were what when where which while who whom why
    with without would you your
    """.split()
)
MAX_CANDIDATES = 20

# --- retrieval and history ----------------------------------------------
DEFAULT_TOP_K = 8
MAX_TOP_K = 10
QUERY_CHARS = 500
FLOOR_OF_MODEL = {"embed-active": 0.58, "hashing": 0.25}
RETENTION_DAYS = 30
HISTORY_TOKENS = 3000
MESSAGE_CHARS = 32000
EMBED_BATCH = 20
APPEND_ONLY = ("turns", "observations", "quiz_attempts")
IMMUTABLE = ("messages",)
