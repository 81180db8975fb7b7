"""Defaults. Results depend on them, so they are stated once, here."""

# Build
NEWEST_FIRST_SOURCE = 15_000
NEWEST_THIRD_SOURCE = 20_000
NEWEST_TEST_PROFILE = 10_000
MIN_PLOT_CHARS = 30
DUPLICATE_THRESHOLD = 0.85
MAX_TERMS = 25
EMBED_PLOT_CHARS = 1_500
ENCODE_BATCH = 128

# Search
RETRIEVAL_LIMIT = 50
NUM_RESULTS = 5
APP_RESULTS = 24
SIMILAR_COUNT = 6
RERANK_CHARS = 2_000
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
FULLTEXT = True
BM25_K1 = 1.2
BM25_B = 0.75

# Vector index
INDEX_MIN_ROWS = 256
SUB_VECTORS = 96

# Presentation
PAGE_SIZE = 6
MAX_PAGES = 4
PREVIEW_CHARS = 160

# Text tables
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
GENRE_NOISE = ("unknown", "back to top", "nan", "none", "")
TERM_NOISE = ("unknown", "nan", "")
GENRE_SPLIT = r"[,|\[\]/]"
TERM_CLEAN = r"[\[\]'\"]"
# Characters with case, in the regular expressions of the JVM, and all others.
CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
UNCASED = r"[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
UNKNOWN = "Unknown"
YEAR_RANGE = (1880, 2030)

# Scores are compared at this many decimal places. Sums of doubles depend on the order in
# which partitions arrive; rounding first makes every ranking repeatable.
SCORE_PLACES = 6
