"""Fixed values of the methods (they must stay as stated for results to agree).

# ---- fixed values ----------------------------------------------------------------------
DEMOG_SCALAR          2.0    demographic confidence multiplier
GENDER_SHARE          0.95   share of member-rows of one gender that makes a condition
                             gender-specific (inclusive)
POPULAR_TOP           30     popular conditions kept per class
POPULAR_PER_MEMBER    15     popular conditions kept per member and class
EVAL_RANKS            15     ranks per member and class in the hold-out evaluation
EXPORT_RANKS          10     recommendations exported per member
RECALL_K              10     rank cut of the single-number accuracy
REFERENCE_CANDIDATES  100    candidates per member before filtering in the original method
                             (evaluation); 30 for the export
ALS_RANK, ALS_ALPHA, ALS_REG, ALS_ITERATIONS   50, 100.0, 7.0, 10; non-negative factors
CLASS_LEVELS          "1" -> "Chronic", "0" -> "Non-Chronic"
MODEL_LEVELS          "recommender" -> "Matrix Factorization", "popular" -> "Popularity"
"""

DEMOG_SCALAR = 2.0
GENDER_SHARE = 0.95
POPULAR_TOP = 30
POPULAR_PER_MEMBER = 15
EVAL_RANKS = 15
EXPORT_RANKS = 10
RECALL_K = 10
REFERENCE_CANDIDATES = 100
REFERENCE_EXPORT_CANDIDATES = 30
ALS_RANK = 50
ALS_ALPHA = 100.0
ALS_REG = 7.0
ALS_ITERATIONS = 10
ALS_NONNEGATIVE = True
CLASS_LEVELS = [("1", "Chronic"), ("0", "Non-Chronic")]
MODEL_LEVELS = [("recommender", "Matrix Factorization"), ("popular", "Popularity")]
