"""Values shared by the whole library."""

# The three sentiment classes, in report order, and their
# display names.
CLASSES = (-1, 0, 1)
CLASS_NAMES = {-1: "Négatif", 0: "Neutre", 1: "Positif"}

# Column names recognised by exact match.
LABEL = "label"
RATING = "numeric_rating"

# Fixed value: the seed of every draw.
SEED = 42

# Names of the pre-trained models that may have made scores.
MODEL_NAMES = (
    "cmarkea/distilcamembert-base-sentiment",
    "cardiffnlp/twitter-xlm-roberta-base-sentiment",
    "nlptown/bert-base-multilingual-uncased-sentiment",
)
