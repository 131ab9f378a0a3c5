"""A scorer that counts words of a list; it stands in where no model is at hand."""

from __future__ import annotations

import pandas as pd

# The words counted and the short-text limit.
ABUSE = ("trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid")
SHORT_TEXT = 500


def lexicon_scorer():
    """Two or more listed words: 1 star; one: 2 stars; none: 3 stars if short, else 5."""
    listed = rf"(?<!\w)(?:{'|'.join(ABUSE)})(?!\w)"

    def batch(texts: pd.Series) -> pd.DataFrame:
        hits = texts.str.lower().str.count(listed)
        label = pd.Series("5 stars", index=texts.index)
        label[texts.str.len() < SHORT_TEXT] = "3 stars"
        label[hits == 1] = "2 stars"
        label[hits >= 2] = "1 star"
        return pd.DataFrame({"label": label, "score": (1 - 1 / (2.0 + hits)).round(6)})

    return batch
