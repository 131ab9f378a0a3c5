"""Finding the columns of a review table by name."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from opinion_spark.constants import LABEL, RATING


@dataclass(frozen=True)
class ReviewSchema:
    """Which column plays which role; ``None`` where a role is not filled."""

    text: str | None
    title: str | None
    country: str | None
    has_label: bool
    has_rating: bool

    def require_text(self) -> str:
        if self.text is None:
            raise ValueError("no column holds the review text (its name needs both 'review' and 'text')")
        return self.text

    def export_columns(self) -> list[str]:
        """Columns of the cleaned table in their fixed order, each once."""
        wanted = [self.require_text(), self.title, RATING, LABEL, self.country]
        return list(dict.fromkeys(c for c in wanted if c is not None))


def resolve_roles(columns: Iterable[str]) -> ReviewSchema:
    """The first column in table order that fits a role gets it."""
    names = list(columns)

    def pick(fits):
        return next((name for name in names if fits(name.lower())), None)

    return ReviewSchema(
        text=pick(lambda n: "review" in n and "text" in n),
        title=pick(lambda n: "title" in n or "summary" in n),
        country=pick(lambda n: "country" in n),
        has_label=LABEL in names,
        has_rating=RATING in names,
    )
