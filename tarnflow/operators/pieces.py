"""A section or chunk inside a task."""

from __future__ import annotations

from typing import NamedTuple


class Piece(NamedTuple):
    """A section or chunk with its heading and the links of its images."""

    heading: str | None
    content: str
    images: tuple[str, ...] = ()

    def plus(self, other: Piece) -> Piece:
        """This piece and the ``other`` after it under its heading, with all their images."""
        return Piece(self.heading, f"{self.content}\n\n{other.content}", tuple(sorted({*self.images, *other.images})))
