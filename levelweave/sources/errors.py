"""What can be wrong with a matrix file."""

from __future__ import annotations


class MatrixFileError(ValueError):
    """A matrix file that cannot be read; ``path`` names it."""

    def __init__(self, path: str, problem: str):
        super().__init__(f"{path}: {problem}")
        self.path, self.problem = path, problem


class HeaderError(MatrixFileError):
    """The banner or the line of sizes is not as the format says."""


class FormatError(MatrixFileError):
    """A kind of matrix that is not supported."""


class EntriesError(MatrixFileError):
    """Entries that are broken, out of range or not as many as announced."""
