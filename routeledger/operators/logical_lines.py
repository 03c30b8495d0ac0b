"""Logical lines: physical lines joined while parentheses are open.

A file is one row, so it is folded where it is read, in one narrow pass over small
Arrow batches: neither content nor lines are shuffled or sorted. The rules that read
the logical lines are Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, physical_lines

FILES = 256  # files turned into Python strings at a time
SCHEMA = "repo string, rel_path string, start_line int, text string"


def fold_lines(lines: list[str], fluent: bool = False) -> Iterator[tuple[int, str]]:
    """``(start_line, text)`` of each logical line; the balance restarts with each."""
    pieces: list[str] = []
    start = balance = 0
    for number, raw in enumerate(lines, 1):
        bare = raw.strip(WHITE_SPACE)
        chained = fluent and bare.startswith(".")
        if number == 1 or (balance <= 0 and not chained):
            if pieces:
                yield start, "".join(pieces).strip(WHITE_SPACE)
            pieces, start, balance = [raw], number, 0
        elif balance > 0:
            pieces += [" ", bare]
        else:
            # White space before the dot goes, also that of blank lines.
            while pieces and not (kept := pieces.pop().rstrip(WHITE_SPACE)):
                pass
            pieces += [kept, bare]
        balance += raw.count("(") - raw.count(")")
    if start:
        yield start, "".join(pieces).strip(WHITE_SPACE)


def logical_lines(files: DataFrame, fluent: bool = False) -> DataFrame:
    """``(repo, rel_path, start_line, text)`` for every logical line of every file.

    With ``fluent`` a line that begins with a dot continues the one before it and
    is joined to it without a space. Null content has no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                found = [list(fold_lines(x or [], fluent)) for x in part.column(2).to_pylist()]
                owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)),
                        part.column(1).take(pa.array(owner)),
                        pa.array([s for x in found for s, _ in x], pa.int32()),
                        pa.array([t for x in found for _, t in x], pa.string()),
                    ],
                    names=["repo", "rel_path", "start_line", "text"],
                )

    lines = files.select("repo", "rel_path", physical_lines(F.col("content")).alias("lines"))
    return lines.mapInArrow(run, SCHEMA)
