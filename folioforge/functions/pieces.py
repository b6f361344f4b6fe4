"""Functions of a row in Python, over Arrow batches, whose results are handed on piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Characters of results that are handed on together.
PIECE_CHARS = 1_000_000


def size(value) -> int:
    """The characters in a row's result, and one for anything else in it."""
    if isinstance(value, str):
        return len(value)
    if isinstance(value, dict):
        value = value.values()
    elif not isinstance(value, (list, tuple)):
        return 1
    return sum(map(size, value))


def in_pieces(batches: Iterator, row: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """row(...) of each row, handed on whenever the results have PIECE_CHARS: those of a whole batch can take many times its memory."""
    for batch in batches:
        out, chars = [], 0
        for values in zip(*(batch if isinstance(batch, tuple) else (batch,)), strict=True):
            out.append(row(*(v.as_py() for v in values)))
            chars += size(out[-1])
            if chars >= PIECE_CHARS:
                yield pa.array(out, kind)
                out, chars = [], 0
        if out:
            yield pa.array(out, kind)
