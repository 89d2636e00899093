"""Where the words of a text stand, one Arrow batch at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# Ship this function with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows handed on at a time.
_ROWS = 1 << 16


def token_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_ord, token, at) from (page_ord, norm): each distinct token of a page with its first characters' places, from 1."""
    pages: list[int] = []
    tokens: list[str] = []
    ends: list[int] = [0]
    places: list[int] = []

    def rows() -> pa.RecordBatch:
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(tokens, pa.string()), at], names=["page_ord", "token", "at"])

    for batch in batches:
        for page, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: dict[str, list[int]] = {}
            place = 1
            for token in (norm or "").split(" "):
                if token:
                    found.setdefault(token, []).append(place)
                place += len(token) + 1
            for token, at in found.items():
                pages.append(page)
                tokens.append(token)
                places.extend(at)
                ends.append(len(places))
            if len(tokens) >= _ROWS:
                yield rows()
                pages, tokens, ends, places = [], [], [0], []
    if tokens:
        yield rows()
