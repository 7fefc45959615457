"""Arrow batches as Python values, a bounded part at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that become Python objects at once: a batch may hold thousands of long texts.
STEP = 128


def values(column: pa.Array, step: int = STEP) -> Iterator:
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()
