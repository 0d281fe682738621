"""Sets of words that meet within groups: steps over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Meetings of words that are looked at in one go.
MEETINGS = 1 << 21


def runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that begin at ``first`` and have ``count`` places: the run of each place, and the place."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - (np.cumsum(count) - count - first)[of]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def cuts(count: np.ndarray, about: int = MEETINGS) -> list[slice]:
    """Slices of neighbours whose counts sum to about as many."""
    edges = (np.flatnonzero(np.diff(np.cumsum(count) // about)) + 1).tolist()
    return [slice(a, b) for a, b in zip([0, *edges], [*edges, len(count)], strict=True)]


def starts(ids: pa.Array, before: pa.Scalar | None = None) -> np.ndarray:
    """Whether a group begins with the row; ``before`` is the id of the row in front.  Rows without an id are groups of their own."""
    same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
    first = before is not None and before.is_valid and len(ids) > 0 and before.as_py() == ids[0].as_py()
    return np.r_[not first, ~same][: len(ids)]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of batches, sorted by their first column, in tables of whole groups: those that end in a batch, with what was held of the first one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        new = np.flatnonzero(starts(b.column(0), held[-1].column(0)[-1] if held else None)).tolist()
        if new and (held or new[-1]):
            yield pa.Table.from_batches(held + ([b.slice(0, new[-1])] if new[-1] else []))
            held = []
        held += [b.slice(new[-1] if new else 0)] if b.num_rows else []
    if held:
        yield pa.Table.from_batches(held)


def shared_words(group: np.ndarray, side: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): rows of side 0 and of side 1 of one group that have words in common, and how many; rows are sorted by group.

    ``word`` has the codes of all rows' distinct words, ``size`` of them for each row.  A group has a counter for each two of its rows."""
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((word, group[row]))
    row, word = row[order], word[order]
    key = np.cumsum(np.r_[True, (word[1:] != word[:-1]) | (group[row[1:]] != group[row[:-1]])][: len(row)]) - 1
    mine = [side[row] == s for s in (0, 1)]
    n_other = np.bincount(key[mine[1]], minlength=int(key.max(initial=-1)) + 1)
    x, y, k = row[mine[0]], row[mine[1]], key[mine[0]]
    first = (np.cumsum(n_other) - n_other)[k]
    # places of rows within their group and side, and of a group's counters
    n = [np.bincount(group[side == s], minlength=int(group.max(initial=-1)) + 1) for s in (0, 1)]
    place = np.where(side == 0, np.cumsum(side == 0) - 1 - (np.cumsum(n[0]) - n[0])[group], np.cumsum(side == 1) - 1 - (np.cumsum(n[1]) - n[1])[group])
    counters = np.cumsum(n[0] * n[1]) - n[0] * n[1]
    at_x = counters[group[x]] + place[x] * n[1][group[x]]
    met = np.zeros(int((n[0] * n[1]).sum()), "int64")
    for cut in cuts(n_other[k]):
        of, at = runs(first[cut], n_other[k[cut]])
        met += np.bincount(at_x[cut][of] + place[y[at]], minlength=len(met))
    hit = np.flatnonzero(met)
    g = np.searchsorted(counters + n[0] * n[1], hit, "right")
    rest = hit - counters[g]
    rows = [np.flatnonzero(side == s) for s in (0, 1)]
    return rows[0][(np.cumsum(n[0]) - n[0])[g] + rest // n[1][g]], rows[1][(np.cumsum(n[1]) - n[1])[g] + rest % n[1][g]], met[hit]
