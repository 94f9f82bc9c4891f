"""Periodic runs of words: stretches that repeat a period four times or more.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal), at least ``max(SHORTEST, TIMES * q)`` words long, that no
neighbouring word extends. Every word of a run occurs ``TIMES`` times or more
in it, so a word that is rarer within its segment ends the segment; this is
repeated on the parts until nothing changes. What survives is scanned for lags:
for each power of two ``g`` the distance from every window of ``g`` words to its
next equal window. Inside a run of period ``q <= g`` the next equal window is
exactly ``q`` ahead (a nearer one would give a smaller period), and no window
beside the run has that distance, so a stretch of equal distances is a run and
gives its begin and end. The scan takes O(m log^2 m) for a segment of m words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from newslake.llm.common import row_blocks, text_buffers
from newslake.llm.wordhash import Words

#: What a run needs: periods and words.
TIMES, SHORTEST = 4, 6
BLOCK_BYTES = 1 << 20


def _ids(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    length = words.end - words.start
    offsets = np.concatenate([[0], np.cumsum(length)])
    ink = words.data[words.ink]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ink))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def surviving(ids: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may lie in a run, ascending, and the segment of each:
    ``segment`` (ascending numbers of adjoining words) is split at words that
    occur fewer than ``TIMES`` times in it, and the parts again, until stable.
    Only segments that lost a word are looked at again."""
    at, seg = np.arange(len(ids)), np.asarray(segment, np.int64)
    done_at, done_seg, base = [], [], 0
    while len(at):
        # Sorted by segment and word: runs of equal keys are the counts.
        by = np.lexsort((ids[at], seg))
        s, w = seg[by], ids[at][by]
        first = np.ones(len(by), bool)
        first[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(by)))
        often = np.empty(len(by), bool)
        often[by] = np.repeat(count, count) >= TIMES
        change = np.zeros(int(seg[-1]) + 1, bool)
        change[seg[~often]] = True
        stable = ~change[seg]
        if stable.any():
            done_at.append(at[stable])
            done_seg.append(seg[stable] + base)
            base += int(seg[-1]) + 1
        keep = often & ~stable
        at, old = at[keep], seg[keep]
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1])
        seg = np.cumsum(new) - 1
        long_enough = np.bincount(seg)[seg] >= SHORTEST
        at, seg = at[long_enough], seg[long_enough]
        if len(at):
            seg = np.cumsum(np.concatenate([[0], seg[1:] != seg[:-1]]))
    if not done_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, seg = np.concatenate(done_at), np.concatenate(done_seg)
    by = np.argsort(at, kind="stable")
    at, seg = at[by], seg[by]
    sizes = np.unique(seg, return_inverse=True, return_counts=True)
    fit = sizes[2][sizes[1]] >= SHORTEST
    return at[fit], seg[fit]


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def lag_scan(ids: np.ndarray, at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run in the segments: ``at`` are
    positions (ascending), ``segment`` the segment of each."""
    found = [np.zeros((3, 0), np.int64)]
    if not len(at):
        return tuple(found[0])
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.append(begin, len(at)))
    end = np.repeat(begin + size, size)  # of the segment, as an index into at
    place = np.arange(len(at))
    rank, g = _dense(ids[at]), 1
    alive = place  # where a window of g words begins, within its segment
    while len(alive):
        # Distance from each window to its next equal one.
        by = alive[np.argsort(rank[alive], kind="stable")]
        lag = np.zeros(len(at), np.int64)
        same = (rank[by[1:]] == rank[by[:-1]]) & (segment[by[1:]] == segment[by[:-1]])
        lag[by[:-1][same]] = at[by[1:][same]] - at[by[:-1][same]]
        lag[(lag > g) | (2 * lag <= g)] = 0
        # Stretches of equal distances at adjoining places of one segment.
        edge = np.ones(len(at), bool)
        edge[1:] = (lag[1:] != lag[:-1]) | (segment[1:] != segment[:-1])
        lo = np.flatnonzero(edge)
        hi = np.append(lo[1:], len(at))
        q = lag[lo]
        length = hi - lo - 1 + q + g
        ok = (q > 0) & (length >= np.maximum(SHORTEST, TIMES * q))
        found.append(np.stack([at[lo[ok]], length[ok], q[ok]]))
        # Windows twice as long, in segments that can hold a run of a longer period.
        roomy = alive[(alive + 2 * g <= end[alive]) & (np.repeat(size, size)[alive] >= TIMES * (g + 1))]
        pair = np.zeros(len(at), np.int64)
        pair[roomy] = _dense(rank[roomy] * (int(rank.max()) + 1) + rank[roomy + g])
        rank, alive, g = pair, roomy, 2 * g
    runs = np.concatenate(found, axis=1)
    return tuple(runs[:, np.lexsort((runs[2], runs[0]))])


def runs_of(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a column of words, by start, then
    period; ``row`` (ascending) tells the text of each word."""
    return lag_scan(ids, *surviving(ids, row))


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words a run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover[:-1]) > 0


def _joined(words: Words, picked: np.ndarray, at: np.ndarray) -> list[str]:
    """Hex digest of the ``picked`` words of each row, joined by one space;
    ``at`` bounds the rows in ``picked``. Goes forward in bounded pieces."""
    length = words.end[picked] - words.start[picked]
    total = np.concatenate([[0], np.cumsum(length + 1)])
    out = []
    for lo, hi in row_blocks(total[at], BLOCK_BYTES):
        a, b = at[lo], at[hi]
        digests = [hashlib.sha256() for _ in range(hi - lo)] if hi - lo == 1 else None
        if digests:  # one row, of any length
            for x in range(a, b, BLOCK_BYTES // 8):
                y = min(b, x + BLOCK_BYTES // 8)
                piece = _bytes(words, picked[x:y], length[x:y])
                digests[0].update(piece[: -1] if y == b else piece)
            out.append(digests[0].hexdigest())
            continue
        pieces = _bytes(words, picked[a:b], length[a:b])
        for r in range(lo, hi):
            x, y = total[at[r]] - total[a], total[at[r + 1]] - total[a]
            out.append(hashlib.sha256(pieces[x: max(x, y - 1)]).hexdigest())
    return out


def _bytes(words: Words, picked: np.ndarray, length: np.ndarray) -> bytes:
    """The picked words, each followed by a space."""
    step = length + 1
    out = np.full(int(step.sum()), 32, np.uint8)
    begin = np.cumsum(step) - step
    inner = np.ones(len(out), bool)
    inner[begin + length] = False
    shift = np.repeat(words.start[picked] - begin, length)
    where = np.flatnonzero(inner)
    out[where] = words.data[where + shift]
    return out.tobytes()


FIELDS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256"]


def find_runs(docs: DataFrame, text_col: str = "text", rewrite: Callable[[pa.RecordBatch, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``docs`` with its periodic runs: ``n_words``, ``n_runs``; ``start``,
    ``length``, ``period`` and ``exponent_milli`` of the longest run (of equal
    lengths the first, then the smaller period; null without a run); ``runs``,
    an array of structs (start, length, period) by start, then period;
    ``runs_sha256`` (of ``start,length,period`` and a line feed for each);
    ``collapsed_sha256`` of the words left when each run keeps its first period
    only, joined by one space.

    ``rewrite(batch, at)`` may give, for the rows of a batch whose words are
    ``at[r] .. at[r + 1]``, the number of the word that takes each word's place.
    Null and empty texts have no words. Whole texts are read, in blocks of
    bounded bytes (a longer text is a block of its own). There is no shuffle:
    an empty table gives an empty one, repeated rows are rows of their own.
    A column of ``docs`` with one of the new names (in any case) is replaced."""
    run_type = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
    kept = [f for f in docs.schema.fields if f.name.lower() not in FIELDS]
    if text_col.lower() in FIELDS:
        raise ValueError(f"rename {text_col}: the result has a column of that name")
    types = {"runs": run_type, "runs_sha256": StringType(), "collapsed_sha256": StringType()}
    schema = StructType(kept + [StructField(c, types.get(c, LongType())) for c in FIELDS])
    names = [f.name for f in kept]

    def run(batches):
        for whole in batches:
            offsets = text_buffers(whole.column(text_col))[1]
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                b = whole.slice(lo, hi - lo)
                columns = _describe(b, text_col, rewrite)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *columns], schema=pa.schema(
                    [b.schema.field(c) for c in names] + [pa.field(c, x.type) for c, x in zip(FIELDS, columns)]))
    return docs.mapInArrow(run, schema)


def _describe(b: pa.RecordBatch, text_col: str, rewrite) -> list[pa.Array]:
    words = Words(*text_buffers(b.column(text_col)), lower=False)
    n, at = len(words.start), words.at
    picked = np.arange(n) if rewrite is None else rewrite(b, at)
    start, length, period = runs_of(_ids(words)[picked] if n else np.zeros(0, np.int64), words.row)
    drop = dropped(n, start, length, period)
    kept = np.flatnonzero(~drop)
    collapsed = _joined(words, picked[kept], np.searchsorted(kept, at))
    row = words.row[start] if n else start
    local = start - at[row] if n else start
    bounds = np.searchsorted(row, np.arange(words.rows + 1))
    best = np.full(words.rows, -1)
    by = np.lexsort((period, local, -length, row))
    lead = by[np.concatenate([[True], row[by][1:] != row[by][:-1]])] if len(by) else by
    best[row[lead]] = lead
    has = best >= 0
    lines = [b""] * words.rows
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        x, y = bounds[r], bounds[r + 1]
        lines[r] = "".join(f"{s},{l},{q}\n" for s, l, q in zip(local[x:y].tolist(), length[x:y].tolist(), period[x:y].tolist())).encode()

    def long(values: np.ndarray) -> pa.Array:
        out = np.zeros(words.rows, np.int64)
        out[has] = values[best[has]]
        return pa.array(out, mask=~has)
    structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (local, length, period)], ["start", "length", "period"])
    return [pa.array(np.diff(at), pa.int64()), pa.array(np.diff(bounds), pa.int64()), long(local), long(length), long(period),
            long(1000 * length // np.maximum(period, 1)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
            pa.array([hashlib.sha256(x).hexdigest() for x in lines]), pa.array(collapsed, pa.string())]


def planted(hash_col: str) -> Callable[[pa.RecordBatch, np.ndarray], np.ndarray]:
    """A ``rewrite`` that gives one text in ten a periodic end, by the unsigned
    32-bit hash ``h`` in ``hash_col``: with ``h % 10 == 0``, ``g = h // 10`` and
    ``n`` words, word ``i >= a`` becomes word ``a + (i - a) % p`` where
    ``a = g % n`` and ``p = 1 + (n - a) // (3 + g % 8)``. A null hash leaves the
    text as it is."""
    def rewrite(b: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        out = np.arange(int(at[-1]))
        column = b.column(hash_col)
        h = column.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.diff(at)
        for r in np.flatnonzero((h % 10 == 0) & (n > 0)).tolist():
            g, size = int(h[r]) // 10, int(n[r])
            a = g % size
            p = 1 + (size - a) // (3 + g % 8)
            out[at[r] + a: at[r + 1]] = at[r] + a + np.arange(size - a) % p
        return out
    return rewrite
