"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text is cut where no piece can reach across: before each run of the space
mark and around characters that no longer piece holds. Of the parts of a
batch, each distinct one is encoded once. Parts of equal length advance
together: at each end position, the hashes of all substrings that end there
probe the sorted hashes of the pieces, the best sum of scores is a vectorised
maximum, and the length that gave it is stored as backpointer.

The result is the segmentation with the largest sum of piece scores (of equal
ones the longest last piece), the rule of SentencePiece's unigram encoder; for
a vocabulary built by merges its scores are the merge ranks. Characters without
a piece become byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from newslake.llm.common import row_blocks, text_buffers
from newslake.llm.wordhash import mix

SPACE_MARK = 0x2581
#: A space mark that stands in the text itself; it has no piece and is written as bytes.
LITERAL_MARK = 0x110000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
#: Parts longer than this go through a step per position instead of a step per position of all parts of that length.
TOGETHER = 64
#: Text in one output batch; a longer text is a batch of its own.
BATCH_BYTES = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_QUICK = 1 << 20


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        v = shift = 0
        while True:
            b = data[i]
            i += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v
    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i: i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[i: i + n]
            i += n


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1), _BASE, np.uint64))])


def _value(cp: np.ndarray) -> np.ndarray:
    return mix(cp.astype(np.uint64) + np.uint64(1))


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read a SentencePiece model file. Only models whose normaliser leaves
        text as it is are accepted, as others can't be decoded exactly."""
        pieces, scores, types, spec = [], [], [], {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    x = dict(_fields(value))
                    pieces.append(x[1].decode())
                    scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                    types.append(x.get(3, NORMAL))
                elif number == 3:
                    spec = dict(_fields(value))
        if spec.get(2) or spec.get(4, 1):
            raise ValueError("the model changes text before it encodes it")
        return cls(pieces, np.array(scores), np.array(types), bool(spec.get(3, 1)))

    def __post_init__(self):
        n = len(self.pieces)
        use = np.flatnonzero((self.types == NORMAL) | (self.types == USER))
        texts = [np.array([ord(c) for c in self.pieces[i]], np.uint32) for i in use]
        self.longest = max(map(len, texts), default=1)
        keys = np.array([self._key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], use[order].astype(np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.key_scores = self.scores[self.ids]
        self.quick = np.zeros(_QUICK, bool)
        self.quick[(self.keys & np.uint64(_QUICK - 1)).astype(np.int64)] = True
        self.unknown = (self.scores[use].min() if len(use) else 0.0) - UNKNOWN_PENALTY
        self.bytes = np.full(256, -1, np.int32)
        for i in np.flatnonzero(self.types == BYTE):
            self.bytes[int(self.pieces[i][3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")
        # Parts may be cut before a run of marks if no piece has a mark after another character.
        self.cut_at_marks = not any(chr(SPACE_MARK) in self.pieces[i].lstrip(chr(SPACE_MARK)) for i in use)
        alone = np.ones(0x110002, bool)
        for t in texts:
            if len(t) > 1:
                alone[t] = False
        self.alone = alone
        out = [b""] * n
        for i in range(n):
            if self.types[i] == BYTE:
                out[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif self.types[i] in (NORMAL, USER):
                out[i] = self.pieces[i].replace(chr(SPACE_MARK), " ").encode()
            elif self.types[i] == UNKNOWN:
                out[i] = " ⁇ ".encode()
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.marked = np.array([x[:1] == chr(SPACE_MARK) for x in self.pieces])

    @staticmethod
    def _key(cp: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for v in _value(cp):
            h = h * _BASE + v
        return mix(h + np.uint64(len(cp)))[0]

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a hash is a piece's, and the index among the sorted ones."""
        at = np.flatnonzero(self.quick[(key & np.uint64(_QUICK - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        hit = self.keys[i] == key[at]
        return at[hit], i[hit]


def _viterbi(v: Vocabulary, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of the rows of ``cp`` (parts of equal length). For
    each row and end position: whether a piece of the best path ends there, and
    its id, or -1 for a character without a piece."""
    m, n = cp.shape
    value = _value(cp)
    prefix = np.zeros((n + 1, m), np.uint64)
    for j in range(n):
        prefix[j + 1] = prefix[j] * _BASE + value[:, j]
    power = _powers(v.longest)
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0
    back = np.zeros((n + 1, m), np.int32)
    piece = np.full((n + 1, m), -1, np.int32)
    for end in range(1, n + 1):
        most = min(v.longest, end)
        score = np.full((most, m), -np.inf)  # longest first, so that the first of equal ones is the longest
        ids = np.full((most, m), -1, np.int32)
        for k, length in enumerate(range(most, 0, -1)):
            key = mix(prefix[end] - prefix[end - length] * power[length] + np.uint64(length))
            at, i = v.probe(key)
            score[k, at] = best[end - length, at] + v.key_scores[i]
            ids[k, at] = v.ids[i]
        none = ids[-1] < 0
        score[-1, none] = best[end - 1, none] + v.unknown
        first = np.argmax(score, axis=0)
        across = np.arange(m)
        best[end], piece[end], back[end] = score[first, across], ids[first, across], most - first
    on = np.zeros((n + 1, m), bool)
    at = np.full(m, n)
    while (live := np.flatnonzero(at > 0)).size:
        on[at[live], live] = True
        at[live] -= back[at[live], live]
    return on[1:].T, piece[1:].T


def _long(v: Vocabulary, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long part: pieces are found for all positions at once,
    then the path advances position by position."""
    n = len(cp)
    value = _value(cp)
    matches: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
    for length in range(min(v.longest, n), 0, -1):
        h = np.zeros(n - length + 1, np.uint64)
        for j in range(length):
            h = h * _BASE + value[j: n - length + 1 + j]
        at, i = v.probe(mix(h + np.uint64(length)))
        for s, q in zip(at.tolist(), i.tolist()):
            matches[s + length].append((length, float(v.key_scores[q]), int(v.ids[q])))
    best, back, piece = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    for end in range(1, n + 1):
        top, chosen, of = -np.inf, 1, -1
        for length, s, q in matches[end]:
            if best[end - length] + s > top:
                top, chosen, of = best[end - length] + s, length, q
        if not matches[end] or matches[end][-1][0] > 1:
            if best[end - 1] + v.unknown > top:
                top, chosen, of = best[end - 1] + v.unknown, 1, -1
        best[end], back[end], piece[end] = top, chosen, of
    on, at = np.zeros(n, bool), n
    while at > 0:
        on[at - 1] = True
        at -= back[at]
    return on, np.array(piece[1:], np.int32)


def _gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + count[i] - 1 for all i, one after another."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _byte_tokens(v: Vocabulary, cp: np.ndarray, on: np.ndarray, piece: np.ndarray, width: np.ndarray):
    """Tokens of flat positions: pieces of the path, and bytes for characters without one. -> tokens, owner position."""
    at = np.flatnonzero(on)
    p, w = piece[at], np.where(piece[at] < 0, width[at], 1)
    tokens = np.repeat(p, w)
    gap = np.flatnonzero(p < 0)
    if len(gap):
        chars = cp[at[gap]].copy()
        chars[chars == LITERAL_MARK] = SPACE_MARK
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        tokens[_gather((np.cumsum(w) - w)[gap], w[gap])] = v.bytes[raw]
    return tokens, np.repeat(at, w)


def _encode_block(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the rows of a block and the number of each row's."""
    rows = len(offsets) - 1
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = lead[offsets]
    cp = np.where(cp == SPACE_MARK, LITERAL_MARK, np.where(cp == 0x20, SPACE_MARK, cp)).astype(np.uint32)
    if v.dummy_prefix:
        filled = first[1:] > first[:-1]
        cp = np.insert(cp, first[:-1][filled], SPACE_MARK)
        first = first + np.concatenate([[0], np.cumsum(filled)])
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    cut = np.zeros(len(cp) + 1, bool)
    cut[first] = True
    cut = cut[:-1]
    mark, alone = cp == SPACE_MARK, v.alone[cp]
    if v.cut_at_marks:
        cut[1:] |= mark[1:] & ~mark[:-1]
    cut |= alone
    cut[1:] |= alone[:-1]
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(cp)))
    place = np.arange(len(cp)) - np.repeat(start, length)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_value(cp) * _powers(int(length.max()))[place])])
    h = mix(sums[start + length] - sums[start] + length.astype(np.uint64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    # Encode each distinct part; its tokens stand at tok_at[part], tok_n[part] many.
    part_length = length[one]
    tokens, tok_n, tok_at, total = [], np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), 0
    for n in np.unique(part_length):
        of = np.flatnonzero(part_length == n)
        group = cp[start[one[of]][:, None] + np.arange(n)]
        if n <= TOGETHER:
            on, piece = _viterbi(v, group)
        else:
            found = [_long(v, g) for g in group]
            on, piece = np.stack([f[0] for f in found]), np.stack([f[1] for f in found])
        flat = group.reshape(-1)
        width = np.where(flat < 0x80, 1, np.where(flat < 0x800, 2, np.where((flat < 0x10000) | (flat == LITERAL_MARK), 3, 4)))
        t, owner = _byte_tokens(v, flat, on.reshape(-1), piece.reshape(-1), width)
        tok_n[of] = np.bincount(owner // n, minlength=len(of))
        tok_at[of] = total + np.cumsum(tok_n[of]) - tok_n[of]
        tokens.append(t)
        total += len(t)
    tokens = np.concatenate(tokens)
    per_part = tok_n[which]
    out = tokens[_gather(tok_at[which], per_part)]
    row = np.searchsorted(first, start, "right") - 1
    return out.astype(np.int32), np.bincount(row, per_part, rows).astype(np.int64)


def encode_column(v: Vocabulary, text: pa.Array) -> pa.ListArray:
    """Token ids of each text; null for null, none for empty."""
    data, offsets = text_buffers(text)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo, hi in row_blocks(offsets, 1 << 20):
        t, n = _encode_block(v, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        ids.append(t)
        counts.append(n)
    at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    if at[-1] >= 1 << 31:
        raise ValueError("too many tokens for one batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    mask = text.is_null() if text.null_count else None
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(ids)), mask=mask)


def decode_column(v: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """Text of each list of token ids; bytes that aren't UTF-8 become U+FFFD."""
    at = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy(zero_copy_only=False)[at[0]: at[-1]]
    at = at - at[0]
    texts: list[str] = []
    for lo, hi in row_blocks(at, 1 << 18):
        texts += _decode_block(v, flat[at[lo]: at[hi]], at[lo: hi + 1] - at[lo])
    return pa.array(texts, pa.string(), mask=np.array(ids.is_null())) if ids.null_count else pa.array(texts, pa.string())


def _decode_block(v: Vocabulary, flat: np.ndarray, at: np.ndarray) -> list[str]:
    count = np.diff(v.out_at)[flat]
    raw = v.out[_gather(v.out_at[flat], count)]
    end = np.concatenate([[0], np.cumsum(count)])[at]
    if v.dummy_prefix and len(flat):
        filled = np.flatnonzero(at[1:] > at[:-1])
        strip = filled[v.marked[flat[at[filled]]]]
        keep = np.ones(len(raw), bool)
        keep[end[strip]] = False
        raw = raw[keep]
        gone = np.zeros(len(at), np.int64)
        gone[strip + 1] = 1
        end = end - np.cumsum(gone)
    blob = raw.tobytes()
    return [blob[a:b].decode("utf-8", "replace") for a, b in zip(end[:-1].tolist(), end[1:].tolist())]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", into: str = "token_ids", check: str | None = None) -> DataFrame:
    """``docs`` with one more column, the token ids of ``text_col`` (null for
    null, an empty list for an empty text). With ``check``, a second column of
    that name tells whether decoding the ids gives the text back. The model is
    read on the driver and sent to the tasks. Whole texts are encoded; an empty
    table gives an empty one. Raises ValueError if a new column exists."""
    if {into, check} & set(docs.columns):
        raise ValueError(f"column {into} or {check} exists")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches):
        v = vocabulary.value
        for whole in batches:
            # Batches of a bounded number of bytes, so that the working arrays stay small.
            for lo, hi in row_blocks(text_buffers(whole.column(text_col))[1], BATCH_BYTES):
                b = whole.slice(lo, hi - lo)
                text = b.column(text_col)
                ids = encode_column(v, text)
                cols, names = [*b.columns, ids], [*b.schema.names, into]
                if check:
                    same = [x == y for x, y in zip(text.to_pylist(), decode_column(v, ids).to_pylist())]
                    cols, names = [*cols, pa.array(same, pa.bool_())], [*names, check]
                yield pa.RecordBatch.from_arrays(cols, names)
    fields = [*docs.schema.fields, StructField(into, ArrayType(IntegerType()))] + ([StructField(check, BooleanType())] if check else [])
    return docs.mapInArrow(run, StructType(fields))


def decode(df: DataFrame, model_path: str, ids_col: str = "token_ids", into: str = "text") -> DataFrame:
    """``df`` with one more column, the text of ``ids_col`` (null for null)."""
    if into in df.columns:
        raise ValueError(f"column {into} exists")
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches):
        for b in batches:
            ids = b.column(ids_col).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, decode_column(vocabulary.value, ids)], [*b.schema.names, into])
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, StringType())]))
