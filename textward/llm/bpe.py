"""Byte-level BPE encoding and decoding, with a pre-tokeniser of arrays instead of a regex.

A text becomes an array of code points and that an array of symbols: what a character means to
the splitter, given its right neighbour. A symbol is a function from the splitter's state before
the character to the state after it. Such functions compose associatively, so rows of characters
are composed independently of what stands before them, the rows' compositions are scanned in
logarithmically many steps, and a last sweep, all rows at once, gives every boundary. The slices
between boundaries go through a cache of merged pairs. Offsets are kept, so tokens can be traced
to their bytes and decoded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States of the splitter: what the open piece is.
FREE, LETTERS, NUMBERS, OTHERS, BLANK, SPACES, ONE_MORE, TWO_MORE = range(8)
# Symbols. LAST_*: white space before something else; INNER: white space before white space or the end.
END, LETTER, NUMBER, OTHER, INNER, LAST_BLANK, LAST_SPACE, SHORT, LONG = range(9)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(state after, whether a piece begins here) for each symbol and state before."""
    after = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    after[END] = FREE
    for symbol, state in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        after[symbol] = state
        begins[symbol, [state, BLANK]] = False
    # The letters of a contraction follow its apostrophe without a new piece.
    after[LETTER, TWO_MORE], after[LETTER, ONE_MORE] = ONE_MORE, FREE
    begins[LETTER, [TWO_MORE, ONE_MORE]] = False
    after[INNER] = SPACES
    begins[INNER, SPACES] = False
    after[LAST_BLANK] = BLANK
    after[LAST_SPACE] = FREE
    # An apostrophe with contraction letters after it, unless it continues a piece.
    for symbol, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        after[symbol] = state
        after[symbol, [OTHERS, BLANK]] = OTHERS
        begins[symbol, [OTHERS, BLANK]] = False
    return after, begins


AFTER, BEGINS = _transitions()
ROW = 64  # characters in a row of the scan
NONE = np.int64(1) << 40  # the rank of a pair that does not merge
SHORT_PIECE = 64  # bytes of a piece that is kept in the cache
PIECES_AT_ONCE = 4096
# Characters that are pre-tokenised at once; one longer text goes alone.
CHARS_AT_ONCE = 1 << 20


@lru_cache(1)
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) for each code point, by Unicode property."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", INNER)):
        for m in regex.finditer(pattern, every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            kinds[first : last + 1] = kind
    return kinds


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; 0x110000 ends a text."""
    n = len(points)
    kinds = np.append(_kinds(), np.uint8(END))
    symbols = kinds[points]
    following = np.append(symbols[1:], np.uint8(END))
    space = symbols == INNER
    last = space & (following != INNER) & (following != END)
    symbols[last] = np.where(points[last] == 32, LAST_BLANK, LAST_SPACE)
    at = np.flatnonzero(points == 39)
    if len(at):
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        one, two = np.where(at + 1 < n, one, 0), np.where(at + 2 < n, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        symbols[at[short]] = SHORT
        symbols[at[long]] = LONG
    return symbols


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that compositions of symbols can be: the first of them for each symbol, the
    table that composes two, and the state each one leads to from FREE."""
    known: dict[bytes, int] = {}
    for row in (np.arange(8, dtype=np.uint8), *AFTER):
        known.setdefault(row.tobytes(), len(known))
    tables = [np.frombuffer(k, np.uint8) for k in known]
    n = 0
    while n < len(tables):  # until no composition is new
        n = len(tables)
        for f in list(tables):
            for symbol in AFTER:
                made = symbol[f]
                if made.tobytes() not in known:
                    known[made.tobytes()] = len(known)
                    tables.append(made)
    compose = np.array([[known[g[f].tobytes()] for g in tables] for f in tables], np.uint8)
    of_symbol = np.array([known[row.tobytes()] for row in AFTER], np.uint8)
    return of_symbol, compose, np.array([f[FREE] for f in tables], np.uint8)


def boundaries(points: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point of texts that each end with 0x110000."""
    of_symbol, compose, from_free = _functions()
    n, many = len(points), len(compose)
    flat = compose.reshape(-1)
    symbols = np.full(-(-n // ROW) * ROW, END, np.uint8)
    symbols[:n] = _symbols(points)
    rows = np.ascontiguousarray(symbols.reshape(-1, ROW).T)
    # Each row as one function, whatever the state before it.
    steps = of_symbol[rows]
    function = steps[0].astype(np.intp)
    for step in steps[1:]:
        function = flat[function * many + step].astype(np.intp)
    # Inclusive scan of the compositions by doubling.
    reach = 1
    while reach < len(function):
        function[reach:] = flat[function[:-reach] * many + function[reach:]]
        reach *= 2
    state = np.append(np.uint8(FREE), from_free[function[:-1]]).astype(np.intp)
    # Last sweep: with the state before each row known, its boundaries follow.
    begin = np.empty(rows.shape, bool)
    begins, after = BEGINS.reshape(-1), AFTER.reshape(-1).astype(np.intp)
    for i, column in enumerate(rows):
        at = column.astype(np.intp) * 8 + state
        begin[i] = begins[at]
        state = after[at]
    return begin.T.reshape(-1)[:n]


def pieces(texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
    """Each text's UTF-8 and the byte offsets of its pieces, the end of the text included."""
    if not texts:
        return []
    raw = [t.encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "replace"), np.uint32).copy()
    ends = np.cumsum(lengths + 1) - 1
    points[ends] = 0x110000
    begin = boundaries(points)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[ends] = 0
    offset = np.cumsum(width) - width
    begin[ends] = True
    at = np.flatnonzero(begin)
    cuts = np.searchsorted(at, ends, side="right")
    first = np.append(0, cuts[:-1])
    base = offset[np.append(0, ends[:-1] + 1)]
    return [(raw[i], offset[at[first[i] : cuts[i]]] - base[i]) for i in range(len(texts))]


class Pieces(dict):
    """Tokens of pieces seen, as a dictionary that is emptied when it holds ``keep`` of them."""

    def __init__(self, merge, keep: int):
        self.merge, self.keep = merge, keep

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        return self.merge(piece)  # a long piece: not kept


@dataclass
class Vocabulary:
    """Ranks of byte strings, which are also their ids, and a bounded cache of merged pieces."""

    ranks: dict[bytes, int]
    keep: int = 1_000_000

    def __post_init__(self):
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.length = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        self.length[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cached = Pieces(self.merge_long, self.keep)
        self.wide = max(self.bytes_of, default=0) + 1
        pairs = {}
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left * self.wide + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they do not merge."""
        keys = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], NONE)

    def merge_all(self, found: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of many short pieces: in each round the adjacent pair of lowest rank, leftmost on
        ties, merges in every piece at once."""
        n = len(found)
        size = np.array([len(p) for p in found])
        most = int(size.max())
        place = np.arange(most + 1)
        raw = np.zeros((n, most + 1), np.uint8)
        raw[place < size[:, None]] = np.frombuffer(b"".join(found), np.uint8)
        ids = self.of_byte[raw]
        ids[place >= size[:, None]] = -1  # what ends a piece merges with nothing
        # Links to the neighbours; the end of a piece points at itself.
        right = np.minimum(place[None, :] + 1, size[:, None])
        left = np.repeat(place[None, :] - 1, n, axis=0)
        rank = np.full((n, most + 1), NONE)
        if most > 1:
            rank[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
            rank[:, :-1][ids[:, 1:] < 0] = NONE
        row = np.arange(n)
        while len(row):
            at = rank[row].argmin(axis=1)
            low = rank[row, at]
            row, at, low = row[low < NONE], at[low < NONE], low[low < NONE]
            gone = right[row, at]
            after = right[row, gone]
            ids[row, at], ids[row, gone], rank[row, gone] = low, -1, NONE
            right[row, at], left[row, after] = after, at
            onward = ids[row, after]
            rank[row, at] = np.where(onward < 0, NONE, self.pair_ranks(low, onward))
            before = left[row, at]
            has = before >= 0
            r, b = row[has], before[has]
            rank[r, b] = self.pair_ranks(ids[r, b], low[has])
        kept = ids >= 0
        flat = ids[kept].tolist()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece, by a heap of pairs: one as long as a text takes n log n steps."""
        n, ranks = len(piece), self.ranks
        if piece in ranks:
            return (ranks[piece],)
        end = list(range(1, n + 1))  # of the part that begins at each place
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two has merged meanwhile
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def learn(self, found: set[bytes]) -> None:
        """Adds short pieces to the cache."""
        cached, ranks = self.cached, self.ranks
        if len(cached) + len(found) > self.keep:
            cached.clear()
        fresh = []
        for piece in found - cached.keys() if len(cached) < len(found) else [p for p in found if p not in cached]:
            rank = ranks.get(piece)
            if rank is not None:
                cached[piece] = (rank,)
            elif len(piece) <= SHORT_PIECE:
                fresh.append(piece)
        fresh.sort(key=len)  # pieces of about one length share a matrix
        for i in range(0, len(fresh), PIECES_AT_ONCE):
            some = fresh[i : i + PIECES_AT_ONCE]
            cached.update(zip(some, self.merge_all(some)))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        parts = []
        for raw, cuts in pieces(texts):
            bounds = cuts.tolist()
            parts.append([raw[a:b] for a, b in zip(bounds, bounds[1:])])
        self.learn(set().union(*parts))
        get = self.cached.__getitem__
        for part in parts:
            yield list(chain.from_iterable(map(get, part)))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token begins, the end of the text included."""
        return np.append(0, np.cumsum(self.length[ids]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line holds a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_VOCABULARIES: dict[str, Vocabulary] = {}


def _share(df: DataFrame, path: str) -> Callable[[], Vocabulary]:
    """What gives a task the vocabulary of a file: read here, broadcast (a file of bounded size), and
    built once per worker process, so that its cache outlives a task."""
    ranks = load_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def vocabulary() -> Vocabulary:
        if name not in _VOCABULARIES:
            _VOCABULARIES.clear()
            _VOCABULARIES[name] = Vocabulary(shared.value)
        return _VOCABULARIES[name]

    return vocabulary


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text)
    yield start, len(texts)


def encode(docs: DataFrame, path: str, text: str = "text", check: bool = False) -> DataFrame:
    """The documents with ``token_ids`` (array of int) and ``token_offsets`` (byte offsets, one more
    than tokens) added, in place of columns so called; with ``check`` also ``decodes``, whether the
    ids decode to the text's bytes.

    The vocabulary file, of bounded size, is read where the job starts and broadcast. A null text
    is an empty one and has no tokens; a text of any length is encoded whole; repeated rows repeat.
    An empty table gives an empty table.
    """
    kinds = {"token_ids": "array<int>", "token_offsets": "array<long>"}
    return _apply(docs, path, text, kinds | {"decodes": "boolean"} if check else kinds, _checked if check else _encoded)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of their encoding.

    Like ``encode``, for a check of the ids and of the round trip without moving the arrays.
    """
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _apply(docs, path, text, kinds, _digested)


def _encoded(vocabulary: Vocabulary, texts: list[str]) -> list[list]:
    ids = [np.array(found, np.int32) for found in vocabulary.encode(texts)]
    return [ids, [vocabulary.offsets(found) for found in ids]]


def _checked(vocabulary: Vocabulary, texts: list[str]) -> list[list]:
    ids, offsets = _encoded(vocabulary, texts)
    return [ids, offsets, [vocabulary.decode(i.tolist()) == t.encode("utf-8", "replace") for i, t in zip(ids, texts)]]


def _digested(vocabulary: Vocabulary, texts: list[str]) -> list[list]:
    counts, hashes, decoded = [], [], []
    for ids in vocabulary.encode(texts):
        counts.append(len(ids))
        hashes.append(hashlib.sha256(",".join(map(vocabulary.text_of.__getitem__, ids)).encode()).hexdigest())
        decoded.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
    return [counts, hashes, decoded]


def _apply(docs: DataFrame, path: str, text: str, kinds: dict[str, str], work) -> DataFrame:
    shared = _share(docs, path)
    kept = [c for c in docs.columns if c not in kinds]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in base.schema]
        + [T.StructField(k, T._parse_datatype_string(v), True) for k, v in kinds.items()]
    )
    at = kept.index(text)
    arrow = {"array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches):
        vocabulary = shared()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in _groups(texts):  # a batch out for each, so that ids of few texts are in memory
                added = [pa.array(c, arrow[k]) for c, k in zip(work(vocabulary, texts[a:b]), kinds.values())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *added], names=[*kept, *kinds])

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Encoded documents with ``decoded`` (binary), the bytes that the ids stand for; null for null."""
    shared = _share(encoded, path)

    @F.pandas_udf("binary")
    def back(column):
        vocabulary = shared()
        return column.map(lambda found: None if found is None else vocabulary.decode(found))

    return encoded.withColumn("decoded", back(F.col(ids)))

