"""Byte-pair merging with a heap and a linked list: token counts, seeded encoding, decoding.

The vocabulary is a public SentencePiece BPE model with byte fallback, read on
the driver and handed to the workers as bytes; its scores give the merge order.

A text becomes one word-start mark before it and one for each space.  No
piece holds a mark after another character, so no merge crosses such a
place; the loader verifies this on the vocabulary.  Two
neighbouring characters that no piece holds side by side cannot merge either,
so texts are cut into parts at all these places.  What remains is merged by taking the
lowest-ranked adjacent pair again and again, ties to the left.

Counting pops the pairs from a heap over a linked list of symbols, part by part.  Parts
recur, so counts are kept in each task in tables bounded by entries and by bytes.

Encoding holds the agendas of all parts of a block of texts side by side: one row for
each part, in matrices by width, and in each step the least pair of every row is taken.  Merge-dropout draws
for each candidate of each part of each document: the gaps between skipped candidates are geometric
and follow by hash from the seed, the document's key, the part's place in the text and the draw's
number.  A skipped pair stays apart unless one of its sides changes.  Parts wider than ``KEPT_PART`` go through the
heap with the same draws and equal results.  Nothing is kept from one block to the next.

Defined results: a null text counts as empty for counts and gives null when
encoded; an empty text has no tokens; characters outside the vocabulary
become their UTF-8 bytes, one token each; special strings inside a text are
ordinary text; a text of any length is done whole; ties go to the left.
Rows are independent, so repeated rows are alike and an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise, repeat
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .textkit import each_batch, each_pair, mix

MARK = "▁"
#: Entries and about most bytes of a generation of finished units; a task's table has two at most.
TABLE_ENTRIES = 100_000
TABLE_BYTES = 24 << 20
#: About what an entry takes besides its characters.
ENTRY_BYTES = 160
#: Widest part that is merged side by side with others.
KEPT_PART = 48
#: Characters of a block of texts that is encoded at once; a longer text is a block by itself.
BLOCK_CHARS = 1 << 17
MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15
NEVER = 1 << 62
#: No merge; beyond all others, which are a rank and a symbol in 31 bits.
NONE = (1 << 31) - 1


class Table(dict):
    """A bounded table of strings: when a generation is full it becomes the old one, and what is met again moves on."""

    def __init__(self, make, entries: int, most: int = 0):
        super().__init__()
        self.make, self.entries, self.most, self.old, self.size = make, entries, most, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries or self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        if self.most:
            self.size += ENTRY_BYTES + 4 * len(key)
        self[key] = value
        return value


class Pairs:
    """A fixed table from pairs of symbols to numbers, by open addressing, for many look-ups at once."""

    def __init__(self, items: dict[int, int]):
        keys, values = np.fromiter(items.keys(), np.int64, len(items)), np.fromiter(items.values(), np.int32, len(items))
        self.bits = max(4 * len(items), 16).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE, dtype=np.int32)
        at, left, self.probes = self.home(keys), np.arange(len(keys)), 1
        while True:
            free = left[self.keys[at] < 0]
            spot = at[self.keys[at] < 0]
            first = np.unique(spot, return_index=True)[1]
            self.keys[spot[first]], self.values[spot[first]] = keys[free[first]], values[free[first]]
            rest = ~np.isin(left, free[first])
            left, at = left[rest], at[rest] + 1 & (1 << self.bits) - 1
            if not len(left):
                break
            self.probes += 1

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; NONE for those that are not in."""
        at = self.home(keys)
        found = self.keys[at]
        hit = found == keys
        out = self.values[at]  # NONE in free places
        left = np.flatnonzero(~hit & (found >= 0))
        out[left] = NONE
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Pieces, merge ranks and byte tokens of a SentencePiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        order = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"a piece has a word start inside: {piece!r}")
                self.ids[piece] = i
                self.bytes.append(piece.replace(MARK, " ").encode())
                order.append((-sp.get_score(i), i, piece))
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        self.rank = {piece: r for r, (_, _, piece) in enumerate(sorted(order)) if len(piece) > 1}
        self.pairs = {p[j : j + 2] for p in self.rank for j in range(len(p) - 1)}
        self.symbol = {x: k for k, x in enumerate(dict.fromkeys(chain(self.ids, (c for p in self.rank for c in p))))}
        self.shift = len(self.symbol).bit_length()
        #: For two symbols side by side: the rank of what they merge to, and its symbol.
        self.merged = {self.symbol[p[:j]] << self.shift | self.symbol[p[j:]]: r << self.shift | self.symbol[p] for p, r in self.rank.items() for j in range(1, len(p)) if p[:j] in self.symbol and p[j:] in self.symbol}
        self.tokens = [(self.ids[x],) if x in self.ids else tuple(self.byte_id[b] for b in x.encode()) for x in self.symbol]
        self.token_size = np.array([len(x) for x in self.tokens], dtype=np.int64)
        self.token_ids = np.fromiter(chain.from_iterable(self.tokens), np.int32)
        if max(self.merged.values(), default=0) >= NONE:
            raise ValueError("too many pieces")
        # For whole blocks: merges and pairs inside pieces as tables, the symbol of each character, and the tokens of each symbol in a row.
        self.merges = Pairs(self.merged)
        self.inside = Pairs({self.symbol[x[0]] << self.shift | self.symbol[x[1]]: 1 for x in self.pairs})
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for x, k in self.symbol.items():
            if len(x) == 1:
                self.of_char[ord(x)] = k
        self.of_char[ord(" ")], self.of_char[ord(MARK)] = self.of_char[ord(MARK)], -1
        for probe in ("a  b\tcé d", " x", "ﬁn ①"):
            if sp.encode(probe) != list(Encoder(self).encode(probe)):
                raise ValueError("the model normalises text in a way that is not supported")

    def parts(self, unit: str):
        """A unit cut where no merge is possible."""
        pairs, start = self.pairs, 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                yield unit[start:i]
                start = i
        yield unit[start:]

    def merge(self, part: str, skips: Iterator[int] = repeat(NEVER)) -> tuple[list[int], int, int, int]:
        """The symbols of a part after all merges (-1: merged into one on the left), the numbers of merges and of candidates met, and the skip then due.

        ``skips`` gives, ascending, the candidates to skip, counted from 0 as
        they come from the heap.  A skipped pair stays apart unless one of its sides changes.
        A part of one character may be outside the vocabulary; its symbol is -2.
        """
        n = len(part)
        if n == 1:
            return [self.symbol.get(part, -2)], 0, 0, next(skips)
        merged, shift = self.merged, self.shift
        low = (1 << shift) - 1
        symbols = [self.symbol[c] for c in part]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [merged.get(a << shift | b, -1) for a, b in pairwise(symbols)]
        heap = [r * n + i for i, r in enumerate(due) if r >= 0]
        due.append(-1)
        heapify(heap)
        done, met, skip = 0, 0, next(skips)
        while heap:
            r, i = divmod(heappop(heap), n)
            if due[i] != r:
                continue
            met += 1
            if met > skip:
                due[i] = -1
                skip = next(skips)
                continue
            done += 1
            j = after[i]
            here = symbols[i] = r & low
            symbols[j] = due[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                due[i] = r = merged.get(here << shift | symbols[k], -1)
                if r >= 0:
                    heappush(heap, r * n + i)
            else:
                due[i] = -1
            k = before[i]
            if k >= 0:
                due[k] = r = merged.get(symbols[k] << shift | here, -1)
                if r >= 0:
                    heappush(heap, r * n + k)
        return symbols, done, met, skip


def mixed(x: int) -> int:
    """The splitmix64 finaliser of one value, as ``mix`` has it for many."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def units(text: str):
    """(marks, characters) of each unit of a text that is not empty."""
    marks = 0
    words = text.split(" ")
    for w in words:
        marks += 1
        if w:
            yield marks, w
            marks = 0
    if marks:
        yield marks, ""


class Counter:
    """Token counts; units and parts are kept in bounded tables as they are met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = Table(self.word, TABLE_ENTRIES, TABLE_BYTES)
        self.parts = Table(self.part, TABLE_ENTRIES, TABLE_BYTES)

    def word(self, word: str) -> int:
        """The count of a unit with one mark; lines meet without a space, and are kept apart."""
        first, *rest = word.split("\n")
        return self.unit(MARK + first) + sum(self.unit("\n" + x) for x in rest)

    def unit(self, unit: str) -> int:
        return sum(map(self.parts.__getitem__, self.vocabulary.parts(unit)))

    def part(self, part: str) -> int:
        v = self.vocabulary
        symbols, merges, _, _ = v.merge(part)
        if symbols[0] == -2:
            return len(part.encode())
        return len(part) - merges + sum(len(v.tokens[s]) - 1 for s in symbols if s >= 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" not in words:
            return sum(map(self.words.__getitem__, words))
        return sum(self.words[w] if m == 1 and w else self.unit(MARK * m + w) for m, w in units(text))


class Encoder:
    """Token ids with merges skipped by keyed hash."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.0, seed: int = 0):
        self.vocabulary = vocabulary
        self.seed = mixed((seed + 1) * GOLDEN & MASK)
        self.log_kept = 0.0 if dropout <= 0 else log1p(-dropout) if dropout < 1 else float("-inf")

    def gaps(self, drawn: np.ndarray) -> np.ndarray:
        """How many candidates pass before one is skipped, from a hash."""
        return np.minimum(np.log(((drawn >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / self.log_kept, NEVER).astype(np.int64)

    def first_skips(self, own: int, n: int) -> list[int]:
        """For each of a text's n parts, the first candidate to be skipped."""
        if not self.log_kept:
            return [NEVER] * n
        return self.gaps(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(own))).tolist()

    def skips(self, own: int, place: int, first: int) -> Iterator[int]:
        """The candidates of a part that are skipped, in order."""
        h, at = mixed(own + (place + 1) * GOLDEN & MASK), first
        while True:
            yield at
            h = mixed(h + GOLDEN & MASK)
            at = NEVER if at >= NEVER else at + 1 + int(self.gaps(np.array([h], dtype=np.uint64))[0])

    def agenda(self, sym: np.ndarray, drawn: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Symbols of many parts of one width (a row each, -1 beyond the end) after all merges."""
        v = self.vocabulary
        n, width = sym.shape
        low, shift = np.int32((1 << v.shift) - 1), np.int64(v.shift)
        out, live = np.empty((n, width), dtype=np.int32), np.arange(n)
        inner = sym[:, 1:] >= 0
        best = np.full((n, width - 1), NONE, dtype=np.int32)
        best[inner] = v.merges.get(sym[:, :-1][inner].astype(np.int64) << shift | sym[:, 1:][inner])
        met, place = 0, np.arange(width)
        while len(live):
            i = best.argmin(axis=1)
            r = best[np.arange(len(live)), i]
            done = r == NONE
            if done.any():
                out[live[done]] = sym[done]
                sym, best, live, i, r, drawn, skip = (x[~done] for x in (sym, best, live, i, r, drawn, skip))
                if not len(live):
                    break
            gone = skip == met
            if gone.any():
                g = np.flatnonzero(gone)
                best[g, i[g]] = NONE
                drawn[g] = mix(drawn[g] + np.uint64(GOLDEN))
                skip[g] += 1 + np.minimum(self.gaps(drawn[g]), NEVER - 1 - skip[g])
            m = np.flatnonzero(~gone)
            if len(m):
                at = i[m]
                from_ = np.minimum(place[None, :] + (place[None, :] > at[:, None]), width - 1)
                new = np.take_along_axis(sym[m], from_, axis=1)
                new[:, -1] = -1
                rows = np.arange(len(m))
                here = r[m] & low
                new[rows, at] = here
                keep = np.minimum(place[None, :-1] + (place[None, :-1] >= at[:, None]), width - 2)
                old = np.take_along_axis(best[m], keep, axis=1)
                old[:, -1] = NONE
                after = np.where(at + 1 < width, new[rows, np.minimum(at + 1, width - 1)], -1)
                ok = after >= 0
                old[rows[ok], at[ok]] = v.merges.get(here[ok].astype(np.int64) << shift | after[ok])
                stop = ~ok & (at < width - 1)
                old[rows[stop], at[stop]] = NONE
                ok = at > 0
                old[rows[ok], at[ok] - 1] = v.merges.get(new[rows[ok], at[ok] - 1].astype(np.int64) << shift | here[ok])
                sym[m], best[m] = new, old
            met += 1
        return out

    def block(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of some texts, one after the other, and where each begins."""
        v = self.vocabulary
        codes = [np.frombuffer((" " + t).encode("utf-32-le"), dtype=np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        n = len(flat)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        # Characters outside the vocabulary are symbols of this block, which merge with nothing.
        sym = v.of_char[flat]
        strange = np.flatnonzero(sym < 0)
        others, which = np.unique(flat[strange], return_inverse=True)
        sym[strange] = len(v.tokens) + which
        spelt = [tuple(v.byte_id[b] for b in chr(c).encode()) for c in others.tolist()]
        joined = np.zeros(n, dtype=bool)
        known = np.flatnonzero((sym[1:] < len(v.tokens)) & (sym[:-1] < len(v.tokens)))
        joined[known + 1] = v.inside.get(sym[known].astype(np.int64) << np.int64(v.shift) | sym[known + 1]) != NONE
        joined[begin[:-1][begin[:-1] < n]] = False
        start = np.flatnonzero(~joined)
        length = np.diff(np.append(start, n))
        doc = np.searchsorted(begin, start, side="right") - 1
        first = np.searchsorted(start, begin[:-1])
        own = np.array([mixed(k * GOLDEN + self.seed & MASK) for k in keys], dtype=np.uint64)
        number = np.arange(len(start)) - first[doc]
        drawn = mix((number + 1).astype(np.uint64) * np.uint64(GOLDEN) + own[doc])
        skip = self.gaps(drawn) if self.log_kept else np.full(len(start), NEVER)
        lo, wide = 2, [w for w in (2, 3, 4, 6, 8, 12, 16, 24, 32, KEPT_PART) if 2 <= w <= KEPT_PART]
        for w in wide:
            rows = np.flatnonzero((length >= lo) & (length <= w))
            lo = w + 1
            if len(rows):
                at = start[rows, None] + np.arange(w)
                inside = np.arange(w) < length[rows, None]
                done = self.agenda(np.where(inside, sym[np.minimum(at, n - 1)], -1), drawn[rows], skip[rows])
                sym[at[inside]] = done[inside]
        for k in np.flatnonzero(length >= lo).tolist():
            part = "".join(map(chr, flat[start[k] : start[k] + length[k]].tolist())).replace(" ", MARK)
            skips = self.skips(int(own[doc[k]]), int(number[k]), int(skip[k])) if self.log_kept else repeat(NEVER)
            sym[start[k] : start[k] + length[k]] = v.merge(part, skips)[0]
        size = np.append(v.token_size, [len(x) for x in spelt]).astype(np.int64)
        offset = np.cumsum(size) - size
        ids = np.concatenate([v.token_ids, np.fromiter(chain.from_iterable(spelt), np.int32)])
        kept = sym >= 0
        each = np.zeros(n + 1, dtype=np.int64)
        sym = sym[kept]
        each[1:][kept] = size[sym]
        ends = np.cumsum(each)
        if ends[-1] == len(sym):  # one token each
            return ids[offset[sym]], ends[begin]
        return ids[np.repeat(offset[sym] - ends[:-1][kept], each[1:][kept]) + np.arange(ends[-1])], ends[begin]

    def encode(self, text: str, key: int = 0) -> list[int]:
        return self.block([text], [key])[0].tolist()

    def blocks(self, texts: list[str], keys: list[int]) -> Iterator[np.ndarray]:
        """The ids of each text, made in blocks of bounded size."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK_CHARS):
                size += len(texts[hi])
                hi += 1
            ids, at = self.block(texts[lo:hi], keys[lo:hi])
            yield from (ids[at[i] : at[i + 1]] for i in range(hi - lo))
            lo = hi


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    return b"".join(map(vocabulary.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


_loaded: dict = {}


def vocabulary_of(model: bytes) -> Vocabulary:
    key = zlib.crc32(model), len(model)
    if key not in _loaded:
        _loaded[key] = Vocabulary(model)
    return _loaded[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_counts(text: Column, model: bytes) -> Column:
    """The number of tokens of each text; no ids are made."""

    @F.arrow_udf("bigint")
    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(vocabulary_of(model))  # its tables go with the task
        return each_batch(lambda texts: pa.array(np.array([counter.count(t.as_py()) for t in texts], dtype=np.int64)), batches)

    return count_tokens(text)


def encode(text: Column, key: Column, model: bytes, dropout: float = 0.1, seed: int = 0) -> Column:
    """Struct of token ids and ``lossless`` (they decode to the text exactly).

    Each candidate merge of each part is skipped or not by a hash of the seed,
    ``key`` (a long, such as the document's id), the part's place in the text and the
    candidate's place in the part.  The same seed and key always give the same ids.
    """

    def encode_batch(texts: pa.Array, keys: pa.Array) -> pa.Array:
        v, raw = vocabulary_of(model), texts.to_pylist()
        made = list(Encoder(v, dropout, seed).blocks([s or "" for s in raw], [k or 0 for k in keys.to_pylist()]))
        ok = [None if s is None else decode_ids(v, x.tolist()) == s for s, x in zip(raw, made, strict=True)]
        nulls = pa.array([s is None for s in raw], type=pa.bool_())
        at = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)), mask=nulls)
        return pa.StructArray.from_arrays([ids, pa.array(ok, type=pa.bool_())], names=["ids", "lossless"])

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def encode_pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return each_pair(encode_batch, batches)

    return encode_pieces(text, key)


def decode(ids: Column, model: bytes) -> Column:
    """The text of an array of token ids; null gives null."""

    @F.arrow_udf("string")
    def decode_pieces(arrays: pa.Array) -> pa.Array:
        v = vocabulary_of(model)
        return pa.array([None if (x := a.as_py()) is None else decode_ids(v, x) for a in arrays], type=pa.string())

    return decode_pieces(ids)
