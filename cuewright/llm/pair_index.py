"""Byte-pair encoding by an index of pair occurrences, and decoding.

The tokenizer is a public one of the word kind: text is normalised and lower-cased, cut into words, and a word's
bytes are merged, its last symbol marked as a word's end.  The file is read on the driver and handed to
the workers as bytes.

The distinct words of a block that the task has not met lately are laid side by side as symbols.  An index maps each
pair that can merge, by its rank, to all its positions.  The ranks present wait in a heap; the least is applied at all its positions
(of many by array operations, of few one after the other, from left to right), and every merge adds the pairs it makes to their lists, whose old entries are told by
their symbols and passed over.  The loader verifies that a merge only uses symbols of lower ranks, so that no
rank comes back once it is done, and the result is that of merging each word by itself.

Words already encoded are kept in a table bounded by entries and bytes; a block is bounded by the Arrow batch, and what
a very long word takes is in proportion to it.

Defined results: a null text gives null, an empty one and one of white space alone no tokens; special strings
inside a text are the special tokens, as the library has them by default; a text of any length is done
whole.  Decoding joins the tokens' strings by one space, special ones too, and passes over ids that the
vocabulary does not have; null gives null.  Rows are independent, so repeated rows are alike and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bpe import NONE, Pairs
from .textkit import each_batch

#: Entries and about most bytes of a generation of words kept; a task has two at most.
KEPT_WORDS = 100_000
KEPT_BYTES = 24 << 20
#: Symbols are below 2**SHIFT; END parts words, DEAD is merged into the symbol on its left.
SHIFT = 20
END, DEAD = -1, -2
#: A rank that has so many positions is applied at all of them by array operations.
MANY = 128


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is a visible Latin-1 character, else the next letter from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def unassigned() -> frozenset[str]:
    """Characters that this Python's Unicode tables do not know."""
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")


class WordVocabulary:
    """Tokens, merges and text rules of a tokenizer file."""

    def __init__(self, data: bytes):
        import tokenizers

        spec = json.loads(data)
        model = spec["model"]
        kinds = [x["type"] for x in (*spec["normalizer"]["normalizers"], *spec["pre_tokenizer"]["pretokenizers"])]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or model["type"] != "BPE" or model["dropout"] or not model["end_of_word_suffix"] or model["ignore_merges"] or spec["decoder"]:
            raise ValueError("the tokenizer works in a way that is not supported")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], dtype=np.int64)
        self.last = np.array([ids[x + end] for x in letters], dtype=np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("special tokens with rules of their own are not supported")
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        #: For each rank the two symbols and what they become.
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"])]
        self.ranks = {a << SHIFT | b: r for r, (a, b, _) in enumerate(self.merges)}
        lately: dict[int, int] = {}
        for r, (_, _, new) in enumerate(self.merges):
            lately[new] = r
        if any(lately.get(x, -1) >= r for r, (a, b, _) in enumerate(self.merges) for x in (a, b)) or max(self.tokens) >> SHIFT:
            raise ValueError("merges are out of order")
        self.pairs = Pairs(self.ranks)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.unknown = unassigned()
        self.token_column = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        self.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()])
        self.cutter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(self.word.pattern), "removed", invert=True)

    def cut(self, text: str) -> list[str]:
        """The words of a text without special strings.  White space parts words and is in none, so runs of it need no replacing."""
        if text.isascii():
            return self.word.findall(text.lower())
        if not self.unknown.isdisjoint(set(text)):  # the library's tables may know more
            return [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # each letter by itself, final or not

    def words(self, text: str) -> list[str]:
        """Words and special strings, in order."""
        if "<|" not in text and all(x.startswith("<|") for x in self.special):
            return self.cut(text)
        pieces = self.marks.split(text)
        return list(chain.from_iterable([p] if k % 2 else self.cut(p) for k, p in enumerate(pieces)))


class PairIndex:
    """Symbols of many words side by side, and where each pair that can merge stands."""

    def __init__(self, vocabulary: WordVocabulary, words: list[str]):
        self.vocabulary = v = vocabulary
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        ends = np.cumsum(size + 1) - 1
        data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        sym = v.inner[data]
        sym[ends - 1] = v.last[data[ends - 1]]
        sym[ends] = END
        here = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        rank = v.pairs.get(sym[here] << np.int64(SHIFT) | sym[here + 1])
        here, rank = here[rank != NONE], rank[rank != NONE]
        order = np.argsort(rank, kind="stable")
        here, rank = here[order], rank[order]
        first = np.append(np.flatnonzero(np.diff(rank, prepend=-1)), len(rank)).tolist()
        self.places: dict[int, list[int]] = {int(rank[a]): here[a:b].tolist() for a, b in pairwise(first)}
        self.sym = sym

    def merge(self) -> None:
        """Apply the ranks present, the least first, until none is left."""
        merges, places = self.vocabulary.merges, self.places
        self.after, self.before = np.arange(1, len(self.sym) + 1), np.arange(-1, len(self.sym) - 1)
        self.agenda = list(places)
        heapify(self.agenda)
        while self.agenda:
            rank = heappop(self.agenda)
            here = places.pop(rank)
            (self.at_many if len(here) >= MANY else self.at_few)(here, *merges[rank])

    def at_many(self, here: list[int], a: int, b: int, new: int) -> None:
        """Merge a and b into new at all positions at once."""
        sym, after, before = self.sym, self.after, self.before
        i = np.sort(np.array(here))
        i = i[np.diff(i, prepend=-1) > 0]
        i = i[sym[i] == a]
        j = after[i]
        both = sym[j] == b
        i, j = i[both], j[both]
        if a == b and len(i):  # in a run of one symbol every other pair, from the left
            at = np.arange(len(i))
            begin = np.maximum.accumulate(np.where(np.append(True, i[1:] != j[:-1]), at, 0))
            odd = (at - begin) % 2 == 1
            i, j = i[~odd], j[~odd]
        k = after[j]
        sym[i], sym[j] = new, DEAD
        after[i], before[k] = k, i
        h = before[i]
        # END beside the new symbol gives a negative number, which no pair has.
        pair = np.concatenate([new << SHIFT | sym[k], sym[h] << SHIFT | new])
        rank = self.vocabulary.pairs.get(pair)
        some = np.flatnonzero((rank != NONE) & (pair >= 0))
        order = some[np.argsort(rank[some], kind="stable")]
        rank, at = rank[order], np.concatenate([i, h])[order].tolist()
        cut = np.append(np.flatnonzero(np.diff(rank, prepend=-1)), len(rank))
        for r, lo, hi in zip(rank[cut[:-1]].tolist(), cut.tolist(), cut[1:].tolist(), strict=False):
            if r in self.places:
                self.places[r] += at[lo:hi]
            else:
                self.places[r] = at[lo:hi]
                heappush(self.agenda, r)

    def at_few(self, here: list[int], a: int, b: int, new: int) -> None:
        """The same, one position after the other."""
        rank_of, places = self.vocabulary.ranks.get, self.places
        sym, after, before = self.sym.data, self.after.data, self.before.data
        here.sort()
        high = new << SHIFT
        for i in here:
            if sym[i] != a:
                continue
            j = after[i]
            if sym[j] != b:
                continue
            sym[i], sym[j] = new, DEAD
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            for at, r in ((i, rank_of(high | sym[k])), (h, rank_of(sym[h] << SHIFT | new))):
                if r is None:
                    continue
                if r in places:
                    places[r].append(at)
                else:
                    places[r] = [at]
                    heappush(self.agenda, r)

    def codes(self) -> list[tuple[int, ...]]:
        """The symbols of each word."""
        sym = self.sym
        ends = np.flatnonzero(sym == END)
        kept = sym >= 0
        at = np.cumsum(kept)[ends].tolist()
        flat = sym[kept].tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *at], at, strict=False)]


class WordEncoder:
    """Ids of blocks of texts; words met lately are kept, in two generations."""

    def __init__(self, vocabulary: WordVocabulary):
        self.vocabulary = vocabulary
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def codes(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct words."""
        special = self.vocabulary.special
        found = list(map(self.young.get, words))
        away = [k for k, code in enumerate(found) if code is None]
        new = []
        for k in away:
            code = self.old.get(words[k]) or ((special[words[k]],) if words[k] in special else None)
            if code is None:
                new.append(k)
            found[k] = code
        index = PairIndex(self.vocabulary, [words[k] for k in new])
        index.merge()
        for k, code in zip(new, index.codes(), strict=True):
            found[k] = code
        self.keep([words[k] for k in away], [found[k] for k in away])
        return found

    def keep(self, words: list[str], codes: list[tuple[int, ...]]) -> None:
        """Words that were not young go to the young generation, which becomes the old one when it is full."""
        for lo in range(0, len(words), 1000):
            w, c = words[lo : lo + 1000], codes[lo : lo + 1000]
            if len(self.young) >= KEPT_WORDS or self.size > KEPT_BYTES:
                self.young, self.old, self.size = {}, self.young, 0
            self.young.update(zip(w, c, strict=True))
            self.size += 200 * len(w) + 4 * sum(map(len, w)) + 36 * sum(map(len, c))

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after the other, and where each begins."""
        found = [self.vocabulary.words(t) for t in texts]
        begin = np.cumsum([0, *map(len, found)])
        words = list(chain.from_iterable(found))
        at = {w: k for k, w in enumerate(dict.fromkeys(words))}
        which = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        codes = self.codes(list(at))
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter(chain.from_iterable(codes), np.int32, int(size.sum()))
        each = size[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        from_ = (np.cumsum(size) - size)[which]
        return flat[np.repeat(from_ - ends[:-1], each) + np.arange(ends[-1])], ends[begin]


def decode_lists(vocabulary: WordVocabulary, ids: pa.ListArray) -> pa.Array:
    """The text of each list of ids."""
    values, at = ids.values.slice(ids.offsets[0].as_py()), ids.offsets.to_numpy()
    at = at - at[0]
    values = values.slice(0, int(at[-1]))
    known = pc.and_kleene(pc.greater_equal(values, 0), pc.less(values, len(vocabulary.token_column)))
    tokens = vocabulary.token_column.take(pc.if_else(known, values, None))
    if tokens.null_count:  # ids that stand for nothing
        kept = pc.is_valid(tokens).to_numpy(zero_copy_only=False)
        tokens, at = tokens.drop_null(), np.concatenate([[0], np.cumsum(kept)])[at]
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), tokens, mask=ids.is_null())
    return pc.binary_join(lists, " ")


_loaded: dict = {}


def vocabulary_of(data: bytes) -> WordVocabulary:
    key = zlib.crc32(data), len(data)
    if key not in _loaded:
        _loaded[key] = WordVocabulary(data)
    return _loaded[key]


def encode(text: Column, tokenizer: bytes) -> Column:
    """The token ids of each text."""

    def encode_batch(encoder: WordEncoder, texts: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        ids, begin = encoder.block([s or "" for s in raw])
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids), mask=pa.array([s is None for s in raw], type=pa.bool_()))

    @F.arrow_udf("array<int>")
    def encode_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = WordEncoder(vocabulary_of(tokenizer))  # its table goes with the task
        return each_batch(lambda texts: encode_batch(encoder, texts), batches)

    return encode_words(text)


def decode(ids: Column, tokenizer: bytes) -> Column:
    """The text of an array of token ids."""

    @F.arrow_udf("string")
    def decode_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_batch(lambda ids: decode_lists(vocabulary_of(tokenizer), ids), batches)

    return decode_words(ids)
