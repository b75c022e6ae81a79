"""Token counts by rank-synchronous merging of symbol arrays.

Texts fall apart at ASCII white space into units whose tokens don't depend on
what stands around them. The distinct new units of a slice of texts are
normalised and split by the tokenizer file's own rules; their distinct new
pre-tokens become one flat array of symbols with offsets, and in each round
every pre-token's lowest-ranked adjacent pair is merged wherever it stands in
that pre-token, for all of them at once. A pre-token without a pair that the
vocabulary merges leaves the arrays, and its symbols are its tokens. A very long
pre-token is merged by itself, rank by rank, from lists of the places of each
pair, so that a round costs what it merges and not the pre-token's length.

Defined results: null text counts as empty and has no bytes and no tokens; a
null id stays null; repeated rows are each counted; an empty table gives no rows;
extra columns are ignored. A special string inside a text is one token, as the
library has it by default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_alphabet
from .common import BATCH_BYTES, rows_of, text_bytes, texts_of, trim
from .words import as_array, byte_class, ends_of, runs, values

LIMIT = 2048
#: ASCII white space: the normaliser turns it into blanks, and no pre-token spans one.
BLANK = byte_class((9, 13), (32, 32))
#: Distinct units and pre-tokens that a worker remembers, and the longest of them; this bounds memory and changes no result.
UNITS, PARTS, MEMO_LENGTH = 400_000, 400_000, 64
#: Symbols of pre-tokens that are merged together; longer ones are merged by themselves.
TOGETHER, LONG = 1 << 20, 2048
NONE = np.iinfo(np.int64).max


class Merges:
    """The merges of a BPE vocabulary as sorted keys, for whole arrays of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, into = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.into = keys[order], order.astype(np.int64), into
        # The lowest pair may be merged wherever it stands only if no merge gives a symbol that an earlier merge needs.
        made = np.full(self.size, -1, np.int64)
        made[into] = np.arange(len(into))
        if len(set(into.tolist())) < len(into) or (np.maximum(made[left], made[right]) >= np.arange(len(into))).any():
            raise ValueError("merges must come after those that make their parts, and each symbol be made by one")
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The symbols of each pre-token's bytes; none is empty."""
        out = self.inner[data]
        out[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it isn't merged."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def count(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many symbols each sequence keeps when nothing is left to merge; none is empty."""
        lengths = np.diff(offsets)
        out, owner = lengths.copy(), np.repeat(np.arange(len(lengths)), lengths)
        # A pair's place is that of its left symbol; a sequence's last symbol has none.
        rank = np.full(len(symbols), NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest, sizes = np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbols)])
            done = lowest == NONE
            out[owner[first[done]]] = sizes[done]
            places = _apart(np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank < NONE)))
            symbols[places] = self.into[rank[places]]
            stays = np.repeat(~done, sizes)
            stays[places + 1] = False
            # Only pairs beside a merged one change.
            changed = np.zeros(len(symbols), bool)
            changed[places] = True
            symbols, owner, rank, changed = symbols[stays], owner[stays], rank[stays], changed[stays]
            changed[:-1] |= changed[1:]
            rank[changed] = NONE
            at = np.flatnonzero(changed[:-1] & (owner[:-1] == owner[1:]))
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        return out

    def count_long(self, symbols: np.ndarray) -> int:
        """The same of one long sequence."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def note(places):
            ranks = self.ranks(symbols[places], symbols[after[places]])
            order = np.argsort(ranks, kind="stable")
            order = order[: np.searchsorted(ranks[order], NONE)]
            if len(order):
                ranks, places = ranks[order], places[order]
                cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
                for rank, part in zip(ranks[cuts].tolist(), np.split(places, cuts[1:]), strict=True):
                    if rank not in waiting:
                        heapq.heappush(heap, rank)
                    waiting[rank].append(part)

        note(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (after[places] < n)]
            places = places[self.ranks(symbols[places], symbols[after[places]]) == rank]
            if not len(places):
                continue
            # Places that follow each other overlap; of a run of them every second one is merged.
            run = np.r_[False, after[places[:-1]] == places[1:]]
            nth = np.arange(len(places)) - np.maximum.accumulate(np.where(run, 0, np.arange(len(places))))
            places = places[nth % 2 == 0]
            gone = after[places]
            symbols[places] = self.into[rank]
            alive[gone] = False
            after[places] = after[gone]
            inner = places[after[places] < n]
            before[after[inner]] = inner
            left = before[places]
            note(np.unique(np.r_[left[left >= 0], inner]))
        return int(alive.sum())


def _apart(places: np.ndarray) -> np.ndarray:
    """Of each run of places that follow each other the first, third and so on."""
    if not len(places):
        return places
    run = np.r_[False, places[1:] == places[:-1] + 1]
    nth = np.arange(len(places)) - np.maximum.accumulate(np.where(run, 0, np.arange(len(places))))
    return places[nth % 2 == 0]


#: How the files that this module serves split a normalised text, and the same for lower-case letters of Latin-1, with the line's end that stands between units.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE_SPLIT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
#: Units that normalise to their lower case.
SIMPLE = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


class Counter:
    """Token counts of texts by one tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if SPLIT not in json.dumps(spec["pre_tokenizer"]).encode().decode("unicode_escape"):
            raise ValueError("the file must drop white space and split the rest by the known pattern")
        self._normal, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self._special = re.compile("|".join(sorted(map(re.escape, (t["content"] for t in spec["added_tokens"])), key=len, reverse=True)) or r"(?!)")
        self._byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self._units: dict[bytes, int] = {}
        #: Counts of pre-tokens, and of the line's end, which has none.
        self._parts: dict[str, int] = {}

    def _pretokens(self, unit: str) -> tuple[list[str], int]:
        """The unit's pre-tokens and how many special strings it holds, by the library's own rules."""
        apart = self._special.split(unit)
        parts = [p for t in apart if t for p, _ in self._split(self._normal(t))]
        return [bytes(map(self._byte_of.__getitem__, p)).decode() for p in parts], len(apart) - 1

    def _learn(self, parts: Iterable[str]) -> dict[str, int]:
        """The counts of pre-tokens, which the memo now has."""
        new = [*{*parts}.difference(self._parts, "\n")]
        coded = [p.encode() for p in new]
        sizes = np.array([len(c) for c in coded], np.int64)
        short = np.flatnonzero(sizes <= LONG)
        for group in _groups(sizes[short].tolist(), TOGETHER):
            own = short[group]
            data, offsets = np.frombuffer(b"".join([coded[i] for i in own]), np.uint8), ends_of(sizes[own])
            self._parts.update(zip([new[i] for i in own], self.merges.count(self.merges.symbols(data, offsets), offsets).tolist(), strict=True))
        for i in np.flatnonzero(sizes > LONG):
            self._parts[new[i]] = self.merges.count_long(self.merges.symbols(np.frombuffer(coded[i], np.uint8), np.array([0, sizes[i]])))
        self._parts["\n"] = 0
        return self._parts

    def _count_new(self, units: list[bytes]) -> np.ndarray:
        """The tokens of distinct units that the memo doesn't have."""
        texts = [u.decode() for u in units]
        special = bool(self._special.search("\n".join(texts)))
        simple = np.array([SIMPLE.fullmatch(t) is not None and not (special and self._special.search(t)) for t in texts], bool)
        out = np.zeros(len(units), np.int64)
        cut = {i: self._pretokens(texts[i]) for i in np.flatnonzero(~simple)}
        flat = SIMPLE_SPLIT.findall("".join([texts[i].lower() + "\n" for i in np.flatnonzero(simple)]))
        seen = {*flat, *chain.from_iterable(c[0] for c in cut.values())}
        known = self._learn(seen).__getitem__
        if flat:
            # Each unit's pre-tokens end with a line's end.
            counts = ends_of(np.fromiter(map(known, flat), np.int64, len(flat)))
            ends = np.flatnonzero(np.fromiter((p == "\n" for p in flat), bool, len(flat)))
            out[simple] = np.diff(counts[np.r_[0, ends + 1]])
        for i, (parts, n) in cut.items():
            out[i] = sum(map(known, parts)) + n
        for p in seen:
            if len(p) > MEMO_LENGTH:
                del self._parts[p]
        return out

    def units(self, units: list[bytes]) -> np.ndarray:
        """The tokens of each of some distinct units."""
        if len(self._units) > UNITS:
            self._units.clear()
        if len(self._parts) > PARTS:
            self._parts.clear()
        out = np.fromiter(map(self._units.get, units, repeat(-1)), np.int64, len(units))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = [units[i] for i in at]
            out[at] = self._count_new(new)
            self._units.update((u, n) for u, n in zip(new, out[at].tolist(), strict=True) if len(u) <= MEMO_LENGTH)
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens of each text of a column."""
        starts, ends, rows = runs(data, offsets, ~BLANK[data])
        out = np.zeros(len(offsets) - 1, np.int64)
        if len(starts):
            inside = ~BLANK[data]
            coded = as_array(data[inside], ends_of(ends - starts), pa.large_binary()).dictionary_encode()
            counts = self.units(values(coded.dictionary))[coded.indices.to_numpy()]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            out[rows[first]] = np.add.reduceat(counts, first)
        return out


def _groups(lengths: list[int], most: int) -> Iterator[slice]:
    """Slices of items with at most about so many symbols, or one item."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if held:
        yield slice(start, len(lengths))


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """This process's counter for a file; tasks of one worker share its memo."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens and whether those are over the limit. No shuffle; a task holds a slice of texts and its memo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part in rows_of(batch, BATCH_BYTES):
                data, offsets = text_bytes(part.column(1))
                tokens = counter.texts(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])
        trim()

    counted = texts_of(docs, id_column).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", "over_limit")
