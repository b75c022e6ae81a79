"""Sum-of-squares online packing of token sequences into windows.

A task reads its documents in order and keeps N(h), the number of partially
filled windows with fill level h, in one array. A document's remainder of s
tokens goes to the level h for which the sum of N(h)^2 after the move is
smallest; level 0 stands for a new window. Documents of a window or more fill
whole windows first. At a task's end the windows that are filled to AS_IT_STANDS
or more stay as the choice left them and are padded; only the emptier ones are
dissolved and cut into whole windows and windows whose size is a power of two,
which need no padding. How many windows stand open is up to the choice, which
keeps few of a level, and at most those of the task's own documents; ids of
vocabularies below 65,536 wait in two bytes each.

Defined results: null text counts as empty (one token, the end id); a special
string in a text is one id, as the library has it by default; a null id stays
null; tasks pack independently, and the task's number is part of sequence_id, so
no id repeats; repeated rows are each packed; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import rows_of, texts_of, trim

WINDOW = 4096
END_ID = 2
#: The fill from which on a window is padded at a task's end.
AS_IT_STANDS = 0.95
#: Distinct words and pre-tokens that a task remembers before their memo starts anew; this bounds memory and changes no result.
WORDS, PARTS = 400_000, 400_000
MEMO_LENGTH = 64
#: A task's sequence numbers stay below 2 ** TASK_BITS.
TASK_BITS = 40
#: White space at which a text may be split without changing its ids: the
#: normaliser turns each run of it into one blank, and no piece spans a blank.
BLANKS = " \t\n\r\x0b\x0c"


class WordIds:
    """Ids of texts by a tokenizers file, memorised by word and by pre-token.

    Words of printable Latin-1 characters are lower-cased and cut here as the
    file's normaliser and splitter do, and its BPE model gives the ids of each
    pre-token; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .byte_bpe import byte_alphabet

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        special = [re.escape(t.content) for t in self._whole.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(special) or r"(?!)").search
        self._letters = dict(enumerate(byte_alphabet()))
        self._simple = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
        self._split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+").findall
        self._words, self._parts = _Memo(self._word), _Memo(self._part)

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
        return _packed([t.id for t in self._model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if self._simple(word) and not self._special(word):
            return b"".join(map(self._parts.__getitem__, self._split(word.lower())))
        return _packed(self._whole.encode(word, add_special_tokens=False).ids)

    def forget(self) -> None:
        self._words.clear()
        self._parts.clear()

    def __call__(self, text: str) -> bytes:
        if len(self._words) > WORDS:
            self._words.clear()
        if len(self._parts) > PARTS:
            self._parts.clear()
        for blank in BLANKS[1:]:
            text = text.replace(blank, " ")
        return b"".join(map(self._words.__getitem__, text.split(" ")))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """Results of a function by its argument, kept for short arguments."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        out = self.function(key)
        if len(key) <= MEMO_LENGTH:
            self[key] = out
        return out


_IDS: dict[str, WordIds] = {}


def ids_by(path: str) -> WordIds:
    """This process's WordIds for a file; tasks of one worker share its memo."""
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


class Levels:
    """The level array N of one task, and the windows that stand at each level."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.standing: dict[int, list[list]] = {}
        self.open = 0

    def choose(self, size: int) -> int:
        """The level h at which adding size tokens gives the smallest sum of N(h)^2."""
        n, top = self.count, self.window - size
        # Taking a window from h changes the sum by 1 - 2 N(h), giving one to h + size by 1 + 2 N(h + size); full windows don't count.
        change = 1 + 2 * n[size : self.window + 1].copy()
        change[top] = 0
        change[1:] += 1 - 2 * n[1 : top + 1]
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        # Of equal changes the fullest window is taken.
        return int(top - np.argmin(change[::-1]))

    def take(self, level: int) -> list:
        if level == 0:
            return []
        self.count[level] -= 1
        self.open -= 1
        return self.standing[level].pop()

    def put(self, level: int, pieces: list) -> None:
        self.count[level] += 1
        self.open += 1
        self.standing.setdefault(level, []).append(pieces)

    def rest(self) -> Iterator[tuple[int, list]]:
        for level in sorted(self.standing):
            yield from ((level, pieces) for pieces in self.standing[level])


def pack_stream(docs: Iterator[tuple[int, bytes]], window: int = WINDOW, keep: float = AS_IT_STANDS, report: dict | None = None) -> Iterator[tuple]:
    """(doc_id, packed ids) to (doc_id, start, length, crc32, doc_tokens, sequence, offset).

    report, if given, counts tokens, those of them that the final cut deals out,
    padding, and the most windows that stood open.
    """
    levels, sequence, size = Levels(window), 0, 4 * window
    counts = report if report is not None else {}
    counts.update(tokens=0, cut=0, padding=0, open=0)

    def close(pieces):
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in pieces:
            ids = _wide(ids)
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset
            offset += len(ids) // 4
        sequence += 1

    for doc, ids in docs:
        total, at = len(ids) // 4, 0
        counts["tokens"] += total
        while len(ids) - at >= size:
            yield from close([(doc, at // 4, ids[at : at + size], total)])
            at += size
        if at < len(ids):
            length = (len(ids) - at) // 4
            level = levels.choose(length)
            pieces = levels.take(level)
            pieces.append((doc, at // 4, _narrow(ids[at:]), total))
            if level + length == window:
                yield from close(pieces)
            else:
                levels.put(level + length, pieces)
                counts["open"] = max(counts["open"], levels.open)
    rest, left = [], 0
    for level, pieces in levels.rest():
        if level >= keep * window:
            # Without a power of two for a size, the window is padded to its end.
            counts["padding"] += 0 if level & (level - 1) == 0 else window - level
            yield from close(pieces)
        else:
            rest += pieces
            left += level
    counts["cut"] = left
    # The rest: cut freely into whole windows, then into powers of two.
    rest = [(doc, start, _wide(ids), total) for doc, start, ids, total in reversed(rest)]
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        left -= room
        pieces = []
        while room:
            doc, start, ids, total = rest.pop()
            pieces.append((doc, start, ids[: 4 * room], total))
            if len(ids) > 4 * room:
                rest.append((doc, start + room, ids[4 * room :], total))
            room -= min(room, len(ids) // 4)
        yield from close(pieces)


def _narrow(ids: bytes):
    """Ids for waiting: an array of two bytes each where they fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2") if wide.max() < 1 << 16 else wide


def _wide(ids) -> bytes:
    return ids if isinstance(ids, bytes) else ids.astype("<u4").tobytes()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id") -> DataFrame:
    """One row per piece. No shuffle: each task packs its own documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = ids_by(path), np.asarray([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << TASK_BITS
        names = [c.split()[0] for c in PIECES.split(", ")]

        def stream():
            for batch in batches:
                for part in rows_of(batch):
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        yield doc, ids_of(text) + end
            ids_of.forget()
            trim()

        def out(rows):
            columns = [list(c) for c in zip(*rows, strict=True)]
            columns[5] = [first + s for s in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        rows = []
        for row in pack_stream(stream(), window):
            rows.append(row)
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return texts_of(docs, id_column).mapInArrow(run, PIECES)
