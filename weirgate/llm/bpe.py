"""Byte-level BPE: encoding by a segment tree of pair ranks, decoding, and piece-wise encoding of texts.

A word's pairs of neighbouring pieces are the leaves of a segment tree over byte positions. Every
inner place holds the smallest (rank, position) below it, so the root names the leftmost pair to
merge next, and a merge changes three leaves in a logarithmic number of steps each. Words are
remembered per Python worker in a bounded table; texts are taken apart at spaces first, where a cut
can't change the words that the pattern finds.

Defined cases: a null text is empty and has no ids; the digest of nothing is that of the empty
string. Very long words cost n log n steps. Repeated and extra columns make no difference.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, rows_out, texts, utf8

# Above the key of every pair, whatever its rank and position.
NONE = 1 << 62
# Words, and parts, that one worker remembers in each of two generations.
MEMORY = 400_000
# Signs after a word that the patterns split off as one word.
MARKS = ".,;:!?"
# Longer words aren't remembered.
LONGEST = 100

# A blank before a space: there the pattern looks further than one part.
_LOOKS_ON = re.compile(r"\s ")
# The same in UTF-8: blanks of one byte, and the last two bytes of longer ones (and of a few signs more).
_SHORT = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_FIRST, _LAST = np.isin(np.arange(256), [0xC2, 0x80, 0x81, 0x9A]), np.isin(np.arange(256), [0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)])


def looks_on(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of the texts, given as UTF-8, may have a blank before a space."""
    space = data == 32
    hit = np.zeros(len(data) + 1, bool)
    hit[1:-1] = space[1:] & _SHORT[data[:-1]]
    hit[2:-1] |= space[2:] & _LAST[data[1:-1]] & _FIRST[data[:-2]]
    before = np.cumsum(hit)
    # A space that begins a text has the blank of another one before it, or none.
    return before[np.maximum(offsets[1:] - 1, 0)] - before[np.minimum(offsets[:-1], len(data))] > 0


def gathered(flat: np.ndarray, wide: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of different lengths, which lie one after the other in ``flat``, in the order of their codes, and where each of those ends."""
    own = wide[codes]
    ends = np.cumsum(own)
    # Where an entry lies in ``flat``, less where it goes.
    shift = (np.cumsum(wide) - wide)[codes] - (ends - own)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(shift, own)], ends


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the leftmost pair of lowest rank is merged until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << 32 | i
    for i in range(width - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    # A piece starts at a live position and ends where the next live one starts.
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    get = ranks.get
    while (root := tree[1]) != NONE:
        at = root & 0xFFFFFFFF
        gone = after[at]
        end = after[at] = after[gone]
        changed = []
        if end < n:
            before[end] = at
            rank = get(word[at : after[end]])
            changed.append((at, NONE if rank is None else rank << 32 | at))
            changed.append((gone, NONE))
        else:
            changed.append((at, NONE))
            if gone < n - 1:
                changed.append((gone, NONE))
        left = before[at]
        if left >= 0:
            rank = get(word[left:end])
            changed.append((left, NONE if rank is None else rank << 32 | left))
        for place, key in changed:
            place += width
            if tree[place] == key:
                continue
            tree[place] = key
            while place > 1:
                other = tree[place ^ 1]
                if other < key:
                    key = other
                place >>= 1
                if tree[place] == key:
                    break
                tree[place] = key
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : after[at]]])
        at = after[at]
    return ids


class Memory:
    """What was found for recent keys. When the young half is full it takes the old one's place."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def recall(self, keys: list) -> tuple[list, list[int]]:
        """What is known of each key, None for the others, and where those are."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found, []
        missing = [i for i, value in enumerate(found) if value is None]
        if self.old:
            for i in missing:
                if (value := self.old.get(keys[i])) is not None:
                    found[i] = self.young[keys[i]] = value
            missing = [i for i in missing if found[i] is None]
        return found, missing

    def add(self, own: dict) -> None:
        if len(self.young) + len(own) > self.most:
            self.old, self.young = self.young, {}
        self.young.update((key, value) for key, value in own.items() if len(key) < LONGEST)


class PieceEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    ``encode`` maps new words (matches of ``pattern``) to their id bytes. A part is what stands between
    two spaces; a plain word and the marks behind it are words of their own. Forgetting costs time and
    never changes a result.
    """

    def __init__(
        self,
        pattern: str,
        encode: Callable[[list[str]], list[bytes]],
        memory: int = MEMORY,
        apart: Callable[[pa.Array], np.ndarray] | None = None,
        one: Callable[[str], bytes] | None = None,
    ) -> None:
        self.find = regex.compile(pattern).findall
        self.encode = encode
        self.words, self.parts = Memory(memory), Memory(memory)
        # Texts that ``apart`` marks are left to ``one`` as they are.
        self.apart, self._one = apart, one

    def one(self, text: str) -> bytes:
        if self._one is not None and self.apart(pa.array([text], pa.string()))[0]:
            return self._one(text)
        return self._plain(text)

    def _ids(self, words: list[str]) -> list[bytes]:
        found, missing = self.words.recall(words)
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            own = dict(zip(new, self.encode(new), strict=True))
            self.words.add(own)
            for i in missing:
                found[i] = own[words[i]]
        return found

    def _new_parts(self, parts: list[str]) -> dict[str, bytes]:
        words, counts = [], []
        for part in parts:
            core = part.rstrip(MARKS)
            if core.isalpha():
                own = [" " + core] if len(core) == len(part) else [" " + core, part[len(core) :]]
            else:
                own = self.find(" " + part)
            words += own
            counts.append(len(own))
        ids, own, at = self._ids(words), {}, 0
        for part, n in zip(parts, counts, strict=True):
            own[part] = b"".join(ids[at : at + n])
            at += n
        self.parts.add(own)
        return own

    def many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. A part is looked up once for all of them."""
        data, offsets = utf8(column)
        whole = looks_on(data, offsets)
        if self.apart is not None:
            whole |= self.apart(column)
        plain = pc.if_else(pa.array(whole), "", pc.fill_null(column, "")).cast(pa.large_string())
        lists = pc.split_pattern(plain, " ")
        parts = lists.flatten().dictionary_encode()
        codes, known = parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_pylist()
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # What a text begins with has no space before it, so it is an entry of its own; so is a text that can't be taken apart.
        firsts = []
        for i, (w, code) in enumerate(zip(whole.tolist(), codes[begin[:-1]].tolist(), strict=True)):
            firsts.append(self.one(column[i].as_py()) if w else b"".join(self._ids(self.find(known[code]))))
        codes[begin[:-1]] = len(known) + np.arange(len(firsts))
        inside = np.unique(codes[codes < len(known)]).tolist()
        entries = [b""] * len(known)
        for i, own in zip(inside, self._of_parts([known[i] for i in inside]), strict=True):
            entries[i] = own
        entries += firsts
        wide = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        ids, ends = gathered(np.frombuffer(b"".join(entries), "<u4"), wide, codes)
        return ids, np.diff(np.concatenate(([0], ends))[begin])

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        found, missing = self.parts.recall(parts)
        if missing:
            own = self._new_parts(list(dict.fromkeys(parts[i] for i in missing)))
            for i in missing:
                found[i] = own[parts[i]]
        return found

    def __call__(self, text: str) -> bytes:
        if self.apart is not None and self.apart(pa.array([text], pa.string()))[0]:
            return self.one(text)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _LOOKS_ON.search(text):
            return b"".join(self._ids(self.find(text)))
        first, *rest = text.split(" ")
        return b"".join(self._ids(self.find(first))) + b"".join(self._of_parts(rest))


def _ids_as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_bpe(path: str, pattern: str) -> tuple[PieceEncoder, list[bytes]]:
    """An encoder for the ranks at ``path``, and the bytes of each id."""

    def make() -> tuple[PieceEncoder, list[bytes]]:
        ranks = read_ranks(path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        return PieceEncoder(pattern, lambda words: [_ids_as_bytes(merge_word(w.encode(), ranks)) for w in words]), pieces

    return once(("byte_bpe", path, pattern), make)


def decode(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I")))


def _select(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and ``ids``, an array of token ids."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = byte_bpe(path, pattern)
        for batch in batches:
            ids = [memoryview(encoder(t)).cast("I").tolist() for t in texts(batch.column(1))]
            yield rows_out(schema, [batch.column(0), ids])

    return _select(df, id_col, text_col).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that each row's ids stand for, in ``data``; a null array gives none."""
    schema = pa.schema([("id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = byte_bpe(path, "(?!)")
        for batch in batches:
            yield rows_out(schema, [batch.column(0), [b"".join(pieces[i] for i in x or ()) for x in batch.column(1).to_pylist()]])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, data binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: number of ids and SHA-256 of the ids and of the decoded bytes."""
    schema = pa.schema(
        [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = byte_bpe(path, pattern)
        for batch in batches:
            ids = [encoder(t) for t in texts(batch.column(1))]
            yield rows_out(
                schema,
                [
                    batch.column(0),
                    [len(x) // 4 for x in ids],
                    [hashlib.sha256(x).hexdigest() for x in ids],
                    [hashlib.sha256(decode(x, pieces)).hexdigest() for x in ids],
                ],
            )

    ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _select(df, id_col, text_col).mapInArrow(run, ddl).withColumnRenamed("id", id_col)
