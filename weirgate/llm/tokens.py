"""Ids of whole texts by the tokenizers library, with a bounded memory of the words seen.

The library works on one word at a time once a text is split, so a word's ids are asked for once per
Python worker. ``BlankEncoder`` is for vocabularies that lower-case and drop white space; for the ones
that keep it there is ``bpe.PieceEncoder``. A text in which a special token is written out is left to the library as a whole,
which finds the token there. ``TextEncoder`` takes whole texts of byte-level vocabularies whose ids are merge ranks.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import MEMORY, Memory, PieceEncoder, gathered
from .common import give_back, once, utf8

# Longer stretches of a text than this many bytes are encoded piece-wise.
LONGEST_PLAIN = 2000
# ASCII letters in lower case, and a space for each ASCII blank.
LOWER = bytes(32 if 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x for x in range(256))


def _library(path: str, plain: Callable[[str], bool], between: str, mark: Callable[[str], bool], at_end: bool):
    """Ids of new words. Plain words go to the library as one text, whose ids are cut where ``mark`` says."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    marked = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    marked[[i for token, i in tokenizer.get_vocab().items() if mark(token)]] = True

    def ids_of(words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(words: list[str]) -> list[bytes]:
        together = [w for w in words if plain(w)]
        ids = np.array(tokenizer.encode_batch_fast([between.join(together)], add_special_tokens=False)[0].ids, "<u4") if together else np.zeros(0, "<u4")
        cuts = np.flatnonzero(marked[ids])
        if len(cuts) != len(together):
            return ids_of(words)
        cuts = np.concatenate(([0], cuts + 1)) if at_end else np.append(cuts, len(ids))
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        own = dict(zip(together, (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        rest = [w for w in words if w not in own]
        own.update(zip(rest, ids_of(rest), strict=True))
        return [own[w] for w in words]

    return encode


def _whole(path: str) -> tuple[Callable[[pa.Array], np.ndarray], Callable[[str], bytes]]:
    """Which texts have a special token written out, and the ids of one text by the library alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

    def apart(texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for special in specials:
            found |= pc.fill_null(pc.match_substring(texts, special, ignore_case=True), False).to_numpy(zero_copy_only=False)
        return found

    return apart, lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """The encoder of a byte-level vocabulary whose pre-tokens are the matches of ``pattern``."""

    return once(("piece_encoder", path, pattern), lambda: _pieces(path, pattern, MEMORY))


def _pieces(path: str, pattern: str, memory: int) -> PieceEncoder:
    apart, one = _whole(path)
    return PieceEncoder(pattern, _library(path, _spaced_word, "", lambda t: t.startswith("Ġ"), False), memory, apart, one)


def _bytes_of_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The ids of a byte-level vocabulary as merge ranks by piece, None if its merges aren't in the order of its ids."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    byte, special = _bytes_of_signs(), {t["content"] for t in whole.get("added_tokens", ())}
    model = whole["model"]
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(sign not in byte for token in vocabulary for sign in token):
        return None
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = [i for t, i in vocabulary.items() if len(t) == 1]
    if None in merged or merged != sorted(merged) or len(single) != 256 or max(single) >= min(merged, default=1 << 32):
        return None
    return {bytes(byte[sign] for sign in token): i for token, i in vocabulary.items()}


def long_stretch(data: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """Which of the texts, given as UTF-8, have a stretch of over ``most`` bytes without a space, or of spaces alone."""
    space, begin = data == 32, np.ones(len(data), bool)
    np.not_equal(space[1:], space[:-1], out=begin[1:])
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    begins = np.flatnonzero(begin)
    wide = np.diff(np.append(begins, len(data)))
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, begins[wide > most], "right") - 1] = True
    return out


class TextEncoder:
    """Ids of whole texts for a byte-level vocabulary, by merge ranks; odd texts are left to a piece-wise encoder.

    Odd are texts with a special token written out, and those with a word so long that merging it pair by pair would take the square of its length.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, rest: PieceEncoder) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.rest = rest

    def many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        odd = self.rest.apart(column) | long_stretch(*utf8(column), LONGEST_PLAIN)
        found = []
        for text, own in zip(column.to_pylist(), odd.tolist(), strict=True):
            found.append(np.frombuffer(self.rest.one(text), "<u4") if own else self.encoding.encode_to_numpy(text or "", disallowed_special=()))
        ids = np.concatenate(found).astype("<u4", copy=False) if found else np.zeros(0, "<u4")
        return ids, np.fromiter(map(len, found), np.int64, len(found))


def text_encoder(path: str, pattern: str) -> TextEncoder | PieceEncoder:
    """The encoder of a byte-level vocabulary whose pre-tokens are the matches of ``pattern``, for whole texts."""

    def make() -> TextEncoder | PieceEncoder:
        ranks = merge_ranks(path)
        # Odd texts are few: the encoder of pieces remembers little for them.
        rest = piece_encoder(path, pattern) if ranks is None else _pieces(path, pattern, 10_000)
        found = rest if ranks is None else TextEncoder(ranks, pattern, rest)
        # The vocabulary was parsed more than once.
        del ranks
        give_back()
        return found

    return once(("text_encoder", path, pattern), make)


def _spaced_word(word: str) -> bool:
    return word[0] == " " and word[1:].isalpha()


# Stands behind each word; no letter, and no text of a plain word has it.
WORD_END = "\U0010fffd"


def marked_ranks(path: str, suffix: str = "</w>") -> tuple[dict[bytes, int], np.ndarray] | None:
    """A vocabulary whose words end in a sign of their own, as merge ranks of words with ``WORD_END`` behind them, and the id of each rank.

    The mark is merged first, with the last byte of a word; then come the vocabulary's merges in their order. None if they don't fit that.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, byte, mark = model["vocab"], _bytes_of_signs(), WORD_END.encode()
    ranks = {bytes([b]): b for b in range(256)}
    ids = {i: vocabulary.get(sign) for sign, i in byte.items()}

    def add(piece: bytes, token: int | None) -> bool:
        """The next rank, if no other has the piece."""
        ids[len(ranks)] = token
        return token is not None and ranks.setdefault(piece, len(ranks)) == len(ids) - 1

    fits = [add(mark[:n], 0) for n in range(2, len(mark) + 1)]
    fits += [add(bytes([i]) + mark, vocabulary.get(sign + suffix)) for sign, i in byte.items()]
    for merge in model["merges"]:
        token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
        signs = token.removesuffix(suffix)
        if any(s not in byte for s in signs):
            return None
        fits.append(add(bytes(byte[s] for s in signs) + mark * token.endswith(suffix), vocabulary.get(token)))
    if not all(fits) or None in ids.values():
        return None
    return ranks, np.array([ids[i] for i in range(len(ids))], "<u4")


# Letters that the vocabulary's normalisation leaves as they are.
_LETTERS = "".join(x for x in map(chr, range(0x250)) if x.isalpha() and x == x.lower())
# A plain word of those, and the marks after it, which the vocabulary's pattern takes as one word whatever they are.
PLAIN = f"^(?P<core>[{_LETTERS}]+)(?P<marks>[{re.escape(string.punctuation)}]*)$"


def plain_words(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None:
    """Gives the ids of plain words, one after the other, and how many each has, by merge ranks and all in one text. None if the vocabulary has none."""
    found = marked_ranks(path)
    if found is None:
        return None
    import tiktoken

    ranks, ids = found
    encoding = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
    last = np.zeros(len(ids), bool)
    # The mark alone isn't left, as it is merged with the byte before it.
    last[[i for token, i in ranks.items() if token.endswith(WORD_END.encode())]] = True

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        together = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(WORD_END, words.type))[0].as_py() + WORD_END
        tokens = encoding.encode_to_numpy(together, disallowed_special=()) if len(words) else np.zeros(0, np.uint32)
        return ids[tokens], np.diff(np.flatnonzero(last[tokens]), prepend=-1)

    return encode


class BlankEncoder:
    """Ids of a text given as UTF-8 bytes, for a vocabulary that drops blanks and ignores case.

    Plain words go through ``plain`` whenever they come, which costs less than to remember them; what else there is, is remembered.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[bytes]],
        memory: int = MEMORY,
        apart: Callable[[pa.Array], np.ndarray] | None = None,
        one: Callable[[str], bytes] | None = None,
        plain: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None = None,
    ) -> None:
        self.encode, self.words, self.cores = encode, Memory(memory), Memory(memory)
        self.apart, self.one, self.plain = apart, one, plain

    def _new(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new words; a plain word and the marks after it are looked up apart."""
        parts: list[tuple[str, ...]] = []
        for word in map(bytes.decode, new):
            core = word.rstrip(string.punctuation)  # İ becomes two signs in lower case
            parts.append((core, word[len(core) :]) if len(core) < len(word) and core.isalpha() and "İ" not in core else (word,))
        asked = list(dict.fromkeys(x for pair in parts for x in pair))
        found, missing = self.cores.recall(asked)
        known = dict(zip(asked, found, strict=True))
        if missing:
            fresh = [asked[i] for i in missing]
            fresh = dict(zip(fresh, self.encode(fresh), strict=True))
            self.cores.add(fresh)
            known |= fresh
        own = {word: b"".join(known[x] for x in pair) for word, pair in zip(new, parts, strict=True)}
        self.words.add(own)
        return own

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        found, missing = self.words.recall(words)
        if missing:
            own = self._new([words[i] for i in missing])
            for i in missing:
                found[i] = own[words[i]]
        return found

    def _entries(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after the other, and how many each has."""
        if self.plain is None:
            ids = self._ids(words.cast(pa.large_binary()).to_pylist())
            return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        parts = pc.extract_regex(words, PLAIN)
        cores, marks = (parts.field(x) for x in ("core", "marks"))
        plain = pc.and_(parts.is_valid(), pc.fill_null(pc.less(pc.utf8_length(cores), LONGEST_PLAIN), False))
        cores, marks = (x.filter(plain).dictionary_encode() for x in (cores, marks))
        ids, wide = self.plain(cores.dictionary)
        known = pa.concat_arrays([marks.dictionary, words.filter(pc.invert(plain))])
        others = self._ids(known.cast(pa.large_binary()).to_pylist())
        ids = np.concatenate((ids, np.frombuffer(b"".join(others), "<u4")))
        # A word is two of these entries, a core and its marks, or one and the empty entry at the end.
        n, few, plain = len(wide), len(marks.dictionary), plain.to_numpy(zero_copy_only=False)
        wide = np.concatenate((wide, np.fromiter(map(len, others), np.int64, len(others)) // 4, [0]))
        both = np.full((len(words), 2), len(wide) - 1)
        both[plain, 0], both[plain, 1] = cores.indices.to_numpy(), n + marks.indices.to_numpy()
        both[~plain, 0] = np.arange(n + few, len(wide) - 1)
        ids, ends = gathered(ids, wide, both.ravel())
        return ids, np.diff(ends[1::2], prepend=0)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. A word is looked up once for all of them."""
        whole = np.flatnonzero(self.apart(texts)) if self.apart is not None else ()
        if len(whole):
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            rest = pc.if_else(pa.array(mask), "", texts)
        data, offsets = utf8(rest if len(whole) else texts)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes().translate(LOWER))]
        lists = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(texts), buffers), " ")
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        ids, wide = self._entries(words.dictionary)
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # A text that is left to the library is an entry of its own.
        codes[begin[:-1][whole]] = len(wide) + np.arange(len(whole))
        own = [np.frombuffer(self.one(texts[int(i)].as_py()), "<u4") for i in whole]
        found, ends = gathered(np.concatenate((ids, *own)), np.concatenate((wide, np.fromiter(map(len, own), np.int64, len(own)))), codes)
        return found, np.diff(np.concatenate(([0], ends))[begin])

    def __call__(self, text: bytes) -> bytes:
        return self.many(pa.array([text.decode()]))[0].tobytes()


def blank_encoder(path: str) -> BlankEncoder:
    def make() -> BlankEncoder:
        apart, one = _whole(path)
        encode = _library(path, str.isalpha, " ", lambda t: t.endswith("</w>"), True)
        return BlankEncoder(encode, apart=apart, one=one, plain=plain_words(path))

    return once(("blank_encoder", path), make)
