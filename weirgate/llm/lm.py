"""Language-model scores from a trigram model in Elias-Fano tries.

The model is an interpolation: a word gets its share of what followed its context, and the rest of the probability, which shrinks as the
context is seen more often, goes by the next shorter context. For a context seen n times, n^GROWTH more events
are set aside; below the words stands an additive estimate, so every text has a probability above zero.

1. Texts become chunks of a few MB: the places of words in the chunk's own list of words, and that list. The lists go to partitions by word,
   which count them over all learned texts and number them, frequent words first. That is all that is known of single words.
2. Each chunk sends its different word pairs and triples, with their counts, to shards by their first word (and the second, where the first
   is frequent). A shard adds up what was learned, writes it as a trie of quantised probabilities, maps it into memory and looks up what each chunk asked.
3. Chunks take the answers back and add up the words of each text.

A chunk sends a word, pair or triple once however often it has it, so the hottest one has a row per chunk. Packed arrays
travel, not rows. The shards grow in number with the corpus; nothing but a few totals reaches the driver.
A pair of two frequent words stays in one shard with all that follows it, once per chunk.

Defined cases: a null or empty text has its end alone. Rows with equal ids are different texts. A null id counts as learned. A text of any length is
scored whole (a long one is a chunk of its own). Where nothing is learned, all words get the additive estimate. An empty table
gives no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cores, give_back, partitions_for, rows_out, steps, task_number, tidy, utf8, written
from .tokens import LOWER
from .trie import Trie

# Bytes of text in a chunk; words of a partition that numbers them; words of texts in a shard.
CHUNK = 8 << 20
PART_WORDS = 2_000_000
SHARD_TOKENS = 1_200_000
# Events that are set aside for a context seen n times: n to this power, for pairs and triples. On sf0.1, held-out texts have 3.67 decades a word with
# these (single words: 4.15), 3.76 with 0.75 and 0.9, and 3.88 with 0.6 and 0.75.
GROWTH = (0.9, 1.0)
# Steps of a quantised probability in a decade; code 0 is no probability at all.
QUANTUM = 4096
# Numbers of the start and the end of a text; words come behind.
START, END, FIRST = 0, 1, 2

CHUNKS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("n", pa.int64()), ("words", pa.int64())])
CHUNKS_DDL = "chunk long, part int, ids array<long>, data binary, n long, words long"
SENT = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
SENT_DDL = "chunk long, part int, data binary"
SCORES = pa.schema(
    [("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
SCORES_DDL = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

CODEC = "zstd"


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers from zero on, each in as few bytes as its largest needs, byte by byte and compressed."""
    out = []
    for array in arrays:
        top = int(array.max()) if len(array) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        planes = array.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
        data = pa.compress(planes, CODEC, asbytes=True) if planes else b""
        out += [np.array([width, len(array), len(data)], "<u4").tobytes(), data]
    return b"".join(out)


def unpack(data: bytes, wide: bool = True) -> list[np.ndarray]:
    """The arrays, as 64-bit numbers or as narrow as they were packed."""
    out, at = [], 0
    while at < len(data):
        width, n, size = np.frombuffer(data, "<u4", 3, at).tolist()
        at += 12
        planes = pa.decompress(data[at : at + size], width * n, CODEC, asbytes=True) if n else b""
        array = np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").reshape(n)
        out.append(array.astype(np.int64) if wide or width == 8 else array)
        at += size
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of all texts as places in a list, that list, and how many words each text has."""
    data, offsets = utf8(texts)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes().translate(LOWER))]
    lists = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(texts), buffers), " ")
    found = lists.flatten().dictionary_encode()
    codes, names = found.indices.to_numpy(), found.dictionary.cast(pa.large_binary()).to_pylist()
    some = np.ones(len(codes), bool)
    if b"" in names:
        blank = names.index(b"")
        some, codes = codes != blank, codes - (codes > blank)
        names.pop(blank)
    ends = np.concatenate(([0], np.cumsum(some)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return codes[some].astype(np.int64), names, np.diff(ends)


def _mixed(sizes: np.ndarray) -> np.ndarray:
    """The order that takes the first of each of several lists, which lie one after the other, then the second of each, and so on."""
    rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.argsort(rank, kind="stable")


def _chunks(parts: int):
    """Per chunk a row with its texts (``part`` -1), and one per partition with its words there and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = task_number() << 33
        for batch in steps(batches, "text", CHUNK):
            codes, names, lengths = _words(batch.column(2))
            learned = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
            part = (of_word % np.uint64(parts)).astype(np.int64)
            total = np.bincount(codes, minlength=len(names))
            # Partition by partition, frequent words first; texts have small numbers for frequent words, which pack well.
            order = np.lexsort((-total, part))
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            place = np.empty(len(order), np.int64)
            place[order[_mixed(np.diff(edges))]] = np.arange(len(order))
            counts = np.bincount(codes, weights=np.repeat(learned, lengths), minlength=len(names)).astype(np.int64)
            codes = place[codes]
            rows = [(chunk, -1, batch.column(0).to_pylist(), pack([codes, lengths, learned.astype(np.int64)]), len(codes) + len(lengths), int(learned.sum()))]
            for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                own = slice(edges[p], edges[p + 1])
                text = pa.compress(joined := b" ".join(names[i] for i in order[own]), CODEC, asbytes=True)
                head = np.array([len(joined), len(text)], "<i8").tobytes()
                rows.append((chunk, p, None, head + text + pack([counts[order[own]], total[order[own]]]), 0, int(edges[p + 1] - edges[p])))
            yield rows_out(CHUNKS, list(zip(*rows, strict=True)))
            chunk += 1

    return run


def _word_list(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    size, packed = np.frombuffer(data, "<i8", 2).tolist()
    words = pa.array([pa.decompress(data[16 : 16 + packed], size, CODEC, asbytes=True).decode()], pa.large_string())
    return pc.split_pattern(words, " ").flatten(), *unpack(data[16 + packed :], wide=False)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows, which come sorted by it, of each part."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != at and held:
                yield at, held
                held = []
            at = row["part"]
            held.append(row)
    if held:
        yield at, held


def _numbers(parts: int):
    """Numbers and counts of a partition's words, for each chunk that has them; and a row with the partition's totals (chunk null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            # Of a list, only the words' places among all of the partition and their counts are kept.
            lists = [_word_list(row.pop("data")) for row in rows]
            ends = np.cumsum([len(x[0]) for x in lists])
            at = np.concatenate([c.indices.to_numpy() for c in pa.chunked_array([words for words, *_ in lists]).dictionary_encode().chunks])
            lists = [own for _, *own in lists]
            give_back()
            # Sums of counts as 64-bit floats are exact below 2^53.
            counts, total = (np.bincount(at, weights=np.concatenate([x[k] for x in lists])).astype(np.int64) for k in (0, 1))
            rank = np.empty(len(total), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
            number = FIRST + rank * parts + part
            yield rows_out(SENT, [[None], [part], [pack([np.array([(counts > 0).sum(), counts.sum()])])]])
            lists = None
            for row, start, end in zip(rows, [0, *ends[:-1]], ends, strict=True):
                mine = at[start:end]
                yield rows_out(SENT, [[row["chunk"]], [part], [pack([number[mine], counts[mine], total[mine]])]])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """Whole numbers spread over 64 bits."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Chunk:
    """Texts of a chunk with the numbers of their words, and the pairs and triples that they ask for."""

    def __init__(self, row: dict, answers: list[dict], totals: dict[str, int]) -> None:
        codes, self.lengths, learned = unpack(row["data"])
        own = [unpack(a["data"]) for a in sorted(answers, key=lambda a: a["part"])]
        number, count, total = ([np.concatenate([x[k] for x in own]) if own else np.zeros(0, np.int64) for k in range(3)])
        mixed = _mixed(np.array([len(x[0]) for x in own], np.int64))
        number, count, total = number[mixed], count[mixed], total[mixed]
        # Places in order of the words' numbers, the start and the end of a text first.
        order = np.argsort(number)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(FIRST, FIRST + len(order))
        self.numbers = np.concatenate(([START, END], number[order]))
        self.counts = np.concatenate(([totals["learned"]] * 2, count[order]))
        self.seen = np.concatenate(([totals["texts"]] * 2, total[order]))
        self.wide = len(self.numbers)
        # Each text: start, start, words, end.
        texts = len(self.lengths)
        starts = np.cumsum(self.lengths + 3) - (self.lengths + 3)
        line = np.full(len(codes) + 3 * texts, START, np.int64)
        line[np.repeat(starts + 2 - (np.cumsum(self.lengths) - self.lengths), self.lengths) + np.arange(len(codes))] = place[codes]
        line[starts + self.lengths + 2] = END
        asked = np.ones(len(line), bool)
        asked[starts], asked[starts + 1] = False, False
        at = np.flatnonzero(asked)
        self.word, self.before = line[at], line[at - 1]
        self.ends = np.cumsum(self.lengths + 1)
        weight = np.repeat(learned, self.lengths + 1).astype(np.float64)
        self.learned = learned.astype(bool)
        pairs, self.pair = np.unique(self.before * self.wide + self.word, return_inverse=True)
        # The context of a word is the pair before it; the first words of texts have a pair of starts, kept first.
        firsts = self.ends - self.lengths - 1
        self.context = np.concatenate(([0], self.pair[:-1] + 1)) if len(self.pair) else np.zeros(0, np.int64)
        self.context[firsts] = 0
        triples, self.triple = np.unique(self.context * self.wide + self.word, return_inverse=True)
        self.pair_words = np.concatenate(([[START], [START]], np.stack(np.divmod(pairs, self.wide))), axis=1)
        self.pair_counts = np.concatenate(([learned.sum()], np.bincount(self.pair, weights=weight, minlength=len(pairs)))).astype(np.int64)
        self.triple_context, self.triple_word = np.divmod(triples, self.wide)
        self.triple_counts = np.bincount(self.triple, weights=weight, minlength=len(triples)).astype(np.int64)

    def shards(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs by shard, and where the pairs and the triples of each shard begin in that order."""
        one, two = self.numbers[self.pair_words]
        split = -(-self.seen[self.pair_words[0]] // (SHARD_TOKENS // 8))
        sub = np.where(split > 1, _mix(two) % np.maximum(split, 1).astype(np.uint64), np.uint64(0))
        shard = (_mix(one.astype(np.uint64) + (sub << np.uint64(40))) >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        after = np.bincount(self.triple_context, minlength=len(order))[order]
        edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        return order, edges, np.concatenate(([0], np.cumsum(after)))[edges]

    def triples_of(self, order: np.ndarray) -> np.ndarray:
        """The triples, whose contexts are in order, in this order of contexts."""
        after = np.bincount(self.triple_context, minlength=len(order))
        begin = (np.cumsum(after) - after)[order]
        wide = after[order]
        return np.arange(len(self.triple_context)) + np.repeat(begin - (np.cumsum(wide) - wide), wide)


def _of_chunk(tokens: pa.Table, answers: pa.Table, totals: dict[str, int]) -> Chunk | None:
    """A chunk and the numbers of its words (answers with parts from 0 on)."""
    if not tokens.num_rows:
        return None
    return Chunk(tokens.to_pylist()[0], [a for a in answers.to_pylist() if a["part"] >= 0], totals)


def _send(shards: int, totals: dict[str, int]):
    def run(key: tuple[pa.Scalar, ...], tokens: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        chunk, rows = _of_chunk(tokens, answers, totals), []
        if chunk:
            order, pair_edges, triple_edges = chunk.shards(shards)
            triples = chunk.triples_of(order)
            after = np.bincount(chunk.triple_context, minlength=len(order))[order]
            for s in np.flatnonzero(pair_edges[1:] > pair_edges[:-1]).tolist():
                own = order[pair_edges[s] : pair_edges[s + 1]]
                some = triples[triple_edges[s] : triple_edges[s + 1]]
                # A first word is sent once for all its pairs here.
                first = chunk.pair_words[0][own]
                runs = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
                ones = chunk.numbers[first[runs]]
                arrays = [
                    np.diff(ones, prepend=0),
                    np.diff(np.append(runs, len(own))),
                    chunk.counts[first[runs]],
                    chunk.numbers[chunk.pair_words[1][own]],
                    chunk.pair_counts[own],
                    after[pair_edges[s] : pair_edges[s + 1]],
                    chunk.numbers[chunk.triple_word[some]],
                    chunk.triple_counts[some],
                ]
                rows.append((key[0].as_py(), s, pack(arrays)))
        return pa.Table.from_batches([rows_out(SENT, list(zip(*rows, strict=True)) if rows else [[], [], []])])

    return run


def _code(p: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.rint(-np.log10(p) * QUANTUM), 65535).astype(np.uint16)


def _decoded(code: np.ndarray, none: float) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code - 1) / QUANTUM), none)


def aside(n: np.ndarray, growth: float) -> np.ndarray:
    """Events set aside for the next shorter context."""
    return n.astype(np.float64) ** growth


LOW = np.int64((1 << 32) - 1)


class Shard:
    """What chunks ask of a shard: different pairs and triples, and what was learned of them."""

    def __init__(self, asked: list[list[np.ndarray]]) -> None:
        join = lambda k: np.concatenate([a[k] for a in asked])
        ones = np.concatenate([np.cumsum(a[0], dtype=np.int64) for a in asked])
        self.heads, one = np.unique(ones, return_inverse=True)
        self.head_counts = np.zeros(len(self.heads), np.int64)
        self.head_counts[one] = join(2)
        twos, threes = join(3), join(6)
        self.names = None
        if max(map(int, (twos.max(initial=0), threes.max(initial=0)))) > LOW:
            # More words than 32 bits tell apart: the shard numbers its own.
            self.names, places = np.unique(np.concatenate((twos, threes)), return_inverse=True)
            twos, threes = places[: len(twos)], places[len(twos) :]
        self.pairs, self.pair = np.unique(np.repeat(one, join(1)) << 32 | twos.astype(np.int64), return_inverse=True)
        self.pair_counts = np.bincount(self.pair, weights=join(4), minlength=len(self.pairs)).astype(np.int64)
        context = np.repeat(self.pair, join(5))
        self.triples, self.triple = np.unique(context << 32 | threes.astype(np.int64), return_inverse=True)
        self.counts = np.bincount(self.triple, weights=join(7), minlength=len(self.triples)).astype(np.int64)

    def word(self, key: np.ndarray) -> np.ndarray:
        low = key & LOW
        return low if self.names is None else self.names[low]

    def trie(self) -> Trie:
        """What was learned: words, what followed them, and what followed those."""
        some, inner = self.pair_counts > 0, self.counts > 0
        kept = np.cumsum(some) - 1
        pairs, n = self.pairs[some], self.pair_counts[some]
        triples, times = self.triples[inner], self.counts[inner]
        total, own_total = self.head_counts[pairs >> 32], self.pair_counts[triples >> 32]
        codes = [
            [],
            [_code(n / (total + aside(total, GROWTH[0]))), _code(aside(n, GROWTH[1]) / (n + aside(n, GROWTH[1])))],
            [_code(times / (own_total + aside(own_total, GROWTH[1])))],
        ]
        parents = [np.zeros(len(self.heads), np.int64), pairs >> 32, kept[triples >> 32]]
        return Trie.of([self.heads, self.word(pairs), self.word(triples)], parents, codes)

    def look_up(self, trie: Trie) -> list[np.ndarray]:
        """The codes of all different pairs (two each) and triples; 0 for those that weren't learned."""
        head = trie.find(0, np.zeros(len(self.heads), np.int64), self.heads)
        pair = trie.find(1, head[self.pairs >> 32], self.word(self.pairs))
        triple = trie.find(2, pair[self.triples >> 32], self.word(self.triples))

        def at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
            return np.where(places >= 0, codes[np.maximum(places, 0)], 0) if len(codes) else np.zeros(len(places), np.uint16)

        return [*(at(c, pair) for c in trie.levels[1][2]), at(trie.levels[2][2][0], triple)]


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's trie, and what it has for each pair and triple of each chunk. Answers have the part -1 - shard."""
    for number, rows in _by_part(batches):
        asked = [unpack(row["data"], wide=False) for row in rows]
        chunks = [(row["chunk"], len(a[3]), len(a[6])) for row, a in zip(rows, asked, strict=True)]
        rows.clear()
        shard = Shard(asked)
        asked.clear()
        with tempfile.TemporaryFile() as file:
            shard.trie().save(file)
            codes = shard.look_up(Trie.mapped(file))
        at = at_triple = 0
        for chunk, pairs, triples in chunks:
            own, inner = shard.pair[at : at + pairs], shard.triple[at_triple : at_triple + triples]
            yield rows_out(SENT, [[chunk], [-1 - number], [pack([codes[0][own], codes[1][own], codes[2][inner]])]])
            at, at_triple = at + pairs, at_triple + triples
        shard = codes = None
        give_back()


def _finish(shards: int, totals: dict[str, int]):
    def run(key: tuple[pa.Scalar, ...], tokens: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        chunk = _of_chunk(tokens, answers, totals)
        if chunk is None:
            return pa.Table.from_batches([rows_out(SCORES, [[]] * len(SCORES))])
        own = sorted((a for a in answers.to_pylist() if a["part"] < 0), key=lambda a: -a["part"])
        order, _, _ = chunk.shards(shards)
        parts = [unpack(a["data"]) for a in own]
        pair_code, rest_code, triple_code = (np.concatenate([p[k] for p in parts]) for k in range(3))
        pairs, rests, triples = np.empty(len(order)), np.empty(len(order)), np.empty(len(triple_code))
        pairs[order], rests[order] = _decoded(pair_code, 0.0), _decoded(rest_code, 1.0)
        triples[chunk.triples_of(order)] = _decoded(triple_code, 0.0)
        low = (chunk.counts + 0.5) / (totals["tokens"] + 0.5 * (totals["words"] + 1))
        rest = np.ones(chunk.wide)
        some = chunk.counts > 0
        rest[some] = aside(chunk.counts[some], GROWTH[0]) / (chunk.counts[some] + aside(chunk.counts[some], GROWTH[0]))
        two = pairs[chunk.pair + 1] + rest[chunk.before] * low[chunk.word]
        three = triples[chunk.triple] + rests[chunk.context] * two
        first = chunk.ends - chunk.lengths - 1
        add = lambda x: np.add.reduceat(x, first)
        ids = tokens.column("ids").to_pylist()[0]
        columns = [ids, ~chunk.learned, chunk.lengths + 1, add(some[chunk.word].astype(np.int64)), add(np.log10(low[chunk.word])), add(np.log10(three))]
        return pa.Table.from_batches([rows_out(SCORES, columns)])

    return run


def language_model_scores(df: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all texts under a trigram model of the ``learned`` ones.

    One row per input row: the id, ``held_out``, ``n_tokens`` (with the end), ``n_known``, ``train_tokens``, ``base_score`` (single words) and ``score``.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learned, F.lit(True)).alias("learned"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Different words grow slower than texts; a word in a hundred bytes is more than any corpus has.
    parts = partitions_for(size // 100, PART_WORDS, cores(df))
    chunks = written(docs.mapInArrow(tidy(_chunks(parts)), CHUNKS_DDL), "lm-chunks", 4 * CHUNK)
    texts = chunks.where("part < 0")
    tokens, learned_texts = texts.agg(F.sum("n"), F.sum("words")).first()
    if tokens is None:
        return docs.sparkSession.createDataFrame([], SCORES_DDL).withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(0).cast("long"))
    n_texts = texts.agg(F.sum(F.size("ids"))).first()[0]
    lists = chunks.where("part >= 0").select("chunk", "part", "data")
    numbers = written(lists.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(tidy(_numbers(parts)), SENT_DDL), "lm-numbers")
    sums = [unpack(r.data)[0] for r in numbers.where("chunk IS NULL").select("data").collect()]  # two numbers per partition
    totals = {
        "texts": int(n_texts),
        "learned": int(learned_texts),
        "tokens": int(sum(s[1] for s in sums)) + int(learned_texts),
        "words": int(sum(s[0] for s in sums)) + (learned_texts > 0),
    }
    numbers = numbers.where("chunk IS NOT NULL")
    shards = partitions_for(tokens, SHARD_TOKENS, cores(df))
    of_texts = texts.select("chunk", "ids", "data").groupBy("chunk")
    sent = of_texts.cogroup(numbers.groupBy("chunk")).applyInArrow(_send(shards, totals), SENT_DDL)
    found = written(sent.repartition(shards, "part").sortWithinPartitions("part", "chunk").mapInArrow(tidy(_look_up), SENT_DDL), "lm-found")
    answers = numbers.unionByName(found).groupBy("chunk")
    scores = of_texts.cogroup(answers).applyInArrow(_finish(shards, totals), SCORES_DDL)
    return scores.withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(totals["tokens"]).cast("long"))
