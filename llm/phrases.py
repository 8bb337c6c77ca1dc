"""Collocations: phrases scored by how much more often they occur than their parts explain.

Phrases are counted level by level, words first.  A phrase can only be frequent
if the two phrases that it holds without its last and without its first word
are, so each level counts the occurrences that the level before admits; what
is below the threshold plays no part in any score or in what is dropped.

A task counts in a HAT-trie: a shallow trie over word ids whose leaves are hash
containers of the rest of the phrase.  A container that grows past a size
bursts into a node with a container for each next word.  When a task holds too
many entries its largest subtrees are spilled whole, as sorted runs cut by
prefix partition (the hash of a phrase's first two words); Spark exchanges the
runs and each prefix partition merges its own.

Pairs of frequent words are many and mostly rare.  So before they are counted
by name, they are counted by hashed place in one table of at most
``FILTER_BITS`` places, which tasks send as sorted runs of a few bytes a pair
and which partitions of the table add up: a pair whose place has fewer
occurrences than the threshold can't be frequent.  Places meet more often as
the corpus outgrows the table; that admits more, and never less.

A word's id is the 64-bit hash of its language and itself.  Ids shared by two
words, one of them frequent, are looked for, and then another seed is taken.
What each level admits reaches the tasks as a bit table of at most
``FILTER_BITS`` bits: a wrong "maybe" costs work, never a wrong count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import blocks, mixed, texts, utf8, written

# Piece ends, blanks, and the language of texts that have none.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
NO_LANG = "und"

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
SHARE = (100, 100)
"""A candidate goes if a longer one has at least this share of its occurrences."""
BURST = 16_384
ENTRIES = 300_000
"""Entries that one task's trie holds before it spills half of them."""
PREFIX_BYTES = 16 << 20
FILTER_BITS = 1 << 28
"""Also the most that the driver gathers and broadcasts, in bits: 32 MB."""
FILTER_SPARE = 16
STREAM = 1 << 18
"""Word ids that a task counts in one step."""
ROW = 256
PLACES = 4_000_000
"""Occurrences of pairs that a task holds before it sends its places."""
MOST = (1 << 16) - 1
SALTS = (4096, 64)
SEEDS = 8
ODD = np.uint64(0x9E3779B97F4A7C15)

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(PIECE_ENDS)] = 2


def words_of(rows: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, in lower case, and the number of each one's piece (no piece spans two texts)."""
    data = np.frombuffer(b"\n".join(rows).translate(LOWER), np.uint8)
    kind = KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    ends = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside[1:-1]])]), piece


def word_ids(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """Never zero, which parts runs."""
    own = xxhash.xxh64_intdigest(lang.encode(), seed)
    one = xxhash.xxh64_intdigest
    return np.maximum(np.fromiter((one(w, own) for w in words), np.uint64, len(words)), np.uint64(1))


def names(ids: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of word ids, for bit tables and prefixes."""
    out = np.full(len(ids), ids.shape[1], np.uint64)
    for i in range(ids.shape[1]):
        out = mixed(out * ODD + ids[:, i])
    return out


def _tokens(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """By block and language: distinct words, their ids, each word's place among them, and its piece."""
    for block in blocks(batches, 1):
        langs = pc.dictionary_encode(pc.fill_null(block.column(0), NO_LANG))
        for number, lang in enumerate(langs.dictionary.to_pylist()):
            rows = block.column(1).filter(pc.equal(langs.indices, number))
            words, piece = words_of(texts(rows))
            if not len(words):
                continue
            told = pc.dictionary_encode(words)
            yield lang, told.dictionary, word_ids(told.dictionary.to_pylist(), lang, seed), np.asarray(told.indices), piece


def _counted(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order and how often each occurs."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    head = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
    first = np.flatnonzero(head)
    return rows[first], np.diff(np.append(first, len(rows))) if counts is None else np.add.reduceat(counts[order], first)


class Node(dict):
    """An inner node: the next word's id (8 bytes) to a node or a container."""


class HatTrie:
    """Counts of phrases of ``words`` word ids; containers are dictionaries of what follows the path."""

    def __init__(self, words: int, burst: int = BURST):
        self.words, self.burst, self.entries = words, burst, 0
        self.root: Node | dict[bytes, int] = {}

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Distinct rows, ascending."""
        if len(rows):
            self.root = self._add(self.root, np.ascontiguousarray(rows.astype(">u8")), counts.tolist(), 0)

    def _add(self, at: Node | dict, rows: np.ndarray, counts: list[int], depth: int) -> Node | dict:
        if isinstance(at, Node):
            words = rows[:, depth]
            heads = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))).tolist()
            for a, b in zip(heads, [*heads[1:], len(words)], strict=True):
                word = words[a : a + 1].tobytes()  # a slice keeps the byte order
                at[word] = self._add(at.get(word) or {}, rows[a:b], counts[a:b], depth + 1)
            return at
        width = 8 * (self.words - depth)
        raw = rows[:, depth:].tobytes()
        before, held = len(at), at.get
        for i, n in zip(range(0, len(raw), width), counts, strict=True):
            key = raw[i : i + width]
            at[key] = held(key, 0) + n
        self.entries += len(at) - before
        # a container of single words has nothing left to tell apart below a node
        return self._burst(at) if len(at) > self.burst and self.words - depth > 1 else at

    @staticmethod
    def _burst(container: dict[bytes, int]) -> Node:
        out = Node()
        for key, n in container.items():
            out.setdefault(key[:8], {})[key[8:]] = n
        return out

    def _items(self, at: Node | dict, path: bytes, out: list[bytes], counts: list[int]) -> None:
        if isinstance(at, Node):
            for word, below in at.items():
                self._items(below, path + word, out, counts)
        else:
            out += [path + key for key in at]
            counts += at.values()

    def _size(self, at: Node | dict) -> int:
        return sum(map(self._size, at.values())) if isinstance(at, Node) else len(at)

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole subtrees, the largest first, until at most ``most`` entries are left: their phrases, ascending, and counts."""
        keys: list[bytes] = []
        counts: list[int] = []
        if isinstance(self.root, Node) and most:
            for word in sorted(self.root, key=lambda w: (-self._size(self.root[w]), w)):
                if self.entries - len(keys) <= most:
                    break
                self._items(self.root.pop(word), word, keys, counts)
        else:
            self._items(self.root, b"", keys, counts)
            self.root = {}
        self.entries -= len(keys)
        rows = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, self.words)
        order = np.lexsort(rows.T[::-1])
        return rows[order], np.array(counts, np.int64)[order]


def _runs(rows: np.ndarray, counts: np.ndarray, prefixes: int) -> pa.RecordBatch:
    """Sorted phrases cut by prefix partition, each one's part packed: ids, then counts."""
    part = (names(rows[:, :2]) % np.uint64(prefixes)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, rows, counts = part[order], rows[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    cuts = list(zip(heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True)) if len(part) else []
    packed = [rows[a:b].tobytes() + counts[a:b].tobytes() for a, b in cuts]
    return pa.RecordBatch.from_arrays([pa.array(part[heads], pa.int64()), pa.array(packed, pa.binary())], names=["prefix", "run"])


def _counter(words: int, prefixes: int, entries: int):
    """Takes (rows, counts) steps and gives runs: all that a task does with its phrases."""

    def run(steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(words)
        for rows, counts in steps:
            trie.add(rows, counts)
            while trie.entries > entries:
                yield _runs(*trie.spill(entries // 2), prefixes)
        yield _runs(*trie.spill(0), prefixes)

    return run


def _merged(words: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        rows, counts = [], []
        for run in texts(table.column("run").combine_chunks()):
            m = len(run) // (8 * words + 8)
            rows.append(np.frombuffer(run, "<u8", m * words).reshape(m, words))
            counts.append(np.frombuffer(run, "<i8", m, 8 * words * m))
        keys, totals = _counted(np.concatenate(rows), np.concatenate(counts))
        stay = totals >= least
        keys, totals = keys[stay], totals[stay]
        raw = keys.astype(">u8").tobytes()
        told = [raw[i : i + 8 * words] for i in range(0, len(raw), 8 * words)]
        return pa.table([pa.array(told, pa.binary()), pa.array(names(keys).view(np.int64)), pa.array(totals)], names=["key", "name", "a"])

    return run


def _frequent(runs: DataFrame, words: int, least: int) -> DataFrame:
    """``key`` (word ids, 8 bytes each), its ``name`` and count ``a``, of phrases that occur often enough."""
    return written(runs.groupBy("prefix").applyInArrow(_merged(words, least), "key binary, name long, a long"), f"phrases-{words}")


def _bits(frequent: DataFrame) -> np.ndarray:
    """The bit table of the names: two bits each, as many bits as the names need but no more than ``FILTER_BITS``."""
    rows = frequent.count()
    size = min(FILTER_BITS, max(1 << 10, 1 << (FILTER_SPARE * rows).bit_length()))
    half = F.shiftrightunsigned("name", 32)
    places = frequent.select(F.explode(F.array(F.col("name").bitwiseAND(F.lit(size - 1)), half.bitwiseAND(F.lit(size - 1)))).alias("p"))
    each = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    told = each.toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[told.column("w").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    return out


def _admitted(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    return _marked(bits, name) & _marked(bits, name >> np.uint64(32))


def _word_steps(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, ids, place, _ in _tokens(batches, seed):
            order = np.argsort(ids, kind="stable")
            counts = np.bincount(place, minlength=len(ids))[order]
            ids = ids[order]  # equal ids of two words would be one key; they are looked for later
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            yield ids[first, None], np.add.reduceat(counts, first)

    return run


STREAMS = "ids binary, id binary, word binary, lang string, total long"


def _cut_at_runs(ids: np.ndarray) -> pa.Array:
    """A stream of runs as rows of about ``ROW`` ids, cut before a run: a batch of rows stays small and a run whole."""
    zeros = np.flatnonzero(ids == 0)
    heads = zeros[np.concatenate(([True], np.diff(zeros // ROW) > 0))]
    ends = np.append(heads, len(ids)).astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def _streams(bits, seed: int):
    """Runs of admitted words as packed ids, zero between runs; the admitted words; the number of all words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        totals: dict[str, int] = {}

        def rows(ids: list | pa.Array, id_: list, word: list, lang: list, total: list) -> pa.RecordBatch:
            most = max(map(len, (ids, id_, total)))
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) if len(x) else pa.nulls(most, kind) for x, kind in zip((ids, id_, word, lang, total), kinds, strict=True)],
                                              names=["ids", "id", "word", "lang", "total"])

        for lang, dictionary, ids, place, piece in _tokens(batches, seed):
            totals[lang] = totals.get(lang, 0) + len(place)
            good = _admitted(bits.value, names(ids[:, None]))
            own = ids.astype(">u8").tobytes()
            new = [(own[8 * i : 8 * i + 8], w) for i, w in zip(np.flatnonzero(good).tolist(), dictionary.filter(pa.array(good)).to_pylist(), strict=True) if (lang, w) not in seen]
            if len(seen) > ENTRIES:
                seen.clear()
            seen.update((lang, w) for _, w in new)
            if new:
                yield rows([], [i for i, _ in new], [w for _, w in new], [lang] * len(new), [])
            where = np.flatnonzero(good[place])
            if not len(where):
                continue
            together = (np.diff(where) == 1) & (np.diff(piece[where]) == 0)  # a word and the one before it are in one run
            linked = np.concatenate(([False], together)), np.concatenate((together, [False]))
            stay = linked[0] | linked[1]
            where, starts = where[stay], ~linked[0][stay]
            out = np.zeros(len(where) + int(starts.sum()), np.uint64)
            out[np.arange(len(where)) + np.cumsum(starts)] = ids[place[where]]
            if len(out):
                yield rows(_cut_at_runs(out), [], [], [], [])
        if totals:
            yield rows([], [], [], list(totals), list(totals.values()))

    return run


def windows(ids: np.ndarray, words: int) -> np.ndarray:
    """Rows of ``words`` ids in one run."""
    if len(ids) < words:
        return np.zeros((0, words), np.uint64)
    out = np.lib.stride_tricks.sliding_window_view(ids, words)
    return out[(out != 0).all(axis=1)]


def _found(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[np.ndarray]:
    """All phrases of the streams, step by step."""
    for batch in batches:
        ids = utf8(batch.column(0))[0].view("<u8")  # each row begins with a zero, so rows join to one stream
        for at in range(0, len(ids), STREAM):
            found = windows(ids[at : at + STREAM + words - 1], words)
            if len(found):
                yield found


def _pair_places(size: int, parts: int):
    """Packed counts by place: for each part of the table the gaps between places and the counts, the highest count for all above."""

    def packed(places: np.ndarray) -> pa.RecordBatch:
        """Sorts ``places`` itself, and holds 32 bits a place: no place is above ``FILTER_BITS``."""
        places.sort()
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        at, counts = places[first], np.minimum(np.diff(first, append=len(places)), MOST).astype(np.uint16)
        del first
        part = at // np.uint32(size // parts)
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        part = part[heads].astype(np.int64)
        gaps = np.diff(at, prepend=np.uint32(0))
        gaps[heads] = at[heads] % np.uint32(size // parts)
        runs = [(b - a).to_bytes(8, "little") + pa.compress(gaps[a:b].tobytes() + counts[a:b].tobytes(), "zstd", asbytes=True)
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(runs, pa.binary())], names=["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.empty(PLACES, np.uint32), 0
        for found in _found(batches, 2):
            places = (names(found) & np.uint64(size - 1)).astype(np.uint32)
            if count and count + len(places) > PLACES:
                yield packed(held[:count])
                count = 0
            if len(places) > PLACES:
                yield packed(places)
                continue
            held[count : count + len(places)] = places
            count += len(places)
        if count:
            yield packed(held[:count])

    return run


def _pair_bits(streams: DataFrame, least: int, size: int) -> np.ndarray:
    """The bit table of places with enough occurrences of pairs."""
    wanted = 4 * int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << (wanted - 1).bit_length(), size // 64)

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(size // parts, np.int64)
        for run in texts(table.column("run").combine_chunks()):
            m = int.from_bytes(run[:8], "little")
            raw = pa.decompress(run[8:], 6 * m, "zstd", asbytes=True)
            counts = np.frombuffer(raw, np.uint16, m, 4 * m).astype(np.int64)
            total[np.cumsum(np.frombuffer(raw, np.uint32, m), dtype=np.int64)] += np.where(counts == MOST, least, counts)
        bits = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table([pa.array([table.column("part")[0].as_py()]), pa.array([bits], pa.binary())], names=["part", "bits"])

    told = streams.mapInArrow(_pair_places(size, parts), "part long, run binary").groupBy("part").applyInArrow(added, "part long, bits binary").toArrow()
    out = np.zeros((parts, size // parts // 64), np.uint64)
    for part, bits in zip(told.column("part").to_pylist(), told.column("bits").to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, "<u8")
    return out.reshape(-1)


def _marked(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Is the bit set at the name's own place."""
    place = name & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _phrase_steps(bits, words: int):
    """Occurrences of phrases that the level before admits by their two shorter parts, pairs by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for found in _found(batches, words):
            if words == 2:
                found = found[_marked(bits.value, names(found))]
            else:
                found = found[_admitted(bits.value, names(found[:, :-1]))]
                found = found[_admitted(bits.value, names(found[:, 1:]))]
            if len(found):
                yield _counted(found)

    return run


def _size(docs: DataFrame) -> tuple[int, int]:
    """Prefix partitions and places of pairs, by the bytes of all texts."""
    told = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    prefixes = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told // PREFIX_BYTES))
    return prefixes, min(FILTER_BITS, max(1 << 10, 1 << told.bit_length()))


def _levels(docs: DataFrame, least: int, most_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Frequent phrases (``size, key, a``), words by id, totals by language, and whether an id is shared by two words."""
    spark = docs.sparkSession
    prefixes, places = _size(docs)

    def counted(source: DataFrame, words: int, steps) -> DataFrame:
        work = _counter(words, prefixes, ENTRIES)
        return _frequent(source.mapInArrow(lambda batches: work(steps(batches)), "prefix long, run binary"), words, least)

    levels = [counted(docs, 1, _word_steps(seed))]
    bits = spark.sparkContext.broadcast(_bits(levels[0]))
    told = written(docs.mapInArrow(_streams(bits, seed), STREAMS), "phrase-streams")
    spelled = told.where(F.col("id").isNotNull()).join(levels[0].select(F.col("key").alias("id")), "id").groupBy("id", "lang", "word").agg(F.count("*").alias("_"))
    spelled = written(spelled.select("id", "lang", F.col("word").cast("string").alias("word")), "phrase-words")
    shared = not spelled.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    totals = told.where(F.col("total").isNotNull()).groupBy("lang").agg(F.sum("total").alias("n"))
    streams = told.where(F.col("ids").isNotNull()).select("ids")
    for words in range(2, most_words + 1):
        if shared or (words > 2 and levels[-1].isEmpty()):
            break
        bits = spark.sparkContext.broadcast(_pair_bits(streams, least, places) if words == 2 else _bits(levels[-1]))
        levels.append(counted(streams, words, _phrase_steps(bits, words)))
    out = None
    for size, level in enumerate(levels, 1):
        level = level.select(F.lit(size).alias("size"), "key", "a")
        out = level if out is None else out.unionByName(level)
    return out, spelled, totals, shared


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``; shares of a language are cut to that many first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for salts in SALTS:
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 share: tuple[int, int] = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases of 2 to ``max_words`` words.

    ``a`` counts a phrase's occurrences within pieces, ``l`` and ``r`` those of
    the parts of its lowest-scoring cut (the first of equal ones), ``n`` the
    language's words; ``score`` is floor(1000 a n / (l r)), in decimals of 38
    digits.  A phrase goes if one with a word more, which holds it, has at
    least ``share`` of its occurrences; a longer one that has is held by such a
    phrase too.  Ties are settled by count, then by the phrase's UTF-8 bytes.

    Null texts are empty, a null language is ``und``; each row counts, repeated
    ones too.  Texts of any length are read whole.  Other columns of ``docs``
    are ignored, whatever their names.  An empty table gives no rows.
    """
    if max_words < 2:
        raise ValueError("max_words must be 2 or more")
    docs = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(NO_LANG)).alias("lang"), docs[text].cast("string").alias("text"))
    for seed in range(SEEDS):
        found, spelled, totals, shared = _levels(docs, min_count, max_words, seed)
        if not shared:
            break
    else:
        raise RuntimeError("every seed gives two words one id")
    long = found.where("size > 1")
    parts = long.select("key", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = parts.withColumns({"left": F.expr("substring(key, 1, 8 * k)"), "right": F.expr("substring(key, 8 * k + 1)")})
    counts = found.select("key", "a")
    parts = parts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(
        counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    ids = long.select("key", F.posexplode(F.expr("transform(sequence(1, size), i -> substring(key, 8 * i - 7, 8))")).alias("at", "id"))
    phrases = ids.join(spelled, "id").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    exact = lambda *names_: [F.col(c).cast("decimal(20,0)") for c in names_]
    a, n, l, r = exact("a", "n", "l", "r")
    scored = parts.join(phrases.join(totals, "lang"), "key").withColumns({"_top": F.lit(1000).cast("decimal(4,0)") * a * n, "_low": l * r})
    cut = scored.groupBy("key", "lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("_top div _low").alias("score"), "k", "l", "r")).alias("c")).select(
        "key", "lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    held = long.where("size > 2").select(F.col("a").alias("_longer"), F.explode(F.array(F.expr("substring(key, 1, 8 * (size - 1))"), F.expr("substring(key, 9)"))).alias("key"))
    held = held.groupBy("key").agg(F.max("_longer").alias("_longer"))
    gone = F.coalesce(F.lit(share[1]) * F.col("_longer") >= F.lit(share[0]) * F.col("a"), F.lit(False))
    best = _best(cut.join(held, "key", "left").where(~gone), top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """DuckDB SQL for ``collocations`` over ``documents``: every phrase is spelled out and counted."""
    sizes = ", ".join(f"({i})" for i in range(1, MAX_WORDS + 1))
    return f"""
WITH docs AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES {sizes}) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS s, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}),
cuts AS (SELECT lang, k, phrase, s, a, unnest(range(1, k)) AS j FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.k, c.phrase, c.s, c.a, c.j, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.s[1:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.s[c.j + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a, s, unnest(range(2, k)) AS m FROM f WHERE k > 2),
parts AS (SELECT lang, a, unnest(list_transform(range(1, len(s) - m + 2), lambda i: array_to_string(s[i:i + m - 1], ' '))) AS phrase FROM inner_),
longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
  n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR {SHARE[1]} * most < {SHARE[0]} * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
