"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The encoding of a text is the best path through the lattice of vocabulary
pieces: nodes are places between characters, an edge is a piece with its
score.  A giant text is cut into chunks anywhere.  A chunk's transfer matrix
has the best score from each entry state to each exit state, a state being how
far the last piece reaches over the chunk's bound.  Matrices combine
associatively under (max, +): a scan gives every chunk the scores of its entry
states.  With them each chunk knows, for any exit state, the entry state that
the best path came from; these maps combine associatively too and fix every
chunk's exit.  Then each chunk is backtraced by itself.

Scores are whole numbers, so sums are exact, and a tie at a node goes to the
longest piece: the result doesn't depend on where a text is cut.

Where the vocabulary has no piece with a space after another character, every
best path passes between a word and the space after it.  Words between such
places are encoded once per task and looked up, and in a chunk only what lies
before the first and after the last such place depends on states.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from llm.common import blocks, written

SIGN = "▁"
"""A space in a model file's pieces. In a text it is a character like others, without a piece, so it is encoded by its bytes."""
SPACE = " "
CHUNK = 1 << 16
CACHE = 600_000
NONE = -(1 << 60)
UNIT = 1 << 16
UNKNOWN = 10
PRIME = (1 << 31) - 1


class Vocabulary:
    """Pieces and scores of a model file.

    A model of merges (BPE) has ranks for scores; ``zipf`` turns a rank r into
    ``-log(r + 2)``, the usual law of word frequencies.  A character without a
    piece is written as its bytes and scores ``UNKNOWN`` below the worst piece.
    """

    def __init__(self, path: str, zipf: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = [b""] * count
        self.byte_ids: dict[int, int] = {}
        raw: dict[str, float] = {}
        for i in range(count):
            piece = model.id_to_piece(i).replace(SIGN, SPACE)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.bytes[i] = piece.encode()
                rank = min(-model.get_score(i), count)
                raw[piece] = -float(np.log(max(rank, 0) + 2)) if zipf else model.get_score(i)
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces")
        self.score = {p: int(round(s * UNIT)) for p, s in raw.items()}
        self.unknown = min(self.score.values()) - UNKNOWN * UNIT
        self.longest = max(map(len, self.ids))
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        if max(self.score.values()) > 0:
            raise ValueError("scores must be logarithms of probabilities")
        # Pieces with their scores and, as 1, beginnings of longer pieces.
        self.table = {p[:i]: 1 for p in self.ids for i in range(1, len(p))} | self.score
        # Neighbours in some piece: between two others every best path passes, wherever they stand.
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.words: dict[str, tuple[int, bytes]] = {}
        self.ends: dict[str, tuple[int, bytes]] = {}

    def edges(self, s: str, k: int) -> Iterator[tuple[int, int]]:
        """``(end, score)`` of the pieces that start at a place, short ones first."""
        known = self.score
        first = known.get(s[k])
        yield k + 1, self.unknown if first is None else first
        for j in range(k + 2, min(len(s), k + self.longest) + 1):
            w = known.get(s[k:j])
            if w is not None:
                yield j, w

    def forward(self, s: str, entry: list[int], stop: int) -> tuple[list[int], list[int]]:
        """Best score and last piece's start of every node; pieces start before ``stop``. Entry nodes have start -1."""
        best = [NONE] * (len(s) + 1)
        back = [-1] * (len(s) + 1)
        best[: len(entry)] = entry[: len(best)]
        for k in range(stop):
            at = best[k]
            if at <= NONE:
                continue
            for j, w in self.edges(s, k):
                if at + w > best[j]:  # on a tie the earlier start, the longest piece, stays
                    best[j], back[j] = at + w, k
        return best, back

    def matrix(self, s: str, stop: int) -> np.ndarray:
        """Best scores from each entry node to every node."""
        best = np.full((len(s) + 1, self.longest), NONE, np.int64)
        for i in range(min(self.longest, len(s) + 1)):
            best[i, i] = 0
        for k in range(stop):
            for j, w in self.edges(s, k):
                np.maximum(best[j], best[k] + w, out=best[j])
        return np.maximum(best, NONE)

    def spell(self, s: str, a: int, b: int) -> list[int]:
        piece = s[a:b]
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.byte_ids[x] for x in piece.encode()]

    def trace(self, s: str, back: list[int], node: int) -> tuple[list[int], int]:
        """The ids of the path that ends in a node, and its entry node."""
        out: list[list[int]] = []
        while back[node] >= 0:
            out.append(self.spell(s, back[node], node))
            node = back[node]
        return [i for part in reversed(out) for i in part], node

    def split(self, s: str) -> list[str]:
        """Parts between which every best path passes."""
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", s) if self.by_word else [s]

    def _word(self, s: str) -> tuple[int, bytes]:
        """Score and ids (32-bit numbers) of a text by itself; as ``forward`` and ``trace``, in one loop for short texts."""
        n, told, unknown = len(s), self.table.get, self.unknown
        best, back = [0] + [NONE] * n, [0] * (n + 1)
        for k in range(n):
            at = best[k]
            w = told(s[k], 2)
            score = at + (w if w <= 0 else unknown)
            if score > best[k + 1]:
                best[k + 1], back[k + 1] = score, k
            if w == 2:
                continue
            for j in range(k + 2, n + 1):
                w = told(s[k:j], 2)
                if w > 0:
                    if w == 2:
                        break
                elif at + w > best[j]:  # on a tie the earlier start, the longest piece, stays
                    best[j], back[j] = at + w, k
        ends = [n]
        while ends[-1]:
            ends.append(back[ends[-1]])
        ends.reverse()
        known = self.ids
        ids = array("i")
        for a, b in zip(ends, ends[1:]):
            i = known.get(s[a:b])
            if i is None:
                ids.extend(self.spell(s, a, b))
            else:
                ids.append(i)
        return best[n], ids.tobytes()

    def learned(self, parts: list[str]) -> dict[str, tuple[int, bytes]]:
        """Score and ids of each part with the space before it, remembered."""
        words = self.words
        new = set(parts).difference(words)
        if len(words) > CACHE:
            words.clear()
            new = set(parts)
        pairs, ends = self.pairs, self.ends
        for part in new:
            if part[-2:] in pairs or len(part) < 2:
                words[part] = self._word(SPACE + part)
                continue
            # No piece joins the last character, a full stop say, to the word: both are encoded for themselves.
            word, end = part[:-1], part[-1]
            own = words.get(word)
            if own is None:
                own = words[word] = self._word(SPACE + word)
            last = ends.get(end)
            if last is None:
                last = ends[end] = self._word(end)
            words[part] = own[0] + last[0], own[1] + last[1]
        return words

    def runs(self, s: str) -> list[tuple[int, bytes]]:
        """Score and ids of each part of a lattice text between places where every best path passes."""
        if self.by_word and s[:1] == SPACE:
            parts = s[1:].split(SPACE)
            if "" not in parts:
                return list(map(self.learned(parts).__getitem__, parts))
        return [self._word(part) for part in self.split(s)]

    def encode(self, text: str) -> list[int]:
        told = array("i")
        told.frombytes(self.encoded(text))
        return told.tolist()

    def encoded(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        return b"".join([ids for _, ids in self.runs(lattice_text(text, True))]) if text else b""

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; the space before the text's first piece goes."""
        told = b"".join(map(self.bytes.__getitem__, ids))
        return (told[1:] if first and told else told).decode()


def lattice_text(text: str, first: bool) -> str:
    """A text's first word has a space before it as the others have."""
    return SPACE * first + text


class Chunk:
    """A chunk's lattice text, with what of it depends on states: before ``head`` and from ``tail`` on."""

    def __init__(self, words: Vocabulary, text: str, ahead: str, first: bool):
        self.words = words
        own = lattice_text(text, first)
        self.s = own + lattice_text(ahead, False)
        self.stop = len(own)
        self.last = not ahead
        cuts = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", own)] if words.by_word else []
        cuts = [c for c in cuts if c >= words.longest]
        self.head, self.tail = (cuts[0], cuts[-1]) if cuts else (None, None)

    def exits(self, best) -> list[int]:
        n = 1 if self.last else self.words.longest
        return [best[self.stop + o] if self.stop + o < len(best) else NONE for o in range(n)] + [NONE] * (self.words.longest - n)

    def middle(self) -> list[tuple[int, bytes]]:
        return self.words.runs(self.s[self.head : self.tail]) if self.head < self.tail else []

    def transfer(self) -> np.ndarray:
        """``[entry state, exit state]`` scores."""
        size = self.words.longest
        if self.head is None:
            best = self.words.matrix(self.s, self.stop)
            out = np.full((size, size), NONE, np.int64)
            for o in range(1 if self.last else size):
                if self.stop + o < len(best):
                    out[:, o] = best[self.stop + o]
            return out
        start = self.words.matrix(self.s[: self.head], self.head)[self.head]
        inside = sum(score for score, _ in self.middle())
        end, _ = self.words.forward(self.s[self.tail :], [0], self.stop - self.tail)
        shifted = [NONE] * self.tail + end
        return np.maximum(start[:, None] + inside + np.array(self.exits(shifted))[None, :], NONE)

    def origins(self, entry: list[int]) -> list[int]:
        """For each exit state the entry state of the best path (-1: no path)."""
        if self.head is None:
            best, back = self.words.forward(self.s, entry, self.stop)
            return [self.words.trace(self.s, back, self.stop + o)[1] if x > NONE else -1 for o, x in enumerate(self.exits(best))]
        s = self.s[: self.head]
        _, back = self.words.forward(s, entry, self.head)
        return [self.words.trace(s, back, self.head)[1]] * self.words.longest

    def ids(self, entry: list[int], state: int) -> tuple[list[int], int]:
        """The pieces of the best path to an exit state, and its entry state."""
        if self.head is None:
            _, back = self.words.forward(self.s, entry, self.stop)
            return self.words.trace(self.s, back, self.stop + state)
        s, end = self.s[: self.head], self.s[self.tail :]
        _, back = self.words.forward(s, entry, self.head)
        out, origin = self.words.trace(s, back, self.head)
        inside = array("i")
        for _, ids in self.middle():
            inside.frombytes(ids)
        out += inside.tolist()
        _, back = self.words.forward(end, [0], self.stop - self.tail)
        return out + self.words.trace(end, back, self.stop - self.tail + state)[0], origin


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of transfer matrices; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NONE)


ROW = ["doc_id", "text_key"]


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, zipf: bool = True,
           sums: bool = False) -> DataFrame:
    """``doc_id, text_key, chunk, ids, exact``: the ids of each text, in chunks from 0.

    With ``sums`` there are, instead of the ids, their number ``n``, their sum
    ``s`` and the sum ``m`` of (place + 1) * id modulo ``PRIME``.

    ``exact`` says that the ids of the chunk decode to its very characters.
    Texts of up to ``chunk`` characters have one chunk; a null text counts as
    empty and has no ids.  Rows that repeat an id and a text are repeated when
    short, told once when cut.  ``path`` names a model file with byte pieces
    that every executor has.  An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    longest = Vocabulary(path, zipf).longest
    if chunk < 2 * longest:
        raise ValueError(f"a chunk must have {2 * longest} characters at least")
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"]
    told = [StructField(c, LongType()) for c in "nsm"] if sums else [StructField("ids", ArrayType(IntegerType()))]
    result = [*told, StructField("exact", LongType())]
    out = StructType([StructField("doc_id", kind.dataType), StructField("text_key", LongType()), StructField("chunk", IntegerType()), *result])

    def summed(ids: np.ndarray) -> tuple:
        if not sums:
            return (ids,)
        place = np.arange(1, len(ids) + 1, dtype=np.int64)  # a chunk's places and ids are below 2^31
        return len(ids), int(ids.sum()), int((place * ids % PRIME).sum() % PRIME)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(path, zipf)
        for block in blocks(batches, 2):
            texts = block.column(2).to_pylist()
            rows_: list[tuple] = []
            for t in texts:
                ids = np.frombuffer(words.encoded(t), np.int32).astype(np.int64)
                rows_.append((*summed(ids), int(words.decode(ids.tolist()) == t)))
            columns = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(zip(*rows_, strict=True), result, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([0] * len(texts), pa.int32()), *columns], names=out.names)

    short = rows.where(F.length("t") <= chunk).select("doc_id", F.xxhash64("t").alias("text_key"), "t").mapInArrow(whole, out)

    parts = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    cut = rows.where(F.length("t") > chunk).dropDuplicates(["doc_id", "t"]).select("doc_id", F.xxhash64("t").alias("text_key"), parts.alias("parts"))
    cut = cut.select("doc_id", "text_key", F.posexplode(F.transform("parts", lambda p, i: F.struct(
        p.alias("own"), F.coalesce(F.substring(F.get("parts", i + 1), 1, longest), F.lit("")).alias("ahead")))).alias("chunk", "p"))
    # The pieces of a giant text are rows of their own from here on, dealt over all tasks.
    cut = written(cut.select("doc_id", "text_key", "chunk", "p.own", "p.ahead").repartition("doc_id", "text_key", "chunk"), "piece-chunks")

    def each(frame: DataFrame, schema, work) -> DataFrame:
        """``work(chunk, entry, exit)`` gives columns beside the chunk's row."""
        extra = [c for c in ("entry", "exit") if c in frame.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Vocabulary(path, zipf)
            for block in blocks(batches, 3):
                own, ahead = (block.column(i).to_pylist() for i in (3, 4))
                more = [block.column(5 + i).to_pylist() for i in range(len(extra))]
                number = block.column(2).to_pylist()
                made = [work(Chunk(words, own[i], ahead[i], number[i] == 0), *(m[i] for m in more)) for i in range(len(own))]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column(i) for i in range(3)] + columns, names=names)

        full = StructType([StructField("doc_id", kind.dataType), StructField("text_key", LongType()), StructField("chunk", IntegerType()), *schema])
        names = full.names
        kinds = [to_arrow_type(f.dataType) for f in schema]
        return frame.select("doc_id", "text_key", "chunk", "own", "ahead", *extra).mapInArrow(run, full)

    def scanned(frame: DataFrame, column: str, new: str, work) -> DataFrame:
        """One small row per chunk: ``work`` turns a text's values in order into new ones."""
        schema = StructType([StructField("doc_id", kind.dataType), StructField("text_key", LongType()), StructField("chunk", IntegerType()), StructField(new, ArrayType(LongType()))])

        def run(part: pa.Table) -> pa.Table:
            part = part.sort_by("chunk")
            made = work(part.column(column).to_pylist())
            return part.select(["doc_id", "text_key", "chunk"]).append_column(new, pa.array(made, pa.list_(pa.int64())))

        return frame.groupBy("doc_id", "text_key").applyInArrow(run, schema)

    def entries(matrices: list[list[int]]) -> list[list[int]]:
        now = np.full((1, longest), NONE, np.int64)
        now[0, 0] = 0
        told = []
        for m in matrices:
            told.append(now[0].tolist())
            now = combine(now, np.array(m, np.int64).reshape(longest, longest))
            now = np.maximum(now - now.max(), NONE)  # only differences matter; sums stay small
        return told

    def exits(origins: list[list[int]]) -> list[list[int]]:
        state, told = 0, []
        for o in reversed(origins):
            told.append([state])
            state = o[state]
        return told[::-1]

    numbers = ArrayType(LongType())
    key = [*ROW, "chunk"]
    at = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]

    def beside(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        return left.alias("l").join(right.alias("r"), at).select("l.*", f"r.{column}")

    matrices = each(cut, [StructField("m", numbers)], lambda c: (c.transfer().reshape(-1).tolist(),))
    entered = written(scanned(matrices, "m", "entry", entries), "piece-entries")
    started = beside(cut, entered, "entry")
    origins = each(started, [StructField("o", numbers)], lambda c, entry: (c.origins(entry),))
    left = scanned(origins, "o", "exit", exits).withColumn("exit", F.col("exit")[0])

    def finish(c: Chunk, entry: list[int], state: int) -> tuple:
        ids, origin = c.ids(entry, state)
        text = c.words.decode(ids, False)
        return *summed(np.array(ids, np.int64)), int(text == c.s[origin : c.stop + state])

    long = each(beside(started, written(left, "piece-exits"), "exit"), result, finish)
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str | None = None, zipf: bool = True) -> DataFrame:
    """``doc_id, text_key, text`` of ``encode``'s rows; chunks are decoded by themselves and then joined."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    source = encoded.select("doc_id", "text_key", "chunk", "ids")
    schema = StructType([source.schema["doc_id"], source.schema["text_key"], source.schema["chunk"]]).add("t", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(path, zipf)
        for batch in batches:
            made = [words.decode(i, c == 0) for i, c in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=schema.names)

    told = source.mapInArrow(run, schema).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("chunk", "t"))).alias("p"))
    return told.select("doc_id", "text_key", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def measured(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per text: ``doc_id, n_chunks, n_tokens, ids_sum, ids_check, exact``.

    ``ids_check`` is the sum of (place + 1) * id modulo 2^31 - 1, which takes
    the order into account.
    """
    light = encode(docs, path, chunk=chunk, sums=True)
    # Each chunk has its own sums; one small row per chunk is put in place.
    single = light.groupBy(*ROW, "chunk").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("m").alias("m"), F.min("exact").alias("exact"))
    folded = single.groupBy(*ROW).agg(F.max("copies").alias("copies"), F.min("exact").alias("exact"), F.sort_array(F.collect_list(F.struct("chunk", "n", "s", "m"))).alias("p"))
    total = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("m")), lambda a, x: F.struct(
        (a["n"] + x["n"]).alias("n"), (a["s"] + x["s"]).alias("s"), ((a["m"] + x["m"] + (a["n"] % PRIME) * (x["s"] % PRIME)) % PRIME).alias("m")))
    per_text = folded.select(*ROW, F.size("p").alias("n_chunks"), total.alias("t"), (F.col("exact") == 1).alias("exact"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text_key"))
    at = rows.doc_id.eqNullSafe(per_text.doc_id) & (rows.text_key == per_text.text_key)
    return rows.join(per_text, at).select(rows.doc_id, "n_chunks", F.col("t.n").alias("n_tokens"), F.col("t.s").alias("ids_sum"), F.col("t.m").alias("ids_check"), "exact")
