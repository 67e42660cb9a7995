"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern. The distinct words of each block of texts meet by word; each distinct word is
encoded once by Spark's higher-order functions: an aggregate over its bytes merges, step by step, the adjacent pair of
least rank. A literal rank map, an array that a pair of ids indexes, gives the ranks; the accumulator keeps the rank of
each pair, and a merge renews two of them. The ids go back by block to the shared folder, and the task that encodes a
block reads the ids of just its words. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumigrid.llm.shared import file_system, qualified
from lumigrid.session import new_folder, settings, table

#: Bytes of text in a block, whose distinct words one task holds; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes beyond which a word is merged where it occurs, as the fold takes a square of steps; the ids are the same.
LONGEST = 256
#: Bits of an id, of a place in a word, and of a rank in the fold's accumulator.
_BITS = 20
_LOW = (1 << _BITS) - 1
_ROWS = 256
#: Places that a row of the rank map tries among other rows.
_TRIES = 100_000
#: Unicode white space, as the tokenizer's \s has it; Python's also has U+001C to U+001F.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that end words often; no letters, numbers, apostrophes or white space.
_MARKS = ".,;:!?*#&%$)-"


def touching(text: str) -> bool:
    """White space next to a space: only there do pieces reach beyond a space that a word follows."""
    return "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _SPACES if c != " ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are the ids, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """The pattern with white space spelt out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACES}").replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]"))


def rank_map(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, cells): the pair of ids a, b has the rank cells[starts[a] + b] less a's bits, if that is a rank.

    A cell holds a and the rank, so one of another a gives a number beyond all ranks. The rows of all a lie over each
    other where their cells leave room. A free cell, and the start of an a without pairs, is -1.
    """
    if max(ranks.values(), default=0) >= _LOW:
        raise ValueError("too many ids")
    found = array("q")  # a, b and rank of each pair in turn
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                found.extend((a, b, rank))
    pairs = np.array(found, np.int64).reshape(-1, 3)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    rows = np.split(pairs, np.nonzero(np.diff(pairs[:, 0]))[0] + 1) if len(pairs) else []
    end, size = max(ranks.values(), default=0) + 1, 4 * len(pairs) + 1
    cells, starts = np.full(size + end, -1, np.int64), np.full(end, -1, np.int64)
    places = np.random.Generator(np.random.PCG64(7))
    for row in sorted(rows, key=len, reverse=True):
        b = row[:, 1]
        for _ in range(_TRIES):
            if (cells[(start := int(places.integers(size))) + b] < 0).all():
                break
        else:  # room of its own
            start, cells = len(cells), np.append(cells, np.full(end + 1, -1, np.int64))
        starts[row[0, 0]], cells[start + b] = start, row[:, 0] << _BITS | row[:, 2]
    return starts, cells


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.aggregate(F.expr("cast(array() as array<int>)"), value, lambda own, _: own, use)


def _literal(numbers: np.ndarray) -> Column:
    """A literal array, null for numbers below 0; the optimizer folds the split and the cast."""
    return F.split(F.lit(",".join(["" if x < 0 else str(x) for x in numbers.tolist()])), ",").try_cast("array<bigint>")


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids (array of long) that merges alone give for a word, a string that is not empty."""
    starts, cells = rank_map(ranks)
    single = np.array([ranks[bytes([k])] for k in range(256)])
    return _let(_literal(starts), lambda s: _let(_literal(cells), lambda c: _let(_literal(single), lambda one: _fold(word, s, c, one, len(starts)))))


def _fold(word: Column, starts: Column, cells: Column, single: Column, end: int) -> Column:
    """The accumulator's elements are the parts of the word: the rank of a part with the next, its place, its id."""

    def rank(a: Column, b: Column) -> Column:
        found = F.get(cells, F.get(starts, a) + F.coalesce(b, F.lit(end).cast("long"))).bitwiseXOR(F.shiftleft(a, _BITS))
        return F.shiftleft(F.least(found, F.lit(_LOW).cast("long")), 2 * _BITS)

    def of(part: Column, mask: int) -> Column:
        return part.bitwiseAND(F.lit(mask).cast("long"))

    def merge(parts: Column, _: Column) -> Column:
        def replaced(least: Column, at: Column) -> Column:
            made = F.shiftright(least, 2 * _BITS)  # the rank of a merged token is its id
            here = rank(made, of(F.get(parts, at + 1), _LOW)) + of(least, _LOW << _BITS) + made
            before = lambda part: rank(of(part, _LOW), made) + of(part, (1 << 2 * _BITS) - 1)
            renewed = F.transform(parts, lambda part, k: F.when(k == at - 1, here).when(k == at - 2, before(part)).otherwise(part))
            return _let(F.get(parts, at), lambda gone: F.array_remove(renewed, gone))

        none = lambda least: F.shiftright(least, 2 * _BITS) == _LOW
        step = lambda least: _let(F.array_position(parts, least).cast("int"), lambda at: replaced(least, at))
        return _let(F.array_min(parts), lambda least: F.when(none(least), parts).otherwise(step(least)))

    data = F.split(F.decode(F.encode(word, "utf-8"), "ISO-8859-1"), "")  # a character for each byte
    ids = F.transform(data, lambda c: F.get(single, F.ascii(c)))
    parts = _let(ids, lambda own: F.transform(own, lambda x, k: rank(x, F.get(own, k + 1)) + F.shiftleft(k.cast("long"), _BITS) + x))
    steps = F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2)))
    return F.aggregate(steps, parts, merge, lambda done: F.transform(done, lambda part: of(part, _LOW)))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word: step by step for a short one, with a heap of pairs for a long one."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= LONGEST:
        get = ranks.get
        parts = [word[k : k + 1] for k in range(len(word))]
        pairs = [get(a + b, _LOW) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) != _LOW:
            k = pairs.index(least)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], _LOW)
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], _LOW)
        return [ranks[p] for p in parts]
    ends, follows, before, alive = list(range(1, len(word) + 1)), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), [True] * len(word)
    heap: list[tuple[int, int, int]] = []

    def push(a: int) -> None:
        b = follows[a]
        if b < len(word) and (r := ranks.get(word[a : ends[b]])) is not None:
            heap.append((r, a, ends[b])) if not ready else heapq.heappush(heap, (r, a, ends[b]))

    ready = False
    for a in range(len(word)):
        push(a)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, a, end = heapq.heappop(heap)
        b = follows[a] if alive[a] else len(word)
        if b >= len(word) or ends[b] != end:
            continue
        alive[b], ends[a], follows[a] = False, end, follows[b]
        if follows[a] < len(word):
            before[follows[a]] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    return [ranks[word[a : ends[a]]] for a in range(len(word)) if alive[a]]


def _marked(word: str, before: str) -> list[str] | None:
    """The letters of a word, after what stands before them, and the marks that follow; None for another form."""
    stem = word.rstrip(_MARKS)
    return ([before + stem, word[len(stem) :]] if len(stem) < len(word) else [before + stem]) if stem.isalpha() else None


def _cut(chunk: str, pieces) -> list[str]:
    """The pieces of a chunk that follows a space; words of letters and marks, and two with a line end between, need no pattern."""
    head, line, tail = chunk.partition("\n")
    first = _marked(head, " ")
    second = _marked(tail, "") if line else []
    return pieces(" " + chunk) if first is None or second is None else [*first, line, *second] if line else first


class _Blocks:
    """Numbers the blocks of a task's texts, alike each time that the task reads the same texts."""

    def __init__(self):
        self.first, self.bytes = TaskContext.get().partitionId() << 20, 0

    def of(self, text: str) -> int:
        block = self.first + self.bytes // BLOCK_BYTES
        self.bytes += len(text)
        return block


def _distinct(shared, pattern: str):
    """(block, word) for the distinct words of each block that are no tokens."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, blocks, ranks = splitter(pattern).findall, _Blocks(), shared.value
        words: set[str] = set()
        chunks: set[str] = set()
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            words.update([" " + chunk for chunk in chunks if chunk.isalpha()])
            for chunk in chunks:
                if not chunk.isalpha():
                    words.update(_cut(chunk, pieces))
            folded = [w for w in words if len(data := w.encode()) <= LONGEST and data not in ranks]
            for k in range(0, len(folded), 50_000):
                some = folded[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(some), pa.int64()), pa.array(some, pa.string())], names=["block", "word"])
            words.clear()
            chunks.clear()

        for batch in batches:
            for value in batch.column(1):
                text = value.as_py() or ""
                if (block := blocks.of(text)) != now:
                    yield from flush()
                    now = block
                if touching(text):
                    words.update(pieces(text))
                else:
                    first, *parts = text.split(" ")
                    words.update(pieces(first))
                    chunks.update(parts)
        yield from flush()

    return distinct


def fold_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, shared) -> tuple[str, int]:
    """Write the folded ids of the words of each block of docs (doc_id, text); gives the folder and its number of files.

    Words of a block meet the same words of other blocks in one exchange, the first of them is folded, and a second
    exchange brings the ids to the file that a hash of the block's number names, ordered by block.
    """
    spark = docs.sparkSession
    folder, files = qualified(spark, new_folder(spark, "words")), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = docs.select("doc_id", "text").mapInArrow(_distinct(shared, pattern), "block long, word string").repartition(files, "word")
    same = Window.partitionBy("word").orderBy("block")
    ids = F.when(F.col("place") == 1, F.transform(fold_merges(F.col("word"), ranks), lambda x: F.lpad(F.hex(x), 8, "0")))
    first = pairs.withColumn("place", F.row_number().over(same)).select("block", "word", F.unhex(F.array_join(ids, "")).alias("ids"))
    every = first.select("block", F.first("ids", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("ids"))
    placed = every.repartitionById(files, F.pmod(F.xxhash64("block"), F.lit(files)).cast("int")).sortWithinPartitions("block")
    # the literal rank map would stand in the text of each plan that is made anew
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__maxPlanStringLength="4000"):
        placed.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(folder)
    return folder, files


def file_of(block: int, files: int) -> int:
    """The file of a block: its XXH64 as Spark's xxhash64 gives it, so that blocks of all tasks spread over all files."""
    return int.from_bytes(xxhash.xxh64_digest(block.to_bytes(8, "little"), 42), "big", signed=True) % files


class _Folded:
    """Reads the folded words of a block."""

    def __init__(self, folder: str, files: int, pieces: list[bytes]):
        self.fs, root = file_system(folder)
        self.files, self.pieces = files, pieces
        names = [f.path for f in self.fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
        self.paths = {int(n.rsplit("/", 1)[-1].split("-")[1]): n for n in names}

    def of(self, block: int) -> dict[str, bytes]:
        """Ids by word, as bytes of 32-bit numbers. The ids spell the word."""
        if (path := self.paths.get(file_of(block, self.files))) is None:
            return {}
        out, pieces = {}, self.pieces
        for chunk in pq.read_table(path, columns=["ids"], filters=[("block", "=", block)], filesystem=self.fs)["ids"].chunks:
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4
            ids = np.frombuffer(chunk.buffers()[2], ">i4").astype(np.int32)
            data, numbers, ends = ids.tobytes(), ids.tolist(), ends.tolist()
            for a, b in zip(ends, ends[1:]):
                out[b"".join([pieces[x] for x in numbers[a:b]]).decode()] = data[4 * a : 4 * b]
        return out


class Encoder(dict):
    """Ids of texts, as bytes of 32-bit numbers; remembers them for what stands between spaces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, helped: bool = True):
        self.ranks, self.pieces, self.helped, self.known = ranks, splitter(pattern).findall, helped, {}

    def start(self, known: dict[str, bytes]) -> None:
        """Begin a block with its folded words."""
        self.known = known
        self.clear()
        self.update((word[1:], ids) for word, ids in known.items() if word[0] == " ")

    def piece(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            data = word.encode()
            if not self.helped and len(data) <= LONGEST and data not in self.ranks:
                raise KeyError(f"not folded: {word!r}")
            got = array("i", merge_word(data, self.ranks)).tobytes()
            if len(data) <= LONGEST:
                self.known[word] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        made = self[chunk] = b"".join(map(self.piece, _cut(chunk, self.pieces)))
        return made

    def encode(self, text: str) -> bytes:
        if touching(text):
            return b"".join(map(self.piece, self.pieces(text)))
        first, *parts = text.split(" ")
        return b"".join((*map(self.piece, self.pieces(first)), *map(self.__getitem__, parts)))


def _pieces(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Tokens by id; None where no token has the id."""
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _encode(shared, folder: str, files: int, pattern: str, helped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        encoder, folded, blocks, now = Encoder(ranks, pattern, helped), _Folded(folder, files, _pieces(ranks)), _Blocks(), None
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                ids, made = batch.column(0).slice(at, _ROWS), []
                for value in batch.column(1).slice(at, _ROWS):
                    text = value.as_py() or ""
                    if (block := blocks.of(text)) != now:
                        encoder.start(folded.of(block))
                        now = block
                    made.append(encoder.encode(text))
                ends = np.cumsum([0, *(len(m) // 4 for m in made)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(made), np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, helped: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs (doc_id, text), each match of pattern encoded by itself.

    ranks_path: a rank file that the driver can read. A null or empty text has no ids. Repeated rows each give a row;
    no rows give no rows; further columns are not read. A task whose texts come in another order than before lacks
    folded words and merges them itself, to the same ids; if it may not (helped), that is an error.
    """
    run, kind = _encoding(docs, ranks_path, pattern, helped)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _encoding(docs: DataFrame, ranks_path: str, pattern: str, helped: bool = True):
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary
    folder, files = fold_words(docs, ranks, pattern, shared)
    return _encode(shared, folder, files, pattern, helped), docs.schema["doc_id"].dataType.simpleString()


def decode_ids(ids: list[int] | None, pieces: list[bytes | None]) -> bytes | None:
    """The joined pieces of ids; empty for no ids, null for null, an error for an id that no token has."""
    if ids is None:
        return None
    try:
        return b"".join([pieces[x] for x in ids])
    except (TypeError, IndexError) as e:
        raise ValueError("an id that no token has") from e


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and data (binary) of each row of encoded (doc_id, ids), by decode_ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                made = [decode_ids(x.as_py(), pieces) for x in batch.column(1).slice(at, _ROWS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, _ROWS), pa.array(made, pa.binary())], names=["doc_id", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def _joined(ids: pa.ListArray, pieces: pa.LargeBinaryArray) -> Iterator[memoryview]:
    """For each row the joined pieces of its ids, all taken at once."""
    ends = ids.offsets.to_numpy()
    taken = pieces.take(ids.values.slice(ends[0], ends[-1] - ends[0]))
    if taken.null_count:
        raise ValueError("an id that no token has")
    bounds = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2] or b"")
    cuts = bounds[ends - ends[0]].tolist()
    return (data[a:b] for a, b in zip(cuts, cuts[1:]))


def _digest(pieces: list[bytes | None], with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    binary, digits = pa.array(pieces, pa.large_binary()), pa.array([b"%d " % k for k in range(len(pieces))], pa.large_binary())
    for batch in batches:
        ids = batch.column(1)
        counts = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
        numbers = [hashlib.sha256(x[:-1]).hexdigest() for x in _joined(ids, digits)]  # less the last space
        data = [hashlib.sha256(x).hexdigest() for x in _joined(ids, binary)]
        own = [batch.column(0), *[ids] * with_ids, counts, pa.array(numbers, pa.string()), pa.array(data, pa.string())]
        yield pa.RecordBatch.from_arrays(own, names=["doc_id", *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, helped: bool = True) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each row of docs, encoded and decoded as encode and decode do; the ids too if wanted."""
    run, kind = _encoding(docs, ranks_path, pattern, helped)
    pieces = docs.sparkSession.sparkContext.broadcast(_pieces(read_ranks(ranks_path)))
    schema = f"doc_id {kind}, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _digest(pieces.value, with_ids, run(batches)), schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the ranks of byte_bpe_50k, and back."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
