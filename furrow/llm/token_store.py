"""Token ids in files, coded in blocks, in ascending order of documents.

A file holds a run of documents: a magic word, blocks of ids with length and checksum, the table
of documents, and a trailer that tells where the table starts. Blocks span documents and can be decoded one by one.
Files are written by tasks under names of their own; the list of files that count, one row per task, gives
their order and the number of ids before each.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import byte_letters
from .common import attempt_file, opened, shared_folder
from .token_coder import checksum, decode_blocks, encode_blocks

MAGIC = b"TOKENS2\n"
BLOCK_IDS = 4096
LANES = 2048
FILE_IDS = 1 << 24
TABLE_BITS = 22
KEPT_PIECES = 2_000_000
END_ID = 0


# ------------------------------------------------------------------------------------------------
# Tokenizing
# ------------------------------------------------------------------------------------------------
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
# Contractions that are pieces of their own: an apostrophe and these letters.
SHORT_ENDINGS = [(c,) for c in "stmd"] + [tuple(e) for e in ("re", "ve", "ll")]


@cache
def character_kinds() -> np.ndarray:
    """Kind of every code point; unknown are those this Python's tables do not assign."""
    kinds = np.fromiter((KIND_OF.get(unicodedata.category(chr(c)), OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


KIND_OF = {
    **{c: LETTER for c in ("Lu", "Ll", "Lt", "Lm", "Lo")},
    **{c: NUMBER for c in ("Nd", "Nl", "No")},
    "Cn": UNKNOWN,
}


def piece_starts(codes: np.ndarray, kinds: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces begin into which a byte-level tokenizer splits texts; ``text_starts`` of non-empty texts.

    A run of letters, numbers or signs is a piece, with a space right before it. Of other white space before such a
    run the last character is a piece and the rest one; at a text's end all is one. An apostrophe without a
    space before it makes a piece with the ending of a contraction that follows.
    """
    n = len(codes)
    begins = np.zeros(n, bool)
    begins[text_starts] = True
    run = np.ones(n, bool)
    run[1:] = kinds[1:] != kinds[:-1]
    run |= begins
    space = kinds == SPACE
    starts = run.copy()
    # Characters after white space of the same text.
    after = np.flatnonzero(run & ~space & ~begins)
    after = after[space[after - 1]]
    starts[after - 1] = True
    starts[after[codes[after - 1] == 0x20]] = False
    quote = np.flatnonzero(starts & (codes == 0x27))
    for ending in SHORT_ENDINGS:
        size = len(ending)
        at = quote[quote + size < n]
        # The apostrophe is a run of its own, and the letters are in one run with it before them, in the same text.
        fits = (kinds[at + 1] == LETTER) & ~begins[at + 1]
        for k, letter in enumerate(ending, 1):
            fits &= codes[at + k] == ord(letter)
        if size == 2:
            fits &= ~begins[at + 2]
        at = at[fits]
        starts[at + 1] = False
        rest = at + 1 + size
        rest = rest[rest < n]
        # What follows the ending begins a piece, unless it is white space or a sign that did so anyway.
        starts[rest[kinds[rest] == LETTER]] = True
    return np.flatnonzero(starts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for every code point, and powers of a base and of its inverse modulo 2^64."""
    values = _mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    powers = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(BATCH_CHARS + 1, base, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    return values, *powers


BASE = 0x9E3779B97F4A7C15
BATCH_CHARS = 1 << 20


class PieceTable:
    """Ids of known pieces, found by a 64-bit hash of their characters in open addressing and told by the characters."""

    def __init__(self, bits: int = TABLE_BITS):
        self.mask = np.int64((1 << bits) - 1)
        self.hashes = np.zeros(1 << bits, np.uint64)
        self.numbers = np.zeros(1 << bits, np.int32)
        self.clear()

    def clear(self) -> None:
        self.hashes[:] = 0
        self.size, self.filled = 0, 0
        self.begin, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint16)
        self.written = 0
        self.text_begin, self.text_length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.codes = np.zeros(1 << 14, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        open_at, slot = np.arange(len(hashes)), hashes.view(np.int64) & self.mask
        wanted = hashes
        while len(open_at):
            there = self.hashes.take(slot)
            hit = there == wanted
            out[open_at[hit]] = self.numbers.take(slot[hit])
            on = ~hit & (there != 0)
            open_at, slot, wanted = open_at[on], (slot[on] + 1) & self.mask, wanted[on]
        return out

    def differing(self, numbers: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which pieces ``codes[start:end]``, in a row, have other characters than the entries of these numbers."""
        sizes = ends - starts
        other = self.text_length.take(numbers) != sizes
        begin = np.where(other, 0, self.text_begin.take(numbers))
        places = np.repeat(begin - starts, sizes) + np.arange(len(codes))
        wrong = np.flatnonzero(self.codes.take(places, mode="clip") != codes)
        other[np.searchsorted(starts, wrong, side="right") - 1] = True
        return np.flatnonzero(other)

    def _write(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Append the characters of new pieces."""
        sizes = ends - starts
        stop = self.written + np.cumsum(sizes)
        while len(sizes) and stop[-1] > len(self.codes):
            self.codes = np.resize(self.codes, 2 * len(self.codes))
        if len(sizes):
            at = np.repeat(starts - (stop - sizes - self.written), sizes) + np.arange(int(sizes.sum()))
            self.codes[self.written : stop[-1]] = codes[at]
            numbers = self.size + np.arange(len(sizes))
            self.text_begin[numbers], self.text_length[numbers] = stop - sizes, sizes
            self.written = int(stop[-1])

    def _grow(self, more: int) -> None:
        """Make room for as many more pieces."""
        while self.size + more > len(self.begin):
            for name in ("begin", "length", "text_begin", "text_length"):
                setattr(self, name, np.resize(getattr(self, name), 2 * len(getattr(self, name))))

    def add(self, hashes: np.ndarray, ids: list[list[int]], codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Enter new pieces ``codes[start:end]``; hashes are distinct and unknown."""
        self._grow(len(ids))
        self._write(codes, starts, ends)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        id_ends = self.filled + np.cumsum(lengths, dtype=np.int64)
        numbers = self.size + np.arange(len(ids))
        while len(ids) and id_ends[-1] > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.begin[numbers], self.length[numbers] = id_ends - lengths, lengths
        if len(ids):
            self.ids[self.filled : id_ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint16, int(lengths.sum()))
            self.filled = int(id_ends[-1])
        self.size += len(ids)
        slot = hashes.view(np.int64) & self.mask
        while len(hashes):
            free = self.hashes.take(slot) == 0
            self.hashes[slot[free]] = hashes[free]
            mine = self.hashes.take(slot) == hashes
            self.numbers[slot[mine]] = numbers[mine]
            hashes, numbers, slot = hashes[~mine], numbers[~mine], (slot[~mine] + 1) & self.mask

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and where each ends."""
        lengths = self.length.take(numbers).astype(np.int64)
        ends = np.cumsum(lengths)
        places = np.repeat(self.begin.take(numbers) - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids.take(places), ends


class PieceTokenizer:
    """A tokenizer file of the tokenizers library; each distinct piece of text is encoded by it once.

    Pieces are what its pre-tokenizer splits texts into, and are encoded independently of each other. They are found
    by a 64-bit hash and compared by their characters. Texts with a piece whose hash another one has taken, with a
    special token's string, with characters newer than this Python knows, or of over a million characters are
    encoded whole. The file's pre-tokenizer must be the byte-level one whose pieces are found here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        splits = content["pre_tokenizer"] or {}
        wanted = {"type": "ByteLevel", "add_prefix_space": False}
        if content["normalizer"] or any(splits.get(k) != v for k, v in wanted.items()) or not splits.get("use_regex", True):
            raise ValueError(f"{path} has a normalizer, or splits texts in another way than by bytes with spaces kept")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = np.array([ord(letter) for letter in byte_letters()], "<u4")
        self.table = PieceTable()

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> list[list[int]]:
        """Ids of single pieces, by the tokenizer's model alone: their bytes as the letters that stand for them."""
        data = np.frombuffer("".join(pieces).encode("utf-8", "replace"), np.uint8)
        characters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        ends = characters[np.cumsum([len(p) for p in pieces])].tolist()
        written = self.letters.take(data).tobytes().decode("utf-32-le")
        tokenize = self.model.tokenize
        return [[token.id for token in tokenize(written[i:j])] for i, j in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = [np.array([], np.uint16)] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > BATCH_CHARS or any(s in text for s in self.specials):
                out[i] = np.array(self._encoded([text])[0], np.uint16)
                continue
            if size + len(text) > BATCH_CHARS:
                self._encode_some(texts, held, out)
                held, size = [], 0
            held.append(i)
            size += len(text)
        if held:
            self._encode_some(texts, held, out)
        return out

    def _encode_whole(self, texts: list[str], which: list[int], out: list[np.ndarray]) -> None:
        for i in which:
            out[i] = np.array(self._encoded([texts[i]])[0], np.uint16)

    def _encode_some(self, texts: list[str], which: list[int], out: list[np.ndarray]) -> None:
        joined = "".join([texts[i] for i in which])
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(texts[i]) for i in which])
        begins = np.cumsum(sizes) - sizes
        kinds = character_kinds().take(codes)
        if (kinds == UNKNOWN).any():
            odd = np.unique(np.searchsorted(begins, np.flatnonzero(kinds == UNKNOWN), side="right") - 1)
            self._encode_whole(texts, [which[k] for k in odd], out)
            left = sorted(set(range(len(which))) - set(odd.tolist()))
            if left:
                self._encode_some(texts, [which[k] for k in left], out)
            return
        starts = piece_starts(codes, kinds, begins)
        ends = np.append(starts[1:], len(codes))
        values, up, down = _hash_tables()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.take(codes) * down[: len(codes)], dtype=np.uint64)])
        hashes = np.maximum(_mixed((sums[ends] - sums[starts]) * up[starts]), np.uint64(1))
        numbers = self.table.find(hashes)
        if (numbers < 0).any():
            if self.table.size + len(hashes) > KEPT_PIECES:
                self.table.clear()
                numbers[:] = -1
            missing = np.flatnonzero(numbers < 0)
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            a, b = starts[first], ends[first]
            self.table.add(new, self._merged([joined[i:j] for i, j in zip(a.tolist(), b.tolist())]), codes, a, b)
            numbers[missing] = self.table.find(hashes[missing])
        ids, id_ends = self.table.gathered(numbers)
        # Texts begin with a piece of their own.
        piece = np.append(np.searchsorted(starts, begins), len(starts))
        bounds = np.concatenate([[0], id_ends])[piece]
        for k, i in enumerate(which):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        taken = self.table.differing(numbers, codes, starts, ends)
        if len(taken):
            self._encode_whole(texts, [which[k] for k in np.unique(np.searchsorted(begins, starts[taken], side="right") - 1)], out)


@cache
def tokenizer_at(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


# ------------------------------------------------------------------------------------------------
# Files
# ------------------------------------------------------------------------------------------------
def file_bytes(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """A file of documents' ids."""
    ids = np.concatenate(documents) if documents else np.array([], np.uint16)
    parts = [MAGIC, struct.pack("<I", -(-len(ids) // BLOCK_IDS))]
    blocks = [ids[at : at + BLOCK_IDS] for at in range(0, len(ids), BLOCK_IDS)]
    for first in range(0, len(blocks), LANES):
        group = blocks[first : first + LANES]
        for block, payload in zip(group, encode_blocks(group)):
            parts += [struct.pack("<III", len(block), len(payload), checksum(payload, len(block))), payload]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    sizes = np.array([len(d) for d in documents], "<u4")
    table = zlib.compress(known.tobytes() + numbers.tobytes() + sizes.tobytes(), 6)
    at = sum(map(len, parts))
    return b"".join([*parts, table, struct.pack("<QI", at, len(documents)), MAGIC])


def read_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file: id and token ids. Blocks are checked before they are decoded."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("no token file, or not whole")
    at, documents = struct.unpack("<QI", data[-20:-8])
    table = zlib.decompress(data[at:-20])
    known = np.frombuffer(table, np.uint8, documents)
    numbers = np.frombuffer(table, "<i8", documents, documents)
    sizes = np.frombuffer(table, "<u4", documents, 9 * documents)
    (n_blocks,) = struct.unpack_from("<I", data, 8)
    place = 12
    pieces, payloads, lengths = [], [], []
    for number in range(n_blocks):
        length, size, check = struct.unpack_from("<III", data, place)
        payload = data[place + 12 : place + 12 + size]
        if len(payload) != size or checksum(payload, length) != check:
            raise ValueError(f"block {number} is damaged")
        payloads.append(payload)
        lengths.append(length)
        place += 12 + size
        if len(payloads) == LANES or number == n_blocks - 1:
            pieces += decode_blocks(payloads, lengths)
            payloads, lengths = [], []
    ids = np.concatenate(pieces) if pieces else np.array([], np.uint16)
    if len(ids) != sizes.sum():
        raise ValueError("ids do not fill the documents")
    ends = np.cumsum(sizes, dtype=np.int64)
    for is_known, number, begin, end in zip(known, numbers, ends - sizes, ends):
        yield int(number) if is_known else None, ids[begin:end]


MANIFEST = "part int, seq int, file string, n_ids long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str) -> list[tuple[str, int]]:
    """Write the ids of ``docs(doc_id, text)``, each closed by id 0, to files in ascending doc_id order, null first.

    Returns the files in order with the number of ids before each: a row per task and ``FILE_IDS`` ids.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        encoder, part, seq = tokenizer_at(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, documents, held = [], [], 0
        end = np.array([END_ID], np.uint16)

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, documents, held, seq
            name = attempt_file(base, ".tok")
            with store.open_output_stream(name, compression=None) as out:
                out.write(file_bytes(doc_ids, documents))
            row = (part, seq, name, held)
            doc_ids, documents, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            # A long text is taken whole, but never with many others.
            texts, size, first = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size < (4 << 20) and i < batch.num_rows - 1:
                    continue
                doc_ids += batch.column(0).slice(first, len(texts)).to_pylist()
                for ids in encoder.encode(texts):
                    documents.append(np.concatenate([ids, end]))
                    held += len(documents[-1])
                texts, size, first = [], 0, i + 1
                if held >= FILE_IDS:
                    yield flush()
        if documents:
            yield flush()

    mark = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark)
    rows = sorted(tuple(r) for r in ordered.mapInArrow(task, MANIFEST).collect())
    files, before = [], 0
    for _, _, name, n_ids in rows:
        files.append((name, before))
        before += n_ids
    return files


def read_tokens(spark: SparkSession, files: list[tuple[str, int]], folder: str) -> DataFrame:
    """Documents of token files, a task per file: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for batch in batches:
            for name, before in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(name) as file:
                    data = file.read()
                rows = []
                for doc_id, ids in read_file(data):
                    rows.append((doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    listed = spark.createDataFrame(files, "file string, before long").repartition(max(1, len(files)))
    return listed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the ids of every whole text of ``docs(doc_id, text)`` and read them back.

    Null and empty texts have the end id only. Documents come in ascending doc_id order, null first; rows of one id are
    ordered by a hash of their texts, and rows that are equal follow each other. Ids must be below
    65536. An empty table gives no files and no rows; other columns are ignored.

    Returns doc_id, start, n_tokens, ids_crc32.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, tokenizer, folder), folder)
