"""BPE encoding and decoding with a contiguous array of ranks.

A word is a row of parts (token ids) next to a row of the ranks of adjacent pairs. The least rank is found by scanning
the row, its boundary is deleted by moving the rest up, and the ranks left and right of it are looked up anew,
until no pair has a rank. Many short words of one length are rows of one matrix, so a step works on all of them.
Long words use a linked list of parts and a heap of ranks instead, which scanning would make quadratic.

Every task keeps the words it has met, up to a bound, so each distinct word is merged once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NO_RANK = np.int32(1 << 30)
LONG_WORD = 64
KEPT_WORDS = 400_000
# Fixed: the white space characters of Unicode.
SPACES = "\t-\r \x85\xa0  -     　"


@cache
def character_class(kind: str, top: int) -> str:
    """Members of a regex class: code points up to ``top`` whose general category starts with ``kind``."""
    out, start, category = [], None, unicodedata.category
    for c in range(top + 2):
        if c <= top and category(chr(c)).startswith(kind):
            start = c if start is None else start
        elif start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(out)


@cache
def word_pattern(top: int) -> re.Pattern:
    """Words of texts whose characters are at most ``top``; small classes match faster."""
    letters, numbers = character_class("L", top), character_class("N", top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


@cache
def unassigned(top: int) -> re.Pattern:
    """Characters up to ``top`` that this Python's Unicode tables do not assign."""
    return re.compile(f"[{character_class('Cn', top)}]")


def class_top(text: str) -> int:
    """The smallest of three bounds that no character of ``text`` exceeds."""
    if text.isascii():
        return 0x7F
    return 0xFFFF if max(text) <= "￿" else 0x10FFFF


@cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def lowered(text: str) -> str:
    """Lower case of each character by itself: a sigma at the end of a word stays a plain one."""
    return text.replace("Σ", "σ").lower()


class WordBpe:
    """A tokenizer file of byte-level words with an end mark, merged by rank.

    Text with characters newer than this Python's Unicode tables is lower-cased and split into words by the tokenizers
    library, which may know them; its words are merged like all others.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.specials.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], np.int64)
        self.result = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.order = pairs[order], order.astype(np.int32)
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.known_ids: dict[str | int, bytes] = {}
        self.known_texts: dict[str | int, str] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; a part of -1 has none."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.order[at], NO_RANK)

    def _merge_rows(self, parts: np.ndarray) -> list[list[int]]:
        """Merge words of one length, a row of parts each."""
        done: list[list[int]] = [[]] * len(parts)
        rows = np.arange(len(parts))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            place = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), int)
            here = np.arange(len(rows))
            least = ranks[here, place] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            ended = least == NO_RANK
            # Parts that were deleted are at the end of their row.
            for r, word, size in zip(rows[ended].tolist(), parts[ended].tolist(), (parts[ended] >= 0).sum(axis=1).tolist()):
                done[r] = word[:size]
            go = ~ended
            rows, parts, ranks, place, least = rows[go], parts[go], ranks[go], place[go], least[go]
            if not len(rows):
                break
            here = np.arange(len(rows))
            width = parts.shape[1]
            columns = np.arange(width)[None, :]
            parts[here, place] = self.result[least]
            # Delete the boundary: what follows it moves up by one.
            filled = np.concatenate([parts, np.full((len(rows), 1), -1, np.int32)], axis=1)
            parts = np.take_along_axis(filled, columns + (columns > place[:, None]), axis=1)
            filled = np.concatenate([ranks, np.full((len(rows), 1), NO_RANK, np.int32)], axis=1)
            ranks = np.take_along_axis(filled, columns[:, :-1] + (columns[:, :-1] > place[:, None]), axis=1)
            right = place + 1 < width
            ranks[here[right], place[right]] = self.ranks(parts[here[right], place[right]], parts[here[right], place[right] + 1])
            left = place > 0
            ranks[here[left], place[left] - 1] = self.ranks(parts[here[left], place[left] - 1], parts[here[left], place[left]])
        return done

    def _merge_long(self, parts: np.ndarray) -> list[int]:
        """Merge one long word."""
        ids, n = parts.tolist(), len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self.ranks(parts[:-1], parts[1:])) if r != NO_RANK]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            rank = int(self.ranks(np.array([ids[i]]), np.array([ids[j]]))[0])
            if rank != NO_RANK:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.result[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        for size, places in by_size.items():
            data = np.frombuffer(b"".join([words[i] for i in places]), np.uint8).reshape(len(places), size)
            parts = self.inner[data]
            parts[:, -1] = self.last[data[:, -1]]
            done = self._merge_rows(parts) if size <= LONG_WORD else [self._merge_long(p) for p in parts]
            for i, ids in zip(places, done):
                out[i] = ids
        return out

    def words(self, text: str) -> list[str | int]:
        """Normalised words of a text; special tokens as their ids."""
        found: list[str | int] = []
        at = 0
        for special in self.special.finditer(text) if self.special else ():
            found += self._words(text[at : special.start()])
            found.append(self.specials[special.group()])
            at = special.end()
        return found + self._words(text[at:] if at else text)

    def _library_words(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {ord(letter): b for b, letter in enumerate(byte_letters())}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [word.translate(self.byte_of).encode("latin-1").decode("utf-8") for word, _ in split]

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and unassigned(class_top(text)).search(text):
            return self._library_words(text.encode("utf-8", "replace").decode("utf-8"))
        text = lowered(unicodedata.normalize("NFC", text))
        return word_pattern(class_top(text)).findall(text)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit numbers, and the decoded text."""
        split = [self.words(t) for t in texts]
        if len(self.known_ids) > KEPT_WORDS:
            self.known_ids.clear()
            self.known_texts.clear()
        new = set().union(*split).difference(self.known_ids)
        plain = [w for w in new if isinstance(w, str)]
        merged = self.merged([w.encode("utf-8", "replace") for w in plain])
        for word, ids in [*zip(plain, merged), *[(w, [w]) for w in new if isinstance(w, int)]]:
            self.known_ids[word] = struct.pack(f"<{len(ids)}I", *ids)
            self.known_texts[word] = self.decode(ids)
        for words in split:
            yield b"".join(map(self.known_ids.__getitem__, words)), " ".join(map(self.known_texts.__getitem__, words))

    def decode(self, ids) -> str:
        """The file names no decoder: token texts joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@cache
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


BATCH_BYTES = 4 << 20


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every whole text of ``docs(doc_id, text)`` with the tokenizer file at path ``tokenizer``.

    Null and empty texts have no ids and decode to an empty text. Rows that repeat are encoded one by one. An empty table
    gives no rows; other columns are ignored.

    Returns doc_id, n_tokens, ids_sha256 (of ids as little-endian 32-bit numbers), decoded_sha256.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def rows(doc_ids: pa.Array, texts: list[str], bpe: WordBpe) -> pa.RecordBatch:
        out = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for ids, text in bpe.encode(texts)]
        columns = [doc_ids.cast(pa.int64()), *[pa.array([o[i] for o in out], schema[i + 1].type) for i in range(3)]]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            first, held, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield rows(batch.column(0).slice(first, len(held)), held, bpe)
                    first, held, size = i + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
