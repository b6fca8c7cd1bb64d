"""Removal of repeated byte strings with suffix arrays, exact over all documents.

A string of ``LENGTH`` bytes that occurs twice holds the same least k-gram (by hash) both times. So every document is cut
into pieces of consecutive strings with the same least k-gram, and pieces meet by it: all occurrences of a string
are in pieces of one shard. Equal pieces are told by a 128-bit BLAKE2b digest of their bytes and only the earliest goes on; the
strings of the others all start earlier. Copies that a task meets itself are not shuffled by their k-gram, so a passage that very
many documents share is one row a task. Pieces whose k-gram no other piece shares are done. What is left, different pieces with a
common k-gram, is sorted by :mod:`suffix_sort`, and of suffixes with a common prefix of ``LENGTH`` all but the earliest
start a removed string. No shard grows with the table: different pieces of one k-gram beyond ``HOT_BYTES`` are dealt by the
digest of each of their strings instead, of which all but the earliest are removed as they stream by. The least k-grams
are chosen by a plain hash, which decides no equality.

Rows that are shuffled hold a few numbers per piece; of texts, only left pieces go to shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut, with_running_total, written
from .suffix_sort import repeated

LENGTH = 100
GRAM = 32
BUFFER = 1 << 19
PIECE_STRINGS = 1 << 11
KNOWN_COPIES = 1 << 15
SHARD_BYTES = 1 << 20
HOT_PIECES = 1000
HOT_BYTES = 8 << 20
KEY_ROWS = 1 << 18
PLACES_PER_PART = 9
NO_ID = (1 << 63) - 1


# ------------------------------------------------------------------------------------------------
# Pieces of texts
# ------------------------------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS:
        inverse = pow(int(BASE), -1, 1 << 64)
        for name, value in (("up", int(BASE)), ("down", inverse)):
            steps = np.full(BUFFER + 1, value, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def digests(parts: list[bytes]) -> np.ndarray:
    """128-bit BLAKE2b digests as rows of two numbers: what equality of bytes rests on."""
    joined = b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in parts])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def least_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-gram of ``data``, and for every string of ``LENGTH`` the place of its least one, the first of equals."""
    up, _ = _powers()
    grams, size = BYTE_HASH[data], 1
    while size < GRAM:
        grams = grams[:-size] * up[size] + grams[size:]
        size *= 2
    grams = _mixed(grams)
    low = np.uint64(BUFFER - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    return grams, (least & low).astype(np.int64)


def buffer_pieces(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of the documents in ``data`` that end at ``ends``: start, strings, gram (hash), content and rest (digest), multi.

    ``multi`` tells that the least k-gram occurs at several places of a piece, without which no string of
    it can repeat within the piece. Fewer than ``BUFFER`` bytes at once.
    """
    n = len(data) - LENGTH + 1
    none = {k: np.array([], np.int64) for k in ("start", "strings", "gram", "content", "rest", "multi")}
    if n <= 0:
        return none
    grams, place = least_grams(data)
    at = np.arange(n)
    document = np.searchsorted(ends, at, side="right")
    whole = at + LENGTH <= ends[np.minimum(document, len(ends) - 1)]
    moved = np.r_[True, (place[1:] != place[:-1]) | (document[1:] != document[:-1]) | ~whole[:-1]]
    runs = np.flatnonzero(moved & whole)
    if not len(runs):
        return none
    gram = grams[place[runs]]
    adjacent = np.r_[False, (document[runs[1:]] == document[runs[:-1]]) & whole[runs[1:] - 1]]
    new = ~(adjacent & np.r_[False, gram[1:] == gram[:-1]])
    first = np.flatnonzero(new)
    start = runs[first]
    multi = np.diff(np.r_[first, len(runs)]) > 1
    document_end = ends[document[start]] - LENGTH + 1
    stop = np.minimum(np.r_[start[1:], n], document_end)
    gram, strings = gram[first], stop - start
    if (strings > PIECE_STRINGS).any():
        parts = -(-strings // PIECE_STRINGS)
        which = np.repeat(np.arange(len(start)), parts)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE_STRINGS
        strings = np.minimum(strings[which] - step, PIECE_STRINGS)
        start, gram, multi = start[which] + step, gram[which], multi[which]
    whole = data.tobytes()
    content = digests([whole[a:b] for a, b in zip(start.tolist(), (start + strings + LENGTH - 1).tolist())])
    return {
        "start": start, "strings": strings, "gram": gram.view(np.int64), "content": content[:, 0], "rest": content[:, 1],
        "multi": multi.astype(np.int64),
    }


PIECES = "gram long, content long, rest long, doc long, slot long, start long, strings int, multi int"
PIECE_SCHEMA = pa.schema([(c, pa.int64()) for c in ("gram", "content", "rest", "doc", "slot", "start")] + [("strings", pa.int32()), ("multi", pa.int32())])
COPY = -1  # in place of ``multi``: a copy of a piece that the task has met at an earlier place


class MetPieces:
    """The places of pieces that a task has met several times, at most ``KNOWN_COPIES`` of them."""

    def __init__(self) -> None:
        self.places: dict[tuple[int, int], tuple[int, int, int]] = {}

    def copies(self, content: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which rows are later than an equal piece; ``content`` and ``place`` have two and three columns."""
        order = np.lexsort((*place.T[::-1], *content.T))
        ordered, places = content[order], place[order]
        new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)]
        first = places[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = (places != first).any(axis=1)
        starts = np.flatnonzero(new)
        several = np.diff(np.r_[starts, len(order)]) > 1
        for i in starts[np.isin(ordered[starts, 0], np.fromiter((k[0] for k in self.places), np.int64, len(self.places)))]:
            key, here = tuple(ordered[i].tolist()), tuple(places[i].tolist())
            if (known := self.places.get(key)) is not None:
                later[i] |= known < here
                self.places[key] = min(known, here)
        if len(self.places) > KNOWN_COPIES:
            self.places.clear()
        for i in starts[several]:
            self.places.setdefault(tuple(ordered[i].tolist()), tuple(places[i].tolist()))
        out = np.zeros(len(order), bool)
        out[order] = later
        return out


def text_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of all texts of ``docs(doc, slot, text)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # doc, slot, offset of the part in its text, bytes
        size, met = 0, MetPieces()

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            data = np.frombuffer(b"".join([h[3] for h in held]), np.uint8)
            ends = np.cumsum([len(h[3]) for h in held])
            found = buffer_pieces(data, ends)
            document = np.searchsorted(ends, found["start"], side="right")
            begins = np.r_[0, ends[:-1]]
            key = np.array([h[:3] for h in held], np.int64).reshape(-1, 3)[document]
            start = found["start"] - begins[document] + key[:, 2]
            copy = met.copies(np.stack([found["content"], found["rest"]], axis=1), np.stack([key[:, 0], key[:, 1], start], axis=1))
            # Copies are done; they are spread by their place.
            gram = np.where(copy, _mixed((key[:, 0] + start).astype(np.uint64)).view(np.int64), found["gram"])
            multi = np.where(copy, COPY, found["multi"])
            columns = [gram, found["content"], found["rest"], key[:, 0], key[:, 1], start, found["strings"], multi]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE_SCHEMA)], schema=PIECE_SCHEMA)

        for batch in batches:
            for doc, slot, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                content = (text.as_py() or "").encode("utf-8", "replace")
                if len(content) < LENGTH:
                    continue
                # Parts of long texts overlap by what strings that start in one part need of the next.
                step = BUFFER - LENGTH
                for at in range(0, len(content) - LENGTH + 1, step):
                    part = content[at : at + step + LENGTH - 1]
                    if size + len(part) >= BUFFER:
                        yield flush()
                    held.append((doc, slot, at, part))
                    size += len(part)
        if held:
            yield flush()

    return docs.select("doc", "slot", "text").mapInArrow(task, PIECES)


# ------------------------------------------------------------------------------------------------
# Meeting of pieces
# ------------------------------------------------------------------------------------------------
MET = "suspect boolean, gram long, doc long, slot long, start long, strings int"
MET_SCHEMA = pa.schema(
    [("suspect", pa.bool_()), ("gram", pa.int64()), ("doc", pa.int64()), ("slot", pa.int64()), ("start", pa.int64()), ("strings", pa.int32())]
)


def met_pieces(pieces: DataFrame) -> DataFrame:
    """Later copies of pieces (suspect false), and first copies that share their k-gram with other bytes (true).

    One sorted pass; of a k-gram's pieces only the first is held until a second one with other bytes shows up.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # gram, content, rest, doc, slot, start, strings of the latest first copy
        waiting = False  # that copy is its k-gram's only one so far

        def rows_of(suspect: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([suspect, *columns], MET_SCHEMA)], schema=MET_SCHEMA)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            done = columns[-1] == COPY
            if done.any():
                yield rows_of(np.zeros(done.sum(), bool), [columns[i][done] for i in (0, 3, 4, 5, 6)])
                columns = [c[~done] for c in columns]
            if not len(columns[0]):
                continue
            gram, content, rest, doc, slot, start, strings, multi = columns
            if last is not None:
                lead = [np.array([v]) for v in last]
                gram, content, rest, doc, slot, start, strings = (np.concatenate([a, b]) for a, b in zip(lead, columns))
                multi = np.r_[0, multi]
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            new = new_gram | np.r_[True, (content[1:] != content[:-1]) | (rest[1:] != rest[:-1])]
            at = np.arange(len(gram))
            first = np.maximum.accumulate(np.where(new, at, 0))
            # Equal rows have the same place: they are one occurrence.
            same = (doc == doc[first]) & (slot == slot[first]) & (start == start[first])
            group = np.cumsum(new_gram) - 1
            kinds = np.bincount(group, weights=new)[group]
            several = np.bincount(group, weights=multi)[group] > 0
            suspect = new & ((kinds > 1) | several)
            if last is not None and not waiting:
                # The carried piece has been given out; its k-gram is known to be shared.
                suspect |= new & (group == 0)
                suspect[0] = False
            rows = suspect | ~(new | same)
            tail = first[-1]
            waiting = not suspect[tail] and not (last is not None and not waiting and group[tail] == 0)
            last = [v[tail] for v in (gram, content, rest, doc, slot, start, strings)]
            yield rows_of(suspect[rows], [v[rows] for v in (gram, doc, slot, start, strings)])

    order = ["gram", "content", "rest", "doc", "slot", "start"]
    return pieces.repartition("gram").sortWithinPartitions(*order).mapInArrow(task, MET)


SPANS = "doc long, slot long, first long, stop long"
SPAN_SCHEMA = pa.schema([("doc", pa.int64()), ("slot", pa.int64()), ("first", pa.int64()), ("stop", pa.int64())])


def split_piece(content: bytes) -> list[tuple[int, int, int]]:
    """A piece cut by where its strings have their least k-gram: part, first string, strings.

    Equal strings have it at the same place, so they are in equal parts. Neighbouring places share a part.
    """
    _, place = least_grams(np.frombuffer(content, np.uint8))
    part = (place - np.arange(len(place))) // PLACES_PER_PART
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip((part[first] + 1).tolist(), first.tolist(), np.diff(np.r_[first, len(part)]).tolist()))


def string_keys(content: bytes) -> np.ndarray:
    """The digest of every string of a piece."""
    return digests([content[i : i + LENGTH] for i in range(len(content) - LENGTH + 1)])


WHOLE, PLACES, STRINGS = 0, 1, 2


def _piece_bytes(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """Bytes of suspects: gram, part, rest, doc, slot, start, content.

    Pieces of a k-gram that has very many are cut, which splits the k-gram's shard; others are part 0. Where a k-gram's
    pieces are too large for one shard, every string is a row without content, and its digest is part and rest. Of equal ones in a
    task only the earliest is such a row; the others are spans already, rows with empty content, the document as gram and
    the stop as part. The pieces of one document are a list, as long as the document at most.
    """
    # A part has a piece's strings in runs, which start ten strings apart or more and have 99 bytes more than strings.
    size = F.sum(11 * F.col("strings") + LENGTH - 1)
    way = F.when(F.col("bytes") > HOT_BYTES, STRINGS).otherwise(PLACES)
    sizes = suspects.groupBy("gram").agg(F.count("*").alias("n"), size.alias("bytes"))
    hot = sizes.where(F.col("n") > HOT_PIECES).select("gram", way.alias("hot"))
    marked = suspects.join(hot, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(WHOLE)))
    listed = marked.groupBy("doc", "slot").agg(F.collect_list(F.struct("gram", "start", "strings", "hot")).alias("pieces"))
    joined = docs.select("doc", "slot", "text").join(listed, ["doc", "slot"])
    schema = pa.schema([*((c, pa.int64()) for c in ("gram", "part", "rest", "doc", "slot", "start")), ("content", pa.binary())])

    def keyed(pieces: list[tuple]) -> pa.RecordBatch:
        counts = [len(p[4]) for p in pieces]
        gram, doc, slot, begin = (np.repeat(np.array([p[i] for p in pieces], np.int64), counts) for i in range(4))
        keys = np.concatenate([p[4] for p in pieces])
        rows = np.stack([gram, keys[:, 0], keys[:, 1], doc, slot, begin + np.concatenate([np.arange(n) for n in counts])])
        rows = rows[:, np.lexsort(rows[::-1])]
        new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
        first = rows[:, np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))]
        # Equal rows of the table are one occurrence.
        doc, slot, start = (later := rows[3:, (rows != first).any(axis=0)])[:, np.lexsort(later[::-1])]
        run = np.r_[True, (doc[1:] != doc[:-1]) | (slot[1:] != slot[:-1]) | (start[1:] > start[:-1] + 1)][: len(doc)]
        last = np.r_[np.flatnonzero(run)[1:], len(doc)][: run.sum()] - 1
        spans = np.stack([doc[run], start[last] + LENGTH, np.zeros(run.sum(), np.int64), doc[run], slot[run], start[run]])
        columns = [pa.array(c) for c in np.concatenate([rows[:, new], spans], axis=1)]
        content = pa.array([None] * int(new.sum()) + [b""] * spans.shape[1], pa.binary())
        return pa.RecordBatch.from_arrays([*columns, content], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n_keys = [], 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                content = row["text"].encode("utf-8", "replace")
                for p in row["pieces"]:
                    piece = content[p["start"] : p["start"] + p["strings"] + LENGTH - 1]
                    if p["hot"] == STRINGS:
                        keys.append((p["gram"], row["doc"], row["slot"], p["start"], string_keys(piece)))
                        n_keys += p["strings"]
                        if n_keys >= KEY_ROWS:
                            yield keyed(keys)
                            keys, n_keys = [], 0
                        continue
                    for part, first, strings in split_piece(piece) if p["hot"] == PLACES else [(WHOLE, 0, p["strings"])]:
                        cut_out = piece[first : first + strings + LENGTH - 1]
                        rows.append((p["gram"], part, 0, row["doc"], row["slot"], p["start"] + first, cut_out))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if keys:
            yield keyed(keys)

    return joined.mapInArrow(task, "gram long, part long, rest long, doc long, slot long, start long, content binary")


def sorted_spans(parts: DataFrame) -> DataFrame:
    """Spans of ``parts`` whose strings also start earlier, by the suffix order of each shard.

    A shard is filled with whole parts of k-grams, none much larger than ``HOT_BYTES``. Rows without content are equal
    strings if their gram and digest are; the first is kept and none is held. Rows with empty content are spans.
    """

    def copies(string: tuple | None, batch: pa.RecordBatch) -> tuple[tuple, pa.RecordBatch]:
        """``string`` is the latest first copy; rows are in order."""
        lead = np.array(string if string is not None else [], np.int64).reshape(6, -1)
        rows = np.concatenate([lead, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]])], axis=1)
        new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
        first = rows[:, np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))]
        # Equal rows of the table are one occurrence.
        _, _, _, doc, slot, start = rows[:, (rows != first).any(axis=0)]
        columns = [doc, slot, start, start + LENGTH]
        return tuple(first[:, -1].tolist()), pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=SPAN_SCHEMA)

    def spans(held: list[tuple]) -> pa.RecordBatch:
        number, offset = repeated([h[6] for h in held], LENGTH)
        begin = np.array([h[5] for h in held], np.int64)[number] + offset
        # A shard may hold no repeat: there are no spans then, and no last one.
        first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + 1)][: len(number)])
        last = np.r_[first[1:], len(number)][: len(first)] - 1
        key = np.array([h[3:5] for h in held], np.int64).reshape(-1, 2)[number[first]]
        columns = [key[:, 0], key[:, 1], begin[first], begin[last] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SPAN_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before, string = [], 0, None, None
        for batch in batches:
            length = pc.fill_null(pc.binary_length(batch.column(6)), -1)
            keys, ready_spans = batch.filter(pc.equal(length, -1)), batch.filter(pc.equal(length, 0))
            if keys.num_rows:
                string, found = copies(string, keys)
                yield found
            if ready_spans.num_rows:
                yield pa.RecordBatch.from_arrays([ready_spans.column(i) for i in (3, 4, 5, 1)], schema=SPAN_SCHEMA)
            batch = batch.filter(pc.greater(length, 0))
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if size >= SHARD_BYTES and row[:2] != held[-1][:2]:
                    yield spans(held)
                    held, size = [], 0
                # Equal rows of the table give equal pieces at one place: one of them counts.
                if row[:6] != before:
                    held.append(row)
                    size += len(row[6])
                before = row[:6]
        if held:
            yield spans(held)

    order = ["gram", "part", "rest", "doc", "slot", "start"]
    return parts.repartition("gram", "part").sortWithinPartitions(*order).mapInArrow(task, SPANS)


# ------------------------------------------------------------------------------------------------
# Documents
# ------------------------------------------------------------------------------------------------
def keyed_documents(docs: DataFrame) -> DataFrame:
    """Add ``doc`` (the id, null last) and ``slot`` (0, or a number that orders different texts of one id)."""
    doc = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_doc")
    key = docs.select(doc, F.xxhash64("text").alias("_mark"))
    several = key.groupBy("_doc").agg(F.min("_mark").alias("a"), F.max("_mark").alias("b")).where("a <> b").select("_doc")
    repeats = cut(key.join(several, "_doc").distinct().withColumn("_one", F.lit(1).cast("long")))
    plain = docs.withColumns({"doc": F.coalesce(F.col("doc_id"), F.lit(NO_ID)), "slot": F.lit(0).cast("long")})
    if repeats.isEmpty():
        return plain
    numbered = with_running_total(repeats, ["_doc", "_mark"], "_one", "_slot").drop("_one")
    marked = plain.withColumn("_hash", F.xxhash64("text"))
    joined = marked.join(numbered, (marked["doc"] == numbered["_doc"]) & (marked["_hash"] == numbered["_mark"]), "left")
    return joined.withColumn("slot", F.coalesce("_slot", F.lit(0).cast("long"))).drop("_doc", "_mark", "_hash", "_slot")


def removed_spans(keyed: DataFrame) -> DataFrame:
    """Removed strings of ``keyed(doc, slot, text)``: doc, slot and a list of (first, stop), which may overlap."""
    met = written(met_pieces(text_pieces(keyed)), "met")
    copies = met.where(~F.col("suspect")).select(
        "doc", "slot", F.col("start").alias("first"), (F.col("start") + F.col("strings") + LENGTH - 1).alias("stop")
    )
    suspects = met.where("suspect").select("gram", "doc", "slot", "start", "strings")
    spans = copies.unionByName(sorted_spans(_piece_bytes(keyed, suspects)))
    return spans.groupBy("doc", "slot").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))


def merged_spans(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """Disjoint spans that do not touch, in order."""
    out: list[list[int]] = []
    for first, stop in sorted(spans or []):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [tuple(s) for s in out]


def kept_bytes(content: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for first, stop in spans:
        kept.append(content[at:first])
        at = stop
    return b"".join([*kept, content[at:]])


def _with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    keyed = keyed_documents(docs)
    return keyed, removed_spans(keyed)


def deduplicated_digests(docs: DataFrame) -> DataFrame:
    """What is removed of every row of ``docs(doc_id, text)``.

    Null texts are empty. Null ids come after all others. Rows with equal id and text are one document, of which neither
    is earlier, and have equal results; different texts of one id are ordered by a hash. Texts under
    100 bytes keep all. An empty table gives no rows; other columns are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    """
    keyed, spans = _with_spans(docs.select("doc_id", "text"))
    joined = keyed.join(spans, ["doc", "slot"], "left").select("doc_id", "text", "spans")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                content = (text.as_py() or "").encode("utf-8", "replace")
                gone = merged_spans([(s["first"], s["stop"]) for s in found or []])
                removed = sum(stop - first for first, stop in gone)
                digest = hashlib.sha256(kept_bytes(content, gone)).hexdigest()
                rows.append((doc_id, len(content), removed, len(gone), digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return joined.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; texts without any stay as they are, null too.

    A cut may split a character, whose remaining bytes go too. Other columns are kept.
    """
    names = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"])
    keyed, spans = _with_spans(docs.select("doc_id", "text", others.alias("row")))
    value = lambda c: F.col("text") if c == "text" else F.col("row")[c].alias(c)
    rows = keyed.join(spans, ["doc", "slot"], "left").select(*map(value, names), F.col("spans").alias("_spans"))
    at = names.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns[:-1]), []
            for text, found in zip(batch.column(at), batch.column(len(names)).to_pylist()):
                if found is None or not text.is_valid:
                    texts.append(text.as_py())
                    continue
                gone = merged_spans([(s["first"], s["stop"]) for s in found])
                texts.append(kept_bytes(text.as_py().encode("utf-8", "replace"), gone).decode("utf-8", "ignore"))
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(task, docs.schema)
