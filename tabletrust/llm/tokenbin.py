"""Token ids of whole texts in binary files of fixed-width packed ids, and reads of documents and windows from them.

Encoding. A byte-level tokenizer without a normaliser never joins a space that a visible character follows to what stands
before it, so texts are cut there. The distinct cuts of a part of a batch, signs at their ends set apart, take their ids from
a memory of bounded size, else from the library, which gets many new ones as one text. Texts that hold the string of an added
token, and all texts of tokenizers of other kinds, go to the library whole. The writer encodes, so ids never pass through Spark
on their way to the files.

File. Every id takes the bits that the largest id of the vocabulary needs. Ids are packed in blocks of BLOCK; the file ends
with a footer, all numbers little-endian:

    blocks     packed ids; id k of a block takes the bits k * bits up to (k + 1) * bits, the lowest bit first
    footer     offsets of the blocks and the end of the last (uint64), starts of the documents' ids within the file and
               the end of the last (uint64), document ids (int64), a byte each that is 1 where the document id is null
    end        ids, documents, blocks (uint64), bits, ids a block (uint32), MAGIC

A folder is one write: its manifest is written last and names the files in order with the ids before each, so files of
failed tasks are never read, and a folder without manifest is no data.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tabletrust.llm.common import _written, shared_dir

MAGIC = b"TOKBIN01"
END = struct.Struct("<QQQII8s")
MANIFEST = "manifest.json"
#: Ids of a block, and bytes from which a writer begins another file.
BLOCK, FILE_BYTES = 1 << 14, 256 << 20
#: Ids that a reader gives in one batch, about.
BATCH_IDS = 1 << 20
#: Bytes of text that are encoded at once, about, and rows at most.
PART_BYTES, PART_ROWS = 2 << 20, 1024
#: Entries of a generation of the memory of cuts, and characters up to which one is remembered.
CUT_MEMORY, SHORT = 250_000, 48
#: Marks of keys that were seen once; half of them marked, they are cleared.
MARKS = 1 << 22
#: New cuts that the library gets as one text; its time for one grows with the text.
JOINED = 256
#: A space that white space follows: then texts are cut with CUT, by a slower way.
ODD, CUT = re.compile(r" \s"), re.compile(r" (?=\S)")
#: Signs that are a piece of their own after letters, and cuts of Latin letters that end in one (an Arrow pattern).
ENDS = ".,;:!?"
ENDED = f"^[A-Za-zÀ-ÖØ-öø-ɏ]+[{ENDS}]$"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in `bits` bits each, lowest bit first. Eight ids fill `bits` bytes, so eight columns are shifted into place."""
    n = len(ids)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    columns = np.zeros((-(-n // 8), 8), np.uint64)
    columns.ravel()[:n] = ids
    out = np.zeros((len(columns), bits), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        wide = columns[:, j] << np.uint64(shift)
        for i in range(-(-(bits + shift) // 8)):
            out[:, byte + i] |= (wide >> np.uint64(8 * i)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    groups = -(-n // 8)
    octets = np.zeros((groups, bits), np.uint8)
    octets.ravel()[: len(data)] = np.frombuffer(data, np.uint8)[: groups * bits]
    out, mask = np.empty((groups, 8), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        wide = np.zeros(groups, np.uint64)
        for i in range(-(-(bits + shift) // 8)):
            wide |= octets[:, byte + i].astype(np.uint64) << np.uint64(8 * i)
        out[:, j] = ((wide >> np.uint64(shift)) & mask).astype(np.uint32)
    return out.ravel()[:n]


def bits_for(size: int) -> int:
    """Bits of the largest id of a vocabulary of `size` ids."""
    return max(1, (size - 1).bit_length())


class Memory:
    """What was used lately, in two generations of CUT_MEMORY entries, about. A key is kept from the second time it is seen,
    as most that are new never come again; `now` also holds the new keys of the current part until it is settled."""

    def __init__(self):
        self.now, self.before, self.seen, self.marked = {}, {}, bytearray(MARKS), 0

    def missing(self, keys: list[str]) -> list[str]:
        """The keys that aren't remembered; those of the older generation become young again."""
        now, before, new = self.now, self.before, []
        for k in keys:
            if k not in now:
                if k in before:
                    now[k] = before[k]
                else:
                    new.append(k)
        return new

    def settle(self, new: list[str]) -> None:
        """After a part: its new keys go unless they have been seen before; a full generation becomes the older one."""
        seen, now = self.seen, self.now
        for k in new:
            mark = hash(k) % MARKS
            if not seen[mark]:
                seen[mark] = 1
                self.marked += 1
                del now[k]
            elif len(k) > SHORT:
                del now[k]
        if self.marked > MARKS // 2:
            self.seen, self.marked = bytearray(MARKS), 0
        if len(now) >= CUT_MEMORY:
            self.now, self.before = {}, now


class Encoder:
    """Ids of whole texts, those that the library's encode gives without special tokens around them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        before = spec["pre_tokenizer"] or {}
        self.cuts = spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.code = "H" if self.size <= 1 << 16 else "I"
        # Ids that begin with the space of a cut; added tokens of several words could come about between joined cuts.
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.joins = not any(re.search(r"\s", t) for t in added)
        self.memory = Memory()
        self.library.model._resize_cache(1)  # the memory sees each cut before it does
        self.ends = [*self._ids(list(ENDS)), b""]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, cuts: list[str]) -> list[bytes]:
        """The ids of cuts, each after a space. Visible ones are joined: the library cuts them apart again where an id begins
        with a space, as no other byte of theirs is one."""
        out: dict[str, bytes] = {}
        plain = [c for c in cuts if c and c.isprintable() and " " not in c] if self.joins else []
        for k in range(0, len(plain), JOINED):
            some = plain[k : k + JOINED]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.code)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                data, at = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
                out.update((c, data[a:b]) for c, a, b in zip(some, at, at[1:], strict=False))
        rest = [c for c in cuts if c not in out]
        out.update(zip(rest, self._ids([" " + c for c in rest]), strict=True))
        return [out[c] for c in cuts]

    def _cuts(self, texts: pa.Array) -> pa.Array:
        """Each text's cuts, the spaces between them left out; texts with an added token stay whole."""
        lists, slow = pc.split_pattern(texts, " "), []
        for i, t in enumerate(texts.to_numpy(zero_copy_only=False)):
            if self.added and self.added.search(t):
                slow.append((i, [t]))
            elif ODD.search(t):
                slow.append((i, CUT.split(t)))
        if slow:
            order = np.arange(len(texts))
            order[[i for i, _ in slow]] = len(texts) + np.arange(len(slow))
            lists = pa.concat_arrays([lists, pa.array([c for _, c in slow], lists.type)]).take(pa.array(order))
        return lists

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has; a null text has none."""
        texts = texts.fill_null("")
        if not self.cuts:
            ids = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(ids), self.code), np.array([len(x) for x in ids], np.int64) // np.dtype(self.code).itemsize
        lists = self._cuts(texts)
        starts, cuts = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        starts -= starts[0]
        first = np.zeros(len(cuts), bool)  # no space stands before a text's first cut
        first[starts[:-1]] = True
        words = cuts.filter(pa.array(~first)).dictionary_encode()
        ended = pc.match_substring_regex(words.dictionary, ENDED)
        sign = pc.if_else(ended, pc.index_in(pc.utf8_slice_codeunits(words.dictionary, -1), pa.array(list(ENDS), words.dictionary.type)), len(ENDS))
        stems = pc.if_else(ended, pc.utf8_slice_codeunits(words.dictionary, 0, -1), words.dictionary).dictionary_encode()
        keys = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.memory.missing(keys)
        now = self.memory.now
        now.update(zip(new, self._new(new), strict=True))
        known = pa.array([now[k] for k in keys], pa.large_binary()).take(stems.indices)
        self.memory.settle(new)
        known = pc.binary_join_element_wise(known, pa.array(self.ends, pa.large_binary()).take(sign), pa.scalar(b"", pa.large_binary()))
        heads = pa.array(self._ids(cuts.filter(pa.array(first)).to_pylist()), pa.large_binary())
        at = np.empty(len(cuts), np.int64)
        at[~first], at[first] = words.indices.to_numpy(), len(known) + np.arange(len(heads))
        made = pa.concat_arrays([known, heads]).take(pa.array(at))
        size, (_, offsets, data) = np.dtype(self.code).itemsize, made.buffers()
        ends = np.frombuffer(offsets, np.int64, len(made) + 1, 8 * made.offset)[starts] // size
        return np.frombuffer(data or b"", self.code, ends[-1] - ends[0], int(ends[0]) * size), np.diff(ends)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in 2 bytes each if the vocabulary fits in them, else in 4."""
        ids, lengths = self.flat(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), [0, *(np.cumsum(lengths) * ids.itemsize).tolist()]
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def ended(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Like `flat`, in 4 bytes each, with end_id after each text."""
        ids, lengths = self.flat(texts)
        if end_id is None:
            return ids.astype("<u4"), lengths
        out, stops = np.empty(len(ids) + len(lengths), "<u4"), np.cumsum(lengths + 1)
        own = np.ones(len(out), bool)
        own[stops - 1] = False
        out[own], out[~own] = ids, end_id
        return out, lengths + 1


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PART_BYTES of its second column, one row at least and PART_ROWS at most."""
    stops, k = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while k < batch.num_rows:
        upto = int(np.searchsorted(stops, (stops[k - 1] if k else 0) + PART_BYTES, "right"))
        n = min(max(1, upto - k), PART_ROWS)
        yield batch.slice(k, n)
        k += n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _File:
    """One file as it is written: whole blocks at once, the footer at the end."""

    def __init__(self, folder: str, name: str, bits: int):
        self.name, self.bits = name, bits
        system, at = file_system(folder)
        self.out = system.open_output_stream(f"{at}/{name}")
        self.offsets, self.starts, self.ids, self.n, self.rest = [0], [0], [], 0, np.empty(0, np.uint32)

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.ids += doc_ids
        self.starts += (self.n + np.cumsum(lengths)).tolist()
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> dict[str, Any]:
        if len(self.rest):
            self._block(self.rest)
        for values, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), ([x or 0 for x in self.ids], "<i8"), ([x is None for x in self.ids], "u1")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(END.pack(self.n, len(self.ids), len(self.offsets) - 1, self.bits, BLOCK, MAGIC))
        self.out.close()
        return {"name": self.name, "n_ids": self.n, "n_docs": len(self.ids)}


class TokenFile:
    """A file opened for reading: the footer is read first, then only the blocks that are asked for."""

    def __init__(self, folder: str, name: str):
        system, at = file_system(folder)
        self.data = system.open_input_file(f"{at}/{name}")
        size = self.data.size()
        self.n_ids, self.n_docs, blocks, self.bits, self.block, magic = END.unpack(self.data.read_at(END.size, size - END.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        sizes = [8 * (blocks + 1), 8 * (self.n_docs + 1), 8 * self.n_docs, self.n_docs]
        footer, at = self.data.read_at(sum(sizes), size - END.size - sum(sizes)), 0
        parts = []
        for length, kind in zip(sizes, ("<u8", "<u8", "<i8", "u1"), strict=True):
            parts.append(np.frombuffer(footer[at : at + length], kind).astype(np.int64))
            at += length
        self.offsets, self.starts, self.doc_ids, self.no_id = parts

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, as places within the file."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        data = self.data.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for k in range(first, last):
            block = data[self.offsets[k] - self.offsets[first] : self.offsets[k + 1] - self.offsets[first]]
            out.append(unpack(block, min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]


class TokenStore:
    """Random access to a folder that a write has made: ids by place, documents by number."""

    def __init__(self, folder: str):
        system, at = file_system(folder)
        with system.open_input_stream(f"{at}/{MANIFEST}") as f:
            self.files = json.loads(f.read())["files"]
        self.folder = folder
        self.starts = np.cumsum([0, *(x["n_ids"] for x in self.files)])
        self.docs = np.cumsum([0, *(x["n_docs"] for x in self.files)])
        self.n_ids, self.n_docs = int(self.starts[-1]), int(self.docs[-1])
        self.open = lru_cache(maxsize=8)(lambda k: TokenFile(folder, self.files[k]["name"]))

    def window(self, start: int, length: int) -> np.ndarray:
        """`length` ids from place `start` on, over the ends of documents and files; fewer at the end of the data."""
        stop, out = min(start + length, self.n_ids), []
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        while start < stop:
            upto = min(stop, int(self.starts[k + 1]))
            if upto > start:
                out.append(self.open(k).ids(start - int(self.starts[k]), upto - int(self.starts[k])))
                start = upto
            k += 1
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        """The ids of the document that stands at `number`, from 0, in the order of the files."""
        k = int(np.searchsorted(self.docs, number, "right")) - 1
        f, i = self.open(k), number - int(self.docs[k])
        return f.ids(int(f.starts[i]), int(f.starts[i + 1]))


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list[dict[str, Any]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.bits, self.model = options["path"], int(options["bits"]), options.get("model")
        self.end_id = int(options["end"]) if "end" in options else None

    def _ids(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.model:
            return encoder(self.model).ended(part, self.end_id)
        rows = part.to_pylist()
        return np.frombuffer(b"".join(rows), "<u4"), np.array([len(x) // 4 for x in rows], np.int64)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, now, done = TaskContext.get().partitionId(), None, []
        for batch in iterator:
            for part in parts(batch):
                if now is None:
                    now = _File(self.folder, f"{task:06d}-{uuid.uuid4().hex}.tok", self.bits)
                ids, lengths = self._ids(part.column(1))
                now.add(part.column(0).to_pylist(), lengths, ids)
                if now.offsets[-1] >= FILE_BYTES:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        return Written(task, done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.task) for f in m.files]
        system, at = file_system(self.folder)
        system.create_dir(at)
        with system.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps({"bits": self.bits, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = file_system(self.folder)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{at}/{f['name']}")


@dataclass
class _Part(InputPartition):
    """A file, or windows from first up to last."""

    file: int
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.length = options["path"], int(options.get("window", 0))

    def partitions(self) -> list[_Part]:
        store = TokenStore(self.folder)
        if not self.length:
            return [_Part(k, 0, 0) for k in range(len(store.files))]
        each, n = max(1, 16 * BATCH_IDS // self.length), -(-store.n_ids // self.length)
        return [_Part(0, k, min(n, k + each)) for k in range(0, n, each)]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without documents has no partitions
            return iter(())
        store = TokenStore(self.folder)
        return self._windows(store, partition) if self.length else self._documents(store, partition.file)

    def _windows(self, store: TokenStore, part: _Part) -> Iterator[pa.RecordBatch]:
        each = max(1, BATCH_IDS // self.length)
        for k in range(part.first, part.last, each):
            n = min(each, part.last - k)
            ids = store.window(k * self.length, n * self.length)
            cuts = np.minimum(np.arange(n + 1) * self.length, len(ids)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n) * self.length), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.view(np.int32)))], names=["start", "ids"])

    def _documents(self, store: TokenStore, k: int) -> Iterator[pa.RecordBatch]:
        f, base, i = store.open(k), int(store.starts[k]), 0
        while i < f.n_docs:
            j = max(i + 1, int(np.searchsorted(f.starts, f.starts[i] + BATCH_IDS, "right")) - 1)
            starts = f.starts[i : j + 1]
            data, cuts = f.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes(), (starts - starts[0]) * 4
            rows = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            ids = pa.array(f.doc_ids[i:j], mask=f.no_id[i:j] == 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(rows, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
            i = j


class TokenSource(DataSource):
    """Spark source `tokenbin`. Writes rows (doc_id long, ids binary: little-endian unsigned 32-bit), option bits; with
    option model=path rows (doc_id long, text string), encoded where they are written, option end=id after each. Reads
    doc_id, start, n_tokens and ids in that form; with option window=n instead start and ids (array<int>) of each n ids."""

    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        return "start long, ids array<int>" if "window" in self.options else "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: Any) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def write(docs: DataFrame, path: str, model_path: str, end_id: int | None = None) -> None:
    """Writes the ids of every row's whole text to the folder, documents in ascending order of doc_id.

    Texts are dealt to ranges of (doc_id, text hash, row), sorted there and encoded where they are written, so texts are
    shuffled once and no id owns a range. Rows without an id come first; rows with equal ids are documents of their own, in
    the order of their texts' hashes. Null and empty texts have only the end id; texts of any length are encoded whole.
    An empty table makes a folder without files. Columns other than doc_id and text aren't read, whatever they are called.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenSource)
    keys = ["doc_id", "_text_hash", "_row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = ordered.select("doc_id", "text").write.format("tokenbin").option("bits", bits_for(encoder(model_path).size)).option("model", model_path)
    (out if end_id is None else out.option("end", end_id)).mode("append").save(path)


def read(spark: SparkSession, path: str, window: int | None = None) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids of each document of a folder; or windows of so many ids."""
    spark.dataSource.register(TokenSource)
    source = spark.read.format("tokenbin")
    return (source.option("window", window) if window else source).load(path)


def new_folder(spark: SparkSession) -> str:
    """A folder for one write below the shared one; common.discard deletes it."""
    path = f"{shared_dir(spark)}/tabletrust-tokens-{uuid.uuid4().hex}"
    system, at = file_system(path)
    system.create_dir(at)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path
