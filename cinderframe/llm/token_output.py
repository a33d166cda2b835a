"""Token ids in length-delimited binary records with masked checksums and an offset index."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from cinderframe.llm.common import text_rows
from cinderframe.session import new_folder, written

#: Text bytes of one record file.
FILE_BYTES = 32 << 20
#: Bytes of a piece's key, and of keys and ids that a worker remembers.
WIDE = 24
REMEMBERED = 64 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "?"), ("offset", "<u8"), ("n_tokens", "<u8")])


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that a checksum of bytes that hold checksums stays a good one."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """length u64 | masked checksum of the length u32 | payload | masked checksum of the payload u32."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[bytes]:
    """The payloads of a file; raises ValueError where a checksum or a length does not hold."""
    at = 0
    while at < len(data):
        head = data[at : at + 12]
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError(f"bad record length at byte {at}")
        end = at + 12 + struct.unpack("<Q", head[:8])[0]
        payload, check = data[at + 12 : end], data[end : end + 4]
        if len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
            raise ValueError(f"bad record at byte {at}")
        yield payload
        at = end + 4


def serialized(doc_id: int | None, ids: np.ndarray) -> bytes:
    """id i64 (0 if null) | 1 if the id is null u8 | width of a token id in bytes u8 | token ids; two bytes each where all fit."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def deserialized(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack("<qBB", payload[:10])
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes: ASCII letters; ASCII characters that are none. Of pairs of bytes, as 16-bit numbers: letters from U+00C0 to U+024F."""
    codes = np.arange(256)
    letter = np.array([chr(c).isalpha() for c in range(128)] + [False] * 128)
    pairs = np.zeros(1 << 16, bool)
    for char in map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]):
        pairs[int.from_bytes(char.encode(), "big")] = True
    return letter, (codes < 128) & ~letter, pairs


LETTER, OTHER, LETTERS = _classes()
#: White space beyond ASCII, as numbers of two or three bytes; 1C to 1F and the other control characters are taken for white space, too.
SPACES = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
KEPT = np.array([[0xFF] * k + [0] * (WIDE - k) for k in range(WIDE + 1)], np.uint8).view(np.uint64)
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Places, in UTF-8 bytes, where texts may be cut and the ids of the pieces put together, for a byte-level pre-tokenizer ends a token there.

    They lie between a letter and an ASCII character that is none, and in front of a space that has other characters than white space on
    both sides. Letters are those of ASCII and two bytes that every version of Unicode has as letters. No piece ends with white space,
    unless it ends a text.
    """
    at = np.flatnonzero(OTHER[data])
    at = at[at > 0]
    wide = np.concatenate([[0, 0, 0], data, [0, 0, 0, 0]]).astype(np.int64)  # data[p] is wide[p + 3]
    pair = lambda p: (wide[p] << 8) | wide[p + 1]
    last = wide[at + 2]
    letter = LETTER[last]
    beyond = np.flatnonzero(last > 127)
    letter[beyond] = LETTERS[pair(at[beyond] + 1)]
    space = at[(data[at] == 32) & ~letter]
    left, right = wide[space + 2], wide[space + 4]
    fits = (left > 32) & (right > 32)
    far = np.flatnonzero(fits & (left > 127))
    p = space[far]
    fits[far] = ~np.isin(pair(p + 1), SPACES) & ~np.isin(wide[p] << 16 | pair(p + 1), SPACES)
    far = np.flatnonzero(fits & (right > 127))
    p = space[far] + 4
    fits[far] = ~np.isin(pair(p), SPACES) & ~np.isin(pair(p) << 8 | wide[p + 2], SPACES)
    found = np.zeros(len(data) + 1, bool)
    found[at[letter]] = found[space[fits]] = True
    return np.flatnonzero(found)


class Encoder:
    """The tokenizers library's ids of a text, with the ids of pieces seen before remembered.

    Texts are cut where the pre-tokenizer ends a token whatever stands around (see `piece_starts`), and each different piece is encoded once.
    Pieces of up to WIDE bytes are remembered by their bytes, sorted by a hash; a hash that two pieces share shows, as bytes are compared.
    Texts that hold a special token are encoded whole, as the library has it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values()) + 2, bool)  # ids whose first byte is a space, written as U+0120
        self.begins[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self._remember(np.zeros(0, np.uint64), np.zeros((0, WIDE // 8), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _remember(self, hashes: np.ndarray, keys: np.ndarray, length: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Sorted hashes of pieces, their bytes and lengths, and where their ids lie."""
        self.hashes, self.keys, self.length, self.at, self.size, self.ids = hashes, keys, length, at, size, ids

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, "<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces behind each other, and how many each has. Pieces of one space in front of other characters are encoded as one text."""
        plain = [w[0] == " " and not w[-1].isspace() and not w[1].isspace() and w.rfind(" ") == 0 for w in pieces]
        size = np.zeros(len(pieces), np.int64)
        place, rest = np.flatnonzero(plain), np.flatnonzero(~np.array(plain, bool))
        ids: list[np.ndarray] = []
        for i in range(0, len(place), 2048):
            part = place[i : i + 2048]
            found = self._library(["".join([pieces[k] for k in part.tolist()])])[0]
            begin = np.flatnonzero(self.begins[found])
            if len(begin) != len(part):
                raise ValueError("ids of pieces do not begin with a space each")
            size[part] = np.diff(np.append(begin, len(found)))
            ids.append(found)
        others = self._library([pieces[k] for k in rest.tolist()])
        size[rest] = [len(found) for found in others]
        flat = np.concatenate([*ids, *others, np.zeros(0, "<u4")])
        order = np.concatenate([place, rest])
        at = np.empty(len(pieces), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return flat[_ranges(at, size)], size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [k for k, text in enumerate(texts) if any(token in text for token in self.special)]
        bodies = [text.encode() for text in texts]
        for k in whole:
            bodies[k] = b""
        found = self._cut_and_put_together(bodies)
        if found is None:
            return self._library(texts)
        for k, ids in zip(whole, self._library([texts[k] for k in whole])):
            found[k] = ids
        return found

    def _cut_and_put_together(self, bodies: list[bytes]) -> list[np.ndarray] | None:
        """Ids of texts; none if different pieces share a hash."""
        blob = b"".join(bodies)
        data = np.frombuffer(blob, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(body) for body in bodies])]).astype(np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[piece_starts(data)] = cut[bounds] = True
        start = np.flatnonzero(cut[:-1])
        length = np.diff(np.append(start, len(data)))
        at, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        text_of = lambda k: [blob[i : i + n].decode() for i, n in zip(start[k].tolist(), length[k].tolist())]

        short = np.flatnonzero(length <= WIDE)
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(WIDE, np.uint8)]), WIDE)[start[short]]
        keys = rows.view(np.uint64) & KEPT[length[short]]
        code = (keys * STEPS).sum(1, dtype=np.uint64) + length[short].astype(np.uint64)
        code = (code ^ (code >> np.uint64(29))) * STEPS[0]
        hashes, first, each = np.unique(code, return_index=True, return_inverse=True)
        lengths = length[short[first]]
        if (keys != keys[first][each]).any() or (length[short] != lengths[each]).any():
            return None
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        same = np.zeros(len(hashes), bool)
        if len(self.hashes):
            same = self.hashes[place] == hashes
            if (same & ((self.keys[place] != keys[first]).any(1) | (self.length[place] != lengths))).any():
                return None
        fresh = np.flatnonzero(~same)
        ids, sizes = self._pieces(text_of(short[first[fresh]]))
        begin, count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        begin[same], count[same] = self.at[place[same]], self.size[place[same]]
        begin[fresh], count[fresh] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        pool = np.concatenate([self.ids, ids])
        at[short], size[short] = begin[each], count[each]

        if pool.nbytes + (len(self.hashes) + len(fresh)) * (WIDE + 32) > REMEMBERED:  # only what these texts hold stays
            self._remember(hashes, keys[first], lengths, np.cumsum(count) - count, count, pool[_ranges(begin, count)])
        else:
            joined = lambda old, new: np.concatenate([old, new[fresh]])[order]
            order = np.argsort(np.concatenate([self.hashes, hashes[fresh]]), kind="stable")
            self._remember(*(joined(*x) for x in ((self.hashes, hashes), (self.keys, keys[first]), (self.length, lengths), (self.at, begin), (self.size, count))), pool)

        long = np.flatnonzero(length > WIDE)
        if len(long):
            nth: dict[str, int] = {}
            each = np.array([nth.setdefault(piece, len(nth)) for piece in text_of(long)])
            ids, sizes = self._pieces(list(nth))
            at[long], size[long] = (len(pool) + np.cumsum(sizes) - sizes)[each], sizes[each]
            pool = np.concatenate([pool, ids])
        out = pool[_ranges(at, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, bounds)]
        return [out[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[k] .. at[k] + size[k] - 1 for every k, behind each other."""
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, text in enumerate(texts):
        if size and size + len(text) > most:
            yield i, j
            i, size = j, 0
        size += len(text)
    if texts:
        yield i, len(texts)


def write_records(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode, write in ascending id order, return the manifest: part, file, index, n_docs, n_tokens.

    Ranges of ids become files. A task writes under names of its own attempt and reports them, so what a lost or repeated
    attempt left behind is never read. Beside each file stands its index (id, whether it is null, offset, tokens of every record), for
    reading single records in any order.
    """
    rows = text_rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // file_bytes))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        known, index, at, tokens, out = encoder(path), [], 0, 0, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _groups(texts):
                if out is None:
                    out = store.open_output_stream(f"{name}.rec")
                for doc_id, found in zip(ids[i:j], known.encode(texts[i:j])):
                    found = np.append(found, np.uint32(end_id)).astype("<u4")
                    record = frame(serialized(doc_id, found))
                    out.write(record)
                    index.append((doc_id or 0, doc_id is None, at, len(found)))
                    at, tokens = at + len(record), tokens + len(found)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{name}.idx") as side:
            side.write(np.array(index, INDEX).tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [f"{name}.rec"], "index": [f"{name}.idx"], "n_docs": [len(index)], "n_tokens": [tokens]},
            pa.schema([("part", pa.int32()), ("file", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return rows.mapInArrow(write, "part int, file string, index string, n_docs long, n_tokens long")


def read_at(folder: str, file: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(file) as source:
        source.seek(offset)
        head = source.read(12)
        return deserialized(next(frames(head + source.read(struct.unpack("<Q", head[:8])[0] + 4))))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, from the files. Checksums are verified."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, not a document
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    files = files.select("file", "start").repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(file) as source:
                    data = source.read()
                rows: list[tuple] = []
                for payload in frames(data):
                    doc_id, ids = deserialized(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents as token records below the shared folder and read them back.

    A null text is empty: its record holds the end id only. Repeated ids keep all their records, next to each other. An empty
    table writes no file.
    """
    folder = new_folder(docs.sparkSession, "token-records")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return read_records(written(write_records(docs, folder, path, id_col, text_col), "token-manifest"), folder)
