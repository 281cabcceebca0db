"""Token ids in shards, each one wavelet matrix: a compressed file that answers access, count and occurrence queries.

Ids are coded by their rank in the shard's alphabet, the most frequent first, so that a code has as many bits as the
shard's own ids need. Level k of the matrix holds bit k (highest first) of each code, in an order in which, level by level, zeros were moved
stably before ones. Ranks are kept per 512-bit block; with them ``access``, ``rank`` and ``select`` of a shard take one
step for each bit. A shard's file is

    magic "LWM1", header length (4 bytes), header (JSON: n, documents, end id, size of the alphabet, plane lengths), then
    document ids (8 bytes each), document starts within the shard (8 bytes each, one more than documents),
    the alphabet (4 bytes each), and for each level the plane, compressed by Zstandard if that is shorter.

All numbers are little-endian. Rank directories are rebuilt on opening; they would be an eighth of the planes.

Shards are files below the shared folder, or another that pyarrow can open: a task writes each under a name of its own
attempt and names it in a stored table (order, first id, path, sizes), which Spark commits whole; so a task that is run again
leaves files that nothing names, and readers see each shard once. They open the files that the table names.

Defined cases: a null or empty text has the end id alone; null document ids come first; rows of one id keep a fixed
order (by text) and are written one after the other; other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common

MAGIC = b"LWM1"
BLOCK = 512
#: A shard is closed at this many ids.
SHARD_IDS = 2_000_000
END_ID = 0
#: Chunks between spaces kept with their ids in each worker; beyond that the later half, mostly rare ones, is forgotten.
CHUNKS = 1_200_000
#: Texts are encoded in batches of at most so many rows, of some so many bytes.
ROWS, TEXT_BYTES = 1_600, 8_000_000
#: Up to so many shards their starts are broadcast (8 MB); more are joined by shuffle.
BROADCAST_SHARDS = 500_000
_NO_ID = -(2**63)


class WaveletMatrix:
    """Over unsigned ids below ``2 ** bits``."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        #: Each plane is packed, lowest bit first, in 64-bit words.
        self.n, self.planes, self.bits = n, planes, len(planes)
        self.zeros, self.before = [], []
        for words in planes:
            ones = np.bitwise_count(words).astype(np.int64)
            blocks = np.zeros(-(-len(words) * 64 // BLOCK) + 1, dtype=np.int64)
            per = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 64)) if len(ones) else ones
            blocks[1 : len(per) + 1] = np.cumsum(per)
            self.before.append(blocks)
            self.zeros.append(n - int(ones.sum()))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes = []
        for k in range(bits - 1, -1, -1):
            bit = (ids >> ids.dtype.type(k) & ids.dtype.type(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.frombuffer(packed.tobytes().ljust(-(-len(packed) // 8) * 8, b"\0"), dtype="<u8"))
            ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])  # far faster than by masks
        return cls(len(ids), planes)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 6]) >> (i & 63) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        words = self.planes[level][block * (BLOCK // 64) : i >> 6]
        n = int(self.before[level][block]) + int(np.bitwise_count(words).sum())
        return n + ((int(self.planes[level][i >> 6]) & (1 << (i & 63)) - 1).bit_count() if i & 63 else 0)

    def select(self, level: int, bit: int, k: int) -> int:
        """Where the ``k``-th (from 0) such bit of a plane is."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            b = self.bit(level, i)
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if b else i - ones
            value = value << 1 | b
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank1(level, start), self.rank1(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands in a stretch."""
        low, high = self._range(value, start, self.n if end is None else end)
        return high - low

    def find(self, value: int, k: int) -> int:
        """The place of the ``k``-th (from 0) occurrence of an id, or -1."""
        low, high = self._range(value, 0, self.n)
        if k >= high - low:
            return -1
        i = low + k
        for level in range(self.bits - 1, -1, -1):
            b = value >> (self.bits - 1 - level) & 1
            i = self.select(level, b, i - self.zeros[level] if b else i)
        return i

    def ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """``rank1`` of many places at once."""
        words = self.planes[level]
        sums = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        whole, rest = at >> 6, (at & 63).astype(np.uint64)
        part = words[np.minimum(whole, len(words) - 1)] & ((np.uint64(1) << rest) - np.uint64(1))
        return sums[whole] + np.bitwise_count(part)

    def access_many(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self.ranks(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            value = value << 1 | bit
        return value

    def count_many(self, value: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often an id stands in each of many stretches."""
        for level in range(self.bits):
            a, b = self.ranks(level, start), self.ranks(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return end - start

    def decode(self) -> np.ndarray:
        """All ids in order: each level's moves undone, from the lowest up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        value = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].view(np.uint8), bitorder="little", count=self.n).view(bool)
            out = np.empty_like(value)
            zeros = self.zeros[level]
            out[np.flatnonzero(~bit)] = value[:zeros]
            out[np.flatnonzero(bit)] = value[zeros:] | kind(1 << (self.bits - 1 - level))
            value = out
        return value


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, end_id: int = END_ID) -> bytes:
    """The file of a shard."""
    counts = np.bincount(ids)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    code = np.zeros(len(counts), dtype=np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    matrix = WaveletMatrix.build(code[ids], max(1, (len(alphabet) - 1).bit_length()))
    planes, squeeze = [], zstandard.ZstdCompressor(level=1).compress
    for words in matrix.planes:
        raw = words.tobytes()
        small = squeeze(raw)
        planes.append((small, True) if len(small) < len(raw) else (raw, False))
    header = json.dumps({"n": matrix.n, "docs": len(doc_ids), "end_id": end_id, "alphabet": len(alphabet), "planes": [[len(p), z] for p, z in planes]}).encode()
    own = np.array([_NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, own, starts.astype("<i8").tobytes(), alphabet.astype("<u4").tobytes(), *(p for p, _ in planes)])


class Shard:
    """An opened file: ``doc_ids``, ``starts``, and access, counting and lookup of token ids."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a shard")
        at = 8 + struct.unpack_from("<I", file, 4)[0]
        head = json.loads(file[8:at])
        n_docs, n_ids = head["docs"], head["alphabet"]
        self.end_id = head["end_id"]
        ids = np.frombuffer(file, dtype="<i8", count=n_docs, offset=at)
        self.doc_ids = [None if d == _NO_ID else d for d in ids.tolist()]
        self.starts = np.frombuffer(file, dtype="<i8", count=n_docs + 1, offset=at + 8 * n_docs)
        at += 16 * n_docs + 8
        self.alphabet = np.frombuffer(file, dtype="<u4", count=n_ids, offset=at)
        at += 4 * n_ids
        planes, expand = [], zstandard.ZstdDecompressor().decompress
        for size, squeezed in head["planes"]:
            raw = file[at : at + size]
            planes.append(np.frombuffer(expand(raw) if squeezed else raw, dtype="<u8"))
            at += size
        self.matrix = WaveletMatrix(head["n"], planes)

    def _code(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def access(self, i: int) -> int:
        return int(self.alphabet[self.matrix.access(i)])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        code = self._code(token)
        return 0 if code is None else self.matrix.count(code, start, end)

    def access_many(self, at: np.ndarray) -> np.ndarray:
        return self.alphabet[self.matrix.access_many(at)]

    def count_many(self, token: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        code = self._code(token)
        return np.zeros(len(start), dtype=np.int64) if code is None else self.matrix.count_many(code, start, end)

    def find(self, token: int, k: int) -> int:
        code = self._code(token)
        return -1 if code is None else self.matrix.find(code, k)

    def decode(self) -> np.ndarray:
        return self.alphabet[self.matrix.decode()]


class Encoder:
    """The tokenizers library for words it hasn't seen, and its tokens for those it has: what it gives for a text is what
    it gives for the text's words, one after the other, as its pattern parts them.

    Texts are cut at their spaces (see ``bpe.Remembered``) and the chunks told apart by compiled code, a batch at once. Only
    new chunks are cut into words, and only new words meet the library's model. Ids of known ones stand one after the other in
    ``flat``, those of code k from ``at[k]`` on: ``codes`` has chunks with a space before them, ``bare`` words without.
    """

    def __init__(self, path: str, most: int = CHUNKS):
        from tokenizers import Tokenizer

        from lathe.llm import bpe

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.uint16 if self.library.get_vocab_size(True) <= 1 << 16 else np.uint32
        own = bpe.vocabulary(path)
        self.added = {t: k.to_bytes(4, "little") for t, k in own.added.items()}
        self.chars = str.maketrans(dict(enumerate(bpe.byte_characters())))
        self.shown = np.array([ord(c) for c in bpe.byte_characters()], dtype="<u2")
        self.remembered = bpe.Remembered(own, self.learn)
        # a byte that no text has, and that merges with nothing, keeps words apart
        self.apart, model = own.first[255], self.library.model
        if model.dropout or model.ignore_merges or any(self.apart in divmod(pair, own.merges.n) for pair in own.merges.rank):
            raise ValueError("words of this vocabulary cannot be encoded side by side")
        self.most, self.n, self.codes, self.bare = most, 0, {}, {}
        self.flat, self.at, self.open = np.zeros(1 << 20, dtype=self.kind), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=bool)

    def learn(self, words: list[str]) -> list[bytes]:
        """Words by the library's model, which takes bytes as the characters that stand for them."""
        model, added, chars = self.library.model, self.added, self.chars
        tokenize = model.tokenize
        return [added.get(w) or array("I", [t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(chars))]).tobytes() for w in words]

    def learn_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for many words of texts, some of them at a time: all ids, and how many each word has."""
        tokenize, sep = self.library.model.tokenize, chr(self.shown[255])
        data = b"\xff".join([w.encode("utf-8", "surrogatepass") for w in words])
        shown = self.shown[np.frombuffer(data, dtype=np.uint8)].tobytes().decode("utf-16-le").split(sep)
        found = array("I")
        for k in range(0, len(shown), 32):
            found.extend([t.id for t in tokenize(sep.join(shown[k : k + 32]) + sep)])
        ids = np.frombuffer(found, dtype=np.uint32)
        ends = np.flatnonzero(ids == self.apart)
        return ids[ids != self.apart], np.diff(ends, prepend=-1) - 1

    def _room(self, name: str, n: int) -> np.ndarray:
        held = getattr(self, name)
        if n > len(held):
            held = np.concatenate([held, np.zeros(max(n, len(held) * 3 // 2) - len(held), dtype=held.dtype)])
            setattr(self, name, held)
        return held

    def _add(self, ids: np.ndarray, counts: np.ndarray, opened: list[bool]) -> range:
        """Codes for new words or chunks."""
        codes, start = range(self.n, self.n + len(counts)), int(self.at[self.n])
        self._room("flat", start + len(ids))[start : start + len(ids)] = ids
        self._room("at", codes.stop + 1)[codes.start + 1 : codes.stop + 1] = start + np.cumsum(counts)
        self._room("open", codes.stop)[codes.start : codes.stop] = opened
        self.n = codes.stop
        return codes

    def _take(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Stretches of ``flat``, one after the other."""
        ends = np.cumsum(n)
        return self.flat[np.repeat(start - ends + n, n) + np.arange(ends[-1])]

    def _know(self, chunks: list[str]) -> np.ndarray:
        """Codes for new chunks."""
        plain, codes, bare = self.remembered.plain, self.codes, self.bare
        # the pattern parts chunks at the spaces between them, but for those that end in white space
        opened = np.array([not x or x[-1].isspace() for x in chunks])
        order = np.argsort(opened, kind="stable")
        chunks, alone = [chunks[k] for k in order.tolist()], len(chunks) - int(opened.sum())
        words = plain(" " + " ".join(chunks[:alone])) if alone else []
        for x in chunks[alone:]:
            words += plain(" " + x)
        starts = np.flatnonzero(np.fromiter([w[0] == " " for w in words], bool, len(words)))
        size = np.diff(starts, append=len(words))
        # a chunk of one word is as new as the word
        found = [-1 if one else codes.get(w[1:], -1) if w[0] == " " else bare.get(w, -1) for w, one in zip(words, np.repeat(size == 1, size).tolist(), strict=True)]
        missing = [w for w, c in zip(words, found, strict=True) if c < 0]
        new = sorted(dict.fromkeys(missing), key=lambda w: w[0] == " ", reverse=True)
        word = np.array(found)
        if new:
            made = dict(zip(new, self._add(*self.learn_many(new), [w[-1].isspace() for w in new]), strict=True))
            word[word < 0] = list(map(made.__getitem__, missing))
            n_spaced = sum(w[0] == " " for w in new)
            codes.update(zip([w[1:] for w in islice(made, n_spaced)], made.values(), strict=False))
            bare.update(islice(made.items(), n_spaced, None))
            del made
        code = word[starts]
        if len(several := np.flatnonzero(size > 1)):
            word = word[np.repeat(size > 1, size)]
            start, n = self.at[word], self.at[word + 1] - self.at[word]
            of_chunk = np.add.reduceat(n, np.cumsum(size[several]) - size[several])
            made = self._add(self._take(start, n), of_chunk, opened[order][several])
            codes.update(zip([chunks[k] for k in several.tolist()], made, strict=True))
            code[several] = made
        out = np.empty_like(code)
        out[order] = code
        return out

    def many(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (none of them null), each followed by ``end_id``, and how many each text has."""
        if not len(texts):
            return np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64)
        if self.n > self.most:
            self.n = n = self.most // 2
            self.codes, self.bare = ({x: c for x, c in known.items() if c < n} for known in (self.codes, self.bare))
        parts = pc.split_pattern(texts, " ")
        edges = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        which, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        first, last = edges[:-1], edges[1:] - 1
        # first chunks have no space before them: they are words of their own
        heads = names[which[first]].tolist()
        spaced = np.ones(len(which), dtype=bool)
        spaced[first] = False
        needed = np.zeros(len(names), dtype=bool)
        needed[which[spaced]] = True
        code = np.fromiter(map(self.codes.get, names, repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(needed & (code < 0))):
            code[new] = self._know(names[new].tolist())
        # chunks that are first ones only may have no code: theirs isn't read below
        code[code < 0] = 0
        start, n, opened = self.at[code][which], (self.at[code + 1] - self.at[code])[which], self.open[code][which]
        # where white space comes before a space, or with added tokens, the whole text is cut by the pattern
        opened[first] = opened[last] = False
        odd = set((np.searchsorted(edges, np.flatnonzero(opened), "right") - 1).tolist())
        odd.update(k for k, x in enumerate(heads) if x[-1:].isspace() and last[k] > first[k])
        for token in self.added:
            odd.update(np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist())
        for k in odd:
            n[edges[k] : edges[k + 1]] = 0
        cut = [self.remembered.pieces(texts[k].as_py()) if k in odd else self.remembered.plain(x) for k, x in enumerate(heads)]
        self.remembered.know({w for ws in cut for w in ws})
        word, used = self.remembered.words.__getitem__, int(self.at[self.n])
        rows = [b"".join(map(word, ws)) for ws in cut]
        ids = np.frombuffer(b"".join(rows), dtype="<u4")
        # they stand beyond what is known, until the next batch
        self._room("flat", used + len(ids))[used : used + len(ids)] = ids
        n[first] = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        start[first] = used + np.cumsum(n[first]) - n[first]
        counts = np.add.reduceat(n, first)
        return np.insert(self._take(start, n), np.cumsum(counts), end_id), counts + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def opened(folder: str):
    """(store, path within it) of a folder or file: a URI, or a path of a shared file system."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def by_size(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of some ``TEXT_BYTES`` of text; a longer text ends its piece or begins one."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(), dtype=np.int64)
    edges = np.flatnonzero(np.diff(sizes // TEXT_BYTES, prepend=0)).tolist()
    for a, z in zip([0, *edges], [*edges, len(sizes)], strict=True):
        if a < z:
            yield batch.slice(a, z - a)


def write_shards(docs: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID, shard_ids: int = SHARD_IDS, folder: str | None = None) -> DataFrame:
    """A stored table (place, first_id, last_id, n_docs, n_ids, path): the shards written, in ascending order of ``place``."""
    from lathe.llm import bpe

    path = path or bpe.default_vocabulary()
    folder = folder or f"{common.shared_dir(docs.sparkSession)}/lathe-shard-files-{uuid.uuid4().hex}"
    ordered = common.texts(docs, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    names = ["place", "first_id", "last_id", "n_docs", "n_ids", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        task = TaskContext.get()
        store, at_folder = opened(folder)
        ids, doc_ids, counts, held, part = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            # ranges are in the order of partitions
            place = (task.partitionId() << 32) + part
            name = f"shard-{place:016x}-{task.taskAttemptId()}.lwm"
            starts = np.cumsum([0, *counts])
            store.create_dir(at_folder, recursive=True)
            with store.open_output_stream(f"{at_folder}/{name}") as out:
                out.write(pack(doc_ids, starts, np.concatenate(ids), end_id))
            row = [[place], [doc_ids[0]], [doc_ids[-1]], [len(doc_ids)], [int(starts[-1])], [f"{folder}/{name}"]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [*[pa.int64()] * 5, pa.string()], strict=True)], names=names)

        for b in (piece for rows in batches for piece in by_size(rows, "text")):
            own_ids = b.column("doc_id").to_pylist()
            tokens, n = own.many(b.column("text"), end_id)
            at = 0
            for doc_id, k in zip(own_ids, n.tolist(), strict=True):
                ids.append(tokens[at : at + k])
                doc_ids.append(doc_id)
                counts.append(k)
                at, held = at + k, held + k
                if held >= shard_ids:
                    yield close()
                    ids, doc_ids, counts, held, part = [], [], [], 0, part + 1
        if doc_ids:
            yield close()

    return common.stored(common.in_batches(ordered, run, "place long, first_id long, last_id long, n_docs long, n_ids long, path string", rows=ROWS), "shards")


def read_shard(path: str) -> Shard:
    store, at = opened(path)
    with store.open_input_file(at) as f:
        return Shard(f.read())


def numbered(shards: DataFrame) -> DataFrame:
    """(place, start): ids in all shards before each, summed by ranges of shards."""
    return common.prefix_sums(shards.select("place", "n_ids"), "place", "n_ids", "start").select("place", "start")


def read_documents(shards: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, last_id, n_end_ids[, ids]) of each document, from the files alone.

    The ids are the shard's, decoded; the last one is looked up by access, and end ids are counted by ranks.
    """
    schema = "place long, doc_id long, inner long, n_tokens long, ids_crc32 long, last_id long, n_end_ids long" + ", ids array<int>" * ids

    def run(batches):
        for b in batches:
            for place, path in zip(b.column("place").to_pylist(), b.column("path").to_pylist(), strict=True):
                shard = read_shard(path)
                tokens = shard.decode()
                edges = shard.starts.tolist()
                docs = [tokens[a:z] for a, z in zip(edges, edges[1:], strict=False)]
                n = len(docs)
                last = shard.access_many(shard.starts[1:] - 1).tolist()
                ends = shard.count_many(shard.end_id, shard.starts[:-1], shard.starts[1:]).tolist()
                numbers = [[place] * n, shard.doc_ids, edges[:-1], [len(d) for d in docs], [zlib.crc32(d.tobytes()) for d in docs], last, ends]
                columns = [pa.array(c, pa.int64()) for c in numbers]
                if ids:
                    columns.append(pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["place", "doc_id", "inner", "n_tokens", "ids_crc32", "last_id", "n_end_ids", *(["ids"] * ids)])

    # a row stands for a file of some MB: few to a task
    n = shards.count()
    listed = shards.select("place", "path").repartition(max(1, -(-n // 4)), "place")
    found = common.in_batches(listed, run, schema, rows=1)
    # said outright: by the size of the list of files, Spark would take the documents to be the small side
    starts = numbered(shards)
    joined = found.join(F.broadcast(starts) if n <= BROADCAST_SHARDS else starts.hint("merge"), "place")
    return joined.select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "last_id", "n_end_ids", *(["ids"] * ids))


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(common.documents(spark, sf_dir)), ids=False)
