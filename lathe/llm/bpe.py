"""Byte-level BPE: encoding with segment trees over the ranks of adjacent pairs, and decoding.

A leaf of the tree holds, for a symbol and the symbol after it, the rank of their merge with the position in the low
bits; the root's minimum is so the leftmost pair of lowest rank. A merge changes three leaves, each a walk to the
root, until no pair can be merged. Short words of a batch are encoded side by side, a tree for each in one array;
long ones get a tree of their own, so that a word of n bytes costs n log n. Encoded words are remembered, up to a
fixed number.

Defined cases: a null or empty text has no tokens and decodes to the empty text; texts are encoded whole; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lathe.llm import common

#: Words, and chunks between spaces, kept with their tokens in each worker; beyond that the later half, mostly rare ones, is forgotten.
REMEMBERED, CHUNKS = 200_000, 700_000
#: Words of at most so many bytes are encoded side by side.
SIDE_BY_SIDE = 64
_NONE = np.iinfo(np.int64).max

#: The published pattern of this family of byte-level vocabularies.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in the files: itself if it prints, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Merges:
    """Which pairs of symbols merge, by rank. Symbols are ids; ``pairs[rank] = (left, right)`` becomes ``made[rank]``."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int], n_symbols: int):
        self.n = n_symbols
        self.made = np.array([*made, 0], dtype=np.int64)
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault(a * n_symbols + b, r)
        keys = np.array(sorted(self.rank), dtype=np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([*(self.rank[k] for k in keys.tolist()), 0], dtype=np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of many pairs, and which of them merge."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        return self.ranks[at], self.keys[at] == key

    def merge_one(self, symbols: list[int]) -> list[int]:
        """A word by a tree of its own."""
        n = len(symbols)
        if n < 2:
            return symbols
        size = 1 << (n - 1).bit_length()
        shift = size.bit_length()
        none = 1 << 62
        sym, after, before = [*symbols, -1], list(range(1, n + 1)), list(range(-1, n))
        rank, made, wide = self.rank, self.made, self.n

        def leaf(i: int) -> int:
            j = after[i]
            if j >= n:
                return none
            r = rank.get(sym[i] * wide + sym[j])
            return none if r is None else r << shift | i

        tree = [none] * (2 * size)
        tree[size : size + n] = map(leaf, range(n))
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low

        while (root := tree[1]) != none:
            i = root & (1 << shift) - 1
            j = after[i]
            sym[i] = int(made[root >> shift])
            after[i] = k = after[j]
            before[k] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    def merge_many(self, words: list[list[int]]) -> list[bytes]:
        """Words of similar length side by side: row w of each array is the word's own tree and linked list."""
        n = np.array([len(w) for w in words])
        size = 1 << max(1, int(n.max() - 1).bit_length())
        shift, w = size.bit_length(), len(words)
        sym = np.zeros((w, size + 1), dtype=np.int64)
        inside = np.arange(size + 1) < n[:, None]
        sym[inside] = np.concatenate([np.asarray(x, dtype=np.int64) for x in words])
        after = np.minimum(np.arange(1, size + 2), n[:, None])
        before = np.tile(np.arange(-1, size), (w, 1))
        tree = np.full((w, 2 * size), _NONE)
        rank, ok = self.ranked(sym[:, :-1], sym[:, 1:])
        ok &= inside[:, 1:]
        tree[:, size:] = np.where(ok, rank << shift | np.arange(size), _NONE)
        for k in (size >> d for d in range(1, size.bit_length())):
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        alive = inside.copy()
        rows = np.arange(w)
        while len(rows := rows[tree[rows, 1] != _NONE]):
            root = tree[rows, 1]
            i = root & (1 << shift) - 1
            j = after[rows, i]
            k = after[rows, j]
            sym[rows, i] = self.made[root >> shift]
            after[rows, i] = k
            before[rows, k] = i
            alive[rows, j] = False
            p = before[rows, i]
            end = n[rows]
            tree[rows, size + j] = _NONE
            for left, right, there in ((i, k, k < end), (np.maximum(p, 0), i, p >= 0)):
                rank, ok = self.ranked(sym[rows, left], sym[rows, right])
                value = np.where(ok & there, rank << shift | left, _NONE)
                tree[rows[there], size + left[there]] = value[there]
            tree[rows[k >= end], size + i[k >= end]] = _NONE
            nodes = np.stack([i, j, np.maximum(p, 0)]) + size
            while nodes[0, 0] > 1:
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
        ids, ends = sym[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: Where the pattern's library takes for letters what the tokenizers' library, with older tables, does not.
NEW_LETTERS = "\\U000323B0-\\U0003FFFF"


def words_of(pattern: str):
    """``findall`` of a pattern whose letters are those of the tokenizers' library; texts with newer ones take a slower path."""
    plain = regex.compile(pattern).findall
    strict = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{N}}[\p{{L}}--[{NEW_LETTERS}]]]").replace(r"\p{L}+", rf"[\p{{L}}--[{NEW_LETTERS}]]+")).findall
    newer = regex.compile(f"[{NEW_LETTERS}]").search
    return lambda text: plain(text) if text.isascii() or not newer(text) else strict(text)


#: White space before a space: there a stretch of white space isn't parted at its spaces.
_RUN = regex.compile(r"\s ")
_MARKS = frozenset(".,;:!?")


class Remembered:
    """Token ids (little-endian, four bytes each) of texts, from those of words seen before.

    The pattern puts a space with what follows it and never looks across it, unless white space comes before; so a text
    is cut at its spaces, and each chunk with the space before it has its own ids, wherever it stands. Texts with such
    white space, or with added tokens, are cut into words by the pattern. ``learn`` gives the ids of new words.
    """

    def __init__(self, cutter: ByteBpe, learn, at_once: int = 400, most: int | None = None):
        self.at_once, self.most = at_once, CHUNKS if most is None else most
        self.pieces, self.plain, self.added, self.learn = cutter.pieces, cutter.words, tuple(cutter.added), learn
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def know(self, words: set[str]) -> None:
        if new := list(words.difference(self.words)):
            if len(self.words) > REMEMBERED:
                self.words = dict(islice(self.words.items(), REMEMBERED // 2))
                new = list(words.difference(self.words))
            self.words.update(zip(new, self.learn(new), strict=True))

    def rows(self, texts: list[str]) -> list[bytes]:
        return [r for lo in range(0, len(texts), self.at_once) for r in self._rows(texts[lo : lo + self.at_once])]

    def _rows(self, texts: list[str]) -> list[bytes]:
        cut = [None if _RUN.search(t) or any(a in t for a in self.added) else t.split(" ") for t in texts]
        if len(self.chunks) > self.most:
            self.chunks = dict(islice(self.chunks.items(), self.most // 2))
        chunks, plain = self.chunks, self.plain
        # most new chunks are letters, or letters and a mark: there the pattern need not be asked
        letters, marked, others = [], [], {}
        for x in set().union(*(c[1:] for c in cut if c)).difference(chunks):
            if x.isalpha() and (x.isascii() or x == plain(x)[0]):
                letters.append(x)
            elif x[-1:] in _MARKS and x[:-1].isalpha():
                marked.append(x)
            else:
                others[x] = plain(" " + x)
        letters += {x[:-1] for x in marked}.difference(chunks, letters)
        chunks.update(zip(letters, self.learn([" " + x for x in letters]), strict=True))
        firsts = [plain(c[0]) if c else self.pieces(t) for c, t in zip(cut, texts, strict=True)]
        self.know({*_MARKS, *(w for ws in (*others.values(), *firsts) for w in ws)})
        word, chunk = self.words.__getitem__, chunks.__getitem__
        for x in marked:
            chunks[x] = chunk(x[:-1]) + word(x[-1])
        for x, ws in others.items():
            chunks[x] = b"".join(map(word, ws))
        return [b"".join([*map(word, ws), *map(chunk, c[1:])]) if c else b"".join(map(word, ws)) for c, ws in zip(cut, firsts, strict=True)]


class ByteBpe:
    """A byte-level vocabulary with its merges and added tokens, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab: dict[str, int] = file["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for token, k in vocab.items():
            self.bytes[k] = bytes(byte_of[c] for c in token)
        for token, k in self.added.items():
            self.bytes[k] = token.encode()
        self.first = [vocab[c] for c in chars]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs], size)
        self.words = words_of(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.remembered = Remembered(self, self.learn)
        self.decimal = [str(k).encode() for k in range(size)]

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens in order."""
        if self.special is None or not any(t in text for t in self.added):
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words(text[at:])

    def learn(self, words: list[str]) -> list[bytes]:
        """The token ids of words."""
        first = self.first
        found: dict[str, bytes] = {token: k.to_bytes(4, "little") for token, k in self.added.items()}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            if word not in found:
                data = word.encode("utf-8", "surrogatepass")
                if len(data) > SIDE_BY_SIDE:
                    found[word] = np.array(self.merges.merge_one([first[b] for b in data]), dtype="<u4").tobytes()
                else:
                    by_size.setdefault((len(data) - 1).bit_length(), []).append((word, data))
        for same in by_size.values():
            for lo in range(0, len(same), 20_000):
                part = same[lo : lo + 20_000]
                for (word, _), ids in zip(part, self.merges.merge_many([[first[b] for b in data] for _, data in part]), strict=True):
                    found[word] = ids
        return [found[w] for w in words]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as unsigned 32-bit integers."""
        return [np.frombuffer(r, dtype="<u4") for r in self.remembered.rows(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


common.forgetting[__name__] = vocabulary.cache_clear


#: What ``tokenize`` can return for each text.
OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"ids": "array<int>", "n_tokens": "long"}


def outputs_of(bpe: ByteBpe, texts: list[str], outputs: tuple[str, ...]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in outputs}
    decoding = {"decoded", "decoded_sha256"} & set(outputs)
    for ids in bpe.encode_many(texts):
        listed = ids.tolist()
        decoded = bpe.decode(listed) if decoding else ""
        for k in outputs:
            if k == "ids":
                out[k].append(listed)
            elif k == "n_tokens":
                out[k].append(len(listed))
            elif k == "ids_sha256":
                out[k].append(hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, listed))).hexdigest())
            else:
                out[k].append(decoded if k == "decoded" else hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
    return out


def tokenize(docs: DataFrame, outputs: tuple[str, ...] = ("ids", "n_tokens"), path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, *outputs) for each row: encodes the text and, for the ``decoded`` outputs, decodes its ids again."""
    path = path or default_vocabulary()

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            found = outputs_of(bpe, b.column("text").to_pylist(), outputs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[k], OUTPUTS[k]) for k in outputs)], names=["doc_id", *outputs])

    return common.in_batches(common.texts(docs, id_col, text_col), run, ", ".join(["doc_id long", *(f"{k} {_SQL.get(k, 'string')}" for k in outputs)]))


def detokenize(ids: DataFrame, path: str | None = None, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) from token ids; null ids give the empty text."""
    path = path or default_vocabulary()

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return common.in_batches(ids.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids"), run, "doc_id long, text string")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(common.documents(spark, sf_dir), ("n_tokens", "ids_sha256", "decoded_sha256"))
