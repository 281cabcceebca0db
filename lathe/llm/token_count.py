"""Exact token counts at every prefix, by dynamic programming over words.

In BPE a sequence of tokens is the encoding of its characters if and only if each adjacent pair of them is. So the
last token of a prefix's encoding is the one that ends there and goes with the last token of the prefix before it;
one pass gives, for each prefix of a word, that token and how many there are. Here a word's last symbol carries a word
end: of each prefix both forms are kept, going on and ended. A text is its words, whose counts are summed; so the
table answers for any prefix of the text how many tokens it has, and for any budget where to cut, without encoding
anything again.

Prefixes are of the normalised text (NFC, white space as spaces, lower case), in its code points. Words end where the
library's pattern ends them; the few words that a cut changes (contractions, special strings) enter the table as cut.

A table is kept as its steps, a byte for each code point and deflated (one prefix has at most as many tokens more or fewer
than the one before as the longest token has bytes): ``prefix_tables`` stores one for each text, and ``answered`` reads counts,
and cuts for budgets, from them alone.

Defined cases: a null or empty text has 0 tokens and 0 bytes; texts of any length are counted whole; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lathe.llm import common
from lathe.llm.bpe import byte_characters, words_of

#: Words, and pairs of tokens, kept in each worker; beyond that the later half, mostly rare ones, is forgotten.
REMEMBERED = 600_000
#: Characters of a prefix that is remembered for other words.
SHARED = 8
#: The published pattern of this family of lower-case vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Capitals that Python's tables don't lower yet, and the library does: by Unicode 16.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
_NEW_CAPITALS = regex.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]").search


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """A vocabulary whose tokens may carry a word end, for counting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab: dict[str, int] = file["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.added = [t["content"] for t in file["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.rank: dict[tuple[str, str], int] = {}
        for r, p in enumerate(pairs):
            self.rank.setdefault(p, r)
        chars = byte_characters()
        self.chars = chars
        #: Tokens that are encodings of themselves, by what they read: only these end a prefix.
        self.going: set[str] = set(chars)
        self.ended: set[str] = {c + END for c in chars}
        for a, b in pairs:
            (self.ended if b.endswith(END) else self.going).add(a + b)
        missing = [c for c in (*chars, *(c + END for c in chars)) if c not in vocab]
        if missing:
            raise ValueError(f"no token for {missing[:5]}: counts would depend on unknown tokens")
        #: The longest token with these last characters (three at most), by form: fewer places to try.
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for form, tokens in enumerate((self.going, self.ended)):
            for t in tokens:
                body = t.removesuffix(END)
                self.reach[form][body[-3:]] = max(len(body), self.reach[form].get(body[-3:], 0))
        self.find = words_of(PATTERN)
        self.pieces = words_of(PATTERN + r"|\s+")
        self.space = regex.compile(r"\s+").fullmatch
        self.steps_of: dict[str, bytes] = {}
        self.states: dict[str, tuple[str, int, int]] = {}
        self.latin = bytes(range(256)).decode("latin-1")
        self.as_chars = str.maketrans(dict(zip(self.latin, chars, strict=True)))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.tables: dict[str, np.ndarray] = {}
        self.totals: dict[str, int] = {}

    def plain(self, symbols: list[str]) -> list[str]:
        """BPE as it is defined: the leftmost pair of lowest rank, again and again."""
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], token[len(body) - 1 :]]

    def together(self, a: str, b: str) -> bool:
        """Whether the encoding of what ``a`` and ``b`` read is ``a, b``."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = (a, b) not in self.rank and self.plain([*self.symbols(a), *self.symbols(b)]) == [a, b]
        return found

    def itself(self, token: str) -> bool:
        if token not in self.own:
            self.own[token] = self.plain(self.symbols(token)) == [token]
        return self.own[token]

    def _last(self, word: str, i: int, end: str, last: list[str]) -> tuple[str, int]:
        """The last token of the encoding of the first ``i`` characters, in one of its forms, and where it begins."""
        tokens, reach = (self.ended, self.reach[1]) if end else (self.going, self.reach[0])
        known = self.pairs.get
        longest = reach.get(word[i - 3 if i > 3 else 0 : i], 2)
        for j in range(i - longest if i > longest else 0, i):
            token = word[j:i] + end
            if token in tokens:
                if j:
                    good = known((last[j], token))
                    if good is None:
                        good = self.together(last[j], token)
                else:
                    good = self.itself(token)
                if good:
                    return token, j
        raise AssertionError(f"no last token at {i} of {word!r}")

    def steps(self, word: str, every: bool) -> tuple[list[int], list[int]]:
        """Tokens of each prefix of ``word`` (characters that stand for bytes), going on and, if ``every``, ended; else only the whole ended.

        With ``every``, what is found for short prefixes is remembered: very many words share them.
        """
        n = len(word)
        last, count = [""] * (n + 1), [0] * (n + 1)
        closed = [0] * (n + 1)
        for i in range(1, n + 1):
            known = self.states.get(word[:i]) if every and i <= SHARED else None
            if known:
                last[i], count[i], closed[i] = known
                continue
            if every or i < n:
                last[i], j = self._last(word, i, "", last)
                count[i] = count[j] + 1
            if every or i == n:
                closed[i] = count[self._last(word, i, END, last)[1]] + 1
            if every and i <= SHARED:
                if len(self.states) > REMEMBERED // 2:
                    self.states.clear()
                self.states[word[:i]] = last[i], count[i], closed[i]
        return count, closed

    def total(self, word: str) -> int:
        found = self.totals.get(word)
        if found is None:
            if len(self.totals) > REMEMBERED:
                self.totals = dict(islice(self.totals.items(), REMEMBERED // 2))
            data = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.as_chars)
            found = self.totals[word] = self.steps(data, every=False)[1][-1]
        return found

    def table(self, word: str) -> np.ndarray:
        """Tokens of each prefix of a word, as if the text ended there; by code points, from 0."""
        found = self.tables.get(word)
        if found is None:
            if len(self.tables) > REMEMBERED // 10:
                self.tables.clear()
            if len(word) > 1 and word[0] == "'" and word[1].isalpha():  # cut, a contraction is a quote and letters
                found = [0, *(self.total("'") + (self.total(word[1:k]) if k > 1 else 0) for k in range(1, len(word))), self.total(word)]
            else:
                sizes = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in word)])
                data = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.as_chars)
                found = np.array(self.steps(data, every=True)[1])[sizes]
            found = self.tables[word] = np.asarray(found, dtype=np.int32)
        return found

    @staticmethod
    def normal(text: str) -> str:
        """As the library normalises: characters are lowered one by one, so a capital sigma is never a final one."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _NEW_CAPITALS(text):
                text = text.translate(NEW_CAPITALS)
        return text.lower()

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Normalised stretches between special strings, and these."""
        if not any(t in text for t in self.added):
            return [(self.normal(text), False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(self.normal(text[at : m.start()]), False), (m[0], True)]
            at = m.end()
        return [*out, (self.normal(text[at:]), False)]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table, from the words' totals alone."""
        n = 0
        known, total = self.totals.get, self.total
        for part, special in self.parts(text):
            if special:
                n += 1
            else:
                for w in self.find(part):
                    n += known(w) or total(w)
        return n

    def word_steps(self, piece: str) -> bytes:
        """How the count changes at each code point of a word, or of white space."""
        found = self.steps_of.get(piece)
        if found is None:
            if len(self.steps_of) > REMEMBERED:
                self.steps_of = dict(islice(self.steps_of.items(), REMEMBERED // 2))
            if self.space(piece):
                found = bytes(len(piece))
            elif piece.isascii() and piece[0] != "'":
                # a character is a byte: the table's differences as they come
                counts = self.steps(piece.translate(self.as_chars), every=True)[1]
                found = bytes([b - a & 255 for a, b in zip(counts, counts[1:], strict=False)])
            else:
                found = np.diff(self.table(piece)).astype(np.int8).tobytes()
            self.steps_of[piece] = found
        return found

    def prefix_steps(self, text: str) -> bytes:
        """The table of a text as its steps, a signed byte for each code point of the normalised text."""
        parts = self.parts(text)
        if len(parts) > 1:
            return np.diff(self._with_specials(parts)).astype(np.int8).tobytes()
        known, own = self.steps_of.get, self.word_steps
        return b"".join([known(w) or own(w) for w in self.pieces(parts[0][0])])

    def prefixes(self, text: str) -> np.ndarray:
        """Entry k: the tokens of the first k code points of the normalised text."""
        return counts_of(self.prefix_steps(text))

    def _with_specials(self, parts: list[tuple[str, bool]]) -> np.ndarray:
        out = [np.zeros(1, dtype=np.int64)]
        n, tail = 0, ""
        for part, special in parts:
            if special:
                # a cut special string is plain text, and goes with the word that it touches
                before = n - (self.total(tail) if tail else 0)
                row = np.array([before + self.count(tail + part[:k]) for k in range(1, len(part))] + [n + 1], dtype=np.int64)
                tail = ""
            else:
                row, last = n + counts_of(b"".join(map(self.word_steps, self.pieces(part))))[1:], self.pieces(part)[-1:]
                tail = last[0] if last and not self.space(last[0]) else ""
            if len(row):
                out.append(row)
                n = int(row[-1])
        return np.concatenate(out)

    def cut(self, text: str, budget: int) -> int:
        return cut_of(self.prefixes(text), budget)


def counts_of(steps: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64)])


def cut_of(counts: np.ndarray, budget: int) -> int:
    """The most code points whose tokens, and those of every shorter prefix, are within ``budget``."""
    return int(np.searchsorted(np.maximum.accumulate(counts), budget, side="right")) - 1


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


common.forgetting[__name__] = vocabulary.cache_clear


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id", prefixes: bool = False, budgets: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row; with ``prefixes`` also the table (array<int>), and for each budget the
    code points of the normalised text that fit it (``fits``, array<long> in the order given)."""
    path = path or default_vocabulary()
    schema = "doc_id long, n_bytes long, n_tokens long" + ", prefixes array<int>" * prefixes + ", fits array<long>" * bool(budgets)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            read = b.column("text").to_pylist()
            out = [pa.array([len(t.encode("utf-8", "surrogatepass")) for t in read], pa.int64()), pa.array([bpe.count(t) for t in read], pa.int64())]
            if prefixes:
                out.append(pa.array([bpe.prefixes(t).astype(np.int32) for t in read], pa.list_(pa.int32())))
            if budgets:
                out.append(pa.array([[bpe.cut(t, k) for k in budgets] for t in read], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out], names=names)

    return common.in_batches(common.texts(docs, id_col, text_col), run, schema)


def prefix_tables(docs: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A stored table (doc_id, n_bytes, steps): the prefix table of each text, its steps deflated."""
    path = path or default_vocabulary()

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            read = b.column("text").to_pylist()
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in read], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array([zlib.compress(bpe.prefix_steps(t), 1) for t in read], pa.binary())], names=["doc_id", "n_bytes", "steps"])

    return common.stored(common.in_batches(common.texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, steps binary"), "prefixes")


def answered(tables: DataFrame, budgets: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fits) from stored tables alone: ``fits`` has for each budget the code points of the normalised text within it."""

    def run(batches):
        for b in batches:
            counts = [counts_of(zlib.decompress(x.as_py())) for x in b.column("steps")]
            out = [pa.array([int(c[-1]) for c in counts], pa.int64()), pa.array([[cut_of(c, k) for k in budgets] for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *out], names=["doc_id", "n_bytes", "n_tokens", "fits"])

    return common.in_batches(tables, run, "doc_id long, n_bytes long, n_tokens long, fits array<long>")


LIMIT = 2048


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and the code points within the limit, read from each text's stored prefix table."""
    found = answered(prefix_tables(common.documents(spark, sf_dir)), (LIMIT,))
    return found.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {LIMIT} AS over_limit", "fits[0] AS chars_within_limit")
