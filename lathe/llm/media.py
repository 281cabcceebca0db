"""Interleaved sequences of text and media: HTML is parsed into ordered items, and digests resolve stored payloads.

``sequences`` turns HTML into an array of structs (position, kind, text, digest, caption) in document order: stretches of
text between block elements, and references to media whose ``src`` is ``sha256:<digest>`` (or any other reference, kept
as it is). A caption is the figure's own, or else the ``alt`` text. ``resolved`` joins references with stored media by
digest, each digest's facts stored first so that Spark can split a digest that very many pages refer to; ``assembled``
puts texts and resolved references of a page back in order, positions and captions with them. Media are stored once for
each digest that a task meets, as 8-bit grey PNG images of 64 columns, deflated, and read back through their own parser.

The query makes a page of each text: its lines as paragraphs, the whole text as a captioned image before them, its first
line as an image after the first paragraph. Pages are parsed, their references resolved, and the sequences assembled.

Defined cases: null HTML has no items; a null or empty text has the payload of 64 zero bytes; references to payloads that
aren't stored stay, with null columns; texts and payloads of any length are handled whole; repeated rows stay apart;
equal payloads share a digest and all columns that follow from it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm import common

WIDTH = 64
#: Digests a task remembers as stored; beyond that it starts afresh and may store a payload again.
REMEMBERED = 200_000
ITEM = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
ITEM_SQL = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("kind", "text", "digest", "caption"))]))

_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript", "title"))
_MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden: list[str] = []
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def close_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag in _MEDIA:
            given = dict(attrs)
            if src := given.get("src"):
                self.close_text()
                self.items.append({"kind": "media", "text": None, "digest": src.removeprefix("sha256:"), "caption": given.get("alt") or None})
        elif tag == "figcaption":
            self.close_text()
            self.caption = []
        elif tag in _BLOCKS:
            self.close_text()
            if tag == "figure":
                self.figures.append(len(self.items))

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            if self.hidden and self.hidden[-1] == tag:
                self.hidden.pop()
        elif tag == "figcaption":
            self.close_caption()
        elif tag in _BLOCKS:
            self.close_text()
            if tag == "figure" and self.figures:
                self.close_caption()
                self.figures.pop()

    def close_caption(self) -> None:
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        own = [x for x in self.items[self.figures[-1] if self.figures else len(self.items) :] if x["kind"] == "media"]
        for item in own:
            item["caption"] = text or item["caption"]
        if not own and text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def items(html: str) -> list[dict]:
    """The ordered items of a page; a caption that comes before its media counts as text."""
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.close_caption()
    parser.close_text()
    return [{"position": k, **x} for k, x in enumerate(parser.items)]


def sequences(pages: DataFrame, html_col: str = "html", out: str = "items") -> DataFrame:
    """``pages`` with ``out``, the ordered items of each page."""
    return common.passing(pages, lambda xs: [[items(x) for x in xs]], html_col, [(out, ITEM, ITEM_SQL)])


def exploded(sequenced: DataFrame, keep: list[str], col: str = "items") -> DataFrame:
    """A row for each item: ``keep`` and the item's fields."""
    return sequenced.select(*keep, F.explode(col).alias("_item")).select(*keep, "_item.*")


def resolved(rows: DataFrame, media: DataFrame) -> DataFrame:
    """Items, those with a ``digest`` joined with ``media``, which has a row for each digest and no null one. Text rows and unknown digests stay, with null columns."""
    # rows without a digest are no part of the join: they would all meet in one task
    found = rows.where("digest is not null").join(media, "digest", "left")
    return found.unionByName(rows.where("digest is null"), allowMissingColumns=True)


def assembled(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Back to a sequence for each page, in order of position: as many items as the page has."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", *[c for c in columns if c != "position"]))).alias("items"))


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of 64 columns, unfiltered rows."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; checksums are checked."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, width, data = 8, 0, []
    while at < len(png):
        if at + 12 > len(png) or at + 12 + (size := int.from_bytes(png[at : at + 4])) > len(png):
            raise ValueError("the image is cut off")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(png[at + 8 + size : at + 12 + size]):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            width, _, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if not data:
        raise ValueError("the image has no samples")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("rows are filtered")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Shares of 16 levels of brightness (in 255ths, hex), mean and deviation (hundredths), and which columns are brighter than the mean (hex)."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    levels = np.bincount(samples.ravel() >> 4, minlength=16)
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = int("".join("01"[x] for x in (columns * WIDTH > columns.sum()).astype(int)), 2)
    n, total, squares = samples.size, int(columns.sum()), int(np.square(samples, dtype=np.int64).sum())
    deviation = max(0, squares * n - total * total) ** 0.5 / n
    return f"{''.join(f'{int(v) * 255 // n:02x}' for v in levels)}:{total * 100 // n}:{int(deviation * 100)}:{bits:016x}"


MEDIA = pa.list_(pa.struct([("digest", pa.string()), ("media", pa.binary())]))


def paged(docs: DataFrame, page: Callable[[str, Callable[[str], str]], str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, html, stored): a page for each text, ``page(text, store)``; ``store`` takes a text as a payload and gives its digest.

    ``stored`` has the images of the page that the task hasn't met before.
    """
    schema = "doc_id long, n_bytes long, html string, stored array<struct<digest: string, media: binary>>"

    def run(batches):
        known: set[str] = set()
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                new: list[dict] = []

                def store(part: str, new: list[dict] = new) -> str:
                    png = to_png(payload_of(part))
                    digest = hashlib.sha256(png).hexdigest()
                    if digest not in known:
                        if len(known) > REMEMBERED:
                            known.clear()
                        known.add(digest)
                        new.append({"digest": digest, "media": png})
                    return digest

                rows.append((doc_id, len(text.encode("utf-8", "surrogatepass")), page(text, store), new))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), MEDIA), strict=True)], names=["doc_id", "n_bytes", "html", "stored"])

    return common.in_batches(common.texts(docs, id_col, text_col), run, schema)


def described(media: DataFrame, packed: bool = False) -> DataFrame:
    """What the stored bytes of each digest give, once: (digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature).

    The digest is the stored bytes' own sha256; bytes that have another are damaged, which is an error. ``packed``: digests as
    bytes, half as long to shuffle. The table is stored, so that in a join with it Spark can split a digest of very many rows.
    """
    kind, digests = ("binary", pa.binary()) if packed else ("string", pa.string())
    schema = f"digest {kind}, payload_bytes long, payload_sha256 {kind}, tail_crc32 long, media_bytes long, feature string"
    types = (digests, pa.int64(), digests, pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for b in batches:
            rows = []
            for digest, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload, own = from_png(png), hashlib.sha256(png)
                if own.hexdigest() != digest:
                    raise ValueError(f"the image of {digest} is damaged")
                found = hashlib.sha256(payload)
                rows.append((own.digest() if packed else digest, len(payload), found.digest() if packed else found.hexdigest(), zlib.crc32(payload[-64:]), len(png), feature(payload)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return common.stored(common.in_batches(media.where("media is not null").select("digest", "media"), run, schema).dropDuplicates(["digest"]), "described", compression="zstd")


WHOLE, FIRST = "the whole text", "the first line"


def text_page(text: str, store: Callable[[str], str]) -> str:
    """A text's lines as paragraphs between two images: of all of it, with a caption of the figure, and of its first line, with one of its own."""
    first, *rest = text.split("\n")
    paragraphs = "".join(f"<p>{escape(x, quote=False)}</p>" for x in rest)
    return f'<article><figure><img src="sha256:{store(text)}"><figcaption>{WHOLE}</figcaption></figure><p>{escape(first, quote=False)}</p><img src="sha256:{store(first)}" alt="{FIRST}">{paragraphs}</article>'


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of each text's own image, and its page's resolved sequence as a digest; here texts of paragraphs go by hashes, and digests as bytes."""
    parsed = sequences(paged(common.documents(spark, sf_dir), text_page))
    brief = F.transform("items", lambda x: F.struct(x["position"].alias("position"), F.xxhash64(x["text"]).alias("text"), F.unhex(x["digest"]).alias("digest"), x["caption"].alias("caption")))
    # a key of its own tells rows of one id apart; written with the rows, so it is the same wherever they are read
    table = common.stored(parsed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", brief.alias("items"), "stored"), "pages", compression="zstd")
    facts = described(table.select(F.explode("stored").alias("_one")).select("_one.*"), packed=True)
    # the id and the size go along with the first item alone
    first = F.when(F.col("position") == 0, F.struct("doc_id", "n_bytes")).alias("of")
    items_ = resolved(exploded(table, ["row", "doc_id", "n_bytes"]).select("row", first, "position", "text", "digest", "caption"), facts)
    own = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
    whole = assembled(items_, ["row"], ["of", "text", "digest", "caption", *own])
    shown = F.transform("items", lambda x: F.concat_ws("|", x["position"].cast("string"), F.coalesce(F.lower(F.hex(x["payload_sha256"])), x["text"].cast("string")), F.coalesce(x["feature"], F.lit("")), F.coalesce(x["caption"], F.lit(""))))
    image = F.get(F.filter("items", lambda x: x["caption"] == WHOLE), F.lit(0))
    sha = {"payload_sha256": F.lower(F.hex(image["payload_sha256"])), "media_sha256": F.lower(F.hex(image["digest"]))}
    of = F.get("items", F.lit(0))["of"]
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    n_media = F.size(F.filter("items", lambda x: x["digest"].isNotNull()))
    return whole.select(of["doc_id"].alias("doc_id"), of["n_bytes"].alias("n_bytes"), *(sha.get(c, image[c] if c in own else None).alias(c) for c in columns), F.size("items").alias("n_items"), n_media.alias("n_media"), F.sha2(F.array_join(shown, "\n"), 256).alias("sequence_sha256"))
