"""Media columns: documents as interleaved sequences of text and media references.

``interleave`` parses HTML into an ordered list of items: a text block, or a media reference with its
caption. A caption goes to all references of its figure, before it and after it. The alternatives of one
medium (``source`` elements in a ``picture``, ``video`` or ``audio``) are one reference: an address of the element itself
or of the picture's ``img`` comes before those of its sources, of which the first counts. ``poster`` and ``object`` are
no references. References name their payload by digest (``media:<sha256 of the payload>``) or hold it
(``data:`` addresses, which ``embedded`` collects); others keep their address alone. ``store`` keeps
payloads losslessly as PNG images of 8-bit grey samples, 64 to a row, one per digest; ``resolve``
joins references with stored media on the digest, so that each reference keeps its position and
caption. ``read_back`` decodes stored media and computes features.

Shuffles: stored media once by digest, with copies dropped before the exchange as far as a task sees
them, and references (digests, not bytes) once. A digest that a third of all references share is hot
only on the side of the references, which adaptive execution can split; the other side is unique.

Defined results: a null text is an empty one; an empty text has a payload of 64 zero bytes. Null HTML
has no items. A reference without a stored payload keeps null media. Repeated rows get equal
results, and so do rows with one page id, or none, each by its own items. Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = 64
PNG_MARK = b"\x89PNG\r\n\x1a\n"
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset(("script", "style", "template", "noscript", "title"))
#: Elements that a head can have.
HEAD = frozenset("head title meta link base style script noscript template".split())
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
#: Elements whose sources are alternatives.
CHOICES = frozenset(("picture", "video", "audio"))
ITEM = "struct<position: int, kind: string, text: string, src: string, digest: string, caption: string, bytes: long>"


def _data(src: str) -> bytes | None:
    """What a ``data:`` address holds, or null if it cannot be read."""
    head, _, body = src[5:].partition(",")
    try:
        raw = unquote_to_bytes(body)
        return base64.b64decode(raw, validate=True) if head.lower().endswith(";base64") else raw
    except (ValueError, binascii.Error):
        return None


def _source(found: dict[str, str | None]) -> str:
    """The address of a medium: ``src``, or the last of ``srcset``, which names the largest by custom."""
    if found.get("src"):
        return found["src"] or ""
    choices = [x.split()[0] for x in re.split(r",\s+", (found.get("srcset") or "").strip().rstrip(",")) if x.split()]
    return choices[-1] if choices else ""


class _Sequencer(HTMLParser):
    """Collects items in order; the caption of a figure goes to its references, but not to those of figures in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict[str, str | int | None]] = []
        self.text: list[str] = []
        self.hidden = 0
        self.head = False
        self.figures: list[tuple[list[int], list[str]]] = []  # of each open figure, the items that are its own, and its caption
        self.choices: list[list[dict[str, str | None]] | None] = []  # of each open medium, its sources so far; null if it has its reference
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None, "bytes": None})

    def _reference(self, found: dict[str, str | None]) -> None:
        src = _source(found)
        if not src or self.hidden:
            return
        self._flush()
        digest, size = None, found.get("data-bytes") or ""
        if src.startswith("media:"):
            digest = src[6:].lower()
        elif src[:5].lower() == "data:" and (raw := _data(src)) is not None:
            digest, size = hashlib.sha256(padded(raw)).hexdigest(), str(len(raw))
        caption = found.get("alt") or None
        if self.figures:
            own, captions = self.figures[-1]
            own.append(len(self.items))
            caption = captions[-1] if captions else caption
        count = int(size) if size.isascii() and size.isdecimal() and len(size) < 19 else None
        self.items.append({"kind": "media", "text": None, "src": src, "digest": digest, "caption": caption, "bytes": count})

    def _medium(self, tag: str, found: dict[str, str | None]) -> None:
        """A medium, or one of the sources among which an open one chooses."""
        if tag in CHOICES:
            self.choices.append(None if _source(found) else [])
        elif tag == "source" and self.choices:
            if self.choices[-1] is not None and _source(found) and not self.hidden:
                self.choices[-1].append(found)
            return
        elif tag == "img" and self.choices and _source(found):
            self.choices[-1] = None
        self._reference(found)

    def _chosen(self) -> None:
        """The end of a medium: without an address of its own it is its first source."""
        sources = self.choices.pop()
        if sources:
            self._reference(sources[0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "head":
            self.head = True
        elif tag not in HEAD:
            self.head = False  # whose end tag may be left out
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag in MEDIA or tag in CHOICES:
            self._medium(tag, dict(attrs))
        elif tag in BLOCKS:
            self._flush()
            if tag == "figure":
                self.figures.append(([], []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figures and text:
                own, captions = self.figures[-1]
                captions.append(text)
                for at in own:
                    self.items[at]["caption"] = text
        elif tag in CHOICES and self.choices:
            self._chosen()
        elif tag in BLOCKS:
            self._flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden and not (self.head and not data.strip()):
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict[str, str | int | None]]:
    """The items of a page, in order."""
    parser = _Sequencer()
    parser.feed(html or "")
    parser.close()
    while parser.choices:
        parser._chosen()
    parser._flush()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, items): the ordered items of each page."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "src", "digest", "caption")), ("bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                items = pa.array([parse(x.as_py()) for x in part.column("html")], kind)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), items], names=["page_id", "items"])

    return slim.mapInArrow(run, f"page_id {slim.schema['page_id'].dataType.simpleString()}, items array<{ITEM}>")


def padded(raw: bytes) -> bytes:
    """Bytes with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def to_png(payload: bytes) -> bytes:
    """A grey image of one sample per byte; the payload is a positive multiple of 64 bytes."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    header = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG_MARK + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that ``to_png`` wrote, as rows; every chunk's checksum is verified."""
    if data[:8] != PNG_MARK:
        raise ValueError("not a PNG image")
    at, body, shape = 8, b"", (0, 0)
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", part)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey images without interlacing")
            shape = (height, width)
        elif kind == b"IDAT":
            body += part
        at += size + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Average hash of 8 x 8 areas (16 hexadecimal digits), mean in hundredths, entropy in hundredths of a bit."""
    height = samples.shape[0]
    tops = np.arange(8) * height // 8
    ends = np.maximum((np.arange(8) + 1) * height // 8, tops + 1)
    cells = np.array([samples[a:b].reshape(b - a, 8, -1).mean(axis=(0, 2)) for a, b in zip(tops, ends, strict=True)])
    bits = (cells > cells.mean()).ravel()
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    return f"{int(np.packbits(bits).tobytes().hex(), 16):016x}:{round(100 * samples.mean())}:{round(100 * entropy)}"


def payload(text: Column) -> Column:
    """UTF-8 bytes of the text, with zero bytes up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    pad = F.when(F.octet_length(raw) == 0, ROW).otherwise((ROW - F.octet_length(raw) % ROW) % ROW)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def store(payloads: DataFrame) -> DataFrame:
    """(digest, media) of each distinct digest, from (digest, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                media = pa.array([to_png(x.as_py()) for x in part.column("payload")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("digest"), media], names=["digest", "media"])

    return payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def read_back(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for digest, data in zip(part.column("digest"), part.column("media"), strict=True):
                    stored = data.as_py()
                    samples = from_png(stored)
                    raw = samples.tobytes()
                    rows.append((digest.as_py(), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def embedded(sequences: DataFrame) -> DataFrame:
    """(digest, payload) of the ``data:`` addresses in the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d.as_py(), _data(s.as_py())) for d, s in zip(batch.column("digest"), batch.column("src"), strict=True)]
            kept = [(d, padded(raw)) for d, raw in found if raw is not None]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in kept], pa.string()), pa.array([p for _, p in kept], pa.binary())], names=["digest", "payload"])

    inline = F.filter("items", lambda x: x["digest"].isNotNull() & x["src"].ilike("data:%"))
    return sequences.select(F.explode(inline).alias("x")).select("x.digest", "x.src").mapInArrow(run, "digest string, payload binary")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row per media reference: page_id, n_items, position, src, digest, caption, bytes and the columns of ``media``.

    References without a digest take no part in the join, so that they do not meet in one task. Other
    columns of ``sequences`` are carried through.
    """
    items = F.filter("items", lambda x: (x["kind"] == "media") & x["digest"].isNotNull())
    carried = [c for c in sequences.columns if c != "items"]
    found = sequences.select(*carried, F.size("items").alias("n_items"), F.explode(items).alias("item"))
    return found.select(*carried, "n_items", "item.position", "item.src", "item.digest", "item.caption", "item.bytes").join(media, "digest", "left")


def align(sequences: DataFrame, resolved: DataFrame) -> DataFrame:
    """(page_id, items) with what was resolved in each reference's ``media``, in the items' order.

    A page's references are gathered, which its number of items bounds. Rows of one page id, null ones
    too, are told apart by their items; repeated rows get equal results.
    """
    columns = [c for c in resolved.columns if c not in sequences.columns and c not in ("n_items", "position", "src", "digest", "caption", "bytes")]
    flat = sequences.select("*", F.xxhash64(F.to_json("items")).alias("_same"))
    held = resolved.select("page_id", "position", "digest", F.struct(*columns).alias("_media")).distinct()
    asked = flat.select("page_id", "_same", "items").distinct().select("page_id", "_same", F.explode("items").alias("x"))
    asked = asked.select(F.struct("page_id").alias("_key"), "_same", F.col("x.position").alias("position"), F.col("x.digest").alias("digest"))
    held = held.select(F.struct("page_id").alias("_key"), "position", "digest", "_media").dropDuplicates(["_key", "position", "digest"])
    found = asked.join(held, ["_key", "position", "digest"])
    maps = found.groupBy("_key", "_same").agg(F.map_from_entries(F.collect_list(F.struct("position", "_media"))).alias("_held"))
    joined = flat.withColumn("_key", F.struct("page_id")).join(maps, ["_key", "_same"], "left")
    return joined.select("page_id", F.transform("items", lambda x: x.withField("media", F.try_element_at(F.col("_held"), x["position"]))).alias("items"))


def documents_as_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, payloads): each text as a page of its lines, and as the payload of a figure between its first line and the rest."""
    body = payload(F.col("text"))
    digest = F.sha2(body, 256)
    n_bytes = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("string")
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="media:'), digest, F.lit('" data-bytes="'), n_bytes, F.lit('"></figure>'))
    split = F.instr(paragraphs, "</p>") + 3
    html = F.concat(F.lit("<article>"), F.substr(paragraphs, F.lit(1), split), figure, F.substr(paragraphs, split + 1), F.lit("</article>"))
    return docs.select(F.col("doc_id").alias("page_id"), html.alias("html")), docs.select(digest.alias("digest"), body.alias("payload"))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the media of each document hold after they were stored and read back.

    ``n_items``, ``position`` and ``items_sha256`` (of the text items, each with a line feed) come from the
    document's sequence; its texts are digested before the join and never shuffled.
    """
    pages, payloads = documents_as_media(docs)
    texts = F.array_join(F.transform("items", lambda x: F.when(x["kind"] == "text", F.concat(x["text"], F.lit("\n"))).otherwise("")), "")
    sequences = interleave(pages).withColumn("items_sha256", F.sha2(texts, 256))
    rows = resolve(sequences, read_back(store(payloads)))
    return rows.select(
        F.col("page_id").alias("doc_id"),
        F.col("bytes").alias("n_bytes"),
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "n_items",
        "position",
        "items_sha256",
    )
