"""Web pages as bytes: declared charset, a cap on bytes, and one of three forms of the contents.

``scan`` reads pages (url, content, content_type, status) into (url, title, kind, text, n_bytes, truncated, reason), in
Arrow batches without a shuffle. A page over ``max_bytes`` is cut there, and the character that the cut would split is
left out. A charset that is unknown is read as UTF-8; bytes that are no text become replacement characters.
``reason`` says why a page should be asked of another provider: its text is then null, or, if only scripts
would fill the page, what there is.

Defined results: null content is that of an empty page; a null content type has the kind ``unknown`` and is read as
UTF-8 text; a null status counts as 200. Other columns are ignored.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import html
from skein.functions import text as tx

FORMS = ("markdown", "text", "html")
#: The cap, states that mean a refusal, and how little text of how large a page means scripts.
MAX_BYTES = 2 * 1024 * 1024
REFUSED = (401, 403, 429, 503)
LITTLE_TEXT, LARGE_PAGE = 200, 5000
SCHEMA = "title string, text string, n_bytes long, truncated boolean, reason string"
FIELDS = {"title": pa.string(), "text": pa.string(), "n_bytes": pa.int64(), "truncated": pa.bool_(), "reason": pa.string()}
#: Pages that a task reads at once, however many come in a batch.
PAGES = 64
PAGE_KINDS = ("text/html", "application/xhtml+xml")


def decode(content: bytes, charset: str, max_bytes: int = MAX_BYTES) -> tuple[str, bool]:
    """(text, truncated): the whole characters of the first ``max_bytes`` bytes."""
    cut = len(content) > max_bytes
    try:
        b"x".decode(charset, "replace")  # raises for codecs that give no text
        reader = codecs.getincrementaldecoder(charset)("replace")
        return reader.decode(content[:max_bytes], final=not cut), cut
    except (LookupError, ValueError):
        return codecs.getincrementaldecoder("utf-8")("replace").decode(content[:max_bytes], final=not cut), cut


def _page(url: str | None, content: bytes | None, kind: str, charset: str, status: float, form: str, max_bytes: int) -> tuple[str, str | None, int, bool, str | None]:
    raw = bytes(content) if content is not None else b""
    cut = len(raw) > max_bytes
    if status in REFUSED:
        return "", None, len(raw), cut, f"refused with HTTP {int(status)}"
    if kind == "application/pdf":
        return "", None, len(raw), cut, "the page is a PDF"
    if kind != "unknown" and not kind.startswith("text/") and not kind.endswith(("json", "xml", "javascript")):
        return "", f"({kind}, {len(raw)} bytes - not text, not shown)", len(raw), cut, None
    body, cut = decode(raw, charset, max_bytes)
    title, text = "", body
    if kind in PAGE_KINDS and form != "html":
        title, text = html.to_markdown(body, url or "")
        text = html.to_text(body) if form == "text" else text
    scripts = kind == "text/html" and len(text) < LITTLE_TEXT and len(body) > LARGE_PAGE
    return title, text, len(raw), cut, "the page needs scripts" if scripts else None


def scan(pages: DataFrame, form: str = "markdown", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(url, kind, title, text, n_bytes, truncated, reason) of pages (url, content, content_type, status)."""
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}")
    name = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    kind = F.when(name == "", "unknown").otherwise(name)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch[0]), PAGES):
                rows = [_page(*row, form, max_bytes) for row in zip(*(x.slice(start, PAGES).to_pylist() for x in batch), strict=True)]
                yield pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), FIELDS.values(), strict=True)], names=list(FIELDS))

    page = F.arrow_udf(run, SCHEMA)(F.col("url"), F.col("content"), kind, tx.charset(F.col("content_type")), F.coalesce("status", F.lit(200)))
    return pages.select("url", kind.alias("kind"), page.alias("page")).select("url", "kind", "page.*")


def provider(form: str = "markdown", max_bytes: int = MAX_BYTES) -> Callable[[DataFrame], DataFrame]:
    """The scan as the first of several providers: requests are keyed by ``key``, and have the columns of pages.

    An answer is a struct (title, kind, text).
    """

    def rows(requests: DataFrame) -> DataFrame:
        # The key takes the place of the address in the scan, which joins nothing; links are resolved against it.
        found = scan(requests.withColumn("url", F.col("key")), form, max_bytes)
        answer = F.when(F.col("text").isNotNull(), F.struct("title", "kind", "text"))
        return found.select(F.col("url").alias("key"), answer.alias("answer"), "reason")

    return rows
