"""Files as documents: admission, reading, and providers that need libraries of their own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import text_advance

RUNS = "page int, item_seq int, str string, has_eol boolean, transform array<double>, width double, height double, page_width double, page_height double"
WORDS = "page int, item_seq int, text string, x0 double, y0 double, x1 double, y1 double, img_width int, img_height int"


def _named_pdf(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def accepted_by_server(name: Column, mime: Column) -> Column:
    """A file without a type passes, whatever its name."""
    return (mime == "") | (mime == "application/pdf") | _named_pdf(name)


def accepted_by_client(name: Column, mime: Column) -> Column:
    """A file without a type needs the suffix."""
    return (mime == "application/pdf") | _named_pdf(name)


def first_of_drops(files: DataFrame) -> DataFrame:
    """The file that is taken of each drop of files (drop_id, seq, name, mime and any more columns): the first one, and
    that only if the client accepts it."""
    rest = [c for c in files.columns if c not in ("drop_id", "seq")]
    first = files.groupBy("drop_id").agg(F.min_by(F.struct("seq", *rest), "seq").alias("f")).select("drop_id", "f.*")
    return first.where(accepted_by_client(F.col("name"), F.col("mime"))).select(*files.columns)


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, name, content) of the files under a path; doc_id is a hash of the file's place."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


_made: dict[str, Any] = {}


def once_a_worker(make: Callable[[], Any]) -> Callable[[], Any]:
    """A function that gives what ``make`` made when it was first called in this worker process."""
    token = uuid.uuid4().hex

    def get() -> Any:
        if token not in _made:
            _made[token] = make()
        return _made[token]

    return get


def provided(rows: DataFrame, schema: str, provider: Callable[..., pd.DataFrame], concurrency: int | None = None, setup: Callable[[], Any] | None = None) -> DataFrame:
    """Rows made by a provider (a PDF, OCR or model library) from batches of ``rows``.

    The provider is called in each worker with a pandas frame and, if
    ``setup`` is given, with what that made, once a worker: an OCR engine, an
    open client. A costly or rate-limited provider gets ``concurrency`` tasks
    at most.
    """
    tool = once_a_worker(setup) if setup else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield provider(batch, tool()) if tool else provider(batch)

    source = rows if concurrency is None else rows.repartition(concurrency)
    return source.mapInPandas(run, schema)


def ocr_words(images: DataFrame, read: Callable[[Any, bytes], list[tuple]], setup: Callable[[], Any], concurrency: int | None = None) -> DataFrame:
    """Words of page images (doc_id, page, image) for ``layout.ocr_items``.

    ``read(engine, image)`` gives the words (text, x0, y0, x1, y1) in order and
    the image's (width, height); ``setup`` makes the engine, once a worker. An
    image without words gives no rows.
    """

    def words(batch: pd.DataFrame, engine: Any) -> pd.DataFrame:
        rows = []
        for doc_id, page, image in zip(batch.doc_id, batch.page, batch.image, strict=True):
            found, (width, height) = read(engine, bytes(image))
            rows += [(doc_id, page, n, text, *map(float, box), width, height) for n, (text, *box) in enumerate(found)]
        return pd.DataFrame(rows, columns=["doc_id", *(c.split()[0] for c in WORDS.split(", "))])

    return provided(images.select("doc_id", "page", "image"), f"doc_id long, {WORDS}", words, concurrency, setup)


def pdf_runs(files: DataFrame) -> DataFrame:
    """Glyph runs of PDF files (doc_id, content), by pypdf where it is installed."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf; pass runs from another reader to native_items") from e
    return provided(files.select("doc_id", "content"), f"doc_id long, {RUNS}", _pypdf_runs)


def _pypdf_runs(batch: pd.DataFrame) -> pd.DataFrame:
    """Runs in the order of each page's content. The library reports no widths: they are those of a public font."""
    import io

    import pypdf

    rows = []
    for doc_id, content in zip(batch.doc_id, batch.content, strict=True):
        for n, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages):
            size = (float(page.mediabox.width), float(page.mediabox.height))
            of_page: list[tuple] = []

            def visit(text, _cm, tm, _font, font_size, of_page=of_page, size=size, doc_id=doc_id, n=n):
                if text:
                    shown = text.rstrip("\n")
                    of_page.append((doc_id, n, len(of_page), shown, text.endswith("\n"), [float(v) for v in tm], text_advance(shown) * float(font_size) / 1000, float(font_size), *size))

            page.extract_text(visitor_text=visit)
            rows += of_page
    return pd.DataFrame(rows, columns=["doc_id", *(c.split()[0] for c in RUNS.split(", "))])
