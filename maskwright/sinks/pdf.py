"""Redacted PDF files: pages with zones become images with the zones painted over, other pages pass through.

Reading, rendering and copying pages need a PDF library, which a provider
brings; painting, and files made of page images alone, need none.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import REDACTION_SCALE
from ..operators.redact import output_name
from ..sources.files import once_a_worker

#: A page image and its size in points.
PageImage = tuple[np.ndarray, float, float]


class PdfLibrary(Protocol):
    """What a provider does with one file's bytes."""

    def sizes(self, content: bytes) -> list[tuple[float, float]]:
        """Width and height of each page in points."""

    def render(self, content: bytes, page: int, scale: float) -> np.ndarray:
        """A page's raster at ``scale`` pixels a point: height x width x 3 bytes."""

    def replace(self, content: bytes, images: dict[int, PageImage]) -> bytes:
        """The file with some pages replaced by images of the same size; nothing of a replaced page stays."""


def raster_size(width: float, height: float, scale: float = REDACTION_SCALE) -> tuple[int, int]:
    """Pixels of a page's raster."""
    return math.ceil(width * scale), math.ceil(height * scale)


def paint(raster: np.ndarray, boxes: list[dict]) -> np.ndarray:
    """A copy of a raster with each box (fractions of the page, origin at the top left) in black.

    Every pixel that a box touches is painted, and boxes are cut at the page's edges.
    """
    out = raster.copy()
    height, width = out.shape[:2]
    for b in boxes:
        x0, y0 = math.floor(b["x"] * width), math.floor(b["y"] * height)
        x1, y1 = math.ceil((b["x"] + b["width"]) * width), math.ceil((b["y"] + b["height"]) * height)
        out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = 0
    return out


def image_pdf(pages: list[PageImage]) -> bytes:
    """A PDF file whose pages are images that fill them; it holds no text."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: str, data: bytes) -> bytes:
        packed = zlib.compress(data)
        return f"<< {head} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream"

    catalog, tree = add(b"<< /Type /Catalog /Pages 2 0 R >>"), add(b"")
    kids = []
    for raster, width, height in pages:
        h, w = raster.shape[:2]
        image = add(stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8", np.ascontiguousarray(raster[:, :, :3], np.uint8).tobytes()))
        content = add(stream("", f"q {width:g} 0 0 {height:g} 0 0 cm /Im0 Do Q".encode()))
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {width:g} {height:g}] /Resources << /XObject << /Im0 {image} 0 R >> >> /Contents {content} 0 R >>".encode()))
    objects[tree - 1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root {catalog} 0 R >>\nstartxref\n{table}\n%%EOF\n".encode()
    return bytes(out)


def redact_file(library: PdfLibrary, content: bytes, zones: dict[int, list[dict]], scale: float = REDACTION_SCALE) -> bytes:
    """One file with the zones of its pages painted; a file without zones is returned as it is, zones of pages that it does
    not have are ignored."""
    sizes = library.sizes(content)
    images = {n: (paint(library.render(content, n, scale), zones[n]), *sizes[n]) for n in range(len(sizes)) if zones.get(n)}
    if not images:
        return content
    if len(images) == len(sizes):
        return image_pdf([images[n] for n in range(len(sizes))])
    return library.replace(content, images)


def redacted_files(files: DataFrame, zones_by_page: DataFrame, library: Callable[[], PdfLibrary]) -> DataFrame:
    """Rows (doc_id, name, content) of ``files`` (doc_id, name, content), redacted and renamed.

    ``zones_by_page``: doc_id, page, zones (see ``review.zones_by_page``). Only
    the zones are gathered by document; a file's bytes go through one join.
    ``library`` makes the provider, once a worker. A file that cannot be read
    fails the job: it must not pass unredacted.
    """
    listed = zones_by_page.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), F.col("zones"))))).alias("zones"))
    rows = files.join(listed, "doc_id", "left").select("doc_id", output_name(F.col("name")).alias("name"), "content", "zones")
    make = once_a_worker(library)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for content, zones in zip(batch.content, batch.zones, strict=True):
                by_page = {int(k): v for k, v in json.loads(zones).items()} if zones else {}
                done.append(redact_file(make(), bytes(content), by_page))
            yield batch[["doc_id", "name"]].assign(content=done)

    return rows.mapInPandas(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, name string, content binary")
