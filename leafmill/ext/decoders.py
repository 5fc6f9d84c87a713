"""Decoders of page files, as table functions; this engine begins with the glyphs they give.

A decoder maps a file's bytes to rows of sources.readers.GLYPHS but for the book.
None is bundled, as PDF libraries are not part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from leafmill.sources.readers import GLYPHS


def decoded_pages(files: DataFrame, decoder: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """The glyphs of files (job_id, content), a file at a time."""
    names = [c.strip().split(" ")[0] for c in GLYPHS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job_id, content in zip(batch["job_id"], batch["content"]):
                rows = [{"separators": [], "repeated": [], "links": "[]", "note_id": None, "note_label": None, **r, "book": job_id} for r in decoder(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows)[names]

    return files.select("job_id", "content").mapInPandas(run, GLYPHS)


def plain_text(content: bytes, columns: int = 60, rows: int = 40) -> Iterable[dict]:
    """A stand-in: text set in one size; a form feed, or a full page, begins a new one, and long lines go on in the next."""
    page = 0
    for text in content.decode().split("\f"):
        lines = [line[at : at + columns] for line in text.split("\n") for at in range(0, max(1, len(line)), columns)]
        for begin in range(0, max(1, len(lines)), rows):
            page += 1
            for r, line in enumerate(lines[begin : begin + rows]):
                for c, sign in enumerate(line):
                    x, top = 30 + 6.0 * c, 40 + 13.0 * r
                    yield {"page_no": page, "width": 420.0, "height": 595.0, "ord": r * columns + c, "text": sign, "x0": x, "x1": x + 6, "top": top, "bottom": top + 10, "size": 10.0}
