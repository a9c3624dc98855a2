"""Landed pages of chunked scans as a stream that can stop after a partial page and go on.

Pages lie as ``<folder>/<chunk>/<offset>.json``: an object with ``limit``, ``total`` and ``results`` (a list). The
stream's offset is (chunk, next offset); chunks go in the order of their names. A page is read once it
is whole, that is when it holds as many results as its limit and the total allow, and a chunk ends
with the page that reaches the total. A partial or missing page holds the stream up where it is.
A chunk must have landed in part before a later one ends: what comes before the offset is not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Pages that a task reads.
EACH = 32


def _files(folder: str):
    """(file system, path) of a local path or an address."""
    from pyarrow import fs

    if "://" not in folder:
        folder = folder.removeprefix("file:")
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


class Pages(InputPartition):
    """(chunk, offset) of the pages of one task."""

    def __init__(self, pages: list[tuple[str, int]]):
        self.pages = pages


class PageReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder
        self._known: dict[tuple[str, int], dict | None] = {}

    def _page(self, chunk: str, offset: int) -> dict | None:
        """The page if it is there and whole. Whole pages do not change, so they are looked at once; only their sizes are kept."""
        if (chunk, offset) in self._known:
            return self._known[chunk, offset]
        files, root = _files(self.folder)
        try:
            with files.open_input_stream(f"{root}/{chunk}/{offset}.json") as f:
                page = json.loads(f.read())
        except (FileNotFoundError, ValueError):
            return None
        n = max(0, min(page["limit"], page["total"] - offset))
        if page["limit"] < 1 or len(page["results"]) != n:
            return None
        self._known[chunk, offset] = sizes = {"next": offset + n, "total": page["total"]}
        return sizes

    def _chunks(self) -> list[str]:
        from pyarrow import fs

        files, root = _files(self.folder)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory)

    def _walk(self, chunk: str, offset: int) -> Iterator[tuple[str, int, int, bool]]:
        """(chunk, offset, next offset, whether the chunk ends) of the whole pages from a place on."""
        for name in self._chunks():
            if name < chunk:
                continue
            at = offset if name == chunk else 0
            while True:
                page = self._page(name, at)
                if page is None:
                    return
                ends = page["next"] >= page["total"]
                yield name, at, page["next"], ends
                at = page["next"]
                if ends:
                    break

    def initialOffset(self) -> dict:
        return {"chunk": "", "next_offset": 0, "whole": True}

    def latestOffset(self) -> dict:
        end = self.initialOffset()
        for chunk, _, at, ends in self._walk("", 0):
            end = {"chunk": chunk, "next_offset": at, "whole": ends}
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Pages behind ``start`` up to ``end``, ``EACH`` of them a task."""
        out, last = [], (end["chunk"], end["next_offset"])
        behind = start["chunk"] + "\0" if start["whole"] and start["chunk"] else start["chunk"]  # the next name after a chunk that ended
        for chunk, offset, after, _ in self._walk(behind, start["next_offset"]):
            if (chunk, after) > last:
                break
            out.append((chunk, offset))
        return [Pages(out[i : i + EACH]) for i in range(0, len(out), EACH)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        files, root = _files(self.folder)
        for chunk, offset in partition.pages:
            with files.open_input_stream(f"{root}/{chunk}/{offset}.json") as f:
                page = json.loads(f.read())
            for i, result in enumerate(page["results"]):
                yield chunk, offset + i, result if isinstance(result, str) else json.dumps(result)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the stream's own checkpoint."""


class LandedPages(DataSource):
    """``spark.readStream.format("landed_pages").load(folder)``: chunk, position, payload."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "chunk string, position long, payload string"

    def streamReader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def land_pages(pages: DataFrame, folder: str) -> None:
    """Write pages (chunk, page_offset, page_limit, total, results) where the stream finds them, each in place by a rename."""

    def write(batches):
        files, root = _files(folder)
        for batch in batches:
            for p in batch.to_pylist():
                files.create_dir(f"{root}/{p['chunk']}", recursive=True)
                place = f"{root}/{p['chunk']}/{p['page_offset']}.json"
                with files.open_output_stream(place + ".draft") as f:
                    f.write(json.dumps({"limit": p["page_limit"], "total": p["total"], "results": p["results"]}).encode())
                files.move(place + ".draft", place)
        return iter(())

    pages.select("chunk", "page_offset", "page_limit", "total", "results").mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()
