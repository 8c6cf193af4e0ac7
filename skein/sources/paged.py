"""Paged documents as a data source: spark.read.format("skein-pages").option("parser", "module:Class").load(path).

Tasks are dealt by bytes: small files lie together in one, a large file is split over several, each of which opens it and parses its
own share of the pages. The driver lists files and asks for their sizes, nothing else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib import import_module
from typing import BinaryIO, NamedTuple, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.session import ensure_importable

NAME = "skein-pages"
FILE = "path string, filename string, file_size_bytes long, num_pages int, title string, author string, creation_date string, encrypted boolean"
#: what=pages gives a row for each page, what=files one for each file, whose pages aren't parsed.
SCHEMAS = {"pages": f"{FILE}, page_num int, text string, success boolean, error string", "files": f"{FILE}, content_hash string, error string"}


class Opened(Protocol):
    """A document whose pages are parsed one by one. num_pages and details come from its trailer."""

    num_pages: int

    def details(self) -> tuple[str | None, str | None, str | None, bool]:
        """(title, author, creation date, encrypted)."""

    def page(self, number: int) -> str: ...


class Parser(Protocol):
    def open(self, file: BinaryIO) -> Opened: ...


class PypdfParser:
    """The parser of the optional package pypdf."""

    def open(self, file: BinaryIO) -> Opened:
        from pypdf import PdfReader

        class Pdf:
            def __init__(self):
                self.reader = PdfReader(file)
                self.num_pages = len(self.reader.pages)

            def details(self):
                info = self.reader.metadata or {}
                of = lambda k: (str(info[k]).strip() or None) if info.get(k) else None
                return of("/Title"), of("/Author"), of("/CreationDate"), self.reader.is_encrypted

            def page(self, number):
                return self.reader.pages[number].extract_text() or ""

        return Pdf()


class Share(NamedTuple):
    """Part number `part` of `parts` of a file's pages."""

    path: str
    size: int
    part: int
    parts: int


class Shares(InputPartition):
    def __init__(self, shares: list[Share]):
        self.shares = shares


def dealt(files: list[tuple[str, int]], most: int, whole: bool) -> list[list[Share]]:
    """Shares of about `most` bytes each: a large file is several (unless it stays whole), small ones fill one together."""
    out: list[list[Share]] = []
    together: list[Share] = []
    for path, size in files:
        parts = 1 if whole else max(1, -(-size // most))
        if parts > 1:
            out += [[Share(path, size, i, parts)] for i in range(parts)]
            continue
        if together and sum(s.size for s in together) + size > most:
            out.append(together)
            together = []
        together.append(Share(path, size, 0, 1))
    return [*out, together] if together else out


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.what = options["path"], options.get("what", "pages")
        self.most = int(options.get("partitionbytes", 16 << 20))
        self.suffix = options.get("suffix", "")
        self.parser = options.get("parser", f"{__name__}:PypdfParser")
        if self.what not in SCHEMAS:
            raise ValueError(f"what is pages or files, not {self.what}")

    def partitions(self) -> list[Shares]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(where)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [found] if found.is_file else store.get_file_info(fs.FileSelector(where, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and i.path.endswith(self.suffix))
        return [Shares(s) for s in dealt(files, self.most, self.what == "files")] or [Shares([])]

    def read(self, partition: Shares) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        module, _, name = self.parser.partition(":")
        parser = getattr(import_module(module), name)()
        for share in partition.shares:
            yield from self._rows(store, parser, share)

    def _rows(self, store, parser: Parser, share: Share) -> Iterator[tuple]:
        """A document that can't be opened is one row with its error, a page that can't be parsed likewise."""
        base = (share.path, share.path.rsplit("/", 1)[-1], share.size)
        with store.open_input_file(share.path) as file:
            digest = ()
            if self.what == "files":
                h = hashlib.sha256()
                while block := file.read(1 << 20):
                    h.update(block)
                digest = (h.hexdigest(),)
                file.seek(0)
            try:
                opened = parser.open(file)
                about = (*base, opened.num_pages, *opened.details())
            except Exception as e:
                if not share.part:
                    yield (*base, 0, None, None, None, None, *(digest or (None, "", False)), f"{type(e).__name__}: {e}")
                return
            if digest:
                yield (*about, *digest, None)
                return
            n = opened.num_pages
            for number in range(n * share.part // share.parts, n * (share.part + 1) // share.parts):
                try:
                    yield (*about, number, opened.page(number), True, None)
                except Exception as e:
                    yield (*about, number, "", False, f"{type(e).__name__}: {e}")


class PagedSource(DataSource):
    """Options: parser, what (pages or files), partitionBytes, suffix (of file names). path is a file or a folder, which tasks reach
    through Arrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "pages")]

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ensure_importable(spark)
    spark.dataSource.register(PagedSource)
