"""A harvest of paged records as a streaming source.

What a collector fetched lies in <path>/set=<name>/page=<n>/ (n from 1 on): the n-th answer it got for the set, and behind it those that
followed up to the next folder's, so that a long harvest need not be a file for each page. An answer is an OAI-PMH document: the records,
the token it answers (request's resumptionToken; none: the set from its beginning) and the token of the next page. An expired token is
answered by the error badResumptionToken, and the set begins anew: its records come again and are merged by their ids.

An offset names for each set the last page and the token that must come next, so a stopped harvest goes on with that token, and a page
that answers another one waits until its place in the chain has landed. The first batch takes `pages` new pages of each set at most, and
while that leaves some behind, the next one twice as many: a backlog needs few batches however long it is. A task takes TASK pages of a
set at most, one after another. Files are read through pyarrow's file systems, wherever they lie.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from bisect import bisect_right
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Pages of a task at most.
TASK = 64
_CLOSED = re.compile(rb"</(?:[\w.-]+:)?OAI-PMH\s*>")
_RECORDS = re.compile(rb"<(?:[\w.-]+:)?record[\s>].*</(?:[\w.-]+:)?record\s*>", re.DOTALL)
RECORD = "set string, page int, external_id string, datestamp string, title string, abstract string, categories string"


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ET.Element, name: str) -> str | None:
    found = next((e for e in node.iter() if _plain(e.tag) == name and e.text), None)
    return " ".join(found.text.split()) if found is not None else None


class Answer:
    """One landed page: its token, the next one's, whether its token had expired, and its records."""

    def __init__(self, body: bytes):
        self.root = ET.fromstring(body)
        first: dict = {}
        for e in self.root.iter():
            first.setdefault(_plain(e.tag), e)
        request, token, error = first.get("request"), first.get("resumptionToken"), first.get("error")
        self.asked = (request.get("resumptionToken") if request is not None else None) or ""
        self.next = (token.text or "").strip() if token is not None else ""
        self.expired = error is not None and error.get("code") == "badResumptionToken"

    def records(self) -> Iterator[tuple]:
        """Records that are not deleted and have an id and a date."""
        for r in (e for e in self.root.iter() if _plain(e.tag) == "record"):
            header = next((e for e in r if _plain(e.tag) == "header"), None)
            if header is not None and header.get("status") == "deleted":
                continue
            key, date = _text(r, "id"), _text(r, "datestamp")
            if key and date:
                yield key, date, _text(r, "title"), _text(r, "abstract"), _text(r, "categories")


class Pages(InputPartition):
    """The pages of a set from the first to the last."""

    def __init__(self, name: str, first: int, last: int):
        self.name, self.first, self.last = name, first, last


class HarvestReader(DataSourceStreamReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages
        #: Where the harvest stands; after a restart Spark first plans its last batch again, and that says it.
        self.at: dict | None = None
        #: How many pages of a set the next batch takes at most.
        self.take = pages

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def _folders(self, name: str) -> list[int]:
        """The pages that a folder of the set begins with."""
        store, root = self._open()
        found = (f.base_name[5:] for f in store.get_file_info(fs.FileSelector(f"{root}/set={name}", allow_not_found=True)) if f.base_name.startswith("page="))
        return sorted(int(n) for n in found)

    def _from(self, name: str, page: int, folders: list[int]) -> list[bytes]:
        """The answers of a page and of those that follow it in its folder; none where it has not landed."""
        at = bisect_right(folders, page) - 1
        if at < 0:
            return []
        store, root = self._open()
        files = store.get_file_info(fs.FileSelector(f"{root}/set={name}/page={folders[at]}", allow_not_found=True))
        parts = sorted(f.path for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
        body = b"".join(store.open_input_stream(p).read() for p in parts)
        ends = [0, *(m.end() for m in _CLOSED.finditer(body)), len(body)]
        answers = [a for i, j in zip(ends, ends[1:]) if (a := body[i:j].strip())]
        return answers[page - folders[at] :]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self._open()
        at = dict(self.at or {})
        sets = sorted(f.base_name[4:] for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("set="))
        behind = False
        for name in sets:
            here, folders, ahead = at.get(name, {"page": 0, "token": "", "done": False}), self._folders(name), []
            for _ in range(self.take):
                ahead = ahead or self._from(name, here["page"] + 1, folders)[::-1]
                # The plan needs no records.
                answer = Answer(_RECORDS.sub(b"", ahead.pop())) if ahead else None
                # A finished set is asked from its beginning again; else the page must answer the token that is due.
                if answer is None or answer.asked != here["token"]:
                    break
                here = {"page": here["page"] + 1, "token": "" if answer.expired else answer.next, "done": not answer.expired and not answer.next}
            else:
                behind = True
            if here["page"]:
                at[name] = here
        self.at, self.take = at, 2 * self.take if behind else self.pages
        return at

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if self.at is None:
            self.at = end
        new = [(name, start.get(name, {"page": 0})["page"] + 1, to["page"]) for name, to in sorted(end.items())]
        return [Pages(name, k, min(k + TASK - 1, last)) for name, first, last in new for k in range(first, last + 1, TASK)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        folders, page = self._folders(partition.name), partition.first
        while page <= partition.last:
            bodies = self._from(partition.name, page, folders)
            if not bodies:
                raise FileNotFoundError(f"page {page} of {partition.name} is gone")
            for body in bodies[: partition.last - page + 1]:
                for record in Answer(body).records():
                    yield (partition.name, page, *record)
                page += 1


class Harvest(DataSource):
    """format("harvest") with the options path and pages (new pages of a set in the first batch, 100 unless given)."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> HarvestReader:
        return HarvestReader(self.options["path"], int(self.options.get("pages", "100")))


def harvested(spark: SparkSession, path: str, pages: int = 100) -> DataFrame:
    """The records of a landed harvest as a stream: set, page, external_id, datestamp, title, abstract, categories."""
    spark.dataSource.register(Harvest)
    return spark.readStream.format("harvest").option("path", path).option("pages", str(pages)).load()


def drain(stream: DataFrame, where: str) -> DataFrame:
    """Takes in all pages that have landed, in as many batches as they need, and returns all records so far. Files of a batch are
    committed whole, so a run that is stopped and started again neither loses nor repeats a page."""
    query = stream.writeStream.option("checkpointLocation", f"{where}/checkpoint").format("parquet").option("path", f"{where}/rows").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/rows")


def papers(records: DataFrame) -> DataFrame:
    """One row for each set and id: the newest datestamp's (ties: of the later page)."""
    newest = F.max_by(F.struct("datestamp", "title", "abstract", "categories"), F.struct("datestamp", "page"))
    return records.groupBy("set", "external_id").agg(newest.alias("r")).select("set", "external_id", "r.*")
