"""Session documents: everything that happened in a session as one nested JSON document, written as a stream.

``export_sessions`` deals events by session and sorts them inside the task; the writer opens the document of a session, writes its
events one by one into the list they belong to, and closes it with the counts.  A session is never held as a row or in memory, so
it may be as long as a task can read.  A file holds one document per line and as many sessions as its task was dealt.

Files appear when the whole write is committed; a task that runs twice leaves one file, a write that fails none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# The lists of a document, the event types each holds, and the count of the summary that each gives.
LISTS = {
    "testResults": ("test_start", "test_end"), "transmissionEvents": ("transmission",), "duplicateEvents": ("duplicate_detected",),
    "conversationEvents": ("conversation_event",),
}
COUNTS = {
    "totalTransmissions": "transmission", "totalDuplicates": "duplicate_detected", "totalTests": "test_start",
    "conversationEvents": "conversation_event",
}
OTHER = "otherEvents"
EVENT = "struct<timestamp:bigint,sessionTime:bigint,type:string,testPhase:string,url:string,data:string>"
SUMMARY = "struct<sessionDuration:bigint,totalTransmissions:bigint,totalDuplicates:bigint,totalTests:bigint,conversationEvents:bigint>"
DOCUMENT = "conversationId string, " + ", ".join(f"{name} array<{EVENT}>" for name in (*LISTS, OTHER)) + f", summary {SUMMARY}, exportTimestamp bigint"
_ORDER = [*LISTS, OTHER]


@dataclass
class Written(WriterCommitMessage):
    """The file a task has written, not yet in its place."""

    path: str | None


class SessionWriter(DataSourceWriter):
    """Writes rows that come sorted by session and list."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.exported = options["path"], int(options.get("exporttimestamp", "0"))

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, folder = self._files()
        path, out, document = None, None, None
        for row in iterator:
            if out is None:
                files.create_dir(f"{folder}/_pending", recursive=True)
                path = f"{folder}/_pending/{uuid.uuid4().hex}.json"
                out = files.open_output_stream(path)
            if document is None or document.session != row.conversation_id:
                if document is not None:
                    document.close(self.exported)
                document = _Document(out, row.conversation_id)
            document.add(row)
        if out is not None:
            document.close(self.exported)
            out.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = self._files()
        for message in messages:
            if message is not None and message.path is not None:
                files.move(message.path, f"{folder}/part-{message.path.rsplit('/', 1)[1]}")
        self._tidy(files, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy(*self._files())

    def _tidy(self, files: pafs.FileSystem, folder: str) -> None:
        if files.get_file_info(f"{folder}/_pending").type == pafs.FileType.Directory:
            files.delete_dir(f"{folder}/_pending")


class _Document:
    """One open document of a file."""

    def __init__(self, out, session: str | None):
        self.out, self.session = out, session
        self.place, self.counts = -1, dict.fromkeys(COUNTS, 0)
        self.first = self.last = None
        self._say('{"conversationId":' + json.dumps(session))

    def _say(self, text: str) -> None:
        self.out.write(text.encode())

    def _upto(self, place: int) -> bool:
        """Open the lists up to number ``place``; whether that one is new."""
        new = place > self.place
        while self.place < place:
            self._say(("]" if self.place >= 0 else "") + f',"{_ORDER[self.place + 1]}":[')
            self.place += 1
        return new

    def add(self, row: Row) -> None:
        new = self._upto(row.list)
        event = {"timestamp": row.at, "sessionTime": row.session_time, "type": row.type, "testPhase": row.test_phase, "url": row.url, "data": row.data}
        self._say(("" if new else ",") + json.dumps(event, ensure_ascii=False))
        for name, kind in COUNTS.items():
            self.counts[name] += row.type == kind
        if row.at is not None:
            self.first = row.at if self.first is None else min(self.first, row.at)
            self.last = row.at if self.last is None else max(self.last, row.at)

    def close(self, exported: int) -> None:
        self._upto(len(_ORDER) - 1)
        length = None if self.first is None else self.last - self.first
        self._say('],"summary":' + json.dumps({"sessionDuration": length} | self.counts) + f',"exportTimestamp":{exported}}}\n')


class SessionDocuments(DataSource):
    """``df.write.format("session_documents")``; use it through ``export_sessions``, which deals and sorts the events."""

    @classmethod
    def name(cls) -> str:
        return "session_documents"

    def schema(self) -> str:
        return DOCUMENT

    def writer(self, schema, overwrite: bool) -> SessionWriter:
        return SessionWriter(self.options)


def export_sessions(events: DataFrame, folder: str, exported_ms: int = 0) -> None:
    """Write one document per session of analytics ``events`` (as ``ingest_analytics`` gives them) into the new folder ``folder``.

    Events of a list stand in the order of their time, ties in that of their content.  Types that no list names are ``otherEvents``.
    """
    events.sparkSession.dataSource.register(SessionDocuments)
    place = F.lit(len(LISTS))
    for number, kinds in enumerate(LISTS.values()):
        place = F.when(F.col("type").isin(*kinds), number).otherwise(place)
    columns = ["session_time", "type", "test_phase", "url", "data"]
    rows = events.select("conversation_id", place.alias("list"), F.unix_millis("ts").alias("at"), *columns)
    dealt = rows.repartition("conversation_id").sortWithinPartitions("conversation_id", "list", "at", *columns)
    dealt.write.format("session_documents").mode("append").option("exportTimestamp", exported_ms).save(folder)


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(folder)
