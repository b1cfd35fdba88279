"""Providers as Python data sources: batch answers asked for run by run, and messages of live sessions as a stream.

Nothing here opens a connection. An adapter answers a request; the one at hand gives the answers that were recorded with it, and a caller
registers others in ``ADAPTERS``. Messages come from a log: a folder a shard, whose files are appended to in order of their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vocalith.sources import responses
from vocalith.sources.files import key_term_violations
from vocalith.sources.lines import PART, Part, batches, files_below, objects, parts, store
from vocalith.streaming.messages import INPUT

REQUEST = {"config_id", "utt_id", "provider", "settings", "answers"}
# Settings that each provider's batch requests take, and limits of its key terms: how many, characters, words, banned characters.
SETTINGS = {
    "deepgram": {"smart_format", "punctuate", "language", "keyterms"},
    "assemblyai": {"format_text", "punctuate", "language_code", "keyterms"},
    "elevenlabs": {"language_code", "diarize", "no_verbatim", "temperature", "seed", "keyterms"},
}
KEY_TERMS = {("elevenlabs", "batch"): (100, 50, 5, "<>{}[]\\"), ("assemblyai", "streaming"): (100, 50, None, ""), ("elevenlabs", "streaming"): (50, 20, None, "")}


def preset_violations(terms: DataFrame, provider: str, mode: str) -> DataFrame:
    """``files.key_term_violations`` by the limits of a provider in a mode; one without limits refuses nothing."""
    most, longest, words, banned = KEY_TERMS.get((provider, mode), (1 << 30, 1 << 30, None, ""))
    return key_term_violations(terms, most, longest, words, banned)


def recorded(request: dict, attempt: int) -> tuple[int | None, str | None]:
    """The answer that was recorded for this attempt, or the last one; none at all if nothing was."""
    answers = request.get("answers") or []
    if not answers:
        return None, None
    a = answers[min(attempt, len(answers)) - 1]
    return a.get("status"), a.get("body")


#: (request, attempt) -> (status, body); a null status means that no answer came.
ADAPTERS: dict[str, Callable[[dict, int], tuple[int | None, str | None]]] = {"recorded": recorded}


def asked(request: dict, ask: Callable, most: int, first_s: float, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, int | None, str | None]]:
    """(attempt, status, body) until an answer isn't one to ask again for, after waits that double."""
    provider = request["provider"]
    if odd := sorted(set(request.get("settings") or {}) - SETTINGS.get(provider, set())):
        raise ValueError(f"{provider} has no settings {odd}")
    for attempt in range(1, most + 1):
        status, body = ask(request, attempt)
        yield attempt, status, body
        if status is not None and status not in responses.RETRYABLE:
            return
        if attempt < most:
            sleep(first_s * 2 ** (attempt - 1))


@dataclass
class RunPart(Part):
    run_id: str


class AnswerReader(DataSourceReader):
    """A folder a run, cut into parts by bytes."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema, self.runs = options["path"], schema, None
        self.adapter, self.most, self.first_s = options.get("adapter", "recorded"), int(options.get("attempts", 3)), float(options.get("first_wait_s", 0))
        self.part = int(options.get("part_bytes", PART))
        if self.adapter not in ADAPTERS:
            raise ValueError(f"unknown adapter: {self.adapter}")

    def partitions(self) -> list[RunPart]:
        found = [(p, p.file.rsplit("/", 2)[-2]) for p in parts(files_below(self.path), self.part)]
        return [RunPart(p.file, p.start, p.end, run) for p, run in found if self.runs is None or run in self.runs]

    def read(self, part: RunPart) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for _, request in objects(part, REQUEST, ("config_id", "utt_id", "provider")):
                for attempt, status, body in asked(request, ADAPTERS[self.adapter], self.most, self.first_s):
                    yield {"run_id": part.run_id, **{k: request[k] for k in ("config_id", "utt_id", "provider")}, "attempt": attempt, "status": status, "body": body}

        yield from batches(rows(), to_arrow_schema(self.schema))


class PruningReader(AnswerReader):
    """Filters on ``run_id`` leave runs unread; Spark takes such a reader only in sessions that push filters down to Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("run_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.runs = wanted if self.runs is None else self.runs & wanted
            else:
                yield f


class ProviderAnswers(DataSource):
    """``format("provider_answers")``: every attempt's answer to the requests below ``path/<run>/*.jsonl``, as rows of ``responses.INPUT``.

    Options: ``adapter``, ``attempts``, ``first_wait_s``, ``part_bytes``, ``prune``. A task that is run again asks again.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_answers"

    def schema(self) -> str:
        return responses.INPUT

    def reader(self, schema: StructType) -> AnswerReader:
        kind = PruningReader if self.options.get("prune", "false") == "true" else AnswerReader
        return kind(dict(self.options), schema)


def read_answers(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ProviderAnswers)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("provider_answers").options(prune=prune, **options).load(path)


class MessageReader(DataSourceStreamReader):
    """An offset is, for each shard, the last file and the bytes of its whole lines; files before it are done, later ones not begun.

    So offsets grow with shards, not with files, and a restart goes on at the byte where the last batch ended.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.clean, self.part = options.get("delete_done", "false").lower() == "true", int(options.get("part_bytes", PART))

    def _shards(self) -> dict[str, list[tuple[str, int]]]:
        shards: dict[str, list[tuple[str, int]]] = {}
        for file, size in files_below(self.path):
            shards.setdefault(file.rsplit("/", 2)[-2], []).append((file, size))
        return shards

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for shard, found in self._shards().items():
            file, size = found[-1]
            out[shard] = {"file": file, "bytes": _whole_lines(file, size)}
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for shard, found in self._shards().items():
            last = end.get(shard)
            if last is None:
                continue
            begun = start.get(shard, {"file": "", "bytes": 0})
            for file, size in found:
                if begun["file"] <= file <= last["file"]:
                    a = begun["bytes"] if file == begun["file"] else 0
                    z = last["bytes"] if file == last["file"] else size
                    out += [Part(file, b, min(b + self.part, z)) for b in range(a, z, self.part)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fields = set(self.schema.names)
        yield from batches((row for _, row in objects(part, fields, ("session", "seq"))), to_arrow_schema(self.schema))

    def commit(self, end: dict) -> None:
        if not self.clean:
            return
        for shard, found in self._shards().items():
            for file, _ in found:
                if shard in end and file < end[shard]["file"]:
                    system, at = store(file)
                    system.delete_file(at)

    def stop(self) -> None:
        pass


def _whole_lines(file: str, size: int) -> int:
    """Bytes of a file up to its last line end, looked for from its end."""
    system, at = store(file)
    with system.open_input_file(at) as raw:
        end = size
        while end:
            begin = max(0, end - (1 << 16))
            raw.seek(begin)
            if (found := raw.read(end - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            end = begin
    return 0


class ProviderMessages(DataSource):
    """``format("provider_messages")``: messages of a log ``path/<shard>/*.jsonl`` as a stream, rows of ``messages.INPUT``.

    Options: ``delete_done`` removes files before the committed one; ``part_bytes``. A line that isn't whole yet waits.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_messages"

    def schema(self) -> str:
        return INPUT

    def streamReader(self, schema: StructType) -> MessageReader:
        return MessageReader(dict(self.options), schema)


def stream_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ProviderMessages)
    return spark.readStream.format("provider_messages").options(**options).load(path)
