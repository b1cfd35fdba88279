"""SentencePiece encoding and decoding with the tokenizers library, rebuilt from the model's protobuf."""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from vocalith.llm.common import spare_name, table, text_batches, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces in the model: normal, unknown, control, user-defined, unused, byte.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown piece decodes to.
SURFACE = " ⁇ "
#: Chunks whose ids a worker keeps, ids after which a batch is passed on, and new chunks that go through the libraries as one text.
CACHE, BATCH_IDS, GROUP = 300_000, 2_000_000, 32


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: integers, 4- and 8-byte values and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What of a SentencePiece model encoding needs. Numbers of fields and defaults are those of its public protobuf schema."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for n, v in _fields(data):
            if n == 1:
                p = dict(_fields(v))
                m.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif n == 2:
                t = dict(_fields(v))
                m.kind, m.byte_fallback, m.unknown = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
            elif n == 3:
                t = dict(_fields(v))
                m.charsmap, m.dummy_prefix, m.squeeze, m.escape = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))
        return m

    @cached_property
    def splits(self) -> bool:
        """Whether a text may be cut before each run of markers: no piece has a marker behind another character."""
        return not self.charsmap and self.escape and self.dummy_prefix and not self.squeeze and any(p == MARK for p, _, _ in self.pieces) and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def tokenizer(self):
        """The tokenizers library's model: normaliser, metaspace marker, cuts before runs of markers, scores or merges, byte fallback and decoder."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        names = [p for p, _, _ in self.pieces]
        named = self.escape and SURFACE not in names
        if named:  # no normalised text holds a blank, so the unknown piece can bear the name that it decodes to
            names[self.unknown] = SURFACE
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, (_, s, _) in zip(names, self.pieces)], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            ids = {p: i for i, p in enumerate(names)}
            usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER)}
            rank = sorted((-s, ids[p], p) for p, s, kind in self.pieces if kind == NORMAL and len(p) > 1)
            merges = [(p[:i], p[i:]) for _, _, p in rank for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
            core = models.BPE(ids, merges, unk_token=names[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"models of kind {self.kind} have no counterpart")
        t = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        if self.splits:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        said = [] if named else [decoders.Replace(names[self.unknown], SURFACE)]
        t.decoder = decoders.Sequence([*said, decoders.Metaspace(MARK, "never"), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", int(self.dummy_prefix), 0)])
        t.add_special_tokens([AddedToken(p, normalized=False, special=True) for p, _, kind in self.pieces if kind == USER])
        t.encode_special_tokens = True
        return t


class Codec:
    """Encodes and decodes texts with the rebuilt tokenizer of one model. Chunks met before come from a bounded memo. New ones are encoded
    as one multithreaded batch, in groups of ``GROUP`` as one text or alone, and decoded again; those that don't come back are ``lossy``, and those to
    which the SentencePiece library gives other ids are ``odd``."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.model, self.threads, self.odd, self.lossy = Model.parse(data), threads, set(), set()
        self.own = self.model.tokenizer()
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.silent = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}
        self.lone = {"": array("i", [i]).tobytes() for i, (p, _, _) in enumerate(self.model.pieces) if p == MARK} if self.model.splits else {"": b""}
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.memo: dict[str, bytes] = dict(self.lone)

    def chunks(self, text: str) -> list[str]:
        """The text cut before each run of blanks, its leading marker left out: markers begin pieces, so chunks are encoded and decoded one by one.

        A text with a marker of its own stays whole, as that joins with the markers that blanks become.
        """
        if not text:
            return []
        if not self.model.splits or MARK in text:
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in re.findall(r" *[^ ]+| +\Z", " " + text)]

    def forget(self) -> None:
        """Empty the memo at a task's end: workers go on to other stages."""
        self.memo = dict(self.lone)
        self.odd.clear()
        self.lossy.clear()

    def learn(self, new: list[str]) -> None:
        """Put chunks' ids into the memo.

        Chunks without a blank or marker go through both libraries in groups, joined by blanks. If the library gives a group the same ids and its
        decoded text is the group's, both hold for each chunk: a chunk's ids begin at its only marker, and its text ends at the next blank.
        All others are learnt one by one.
        """
        plain, alone = [], []
        for c in new:
            (plain if self.model.splits and " " not in c and MARK not in c else alone).append(c)
        whole = len(plain) - len(plain) % GROUP
        alone += plain[whole:]
        groups = [plain[i : i + GROUP] for i in range(0, whole, GROUP)]
        said = [" ".join(g) for g in groups]
        mine = [e.ids for e in self.own.encode_batch_fast(said, add_special_tokens=False)] if said else []
        theirs, back = (self.theirs.encode(said, num_threads=self.threads), self.decode(mine)) if said else ([], [])
        for group, text, a, b, t in zip(groups, said, mine, theirs, back):
            ids = np.array(a, np.int32)
            starts = np.flatnonzero(self.begins[ids])
            if a == b and text == t and len(starts) == len(group) and not starts[0]:
                cuts, data = [*(4 * starts).tolist(), 4 * len(a)], ids.tobytes()
                self.memo.update((c, data[i:j]) for c, i, j in zip(group, cuts, cuts[1:]))
            else:
                alone += group
        if alone:
            self.learn_alone(alone)

    def learn_alone(self, new: list[str]) -> None:
        mine = [e.ids for e in self.own.encode_batch_fast(new, add_special_tokens=False)]
        self.odd.update(c for c, a, b in zip(new, mine, self.theirs.encode(new, num_threads=self.threads)) if a != b)
        self.lossy.update(c for c, back in zip(new, self.decode(mine)) if c != back)
        self.memo.update((c, array("i", ids).tobytes()) for c, ids in zip(new, mine))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """Each text's ids, whether they decode to it, and whether the SentencePiece library gives the same."""
        cut = [self.chunks(t or "") for t in texts]
        if len(self.memo) > CACHE:  # the older half goes
            for c in list(islice(self.memo, CACHE // 2)):
                del self.memo[c]
            self.odd &= self.memo.keys()
            self.lossy &= self.memo.keys()
            self.memo |= self.lone  # a trailing blank is a marker and nothing else
        if new := set(chain.from_iterable(cut)) - self.memo.keys():
            self.learn(sorted(new))
        get, odd, lossy = self.memo.__getitem__, self.odd, self.lossy
        return [(np.frombuffer(b"".join(map(get, c)), np.int32), not lossy or lossy.isdisjoint(c), not odd or odd.isdisjoint(c)) for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of the rebuilt decoder, as one multithreaded batch; control pieces say nothing, and broken UTF-8 becomes U+FFFD."""
        return self.own.decode_batch([[i for i in x if i not in self.silent] if not self.silent.isdisjoint(x) else x for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def _codec(name: str, path: str, threads: int) -> Codec:
    with open(SparkFiles.get(name) if name else path, "rb") as f:
        return Codec(f.read(), threads)


def encode(docs: DataFrame, model: str = MODEL, threads: int = 2, kept: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``kept`` columns with ``ids``, and whether decoding gives the text back (``restored``) and the SentencePiece library agrees (``parity``).

    Ids and decoded texts are those of the rebuilt tokenizer. The model file is sent to every executor once, as a file of the job. Whole texts are encoded. Null and empty texts have
    no ids and are restored as empty. Rows are encoded one by one: repeated rows agree. Names that ``kept`` has already
    get an underscore. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    spark.sparkContext.addFile(model)
    name = os.path.basename(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text"))
    keep = docs.select(*[F.col(f"`{c}`") for c in kept])
    names = [spare_name(keep, n) for n in ("ids", "restored", "parity")]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, "", threads)
        for b in batches:
            a = 0
            while a < len(b):
                z, size = a, 0
                lengths = b.column(n)
                while z < len(b) and z - a < 512 and size < BATCH_IDS:
                    size += len(lengths[z].as_py() or "")
                    z += 1
                part = b.slice(a, z - a)
                texts = part.column(n).to_pylist()
                done = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.ListArray.from_arrays(np.cumsum([0, *(len(i) for i, _, _ in done)], dtype=np.int32), np.concatenate([i for i, _, _ in done])), pa.array([r for _, r, _ in done], pa.bool_()), pa.array([p for _, _, p in done], pa.bool_())], [*kept, *names]
                )
                a = z
        codec.forget()

    schema = StructType([*keep.schema.fields, StructField(names[0], ArrayType(IntegerType())), StructField(names[1], BooleanType()), StructField(names[2], BooleanType())])
    return rows.mapInArrow(lambda batches: tidy(run(batches)), schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids as ``decoded``; null ids give null."""
    spark = encoded.sparkSession
    spark.sparkContext.addFile(model)
    name, at, out = os.path.basename(model), encoded.columns.index(ids), spare_name(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, "", 2)
        for b in batches:
            ids = b.column(at).to_pylist()
            texts = iter(codec.decode([i for i in ids if i is not None]))
            texts = [None if i is None else next(texts) for i in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, StringType())]))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "restored", "parity")
