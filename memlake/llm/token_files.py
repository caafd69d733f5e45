"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A folder holds files of consecutive documents, one dictionary and a manifest. The dictionary is
trained on the serialized id arrays of a bounded sample. A file is

    magic, bytes per id, SHA-256 of the dictionary | a zstandard frame a document | index | footer

where the index is an Arrow stream of (doc_id, n_tokens, end): with it one document is read by
seeking to its frame. The footer gives the index's place. Files are written and read as the
Spark data source ``token_ids``: each task writes a file of its own name, and only the
manifest, written when all tasks have ended, makes files part of the folder, so retried and
lost tasks leave nothing that is read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

MAGIC = b"TOKENID1"
HEADER = struct.Struct("<8sB32s")
FOOTER = struct.Struct("<QQ8s")
#: Documents and characters of one that the dictionary is trained on, and its size in bytes.
SAMPLE_DOCS = 2048
SAMPLE_CHARS = 16_384
DICTIONARY_BYTES = 65_536
#: Characters of text for one file.
FILE_CHARS = 256 << 20
LEVEL = 3
#: Ids sent on at a time.
BATCH_IDS = 1 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("end", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("nulls", pa.bool_()), ("start", pa.int64()), ("dictionary", pa.string())])


class Recent(dict):
    """Values by key, made on demand; of keys not asked for lately some ``limit`` are forgotten at a time."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of a text, little-endian unsigned 32-bit, by the tokenizers library, word by word.

    Right for vocabularies whose pieces never reach over white space, as where white space is
    dropped: the ids of a text are those of its words one after another. ``lower``: the
    vocabulary also lower-cases, and ends a piece between letters, digits and signs. Then
    words are looked up in lower case, signs at their end apart, and words of Latin letters
    only go to the merges of the model at once. Texts with the start of an added token are
    encoded at once.
    """

    _SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    _LETTERS = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str, lower: bool = True, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.added = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Recent(self._word, limit)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        if not self.lower:
            return self.whole(word.decode())
        stem = word.rstrip(self._SIGNS)
        if len(stem) < len(word) and stem[-1:].isalnum():
            return self.words[stem] + self.words[word[len(stem) :]]
        text = word.decode()
        if self._LETTERS.fullmatch(text):
            return array("I", [t.id for t in self.model.tokenize(text.translate(self.letters))]).tobytes()
        return self.whole(text)

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if any(a in raw for a in self.added):
            return self.whole(text)
        if self.lower:
            raw = raw.lower()  # bytes: ASCII letters only
        return b"".join(map(self.words.__getitem__, raw.split()))


_encoders: dict[str, WordIds] = {}


def encoder(path: str | None) -> WordIds:
    """The encoder of this worker for the tokenizer file ``path`` (default: the public word BPE)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _coder(path: str | None, end_id: int, by_words: bool):
    """Ids of a text, null being empty, and ``end_id``."""
    words, end = encoder(path), array("I", [end_id]).tobytes()
    encode = words.encode if by_words else words.whole
    return lambda text: encode(text or "") + end


def _encode(path: str | None, end_id: int, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _coder(path, end_id, by_words)
        for b in batches:
            at, held, size = 0, [], 0
            for i, text in enumerate(b["text"]):
                held.append(coded(text.as_py()))
                size += len(held[-1])
                if size >= 4 * BATCH_IDS or i + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([b["doc_id"][at : i + 1], pa.array(held, pa.binary())], names=["doc_id", "ids"])
                    at, held, size = i + 1, [], 0

    return run


def encode(docs: DataFrame, path: str | None = None, end_id: int = 2, by_words: bool = True) -> DataFrame:
    """(doc_id, ids): ids of each text and ``end_id``, little-endian unsigned 32-bit; row order stays.

    ``by_words``: the vocabulary's pieces never reach over white space (see ``WordIds``);
    else whole texts are encoded at once.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, end_id, by_words), "doc_id bigint, ids binary")


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; executors reach it as Spark does."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, content: bytes) -> None:
    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(content)


def _get(folder: str, name: str) -> bytes:
    fs, root = _files(folder)
    with fs.open_input_stream(f"{root}/{name}") as source:
        return source.read()


def narrow(ids: bytes, width: int) -> bytes:
    """32-bit ids as ids of ``width`` bytes."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widen(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on serialized id arrays; few or short samples are used as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:  # the trainer wants more samples
        return b"".join(samples)[-size:]


def _dictionary(content: bytes):
    import zstandard

    if not content:
        return None
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=LEVEL)
    return made


@dataclass
class _Written(WriterCommitMessage):
    part: int
    file: str
    docs: int
    tokens: int
    first: int | None
    last: int | None
    nulls: bool


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.name, self.width = options["path"], options["dictionary"], int(options["width"])
        self.texts = (options.get("tokenizer"), int(options.get("end_id", 2)), options.get("by_words", "true") == "true")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import zstandard

        content = _get(self.folder, f"{self.name}.dictionary")
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content), write_checksum=True)
        part = TaskContext.get().partitionId()
        file = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        fs, root = _files(self.folder)
        ids, counts, ends, at = [], array("q"), array("q"), HEADER.size
        with fs.open_output_stream(f"{root}/{file}") as out:
            out.write(HEADER.pack(MAGIC, self.width, bytes.fromhex(self.name)))
            coded = None
            for batch in iterator:
                ids.append(batch["doc_id"].cast(pa.int64()))
                if "text" in batch.schema.names:
                    coded = coded or _coder(*self.texts)
                    values = (coded(row.as_py()) for row in batch["text"])
                else:
                    values = (row.as_py() for row in batch["ids"])
                for value in values:
                    frame = compressor.compress(narrow(value, self.width))
                    out.write(frame)
                    at += len(frame)
                    counts.append(len(value) // 4)
                    ends.append(at)
            doc_ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
            index = pa.BufferOutputStream()
            with pa.ipc.new_stream(index, INDEX) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(np.frombuffer(counts, np.int64)), pa.array(np.frombuffer(ends, np.int64))], schema=INDEX))
            index = index.getvalue().to_pybytes()
            out.write(index)
            out.write(FOOTER.pack(at, len(index), MAGIC))
        known = doc_ids.drop_null()
        return _Written(part, file, len(doc_ids), sum(counts), known[0].as_py() if len(known) else None, known[-1].as_py() if len(known) else None, doc_ids.null_count > 0)

    def commit(self, messages: list[_Written | None]) -> None:
        """The manifest: one row a file, in order, with the ids of all files before it."""
        rows, start = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            rows.append((m.part, m.file, m.docs, m.tokens, m.first, m.last, m.nulls, start, self.name))
            start += m.tokens
        out = pa.BufferOutputStream()
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(MANIFEST), MANIFEST.types, strict=True)], schema=MANIFEST), out)
        _put(self.folder, "manifest.parquet", out.getvalue().to_pybytes())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _files(self.folder)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.file}")


@dataclass
class _File(InputPartition):
    file: str
    start: int
    dictionary: str
    wanted: frozenset | None


class TokenFile:
    """One file: its index, and the ids of any of its documents by seeking to their frames."""

    def __init__(self, folder: str, file: str, dictionary: str):
        import zstandard

        content = _get(folder, f"{dictionary}.dictionary")
        fs, root = _files(folder)
        self.source = fs.open_input_file(f"{root}/{file}")
        magic, self.width, digest = HEADER.unpack(self.source.read_at(HEADER.size, 0))
        if magic != MAGIC or digest != hashlib.sha256(content).digest():
            raise ValueError(f"{file} was not written with dictionary {dictionary}")
        place, n, magic = FOOTER.unpack(self.source.read_at(FOOTER.size, self.source.size() - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{file} has no end")
        self.index = pa.ipc.open_stream(self.source.read_at(n, place)).read_all()
        self.ends = np.concatenate(([HEADER.size], self.index["end"].to_numpy()))
        self.starts = np.concatenate(([0], np.cumsum(self.index["n_tokens"].to_numpy())))
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(content))

    def ids(self, i: int) -> bytes:
        """Ids of the file's ``i``-th document, little-endian unsigned 32-bit."""
        frame = self.source.read_at(int(self.ends[i + 1] - self.ends[i]), int(self.ends[i]))
        return widen(self.decompressor.decompress(frame), self.width)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.wanted = options["path"], None

    def pushFilters(self, filters):
        """Equality and membership of doc_id choose files and, in them, documents."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) and f.attribute == ("doc_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("doc_id",) else None
            if values is None:
                yield f
            else:
                self.wanted = frozenset(values if self.wanted is None else self.wanted & values)

    def partitions(self) -> list[_File]:
        rows = pq.read_table(pa.BufferReader(_get(self.folder, "manifest.parquet"))).to_pylist()
        if self.wanted is not None:
            rows = [r for r in rows if r["first"] is not None and any(r["first"] <= w <= r["last"] for w in self.wanted if w is not None)]
        return [_File(r["file"], r["start"], r["dictionary"], self.wanted) for r in rows]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        file = TokenFile(self.folder, partition.file, partition.dictionary)
        doc_ids, counts = file.index["doc_id"].combine_chunks(), file.index["n_tokens"].combine_chunks()
        chosen = range(len(doc_ids)) if partition.wanted is None else [i for i, d in enumerate(doc_ids.to_pylist()) if d in partition.wanted]
        held, own, size = [], [], 0

        def batch() -> pa.RecordBatch:
            take = pa.array(own, pa.int64())
            starts = pa.array(file.starts[own] + partition.start)
            return pa.RecordBatch.from_arrays([doc_ids.take(take), starts, counts.take(take), pa.array(held, pa.binary())], schema=ROWS)

        for i in chosen:
            own.append(i)
            held.append(file.ids(i))
            size += len(held[-1])
            if size >= 4 * BATCH_IDS or len(own) >= 1000:
                yield batch()
                held, own, size = [], [], 0
        if own:
            yield batch()


class TokenIds(DataSource):
    """``token_ids``: (doc_id, ids) or (doc_id, text) is written, (doc_id, start, n_tokens, ids) is read.

    Texts are encoded by the task that writes them.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, by_words: bool = True, vocabulary: int = 49_408, file_chars: int = FILE_CHARS) -> None:
    """Writes the token ids of all documents to ``folder``, in ascending doc_id order.

    Rows are dealt to files by ranges of (doc_id, text, row), so copies of one id may lie in
    several files; inside a file they are sorted by doc_id, then text. Null doc_ids come
    first. Null and empty texts are the end id alone. Repeated rows are written as often as
    they occur. An empty table gives a folder with a dictionary and no documents. Texts may be
    of any length: a task holds one Arrow batch of them. Only doc_id and text are read, so other
    columns may have any name. ``vocabulary`` decides between two and four bytes an id. The
    dictionary is trained on at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS``
    characters, those with the smallest hashes.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    short = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("h")).filter(F.length("text").between(1, SAMPLE_CHARS))
    sample = encode(short.orderBy("h", "doc_id").limit(SAMPLE_DOCS), path, end_id, by_words)
    content = train_dictionary([narrow(bytes(r["ids"]), width) for r in sample.select("ids").collect()])
    name = hashlib.sha256(content).hexdigest()
    _put(folder, f"{name}.dictionary", content)
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(-(-total // file_chars), min(4 * spark.sparkContext.defaultParallelism, -(-total // (4 << 20))), 1)
    rows = docs.select("doc_id", "text").withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text")
    out = dealt.select(F.col("doc_id").cast("long").alias("doc_id"), "text").write.format("token_ids").option("path", folder).option("dictionary", name).option("width", width)
    out = out.option("end_id", end_id).option("by_words", str(by_words).lower())
    (out.option("tokenizer", path) if path else out).mode("append").save()


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder; ``start`` counts the ids of all before it.

    A filter on equal or listed doc_ids reads only the index of the files that may hold them
    and the frames of those documents.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("path", folder).load()
