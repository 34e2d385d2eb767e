"""Token ids as Arrow files of fixed-size lists, and reading them back.

Documents are ordered by id over range partitions; each partition is tokenised and
written as one Arrow IPC file (the stream format between a magic number and a
footer). A file's batches hold ``ids`` and ``mask``: fixed-size lists of ``seq_len``
numbers, a mask being a bit a position (true: a token, false: padding, only after a
partition's last token). All batches but the last have ``BATCH`` sequences, so
sequence ``i`` is row ``i % BATCH`` of batch ``i // BATCH``, and its ids and mask are
slices of a memory map, neither copied. Beside it a second file lists the documents'
ids and numbers of tokens. A written partition reports itself by a row with the
names of its files; names are unique to the attempt, so what a failed or doubled
attempt has written is never read.

Ids take 16 bits where the vocabulary allows, else 32. Words repeat, so a bounded
table of encoded words saves most calls of the tokenizer; it is used only for
byte-level tokenizers without normalizer, at spaces where the encoding of what
follows cannot depend on what came before, and for tokenizers that drop white space
and whose pieces and normal forms never reach across a space. It gives the same ids.

Nulls: a null text is an empty one, and has just the end id; a null id comes first.
Repeated rows are written once each, rows of equal id in an order of no meaning. Texts
of any length are encoded whole; one text's ids are held at a time. Other columns,
whatever their names, are not read. An empty table writes no file.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, qualified

SEQ_LEN = 2048
#: Sequences in a batch.
BATCH = 64
#: Words that the table of encoded words holds at most between batches.
WORDS = 300_000
#: Of them, those that came in two calls or more stay for good, up to this many; the others go, the oldest first.
AGAIN = 180_000
#: Words that the table of numbers of ids holds at most between calls; an entry takes less there.
COUNTED = 500_000
_DOCS_IN_BATCH = 4096
#: Documents encoded at a time.
ENCODED = 512


# Fixed value: the pattern of pieces of a public tokenizer; none of its alternatives matches white space.
_SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _drops_spaces(conf: dict) -> bool:
    """Whether a text's ids are those of its parts between spaces, one after the other."""
    pre = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = (conf.get("normalizer") or {}).get("normalizers") or []
    return (
        pre[0].get("pattern") == {"Regex": _SPACELESS} and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
        and all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal)
        and not any(p.get("add_prefix_space") for p in pre)
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf.get("added_tokens", []))
    )


class Encoder:
    """Texts to the bytes of their ids, little-endian, by a tokenizer of the tokenizers library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        conf = json.loads(spec)
        pre = conf.get("pre_tokenizer") or {}
        self.by_word = (
            conf.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf.get("added_tokens", []))
        )
        self.by_part = _drops_spaces(conf)
        self.words: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        self.points = dict(zip(".,", self._plain([".", ","]), strict=True))
        if self.by_word:
            # ids whose text begins with a space: among words that each begin with one, these begin a word
            vocab = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
    _unsafe = re.compile(r" (?:\s|\Z)")

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pointed(self, word: str) -> bool:
        """Letters with one point after them: the ids of the letters and that of the point."""
        return word[-1] in self.points and word[:-1].isalpha() and (word.isascii() or not self.by_part or unicodedata.normalize("NFC", word[:-1]).lower().isalpha())

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words that follow a space, the space included: encoded in long texts and taken apart."""
        if self.by_part:
            return self._plain(words)
        out = []
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some) and at[0] == 0:
                raw, ends = ids.tobytes(), (at * self.dtype.itemsize).tolist() + [ids.nbytes]
                out += [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            else:
                out += self._plain([" " + w for w in some])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A space before a word always starts a new piece of text for the tokenizer."""
        known, fresh, get = self.words, self.fresh, self.words.get
        out: list = [None] * len(texts)
        whole, split, first, unknown = [], [], set(), set()
        for i, text in enumerate(texts):
            if self.by_part:
                head, words = "", [w for w in text.replace("\n", " ").split(" ") if w]
            elif self.by_word and not self._unsafe.search(text):
                head, *words = text.split(" ")
            else:
                whole.append(i)
                continue
            parts = list(map(get, words))
            open_at = [k for k, ids in enumerate(parts) if ids is None]
            unknown.update(map(words.__getitem__, open_at))
            first.add(head)
            split.append((i, head, words, parts, open_at))
        for i, ids in zip(whole, self._plain([texts[i] for i in whole]), strict=True):
            out[i] = ids
        first = list(first)
        heads = dict(zip(first, self._plain(first), strict=True))
        again = {w: fresh[w] for w in unknown if w in fresh}
        pointed = [w for w in unknown if w not in again and self._pointed(w)]
        unknown.difference_update(again, pointed)
        bare = {w[:-1] for w in pointed}.difference(known, again)
        again.update({w: fresh[w] for w in bare if w in fresh})
        missing = list(unknown.union(bare).difference(again))
        found = dict(zip(missing, self._spaced(missing), strict=True))
        now = again | found
        for w in pointed:
            ids = now.get(w[:-1])
            now[w] = (known[w[:-1]] if ids is None else ids) + self.points[w[-1]]
        for i, head, words, parts, open_at in split:
            for k in open_at:
                parts[k] = now[words[k]]
            out[i] = heads[head] + b"".join(parts)
        stay = list(again) + [w for w in pointed if w[:-1] in known]
        for w in stay[: max(0, AGAIN - len(known))]:
            known[w] = now[w]
            fresh.pop(w, None)
        fresh.update(found)
        for w in list(itertools.islice(fresh, max(0, len(fresh) + len(known) - WORDS))):
            del fresh[w]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text.

        Numbers of ids of words are kept while their table has room; the words of a text
        that it then does not hold are counted together, as one text of their own.
        """
        known, get = self.counts, self.counts.get
        out, rest, split = [0] * len(texts), list(texts), []
        for i, text in enumerate(texts):
            if self.by_part:
                split.append((i, "", [w for w in text.replace("\n", " ").split(" ") if w]))
            elif self.by_word and not self._unsafe.search(text):
                head, *words = text.split(" ")
                split.append((i, head, words))
        if len(known) < COUNTED:
            missing = set().union(*(words for _, _, words in split)).difference(known)
            pointed = [w for w in missing if self._pointed(w)]
            missing.difference_update(pointed)
            missing.update({w[:-1] for w in pointed}.difference(known))
            missing = list(missing)
            known.update(zip(missing, self._lengths(missing if self.by_part else [" " + w for w in missing]), strict=True))
            known.update((w, known[w[:-1]] + 1) for w in pointed)
        for i, head, words in split:
            counts = list(map(get, words))
            if None in counts:
                unknown = [w for w, n in zip(words, counts, strict=True) if n is None]
                out[i] = sum(filter(None, counts))
                rest[i] = " ".join(unknown if self.by_part else [head, *unknown])
            else:
                out[i], rest[i] = sum(counts), head
        for w in list(itertools.islice(reversed(known), max(0, len(known) - COUNTED))):
            del known[w]
        left = [i for i, text in enumerate(rest) if text]
        for i, n in zip(left, self._lengths([rest[i] for i in left]), strict=True):
            out[i] += n
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a worker process and tokenizer."""
    key = f"{len(spec)}-{zlib.crc32(spec.encode())}"
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


@dataclass
class _Writer:
    """Writes one partition's files."""

    uri: str
    name: str
    dtype: np.dtype
    seq_len: int
    id_type: pa.DataType

    def __post_init__(self):
        fs, path = _open(self.uri)
        fs.create_dir(path, recursive=True)
        kind = pa.from_numpy_dtype(self.dtype)
        lists = lambda t: pa.list_(t, self.seq_len)
        self.schema = pa.schema([("ids", lists(kind)), ("mask", lists(pa.bool_()))])
        self.doc_schema = pa.schema([("doc_id", self.id_type), ("n_tokens", pa.int64())])
        self.out = fs.open_output_stream(f"{path}/{self.name}.arrow")
        self.doc_out = fs.open_output_stream(f"{path}/{self.name}.docs.arrow")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.docs = pa.ipc.new_file(self.doc_out, self.doc_schema)
        self.buffer, self.ids, self.sizes = bytearray(), [], []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id, ids: bytes):
        self.buffer += ids
        size = len(ids) // self.dtype.itemsize
        self.n_tokens += size
        self.n_docs += 1
        self.ids.append(doc_id)
        self.sizes.append(size)
        if len(self.ids) >= _DOCS_IN_BATCH:
            self._flush_docs()
        if len(self.buffer) >= self.seq_len * BATCH * self.dtype.itemsize:
            self._flush(False)

    def _flush_docs(self):
        if self.ids:
            self.docs.write_batch(pa.record_batch([pa.array(self.ids, self.id_type), pa.array(self.sizes, pa.int64())], schema=self.doc_schema))
            self.ids, self.sizes = [], []

    def _flush(self, final: bool):
        per = self.seq_len * BATCH
        tokens = np.frombuffer(bytes(self.buffer), dtype=self.dtype)
        whole = len(tokens) // per * per
        for i in range(0, whole, per):
            self._batch(tokens[i : i + per], per)
        rest = tokens[whole:]
        self.buffer = bytearray(rest.tobytes())
        if final and len(rest):
            self._batch(rest, -(-len(rest) // self.seq_len) * self.seq_len)

    def _batch(self, tokens, size):
        pad = size - len(tokens)
        cols = [np.pad(tokens, (0, pad)), np.pad(np.ones(len(tokens), dtype=bool), (0, pad))]
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(c), self.seq_len) for c in cols], schema=self.schema))

    def close(self):
        self._flush(True)
        self._flush_docs()
        for x in (self.file, self.out, self.docs, self.doc_out):
            x.close()


def write(docs: DataFrame, tokenizer_path: str, out_uri: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", seq_len: int = SEQ_LEN) -> DataFrame:
    """Writes the files of ``docs`` under ``out_uri``, a folder all executors share; returns the manifest.

    The manifest has a row for each partition: ``part, name, n_docs, n_tokens``.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        coder, writer, part = encoder(spec.value), None, None
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column(2)[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                writer = _Writer(out_uri, name, coder.dtype, seq_len, batch.schema.field(0).type)
            for i in range(0, batch.num_rows, ENCODED):
                some = batch.slice(i, ENCODED)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), coder.encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [writer.name], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    manifest = rows.mapInArrow(run, "part int, name string, n_docs bigint, n_tokens bigint")
    # whole texts come in small Arrow batches: both sides hold one at a time
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ENCODED))
    try:
        return Scratch(spark, "token-manifest").keep(manifest, "manifest")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def sequence(uri: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``i`` of one file; of a local file, views of its memory map, the mask's in bits."""
    fs, path = _open(uri)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(i // BATCH)
    size = batch.schema.field("ids").type.list_size
    ids, mask = (batch.column(c).flatten().slice(i % BATCH * size, size) for c in ("ids", "mask"))
    return ids.to_numpy(), mask


def _documents(uri: str, name: str):
    """Batches of (doc_id, at, n_tokens, crc32) of one partition's files, at counting from its first token."""
    fs, path = _open(uri)
    with fs.open_input_file(f"{path}/{name}.arrow") as f, fs.open_input_file(f"{path}/{name}.docs.arrow") as g:
        tokens, docs = pa.ipc.open_file(f), pa.ipc.open_file(g)

        def pieces():
            for i in range(tokens.num_record_batches):
                batch = tokens.get_batch(i)
                real = batch.column("mask").flatten().true_count
                yield batch.column("ids").flatten().to_numpy()[:real].astype("<u4")

        more, have, at = pieces(), np.empty(0, dtype="<u4"), 0
        for i in range(docs.num_record_batches):
            batch, out = docs.get_batch(i), []
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                crc, missing = 0, n
                while missing > len(have):
                    crc, missing = zlib.crc32(have.data, crc), missing - len(have)
                    have = next(more)
                out.append((doc, at, n, zlib.crc32(have[:missing].data, crc)))
                have, at = have[missing:], at + n
            yield list(zip(*out, strict=True))


def read_documents(manifest: DataFrame, uri: str, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the written files.

    ``start`` adds the tokens of the partitions before; the manifest, a row for each
    partition, passes through one window.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("name", F.coalesce(before, F.lit(0)).alias("before"), "part")
    parts = files.repartition(max(1, manifest.count()), "part")

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc, at, n, crc in _documents(uri, name):
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.array(at, dtype=np.int64) + base), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.select("name", "before").mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id", out_uri: str | None = None) -> DataFrame:
    """Writes the documents' files and returns what they hold.

    They go to a new folder under ``out_uri``, which stays, or else to one that is
    deleted when the driver ends.
    """
    spark = docs.sparkSession
    uri = f"{qualified(spark, out_uri)}/tokens-{uuid.uuid4().hex}" if out_uri else Scratch(spark, "tokens").path("arrow")
    manifest = write(docs, tokenizer_path, uri, end_id, text_col, id_col)
    return read_documents(manifest, uri, docs.schema[id_col].dataType.simpleString())
