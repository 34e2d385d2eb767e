"""Token totals by source, language and tokenizer version, kept by signed batches.

A batch is a table of changes: an insert adds a document and its tokens, a delete
takes both away, a revision adds the difference of the new count and the old. A
batch is summed to one row a group and written to a folder of its own; it counts
from the moment its entry stands in the log.

The log is a folder of numbered entries. An entry is written whole beside the log and
then published under the next number by a step that fails if the number is taken (a
link on a local file system, elsewhere Hadoop's rename without overwriting, which is
atomic on HDFS and stores like it). Whoever finds the number taken reads the log again
and decides anew. So entries have one order for all writers, and

* a batch whose id stands in the log already adds nothing, be it retried or sent twice;
* a snapshot, which ``compact`` writes, names the entries it has summed, and is
  published only if all of them still count then; of two compactors that summed the
  same entries the later one gives up, and batches published meanwhile go on counting;
* a writer that broke off leaves a folder that no entry names, and nobody reads.

Nulls: a null source, language or version is a group of its own; a null count is 0; an
unknown or null op is an error. Repeated change rows count each; an empty batch commits
without rows; other columns are not read. Groups whose documents and tokens have come
to zero are left out of the totals. Rows of one group are added up before the shuffle,
so a hot source is one row a task, and the order of rows and of ties has no effect.

``count_tokens`` counts ids by the tokenizers library: a null text has none; texts of
any length are taken whole.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.llm.common import qualified
from plumbline.llm.token_output import encoder

KEYS = ("source", "lang", "tokenizer_version")
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"
_CHANGES = {"insert": 1, "delete": -1, "revise": 0}
#: Documents encoded at a time.
_ENCODED = 512


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text") -> DataFrame:
    """Every row's other columns, and a column of counts for each tokenizer file, named by its key."""
    spark = docs.sparkSession
    specs = {}
    for name, path in tokenizers.items():
        with open(path, encoding="utf-8") as f:
            specs[name] = f.read()
    sent = spark.sparkContext.broadcast(specs)  # the tokenizers' files, a few MB
    names = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _ENCODED):
                some = batch.slice(i, _ENCODED)
                texts = [t or "" for t in some.column(some.num_columns - 1).to_pylist()]
                counts = [pa.array(encoder(spec).count(texts), pa.int64()) for spec in sent.value.values()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *counts], names=[*names, *sent.value])

    schema = docs.select(*names).schema
    for name in tokenizers:
        schema = schema.add(name, LongType())
    return docs.select(*names, F.col(text_col).cast("string")).mapInArrow(run, schema)


class TokenRollup:
    """A store of totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, qualified(spark, uri)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._path = hadoop.Path
        self._fs = self._path(self.uri).getFileSystem(self._conf)
        self._local = self._fs.getScheme() == "file"
        for folder in ("log", "entries"):
            self._fs.mkdirs(self._path(f"{self.uri}/{folder}"))

    def _log(self) -> list[dict]:
        """The entries in their order."""
        out = []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.uri}/log")))
        for name in names:
            if name.isdigit():
                stream = self._fs.open(self._path(f"{self.uri}/log/{name}"))
                try:
                    out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return out

    def _publish(self, number: int, entry: dict) -> bool:
        """Puts the entry under its number; False if that is taken."""
        made = f"{self.uri}/entries/{uuid.uuid4().hex}"
        target = f"{self.uri}/log/{number:012d}"
        stream = self._fs.create(self._path(made), False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            if self._local:
                plain = lambda uri: self._path(uri).toUri().getPath()
                os.link(plain(made), plain(target))
            else:
                hadoop = self.spark._jvm.org.apache.hadoop.fs
                none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                hadoop.FileContext.getFileContext(self._path(self.uri).toUri(), self._conf).rename(self._path(made), self._path(target), none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        finally:
            with contextlib.suppress(Py4JJavaError):
                self._fs.delete(self._path(made), False)

    def _append(self, entry: dict, still) -> bool:
        """Publishes under the next number, as long as ``still(log)`` holds of the log before it."""
        while True:
            log = self._log()
            if not still(log):
                self._fs.delete(self._path(f"{self.uri}/{entry['folder']}"), True)
                return False
            if self._publish(len(log), entry):
                return True

    @staticmethod
    def _live(log: list[dict]) -> dict[int, str]:
        """Number -> data folder, of the entries that count."""
        out = {}
        for i, entry in enumerate(log):
            for covered in entry.get("covers", ()):
                del out[covered]
            out[i] = entry["folder"]
        return out

    def committed(self) -> set[str]:
        """Ids of the batches that count."""
        return self._ids(self._log())

    @staticmethod
    def _ids(log: list[dict]) -> set[str]:
        return {entry["batch"] for entry in log if "batch" in entry}

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of ``(op, source, lang, tokenizer_version, old_tokens, new_tokens)``; False if it counts already.

        ``op`` is insert (new_tokens), delete (old_tokens) or revise (both).
        """
        if batch_id in self.committed():
            return False
        old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
        op = F.col("op")
        sign = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("long")
        for name, docs in _CHANGES.items():
            sign = F.when(op.eqNullSafe(name), F.lit(docs).cast("long")).otherwise(sign)
        delta = F.when(op == "insert", new).when(op == "delete", -old).otherwise(new - old)
        sums = changes.select(*KEYS, sign.alias("d"), delta.cast("long").alias("t")).groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
        folder = f"data/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.uri}/{folder}")
        return self._append({"batch": batch_id, "folder": folder}, lambda log: batch_id not in self._ids(log))

    def _sum(self, folders: list[str]) -> DataFrame:
        read = self.spark.read.schema(_SCHEMA)
        rows = read.parquet(*(f"{self.uri}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer_version, n_docs, n_tokens)`` of all committed batches."""
        return self._sum(sorted(self._live(self._log()).values())).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Sums the entries that count into one; False if there was nothing to sum, or another compactor came first."""
        live = self._live(self._log())
        if len(live) < 2:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        self._sum(sorted(live.values())).write.parquet(f"{self.uri}/{folder}")
        return self._append({"folder": folder, "covers": sorted(live)}, lambda log: set(live) <= set(self._live(log)))
