"""Delta-maintained token counts.

A rollup holds additive totals of documents, tokens and bytes by source, language and tokenizer version. Changes come as
signed rows: an insert adds, a delete takes away, a revision takes away the old counts and adds the new. A batch is summed to
one row for each key before it is stored, and takes effect by a commit file that is created once: a batch that is sent again,
by a retry or a second driver, changes nothing. Totals are the sum of committed batches; `compact` folds those into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tokens import texts_of

KEY = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """rows with their counts times sign. Null keys stay keys of their own, null counts are 0."""
    return rows.select(*KEY, *[(F.coalesce(F.col(c).cast("long"), F.lit(0)) * sign).alias(c) for c in SUMS])


def inserts(rows: DataFrame) -> DataFrame:
    return signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    return signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals under `root`, a folder of any file system that Spark can write.

    root/data/<batch>/<attempt>/ holds a batch's sums, root/commits/<batch> names the attempt that counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    @staticmethod
    def _name(batch: str) -> str:
        return batch.encode().hex()  # any string is a safe file name

    def committed(self) -> dict[str, dict]:
        out = {}
        for s in self._fs.listStatus(self._path(f"{self.root}/commits")):
            if s.getPath().getName().startswith("."):
                continue
            stream = self._fs.open(s.getPath())
            try:
                entry = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            out[entry["batch"]] = entry
        return out

    def _create(self, batch: str, entry: dict) -> bool:
        """Make the commit file appear whole, or return False if there is one: the step that lets only one of several writers win.

        Elsewhere than on a local disk this is a rename that refuses an existing target, which the file system must do as one step
        (HDFS does; object stores need a committer that does). On a local disk it is a link, which can't be made twice.
        """
        jvm = self.spark.sparkContext._jvm
        final = self._path(f"{self.root}/commits/{self._name(batch)}")
        part = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps(entry | {"batch": batch}).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                at = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.String, 0)) for p in (final, part)]
                jvm.java.nio.file.Files.createLink(*at)
            else:
                rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, final, how)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            if self._fs.exists(part):
                self._fs.delete(part, False)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Store a batch of signed rows; False, and no change, if it was committed before."""
        if self._fs.exists(self._path(f"{self.root}/commits/{self._name(batch)}")):
            return False
        at = f"data/{self._name(batch)}/{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.parquet(f"{self.root}/{at}")
        if self._create(batch, {"at": at}):
            return True
        self._fs.delete(self._path(f"{self.root}/{at}"), True)
        return False

    def _sums(self, entries: dict[str, dict]) -> DataFrame:
        folded = {b for e in entries.values() for b in e.get("folds", ())}
        paths = sorted(f"{self.root}/{e['at']}" for b, e in entries.items() if b not in folded)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]).where(" or ".join(f"{c} <> 0" for c in SUMS))

    def totals(self) -> DataFrame:
        """Sums of all committed batches by key; keys whose every sum is 0 have gone."""
        return self._sums(self.committed())

    def compact(self, name: str) -> bool:
        """Fold all batches committed so far into the batch `name`. Folded batches stay known, so they still can't be committed
        twice. What others commit meanwhile is neither in the sums nor among the folded. Of two compactions that overlap in
        time, the later one sees the first and is refused, so that no batch is folded twice."""
        entries = self.committed()
        if any(e.get("name") == name for e in entries.values()):
            return False
        generation = sum("folds" in e for e in entries.values())
        at = f"data/{self._name(name)}/{uuid.uuid4().hex}"
        self._sums(entries).write.parquet(f"{self.root}/{at}")
        if not self._create(f"\0fold {generation}", {"at": at, "folds": sorted(entries), "name": name}):
            return False
        return True


_encodings: dict[str, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_counts(docs: DataFrame, path: str, name: str, carry: list[str], text_col: str = "text") -> DataFrame:
    """Columns in `carry` with n_tokens and n_bytes of the whole text under the byte-level BPE vocabulary at `path`, read on the driver.

    One row for each row of docs, repeated ones too. Null counts as the empty text: no tokens, no bytes. Columns in `carry` that are
    themselves called n_tokens or n_bytes give way to the counts; any other name, text_col included, may be carried.
    """
    import public_tokenizers

    shipped = docs.sparkSession.sparkContext.broadcast((load_ranks(path), public_tokenizers.PATTERN))
    carry = [c for c in carry if c not in ("n_tokens", "n_bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        if name not in _encodings:
            ranks, pattern = shipped.value
            _encodings[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _encodings[name].encode_ordinary
        for batch in batches:
            raw = texts_of(batch.column(batch.num_columns - 1))
            n = [len(encode(t.decode("utf-8", "replace"))) if t else 0 for t in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array([len(t) for t in raw], pa.int64())], [*batch.schema.names[:-1], "n_tokens", "n_bytes"])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("body"))
    schema = "".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(carry)))
    return rows.mapInArrow(run, f"{schema}n_tokens long, n_bytes long").toDF(*carry, "n_tokens", "n_bytes")
