"""Token ids as Arrow files of equal-length sequences with masks.

Documents are range-partitioned by id and sorted; each task encodes its
documents, appends the end id to each, and writes one pair of Arrow IPC files
(the stream format with a footer, so batches can be addressed):

* ``tokens-N.arrow``: batches of ``rows_per_batch`` rows, columns ``ids``,
  ``valid`` and ``ends``, each a fixed-size list of ``length``.  ``valid`` is
  false on the padding of the last row; ``ends`` marks each document's last id
  (the end id may also occur inside a text, so it cannot serve as a mark).
* ``docs-N.arrow``: document id and its number of ids, in the same order.

Buffers are not compressed: memory-mapped, row ``i`` is a view into batch
``i // rows_per_batch``.  Files move into place when complete, so a task that
is retried or runs twice leaves the same single file.

Defined cases: null text is an empty text (one end id); repeated ids stay, in
the order of their texts; a null id sorts first; an empty table writes no file;
input columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import n_partitions, new_path, stored, table
from .files import committed, open_readable
from .tokens import encoder
from .wordhash import slices

MANIFEST = "part int, tokens string, docs string, n_docs long, n_tokens long"


def _bits(mask: np.ndarray, length: int):
    import pyarrow as pa

    packed = pa.py_buffer(np.packbits(mask, bitorder="little").tobytes())
    return pa.FixedSizeListArray.from_arrays(pa.BooleanArray.from_buffers(pa.bool_(), len(mask), [None, packed]), length)


class _Writer:
    """Fills fixed-size rows from a run of documents; holds one batch."""

    def __init__(self, stream, dtype: np.dtype, length: int, rows: int):
        import pyarrow as pa

        self.pa, self.dtype, self.length, self.size = pa, dtype, length, length * rows
        as_list = lambda kind: pa.list_(pa.field("item", kind), length)
        self.schema = pa.schema([("ids", as_list(pa.from_numpy_dtype(dtype))), ("valid", as_list(pa.bool_())), ("ends", as_list(pa.bool_()))])
        self.out = pa.ipc.new_file(stream, self.schema)
        self.ids, self.ends, self.n = np.zeros(self.size, dtype), np.zeros(self.size, bool), 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.size - self.n)
            self.ids[self.n:self.n + take] = ids[at:at + take]
            self.n, at = self.n + take, at + take
            if at == len(ids):
                self.ends[self.n - 1] = True
            if self.n == self.size:
                self._flush()

    def _flush(self) -> None:
        full = -(-self.n // self.length) * self.length
        if full:
            values = self.pa.array(self.ids[:full])
            valid = np.arange(full) < self.n
            self.out.write_batch(self.pa.record_batch(
                [self.pa.FixedSizeListArray.from_arrays(values, self.length), _bits(valid, self.length), _bits(self.ends[:full], self.length)],
                schema=self.schema))
        self.ids[:], self.ends[:], self.n = 0, False, 0

    def close(self) -> None:
        self._flush()
        self.out.close()


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", length: int = 2048, rows_per_batch: int = 256,
                      n_files: int | None = None) -> DataFrame:
    """Write all texts in ascending id order below ``folder``; returns the stored manifest (one row per file pair)."""
    spark = df.sparkSession
    n_files = n_files or n_partitions(spark)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, n_docs, n_tokens = encoder(tokenizer_path), 0, 0
        end = np.asarray([end_id], enc.dtype).tobytes()
        tokens, docs = f"{folder}/tokens-{part:06d}.arrow", f"{folder}/docs-{part:06d}.arrow"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        index = pa.schema([("doc_id", first.schema.field(0).type), ("n_tokens", pa.int64())])
        with committed(tokens) as stream, committed(docs) as beside:
            out, listed = _Writer(stream, enc.dtype, length, rows_per_batch), pa.ipc.new_file(beside, index)
            for whole in _chain(first, batches):
                for batch in slices(whole, 1, 1 << 21):
                    counts = []
                    for data in enc.encode_column(batch.column(1)):
                        ids = np.frombuffer(data + end, enc.dtype)
                        out.add(ids)
                        counts.append(len(ids))
                    listed.write_batch(pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], schema=index))
                    n_docs, n_tokens = n_docs + len(counts), n_tokens + sum(counts)
            out.close()
            listed.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tokens": [tokens], "docs": [docs],
                                          "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    ordered = (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
               .repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text"))
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _chain(first, rest):
    yield first
    yield from rest


class TokenFile:
    """Random access to the sequences of one token file; ``ids(i)`` is a view, not a copy."""

    def __init__(self, path: str):
        import pyarrow as pa

        self.reader = pa.ipc.open_file(open_readable(path))
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        last = self.reader.num_record_batches - 1
        self.n = max(0, last) * self.rows + (self.reader.get_batch(last).num_rows if self.rows else 0)

    def __len__(self) -> int:
        return self.n

    def _row(self, i: int, column: str):
        return self.reader.get_batch(i // self.rows).column(column)[i % self.rows].values

    def ids(self, i: int) -> np.ndarray:
        return self._row(i, "ids").to_numpy(zero_copy_only=True)

    def mask(self, i: int, column: str = "valid") -> np.ndarray:
        return self._row(i, column).to_numpy(zero_copy_only=False)


def _runs(path: str):
    """The valid ids of a token file, batch by batch."""
    import pyarrow as pa

    reader = pa.ipc.open_file(open_readable(path))
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
        yield ids[: batch.column("valid").flatten().true_count]


def read_documents(tokens: str, docs: str):
    """(doc_id, ids as uint32) of each document of one file pair, in order; holds one batch and one document."""
    import pyarrow as pa

    runs, have = _runs(tokens), np.zeros(0, "<u4")
    listed = pa.ipc.open_file(open_readable(docs))
    for k in range(listed.num_record_batches):
        batch = listed.get_batch(k).to_pydict()
        for doc_id, n in zip(batch["doc_id"], batch["n_tokens"]):
            parts = [have]
            while (got := sum(map(len, parts))) < n:
                parts.append(next(runs).astype("<u4"))
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc_id, have[:n]
            have = have[n:]


def read_token_files(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    # One row per file: its start is the sum of ids in the files before it.
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.withColumn("before", before).select("tokens", "docs", "before")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["before"], []
                for doc_id, ids in read_documents(row["tokens"], row["docs"]):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _rows(pa, out)
                        out = []
                if out:
                    yield _rows(pa, out)

    return (listed.repartition(n_partitions(manifest.sparkSession))
            .mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def _rows(pa, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if k else pa.array(c) for k, c in enumerate(zip(*rows))],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_arrow_sequences(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token files and read back."""
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "token-files"),
                                 public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest)
