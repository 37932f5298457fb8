"""Files in a shared folder, a text each: <prefix><doc_id>_lz77.bin has 16 bytes a factor, little-endian source and length;
<prefix><doc_id>_psv.bin and _nsv.bin have 4 bytes a position, the neighbour of smaller value in text order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI that driver and executors share, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _write_whole(fs: pafs.FileSystem, at: str, name: str, data: bytes, attempt: int) -> None:
    with fs.open_output_stream(f"{at}/.{name}.{attempt}") as out:
        out.write(data)
    fs.move(f"{at}/.{name}.{attempt}", f"{at}/{name}")


#: What stands for "none" in a neighbour file.
NONE = 2**32 - 1


def write_neighbour_files(corpus: DataFrame, folder: str, prefix: str = "") -> DataFrame:
    """Write both neighbour files of each text (doc_id, bytes) that isn't empty, below 2**32 - 1 bytes; returns (doc_id, file, n_bytes), lazily.

    Larger texts, and tables rather than files, go by operators.large.neighbours and Parquet.
    """
    from ..operators import kernels as K
    from ..operators import local

    def make(ids, b):
        from pyspark import TaskContext

        fs, at = open_store(folder)
        fs.create_dir(at, recursive=True)
        psv, nsv, _, _ = K.candidates(b, every=False)
        out = {"doc_id": [], "file": [], "n_bytes": []}
        for doc_id, i, j in zip(ids, b.starts.tolist(), b.ends.tolist(), strict=True):
            for kind, values in (("psv", psv[i:j]), ("nsv", nsv[i:j])) if j > i else ():
                data = np.where(values < 0, NONE, values - i).astype("<u4").tobytes()
                _write_whole(fs, at, f"{prefix}{doc_id}_{kind}.bin", data, TaskContext.get().taskAttemptId())
                for k, x in (("doc_id", doc_id), ("file", f"{prefix}{doc_id}_{kind}.bin"), ("n_bytes", len(data))):
                    out[k].append(x)
        return out

    return local.over_texts(corpus, make, "doc_id bigint, file string, n_bytes bigint")


def write_factor_files(encoded: DataFrame, folder: str, prefix: str = "") -> DataFrame:
    """Write the factors column of (doc_id, factors) to files in a shared folder; returns (doc_id, file, n_bytes), lazily.

    A file is written under another name first and then moved, so a repeated task leaves whole files only.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = open_store(folder)
        fs.create_dir(at, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in rows:
            names, sizes = [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, data = f"{prefix}{doc_id}_lz77.bin", raw.as_py()
                _write_whole(fs, at, name, data, attempt)
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(sizes, pa.int64())], names=["doc_id", "file", "n_bytes"])

    return encoded.select("doc_id", "factors").mapInArrow(run, "doc_id bigint, file string, n_bytes bigint")
