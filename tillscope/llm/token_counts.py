"""Token counts by separator scan over flat token files.

A flat file holds the ids of document after document, each closed by an
end-of-document id, and has no index. Files are cut into blocks of equal size;
each block is searched for separators at once, and a prefix scan over the block
summaries stitches documents that cross a boundary.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.packing import WordCoder
from tillscope.session import materialise, scratch_path, ship_package

_LOADED: dict[str, WordCoder] = {}


def _plain_coder(path: str) -> WordCoder:
    """A coder for which strings of special tokens are ordinary text."""
    if path not in _LOADED:
        _LOADED[path] = WordCoder(path)
        _LOADED[path].library.encode_special_tokens = True
    return _LOADED[path]


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str,
    separator: int,
    dtype: str = "<u2",
    max_bytes: int = 256 << 20,
) -> DataFrame:
    """Write flat token files; return ``(path, doc_no, doc_id, bytes)``, materialised.

    One row per document in file order, and one row per file with its size (and
    null document columns). Each task writes files of its own, so a lost attempt
    leaves only files that no row names. Strings of special tokens in a text are
    ordinary text and never give the separator.
    """
    ship_package(docs.sparkSession)
    names = ["path", "doc_no", "doc_id", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        coder = _plain_coder(path)
        close = np.array([separator], dtype).tobytes()
        out, own, count, size = None, "", 0, 0

        def rows(numbers: list, ids: list, sizes: list) -> pa.RecordBatch:
            columns = [pa.array([own] * len(numbers), pa.string())]
            columns += [pa.array(v, pa.int64()) for v in (numbers, ids, sizes)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            numbers, ids = [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if out is None:
                    own = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.tok"
                    out = system.open_output_stream(
                        f"{base.rstrip('/')}/{own.rpartition('/')[2]}", compression=None
                    )
                    count = size = 0
                tokens = np.frombuffer(coder.encode(text.as_py() or ""), "<u4").astype(dtype)
                out.write(tokens.tobytes() + close)
                numbers.append(count)
                ids.append(doc_id.as_py())
                count, size = count + 1, size + tokens.nbytes + len(close)
                if size >= max_bytes:
                    out.close()
                    yield rows(numbers, ids, [None] * len(numbers))
                    yield rows([None], [None], [size])
                    out, numbers, ids = None, [], []
            if numbers:
                yield rows(numbers, ids, [None] * len(numbers))
        if out is not None:
            out.close()
            yield rows([None], [None], [size])

    return materialise(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            run, "path string, doc_no long, doc_id long, bytes long"
        )
    )


def scan_blocks(
    files: DataFrame, separator: int, dtype: str = "<u2", block_tokens: int = 1 << 21
) -> DataFrame:
    """``(path, block, n_tokens, separators)`` of every block of ``files(path, bytes)``.

    ``separators`` are token positions in the file. A file whose size is no whole
    number of tokens raises.
    """
    ship_package(files.sparkSession)
    width = np.dtype(dtype).itemsize
    blocks = files.select(
        "path",
        "bytes",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {width * block_tokens}"))
        ).alias("block"),
    ).where("bytes > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total, block in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "block")]):
                if total % width:
                    raise ValueError(f"{path}: {total} bytes are no whole number of tokens")
                first = block * block_tokens
                length = min(width * block_tokens, total - width * first)
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    tokens = np.frombuffer(file.read_at(length, width * first), dtype)
                found = np.flatnonzero(tokens == separator) + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]),
                        pa.array([block], pa.int64()),
                        pa.array([len(tokens)], pa.int64()),
                        pa.array([found], pa.list_(pa.int64())),
                    ],
                    ["path", "block", "n_tokens", "separators"],
                )

    # Blocks of one file go to many tasks.
    return blocks.repartition("path", "block").mapInArrow(
        run, "path string, block long, n_tokens long, separators array<bigint>"
    )


def stitch(scanned: DataFrame) -> DataFrame:
    """``(path, doc_no, start, n_tokens)`` of every document, from ``scan_blocks``.

    The exclusive prefix over a file's blocks, one row each, gives the number of
    separators before a block and the last one's position; a document that crosses
    blocks starts after that position. Tokens behind the last separator of a file
    are a document without an end. The separator itself is not counted.
    """
    scanned = materialise(scanned)  # one row per block, one number per document
    own = scanned.select(
        "path",
        "block",
        F.size("separators").cast("long").alias("n"),
        F.element_at("separators", F.when(F.size("separators") > 0, -1)).alias("last"),
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = own.select(
        F.col("path").alias("_path"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before"),
    )
    placed = scanned.join(
        prefix, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block"))
    )
    closed = placed.select(
        "path",
        "docs_before",
        "last_before",
        "separators",
        F.posexplode("separators").alias("at", "stop"),
    ).select(
        "path",
        (F.col("docs_before") + F.col("at")).alias("doc_no"),
        (
            F.when(F.col("at") == 0, F.col("last_before")).otherwise(
                F.get("separators", F.col("at") - 1)
            )
            + 1
        ).alias("start"),
        "stop",
    )
    ends = (
        scanned.groupBy("path")
        .agg(
            F.sum("n_tokens").alias("stop"),
            F.sum(F.size("separators")).alias("doc_no"),
            F.coalesce(F.max(F.array_max("separators")), F.lit(-1)).alias("last"),
        )
        .where("last < stop - 1")
        .select("path", "doc_no", (F.col("last") + 1).alias("start"), "stop")
    )
    return closed.unionByName(ends).select(
        "path", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens")
    )


def count_tokens(
    docs: DataFrame, path: str, separator: int, folder: str | None = None
) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document, read back from flat token files.

    Null and empty texts have 0 tokens. Repeated rows and rows without an id each
    keep a row; an empty table gives none. Other columns are dropped.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    written = write_token_files(docs, folder, path, separator)
    files = written.where("bytes IS NOT NULL").select("path", "bytes")
    counts = stitch(scan_blocks(files, separator)).select(
        F.col("path").alias("_path"), F.col("doc_no").alias("_no"), "n_tokens"
    )
    return (
        written.where("bytes IS NULL")
        .join(counts, (F.col("path") == F.col("_path")) & (F.col("doc_no") == F.col("_no")))
        .select("doc_id", "n_tokens")
    )
