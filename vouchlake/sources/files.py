"""Files as bytes, read in chunks: hash, size, and what their first bytes tell.

Spark lists the files (names and lengths, no content) and packs them into tasks by size; a task reads one
file after another in pieces of ``CHUNK`` bytes. A hash and a gzip stream have one state, so a file is
one task's work, but never one value: memory does not grow with it, and a file may be larger than 2 GB.
"""

from __future__ import annotations

import codecs
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .lines import PLACE, read_lines

CHUNK = 1 << 20
#: Lines or letters of one batch of unpacked lines.
LINES, LETTERS = 10_000, 4 << 20
GZIP = b"\x1f\x8b"
FACTS = "file string, size long, gzip boolean, kind string, head string, sha256 string"
UNPACKED = "file string, seq long, value string"


def _listed(spark: SparkSession, path) -> DataFrame:
    """(path, file): ``path`` as a task opens it, ``file`` as ``_metadata.file_path`` names it elsewhere."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))


def _opened(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    authority, _, name = rest.lstrip("/").partition("/")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme == "s3":
        return fs.FileSystem.from_uri(f"s3://{authority}")[0].open_input_stream(f"{authority}/{name}", compression=None)
    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0].open_input_stream("/" + name, compression=None)


def _chunks(path: str, size: int):
    with _opened(path) as stream:
        while piece := stream.read(size):
            yield piece


def _unpacked(chunks):
    """Bytes of a gzip stream of one or more members."""
    machine = zlib.decompressobj(31)
    for piece in chunks:
        while piece:
            out = machine.decompress(piece, CHUNK)
            if out:
                yield out
            if machine.eof:
                piece = machine.unused_data
                # Zero bytes may pad a stream after its last member.
                piece = piece.lstrip(b"\0") if not piece.startswith(GZIP) else piece
                machine = zlib.decompressobj(31)
            else:
                piece = machine.unconsumed_tail
    tail = machine.flush()
    if tail:
        yield tail


def _first_line(chunks) -> bytes:
    head = b""
    for piece in chunks:
        head += piece
        if b"\n" in piece:
            break
    return head.partition(b"\n")[0].removeprefix(codecs.BOM_UTF8).removesuffix(b"\r")


def _facts_task(size: int, whole: bool):
    def run(batches):
        for batch in batches:
            rows = {name: [] for name in ("file", "size", "gzip", "kind", "head", "sha256")}
            for path, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunks = _chunks(path, size)
                first = next(chunks, b"")
                packed = first.startswith(GZIP)
                pieces = _chunks(path, size)
                head = _first_line(_unpacked(pieces) if packed else pieces).decode(errors="replace")
                pieces.close()
                state, length = hashlib.sha256(first), len(first)
                if whole:
                    for piece in chunks:
                        state.update(piece)
                        length += len(piece)
                chunks.close()
                rows["file"].append(file)
                rows["size"].append(length if whole else None)
                rows["gzip"].append(packed)
                rows["kind"].append("jsonl" if head.lstrip().startswith("{") else "csv")
                rows["head"].append(head)
                rows["sha256"].append(state.hexdigest() if whole else None)
            types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

    return run


def file_facts(spark: SparkSession, path, chunk: int = CHUNK, whole: bool = True) -> DataFrame:
    """(file, size, gzip, kind, head, sha256) of every file.

    ``gzip`` is told by the first two bytes; ``head`` is the first line, unpacked where needed, and ``kind`` is jsonl
    if that begins with a brace, else csv; an empty file has no row. ``sha256`` and ``size`` are those of the stored
    bytes; ``whole=False`` reads the first line only and leaves both null.
    """
    return _listed(spark, path).mapInArrow(_facts_task(chunk, whole), FACTS)


def _lines_task(size: int):
    def run(batches):
        for batch in batches:
            for path, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _line_batches(file, _unpacked(_chunks(path, size)))

    return run


def _line_batches(file: str, pieces):
    decode = codecs.getincrementaldecoder("utf-8")(errors="replace")
    held, rest, seq, letters = [], [], 0, 0

    def batch():
        columns = [pa.array([file] * len(held), pa.string()), pa.array(range(seq - len(held), seq), pa.int64()), pa.array(held, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file", "seq", "value"])

    for piece in pieces:
        first, *more = decode.decode(piece).split("\n")
        rest.append(first)
        for line in more:
            held.append("".join(rest))
            seq, letters, rest = seq + 1, letters + len(held[-1]), [line]
            if len(held) >= LINES or letters >= LETTERS:
                yield batch()
                held, letters = [], 0
    rest.append(decode.decode(b"", True))
    if last := "".join(rest):
        held.append(last)
        seq += 1
    if held:
        yield batch()


def all_lines(spark: SparkSession, path, chunk: int = CHUNK) -> DataFrame:
    """(file, block, seq, line) of every line, as ``lines.read_lines``, also of gzip files without the name.

    Spark unpacks by name and would take such a file for text; it is unpacked piece by piece instead.
    """
    odd = file_facts(spark, path, chunk, whole=False).filter(F.col("gzip") & ~F.col("file").endswith(".gz")).select("file")
    text = read_lines(spark, path).select(*PLACE, "line").join(odd, "file", "left_anti")
    names = _listed(spark, path).join(odd, "file", "left_semi").select("path", "file")
    unpacked = names.mapInArrow(_lines_task(chunk), UNPACKED)
    return text.unionByName(unpacked.select("file", F.lit(0).cast("bigint").alias("block"), "seq", F.col("value").alias("line")))
