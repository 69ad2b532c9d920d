"""Chunking as a table function: one Arrow pass from files to chunk rows."""

from __future__ import annotations

import hashlib
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from corpusgraph.operators import chunking
from corpusgraph.operators.chunking.base import Options, Source
from corpusgraph.schemas import CHUNK_FIELDS, METADATA

#: Chunk rows that go on in one batch hold about so many bytes.
BATCH_BYTES = 8 << 20


def chunk_files(files: DataFrame, options: Options = Options(), routing: str = "full", path_col: str = "path", content_col: str = "content", mime_col: str | None = "mime_type", language_col: str | None = "language", columns: Collection[str] | None = None) -> DataFrame:
    """The chunks of each file: file_path, chunker, warnings, id, content_hash and the chunk fields.

    content may be text or binary. A null or empty file has no chunks. A chunk's id is the digest
    of its path, place and content hash, as equal chunks of two files are two. Files are read
    where they lie; nothing is shuffled. columns are those of the result, all unless they are given:
    the others are neither made nor sent.
    """
    every = _parse_datatype_string(f"file_path string, chunker string, warnings array<string>, id string, content_hash string, {CHUNK_FIELDS}")
    fields = StructType([f for f in every if columns is None or f.name in columns])
    optional = lambda c: F.col(c).cast("string") if c else F.lit("")
    own = files.select(F.col(path_col).cast("string").alias("p"), F.col(content_col).cast("binary").alias("c"), optional(mime_col).alias("m"), optional(language_col).alias("l"))
    kept = frozenset(fields.names)
    members = {k: [f.split(" ")[0] for f in v.split(", ")] for k, v in METADATA.items() if k in kept}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(fields)
        out, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(4)), strict=True):
                path, content, mime, language = (x.as_py() for x in row)
                name, found, warnings = chunking.REGISTRY.chunk(Source(content or b"", mime or "", language or "", path or ""), options, routing)
                for c in found:
                    row = {"file_path": path, "chunker": name, "warnings": warnings}
                    if "id" in kept or "content_hash" in kept:
                        row["content_hash"] = digest = hashlib.sha256(c.content.encode("utf-8", "replace")).hexdigest()
                        if "id" in kept:
                            row["id"] = hashlib.sha256(f"{path}\n{c.index}\n{digest}".encode()).hexdigest()
                    row |= {"index": c.index, "content": c.content, "start_offset": c.start_offset, "end_offset": c.end_offset, "chunk_type": c.chunk_type, "token_estimate": c.token_estimate}
                    row |= {v: {m: c.meta[v].get(m) for m in members[v]} if v in c.meta else None for v in members}
                    out.append(row)
                    held += len(c.content) + 500
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, target)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, target)

    return own.mapInArrow(run, fields)
