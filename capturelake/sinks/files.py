"""Sinks: Markdown files, chunk manifests, exports, content store, archives.  Files are written by the tasks that have them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import short_batches
from ..functions.urls import file_name
from ..storage import get, join, names, put, whole_file

FORMATS = ("json", "jsonl", "parquet")


def _write_each(df: DataFrame, folder: str, name: str, data: str) -> int:
    """Writes column ``data`` (string or binary) of every row to the file named by column ``name``; how many there were."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for n, d in zip(part.column("n"), part.column("d")):
                put(join(folder, n.as_py()), d.as_buffer())
            yield pa.RecordBatch.from_pydict({"written": [part.num_rows]})

    done = short_batches(df.select(F.col(name).alias("n"), F.col(data).cast("binary").alias("d"))).mapInArrow(run, "written long")
    return int(done.agg(F.coalesce(F.sum("written"), F.lit(0)).alias("n")).first()["n"])


def existing_files(folder: str) -> list[str]:
    return names(folder)


def write_markdown(docs: DataFrame, folder: str, overwrite: bool = False, extension: str = ".md", url: str = "url", document: str = "document") -> int:
    """``<name of the url>.md`` for each document; files that exist stay unless they are to be overwritten."""
    named = docs.withColumn("_file", F.concat(file_name(F.col(url)), F.lit(extension)))
    if not overwrite:
        there = docs.sparkSession.createDataFrame([(n,) for n in existing_files(folder)], "_file string")
        named = named.join(there, "_file", "left_anti")
    return _write_each(named, folder, "_file", document)


def write_chunk_manifests(chunks: DataFrame, folder: str, url: str = "doc_id") -> int:
    """``<name>.md.chunks.json`` with the chunk rows of each document."""
    row = F.to_json(F.struct(*chunks.columns))
    files = chunks.groupBy(url).agg(F.sort_array(F.collect_list(F.struct("start", "end", row.alias("j")))).alias("rows"))
    text = F.concat(F.lit("[\n  "), F.array_join(F.transform("rows", lambda r: r["j"]), ",\n  "), F.lit("\n]\n"))
    return _write_each(files.select(F.concat(file_name(F.col(url)), F.lit(".md.chunks.json")).alias("f"), text.alias("t")), folder, "f", "t")


def write_store(captures: DataFrame, folder: str, digest: str = "bytes_sha256", raw: str = "raw_bytes") -> int:
    """``<digest>`` once for each distinct body."""
    return _write_each(captures.dropDuplicates([digest]), folder, digest, raw)


def write_archives(archives: DataFrame, folder: str) -> int:
    return _write_each(archives, folder, "part", "archive")


def export(records: DataFrame, folder: str, kind: str) -> str:
    """documents.<kind>: jsonl and parquet as Spark folders, json as one array streamed to a file."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported export format: {kind!r} (one of {', '.join(FORMATS)})")
    path = join(folder, f"documents.{kind}")
    if kind == "parquet":
        records.write.mode("overwrite").parquet(path)
    elif kind == "jsonl":
        records.write.mode("overwrite").json(path)
    else:
        write_json_array(records, path)
    return path


def write_json_array(df: DataFrame, path: str) -> None:
    """One row a line, streamed partition by partition."""
    with whole_file(path) as f:
        f.write(b"[")
        for k, line in enumerate(df.toJSON().toLocalIterator()):
            f.write(((",\n  " if k else "\n  ") + line).encode())
        f.write(b"\n]\n")


def save_checkpoint(path: str, seen_hashes: list[str], manifest: list[dict], frontier: list[tuple[str, int]] | None = None, visited: list[str] | None = None) -> None:
    """A crawl's state as one JSON file, replaced as a whole."""
    held = {"manifest": manifest, "seen_hashes": sorted(seen_hashes), "visited": None if visited is None else sorted(visited), "frontier": None if frontier is None else [[u, d] for u, d in frontier]}
    put(path, json.dumps({k: v for k, v in held.items() if v is not None}, ensure_ascii=False).encode())


def load_checkpoint(path: str) -> tuple[list[str], list[dict], list[tuple[str, int]], list[str]]:
    """(seen hashes, manifest, frontier, visited); a missing or broken file is an empty state."""
    try:
        state = json.loads(get(path))
        return state.get("seen_hashes", []), state.get("manifest", []), [(u, int(d)) for u, d in state.get("frontier", [])], state.get("visited", [])
    except (OSError, ValueError, TypeError, AttributeError):
        return [], [], [], []
