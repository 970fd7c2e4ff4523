"""Splittable reader of JSON files that hold one object keyed by id, of any size and in any store that Spark reads.

The text is read in pieces that end with a closing brace, which Spark's text source splits by byte ranges, and joined to chunks. Where
a chunk starts, one can't know whether it is inside a string. So each chunk first gives a small transition table: for
each of the three states it may start in, the state it ends in and by how much the nesting changes. Composed in file order, the tables give
every chunk's true start; then the chunks yield the entries of the outer object side by side. Only entries cut by a chunk's end are shuffled
to be joined, and each entry is parsed by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from routelore.sources.staging import stage_table

CHUNK_BYTES = 8 << 20
OUTSIDE, INSIDE, ESCAPED = range(3)
CLOSE = "}"
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.S)
_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\],]', re.S)
_CHUNK = "file string, size long, start long, chunk long, bytes long, text string, " + ", ".join(f"end{s} int, delta{s} long" for s in range(3))


def leave_string(text: str, state: int) -> tuple[int, int]:
    """Where the string ends that the text starts in, and the state there."""
    if state == OUTSIDE:
        return 0, OUTSIDE
    if state == ESCAPED and not text:
        return 0, ESCAPED
    at = _REST.match(text, 1 if state == ESCAPED else 0).end()
    if at == len(text):
        return at, INSIDE
    return (at + 1, OUTSIDE) if text[at] == '"' else (len(text), ESCAPED)


def transition(text: str, state: int) -> tuple[int, int]:
    """The state at the end, and the brackets opened less those closed outside of strings."""
    at, state = leave_string(text, state)
    if state != OUTSIDE:
        return state, 0
    plain, quote, tail = _STRING.sub("", text[at:]).partition('"')
    if quote:
        state = ESCAPED if (len(tail) - len(tail.rstrip("\\"))) % 2 else INSIDE
    return state, sum(plain.count(c) for c in "{[") - sum(plain.count(c) for c in "}]")


def fragments(text: str, state: int, depth: int) -> list[tuple[int, bool, bool, str | None]]:
    """Pieces of the outer object's entries: (number in the chunk, begun before it, open at its end, text); at last the
    open piece, or one without text."""
    at, state = leave_string(text, state)
    begun = depth > 0
    out, number, start = [], 0, 0 if begun else None
    for m in _TOKEN.finditer(text, at) if state == OUTSIDE else ():
        c = text[m.start()]
        if c in "{[":
            depth += 1
            if depth == 1:
                if c == "[" or text[start or 0 : m.start()].strip():
                    raise ValueError(f"not a keyed object: {text[m.start():][:80]!r}")
                start = m.end()
        elif c in "}]":
            depth -= 1
            if depth < 0:
                raise ValueError(f"unmatched bracket: {text[max(0, m.start() - 80):m.end()]!r}")
            if depth == 0:
                out.append((number, begun, False, text[start : m.start()]))
                number, start, begun = number + 1, m.end(), False
        elif c == "," and depth == 1:
            out.append((number, begun, False, text[start : m.start()]))
            number, start, begun = number + 1, m.end(), False
    if depth == 0:
        if text[start or 0 :].strip():
            raise ValueError(f"text outside of the object: {text[start or 0:].strip()[:80]!r}")
        return [*out, (number, False, False, None)]
    return [*out, (number, begun, True, text[start:])]


def chunks(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    """The files' text in chunks with their transition tables. After a file's last piece a brace may be added that isn't there."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in _CHUNK.split(", ")])
        where, parts, held, number = None, [], 0, 0

        def chunk() -> pa.RecordBatch:
            text = CLOSE.join(parts) + CLOSE
            table = [x for s in range(3) for x in transition(text, s)]
            row = [*where, number, len(text.encode()), text, *table]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for b in batches:
            for value, *own in zip(*(b.column(c).to_pylist() for c in ("value", "file", "size", "start"))):
                if own != where or held >= chunk_bytes:
                    if parts:
                        yield chunk()
                    number = number + 1 if own == where else 0
                    where, parts, held = own, [], 0
                parts.append(value)
                held += len(value) + 1
        if parts:
            yield chunk()

    text = spark.read.option("lineSep", CLOSE).text(path)
    named = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"))
    return named.mapInArrow(joined, _CHUNK)


def composed(tables: DataFrame) -> DataFrame:
    """file, start, chunk, state and depth at the chunk's start, and whether its last brace was added. One task per file, a row per chunk."""

    def follow(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["start", "chunk"])
        state, depth, rows = OUTSIDE, 0, []
        for r in own.itertuples():
            rows.append((r.file, r.start, r.chunk, state, depth, False))
            state, change = [(r.end0, r.delta0), (r.end1, r.delta1), (r.end2, r.delta2)][state]
            depth += change
        size, read = own["size"].iloc[0], own["bytes"].sum()
        added = read == size + 1 or (read != size and depth == -1)  # of a compressed file only the nesting tells
        if added:
            rows[-1] = (*rows[-1][:5], True)
        if state != OUTSIDE or depth + added != 0:
            raise ValueError(f"{own['file'].iloc[0]} is not a whole JSON object: it ends {'inside a string' if state else f'at depth {depth + added}'}")
        return pd.DataFrame(rows, columns=["file", "start", "chunk", "state", "depth", "added"])

    return tables.groupBy("file").applyInPandas(follow, "file string, start long, chunk long, state int, depth long, added boolean")


def entries(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """file and entry, the text ``"key": value`` of each entry of each file's outer object. An incomplete file is an error."""
    held = stage_table(chunks(spark, path, chunk_bytes), "chunks")
    at = ["file", "start", "chunk"]
    begins = stage_table(composed(held.drop("text")), "chunk_starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = fragments(r["text"][:-1] if r["added"] else r["text"], r["state"], r["depth"])
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.bool_(), pa.bool_(), pa.string()))]
                place = [pa.array([r[c]] * len(found), pa.string() if c == "file" else pa.int64()) for c in at]
                yield pa.RecordBatch.from_arrays([*place, *columns], names=[*at, "number", "begun", "open", "text"])

    pieces = held.select(*at, "text").join(begins, at).mapInArrow(cut, "file string, start long, chunk long, number long, begun boolean, open boolean, text string")
    pieces = stage_table(pieces, "entry_pieces")
    whole = pieces.where("NOT begun AND NOT open AND text IS NOT NULL").select("file", "text")
    many = pieces.groupBy(*at).agg(F.max("number").alias("many"))
    before = Window.partitionBy("file").orderBy("start", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = many.select(*at, F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first"))
    parts = pieces.where("begun OR open").join(first, at).groupBy("file", (F.col("first") + F.col("number")).alias("entry"))
    parts = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk", "text"))), lambda p: p["text"]), "").alias("text"))
    both = whole.unionAll(parts.select("file", "text"))
    return both.where(F.col("text").rlike(r"\S")).withColumnRenamed("text", "entry")


def keyed_rows(spark: SparkSession, path: str, value: T.DataType, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """route_id and body of every entry; an entry that can't be parsed is an error, a repeated key gives a row each time."""
    parsed = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), T.MapType(T.StringType(), value), {"mode": "FAILFAST", "allowNonNumericNumbers": "true"})
    return entries(spark, path, chunk_bytes).select(F.explode(parsed).alias("route_id", "body"))
