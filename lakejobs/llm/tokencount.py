"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The lengths of its tokens' bytes give each token's span; the spans are joined
with the document's sections (intervals of characters) by binary search, and each section gets the tokens allocated to
it. The rule for a token that crosses a boundary is explicit:

* "most" (default): the section that holds most of its bytes; of equals, the earlier one;
* "first": the section that holds its first byte, whether or not others hold more.

Tokens that lie in no section at all count as outside. The counts of all sections and the outside add up to the count
of the whole document, which counts of separately encoded sections don't.

Defined cases: null and empty texts have no tokens; a document without sections has all tokens outside; empty sections
get none; sections must not overlap (they are sorted; a null list is empty); offsets beyond the text are cut; repeated
rows are counted alike; an empty table gives no rows; extra columns are kept by attribute(), but for those named like one
that it adds, which are replaced.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "first")


def read_ranks(path: str = RANKS) -> bytes:
    return open(path, "rb").read()


@functools.lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str = PATTERN):  # noqa: ANN201
    """The public library's encoder, and the byte length of each token; once per worker process."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
    lengths[list(table.values())] = [len(t) for t in table]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths


def byte_offsets(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.append(begins, len(raw))[np.clip(places, 0, len(begins))]


def allocate(begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a boundary. Spans [begin, end) of tokens, [first, last)
    of sections, both sorted and without overlap."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    if not len(first):
        return np.full(len(begin), -1), np.zeros(len(begin), dtype=bool)
    low = np.searchsorted(last, begin, side="right")  # the first section that ends after the token begins
    high = np.searchsorted(first, end, side="left") - 1  # the last section that begins before the token ends
    section = np.where(low <= high, np.minimum(low, len(first) - 1), -1)
    inside = (section >= 0) & (first[section] <= begin) & (end <= last[section])
    crossing = (section >= 0) & ~inside
    for t in np.flatnonzero(crossing):
        if rule == "first":
            section[t] = low[t] if first[low[t]] <= begin[t] else -1
            continue
        own = np.arange(low[t], high[t] + 1)
        shared = np.minimum(last[own], end[t]) - np.maximum(first[own], begin[t])
        section[t] = own[int(shared.argmax())] if shared.max() > 0 else -1
    return section, crossing


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text; a line holds the line end that closes it."""
    stops = np.flatnonzero(raw == 0x0A) + 1
    ends = stops if len(stops) and stops[-1] == len(raw) or not len(raw) else np.append(stops, len(raw))
    return np.append(0, ends)[:-1], ends


def attribute(docs: DataFrame, sections: str | None = "sections", text: str = "text", ranks: bytes | None = None, rule: str = "most", keep_text: bool = True) -> DataFrame:
    """docs with __n_tokens, __outside, and __counts: array of (start, end, n_tokens, n_crossing), one for each section.

    sections: a column array<struct<start:int,end:int>> of character offsets, end exclusive; None: the lines of the text.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks if ranks is not None else read_ranks())
    fields = [f for f in docs.schema if f.name not in (sections, "__n_tokens", "__outside", "__counts") and (keep_text or f.name != text)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = encoder(shared.value)
        for batch in batches:
            names = batch.schema.names
            keep = [names.index(f.name) for f in fields]
            texts = common.texts(batch, text)
            for a, b in common.steps([len(t) for t in texts]):
                part = batch.slice(a, b - a)
                tokens, outside = np.zeros(b - a, dtype=np.int64), np.zeros(b - a, dtype=np.int64)
                begins, ends, numbers, crossings, sizes = [], [], [], [], []
                given = part.column(names.index(sections)).to_pylist() if sections is not None else [None] * (b - a)
                for i, (t, own) in enumerate(zip(texts[a:b], given, strict=True)):
                    size = lengths[np.array(coder.encode_ordinary(t.decode()), dtype=np.int64)]
                    end = np.cumsum(size)
                    raw = np.frombuffer(t, dtype=np.uint8)
                    if sections is None:
                        first, last = line_spans(raw)
                        before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                        spans = np.stack([before[first], before[last]], axis=1)
                    else:
                        spans = np.array(sorted((s["start"], s["end"]) for s in own or ()), dtype=np.int64).reshape(-1, 2)
                        first, last = byte_offsets(raw, spans[:, 0]), byte_offsets(raw, spans[:, 1])
                    if (first[1:] < last[:-1]).any():
                        raise ValueError("sections overlap")
                    section, crossing = allocate(end - size, end, first, last, rule)
                    held = section >= 0
                    tokens[i], outside[i] = len(size), int((~held).sum())
                    begins.append(spans[:, 0])
                    ends.append(spans[:, 1])
                    numbers.append(np.bincount(section[held], minlength=len(spans)))
                    crossings.append(np.bincount(section[held & crossing], minlength=len(spans)))
                    sizes.append(len(spans))
                flat = [np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (begins, ends, numbers, crossings)]
                structs = pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int64()), pa.array(flat[3], pa.int64())], fields=list(kind.value_type))
                counts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in keep], pa.array(tokens), pa.array(outside), counts.cast(kind)], names=[*[names[i] for i in keep], "__n_tokens", "__outside", "__counts"]
                )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    added = "`__n_tokens` long, `__outside` long, `__counts` array<struct<start:int,end:int,n_tokens:bigint,n_crossing:bigint>>"
    return docs.mapInArrow(run, ", ".join([*kept, added]))


def field_sections(columns: list[str], separator: str = "\n"):  # noqa: ANN201
    """(text, sections) columns of a document made of fields joined by a separator; null fields are empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    at, sections = F.lit(0), []
    for i, p in enumerate(parts):
        end = at + F.char_length(p)
        sections.append(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + (len(separator) if i < len(parts) - 1 else 0)
    return F.concat_ws(separator, *parts), F.array(*sections)


def query(spark: SparkSession, sf_dir: str, path: str = RANKS) -> DataFrame:
    """op1_token_counts: one row for each document and line; a document without lines has one row of section -1."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = attribute(docs, None, ranks=read_ranks(path), keep_text=False)
    lines = out.select("doc_id", F.col("__n_tokens").alias("doc_tokens"), F.col("__outside").alias("outside_tokens"), F.posexplode_outer("__counts").alias("section", "s"))
    return lines.select(
        "doc_id", F.coalesce("section", F.lit(-1)).alias("section"), F.coalesce("s.start", F.lit(0)).alias("start"), F.coalesce("s.end", F.lit(0)).alias("end"),
        F.coalesce("s.n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce("s.n_crossing", F.lit(0).cast("long")).alias("n_crossing"), "doc_tokens", "outside_tokens",
    )
