"""Token ids of a whole corpus by a public byte-level BPE, with stretches that documents share encoded once.

Texts are cut where a rolling hash of their last 32 bytes says so (content-defined chunks, so equal stretches give equal
chunks wherever they begin). Chunks are counted by a 128-bit hash; those that occur more than once are encoded once,
by one owner, and their ids reused. What is encoded of a shared chunk is its middle, from its first to its last place where white space
follows another character: such a place is a border of the tokenizer's pre-tokens in any context, so these ids stay right in
every document. A join of two chunks is repaired by encoding the text between the last such place before and the first one after it,
so the result agrees exactly with encoding the text as a whole. A reused chunk's bytes are compared by hash in
each document.

Hashes are shuffled, texts once at most: to meet the list of their shared chunks, which is broadcast if it is small. In that one pass over the
texts each document encodes what is its own, and the owner of a chunk encodes it; then only documents with shared chunks are
assembled, from ids. A chunk that a third of all documents share is one encoded row, broadcast if the encoded chunks are few; its
copies are a side that skew-join handling may split. Texts below `LEAST` bytes aren't chunked: encoding them costs less than a join.

Defined results: null and empty texts get an empty list; ids don't include special tokens, and their strings in a text are
ordinary text; repeated or null document ids each keep their row. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.runtime import cut

#: Where the public vocabulary file is; the same path on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A cut once in so many bytes on average, least and most bytes of a chunk.
CHUNK, LEAST, MOST = 512, 128, 8_192
_TABLE = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)
#: Certain borders: a blank or line feed after a character that no definition counts as white space.
_BORDER = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")


@lru_cache(maxsize=4)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    return encoding(vocabulary).encode_ordinary(text)


def encode_array(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """`encode`, without a Python object for each id."""
    if not text:
        return np.zeros(0, np.uint32)
    return encoding(vocabulary).encode_to_numpy(text, allowed_special=set(), disallowed_special=())


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, by doubling."""
    h = _TABLE[data]
    for width in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
    return h


def bounds(data: np.ndarray, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; `marks` are the ascending places after which the rolling hash cuts."""
    ends, at, size = [], 0, len(data)
    for m in [*marks.tolist(), size]:
        while m - at > MOST:
            ends.append(_whole(data, at + MOST))
            at = ends[-1]
        if m - at >= LEAST and m < size:
            m = _whole(data, m)
            if m < size:
                ends.append(m)
                at = m
    if at < size:
        ends.append(size)
    return ends


def _whole(data: np.ndarray, at: int) -> int:
    """The next place from `at` that doesn't divide a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def texts_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, marks) of a column of texts without nulls."""
    array = batch.column(column).cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(array) else data[:0]
    offsets = offsets - offsets[0] if len(array) else offsets
    marks = np.flatnonzero(rolling(data) & np.uint32(0xFFFFFFFF - (0xFFFFFFFF >> (CHUNK.bit_length() - 1))) == 0) + 1 if len(data) else np.zeros(0, int)
    return data, offsets, marks


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    data, offsets, marks = texts_of(batch, column)
    first = np.searchsorted(marks, offsets[:-1] + LEAST)
    last = np.searchsorted(marks, offsets[1:])
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]]
        if len(text):
            yield i, text, bounds(text, marks[first[i] : last[i]] - offsets[i])


def middle(text: str) -> tuple[int, int] | None:
    """The first and last certain border of a chunk, in characters; None when there aren't two."""
    first = _BORDER.search(text)
    if first is None:
        return None
    last, at = None, len(text)
    while last is None:
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
        last = _BORDER.match(text, at)
    return (first.start(), at) if at > first.start() else None


def parts(text: bytes, shared: list[dict], vocabulary: str = VOCABULARY) -> tuple[list[np.ndarray], list[bytes]]:
    """What `text` encodes itself, around the middles of its `shared` chunks (start, size, h), and the hashes of these: one fewer than the parts."""
    own, hashes, at = [], [], 0
    for piece in sorted(shared, key=lambda p: p["start"]):
        start, end = piece["start"], piece["start"] + piece["size"]
        raw = text[start:end]
        if start < at or xxhash.xxh3_128_digest(raw) != piece["h"]:
            continue
        inner = split_middle(raw)
        if inner is None:
            continue
        own.append(encode_array(text[at : start + inner[0]].decode(), vocabulary))
        hashes.append(piece["h"])
        at = start + inner[1]
    own.append(encode_array(text[at:].decode(), vocabulary))
    return own, hashes


def split_middle(raw: bytes) -> tuple[int, int] | None:
    """`middle` of a chunk, in bytes."""
    words = raw.decode()
    at = middle(words)
    if at is None:
        return None
    head = len(words[: at[0]].encode())
    return head, head + len(words[at[0] : at[1]].encode())


#: Rows up to which the lists of shared chunks, and the encoded chunks, are broadcast.
BROADCAST_LISTS, BROADCAST_CHUNKS = 200_000, 20_000


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every document."""
    kind = dict(documents.dtypes)[id_col]
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, hashes = [], [], [], []
            for i, text, ends in _pieces(batch, "text"):
                if len(ends) == 1 and len(text) < LEAST:
                    continue
                raw, begin = text.tobytes(), 0
                for end in ends:
                    rows.append(i)
                    starts.append(begin)
                    sizes.append(end - begin)
                    hashes.append(xxhash.xxh3_128_digest(raw[begin:end]))
                    begin = end
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("t").take(at), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary())],
                ["id", "t", "start", "size", "h"],
            )

    # (id, t) names a text: rows that repeat both have the same chunks and the same ids.
    refs = cut(docs.where("id is not null and text <> ''").mapInArrow(chunk, f"id {kind}, t long, start int, size int, h binary").dropDuplicates(["id", "t", "start"]))
    owner = F.min(F.struct("id", "t", "start"))
    shared = refs.groupBy("h").agg(F.count("*").alias("times"), owner.alias("own")).where("times > 1").select("h", "own")
    met = refs.join(shared, "h").withColumn("owned", (F.col("own.id") == F.col("id")) & (F.col("own.t") == F.col("t")) & (F.col("own.start") == F.col("start")))
    lists = cut(met.groupBy("id", "t").agg(F.collect_list(F.struct("start", "size", "h", "owned")).alias("shared")))
    few = lists.count() <= BROADCAST_LISTS
    listed = docs.join(F.broadcast(lists) if few else lists, ["id", "t"], "left").select("id", "t", "text", "shared")

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents: their own ids, how many before each shared chunk, and its hash. Owned chunks: hash and ids, without a list of hashes."""
        for batch in batches:
            at, own, cuts, hashes, chunks = [], [], [], [], []
            for i, (text, here) in enumerate(zip(batch.column("text").to_pylist(), batch.column("shared").to_pylist(), strict=True)):
                raw = text.encode()
                if here is None:
                    at.append(i), own.append(encode_array(text, vocabulary)), cuts.append(None), hashes.append(None), chunks.append(None)
                    continue
                pieces, met_here = parts(raw, here, vocabulary)
                at.append(i), own.append(np.concatenate(pieces)), hashes.append(met_here or None), chunks.append(None)
                cuts.append(np.cumsum([len(p) for p in pieces[:-1]]).tolist() if met_here else None)
                for piece in here:
                    chunk_raw = raw[piece["start"] : piece["start"] + piece["size"]]
                    inner = split_middle(chunk_raw) if piece["owned"] and xxhash.xxh3_128_digest(chunk_raw) == piece["h"] else None
                    if inner:
                        at.append(i), own.append(encode_array(chunk_raw[inner[0] : inner[1]].decode(), vocabulary))
                        cuts.append(None), hashes.append(None), chunks.append(piece["h"])
            lengths = np.array([0, *(len(x) for x in own)])
            values = pa.array((np.concatenate(own) if own else np.zeros(0)).astype(np.int32), pa.int32())
            lists_here = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), values)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("t").take(rows), lists_here, pa.array(cuts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.binary())), pa.array(chunks, pa.binary())],
                ["id", "t", "ids", "cuts", "hashes", "chunk"],
            )

    schema = f"id {kind}, t long, ids array<int>, cuts array<int>, hashes array<binary>, chunk binary"
    encoded = listed.mapInArrow(encode_parts, schema)
    if lists.isEmpty():
        return encoded.select(F.col("id").alias(id_col), "ids")
    encoded = cut(encoded)
    chunks = cut(encoded.where("chunk is not null").select(F.col("chunk").alias("h"), F.col("ids").alias("inner")).dropDuplicates(["h"]))
    if chunks.count() <= BROADCAST_CHUNKS:
        chunks = F.broadcast(chunks)
    apart = encoded.where("hashes is not null")
    wanted = apart.select("id", "t", F.posexplode("hashes").alias("k", "h")).dropDuplicates(["id", "t", "k"])
    filled = wanted.join(chunks, "h").groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("k", "inner"))).alias("inner"))
    # Slices of the document's own ids and the chunks' ids, alternately.
    edge = lambda k: F.when(k < 0, 0).otherwise(F.get("cuts", k))
    between = lambda p: F.concat(F.slice("ids", edge(p["k"] - 1) + 1, edge(p["k"]) - edge(p["k"] - 1)), p["inner"])
    last = F.element_at("cuts", -1)
    joined = apart.join(filled, ["id", "t"]).select(
        "id", F.concat(F.flatten(F.transform("inner", between)), F.slice("ids", last + 1, F.greatest(F.size("ids") - last, F.lit(0)))).alias("ids")
    )
    plain = encoded.where("hashes is null and chunk is null").select("id", "ids")
    return plain.unionByName(joined).withColumnRenamed("id", id_col)


def with_token_counts(documents: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`documents` with `n_tokens`; 0 for null and empty texts. The text itself isn't shuffled."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode_array(t, vocabulary)) if t else 0).astype("int32")

    return documents.withColumn("n_tokens", count(F.coalesce(F.col(text_col), F.lit(""))))
