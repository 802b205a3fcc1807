"""Token files: ids in ascending document order, each document compressed on its own.

A folder holds a zstandard dictionary trained on serialized id arrays, and per
range of documents a data file of frames and an index file. Short documents
compress well one by one because they share the dictionary, so a reader seeks
to one document's frame and decompresses only that. Every index file names the
dictionary's hash.

``ids-NNNNN.bin``: one zstandard frame per document (ids of ``width`` bytes,
little-endian). ``ids-NNNNN.idx``: ``HEADER`` then one ``ENTRY`` per document.
``dictionary.zdict``: absent when there was too little text to train on.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm.common import prefix_sums, prepare_workers, text_of
from segstats.llm.tokenization import largest_id
from segstats.session import shared_dir

MAGIC = b"TOKIDS01"
#: magic, id width in bytes, dictionary hash (0: none), documents.
HEADER = "<8sIQQ"
#: start: the file's ids before this document; at, size: its frame in the data file.
ENTRY = np.dtype(
    [("doc_id", "<i8"), ("null", "u1"), ("n_tokens", "<u8"), ("start", "<u8"), ("at", "<u8"), ("size", "<u8")]
)
DICTIONARY = "dictionary.zdict"
MANIFEST = "manifest"
#: Documents sampled for the dictionary, slices of ids taken from each, ids in a slice, dictionary bytes.
SAMPLE_DOCS, SLICES, SLICE_IDS, DICTIONARY_BYTES = 512, 4, 512, 65_536


def file_system(folder: str):
    """The Arrow file system and path of a folder given as a URI or a plain path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", folder)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _publish(store, own: str, final: str) -> None:
    """Rename a finished file; where another attempt of the same task was first, its equal file stays."""
    from pyarrow import fs

    try:
        store.move(own, final)
    except OSError:
        if store.get_file_info(final).type == fs.FileType.NotFound:
            raise
        store.delete_file(own)


def _dictionary_samples(docs: DataFrame, tokenizer: str, width: int) -> list[bytes]:
    """Slices of the ids of a bounded random sample of documents, evenly spaced in each."""
    rows = docs.count()
    if not rows:
        return []
    kind = f"<u{width}"

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from segstats.llm.tokenization import encoder

        ids_of = encoder(tokenizer).ids
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                ids = np.frombuffer(ids_of(text), "<u4").astype(kind)
                starts = np.unique(np.linspace(0, max(0, len(ids) - SLICE_IDS), SLICES).astype(int))
                out += [ids[s : s + SLICE_IDS].tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    picked = docs.select("text").sample(fraction=min(1.0, SAMPLE_DOCS / rows), seed=11)
    return [bytes(r["ids"]) for r in picked.mapInArrow(slices, "ids binary").limit(2 * SAMPLE_DOCS * SLICES).collect()]


def train_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes; empty when the samples are too few or too small to train on."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 8 or sum(map(len, samples)) < 10 * 1024:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 4)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) if data else 0


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Write the ids of every whole text, ``end_id`` appended, in ascending ``id_col`` order; the folder's URI.

    ``id_col`` holds integers; null sorts first. A null text is empty: its end
    id alone. Rows with equal ids are separate documents, in the order of their
    texts' hashes; a heavily repeated row is spread over ranges by a salt. An
    empty table gives a folder with an empty manifest. Other columns are not
    read. A task writes its range under a name of its own attempt and renames
    it when whole, so a repeated task leaves one file. Ids take two bytes if the
    vocabulary and ``end_id`` allow it, else four.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    folder = folder or shared_dir(spark, "token-files")
    width = 2 if max(largest_id(tokenizer), end_id) < 1 << 16 else 4
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    dictionary = train_dictionary(_dictionary_samples(source, tokenizer, width))
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    if dictionary:
        with store.open_output_stream(f"{root}/{DICTIONARY}") as f:
            f.write(dictionary)
    packed = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from segstats.llm.tokenization import encoder

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = file_system(folder)
        shared = packed.value
        squeeze = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None
        ).compress
        each = encoder(tokenizer).each
        end = np.array([end_id], "<u4")
        name = f"ids-{part:05d}"
        own = f"{root}/.{name}-{attempt}"
        entries: list[np.ndarray] = []
        at = start = 0
        data = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data = data or store.open_output_stream(f"{own}.bin")
            known = np.zeros(batch.num_rows, ENTRY)
            for k, (doc_id, text_ids) in enumerate(zip(batch.column(0).to_pylist(), each(batch.column(1)))):
                ids = np.concatenate([text_ids, end])
                if int(ids.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id of {int(ids.max())} does not fit into {width} bytes")
                frame = squeeze(ids.astype(f"<u{width}").tobytes())
                data.write(frame)
                known[k] = (doc_id or 0, doc_id is None, len(ids), start, at, len(frame))
                start += len(ids)
                at += len(frame)
            entries.append(known)
        if data is None:
            return
        data.close()
        index = np.concatenate(entries)
        with store.open_output_stream(f"{own}.idx") as f:
            f.write(struct.pack(HEADER, MAGIC, width, _hash(shared), len(index)))
            f.write(index.tobytes())
        for kind in ("bin", "idx"):
            _publish(store, f"{own}.{kind}", f"{root}/{name}.{kind}")
        ends = [None if index["null"][k] else int(index["doc_id"][k]) for k in (0, -1)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                *[pa.array([x], pa.int64()) for x in (len(index), start, *ends)],
            ],
            ["shard", "n_docs", "n_tokens", "first", "last"],
        )

    ordered = (
        source.withColumn("tie", F.xxhash64("text"))
        .withColumn("salt", F.rand(5))
        .repartitionByRange("doc_id", "tie", "salt")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    shards = ordered.mapInArrow(write, "shard int, n_docs long, n_tokens long, first long, last long")
    shards.write.parquet(f"{folder}/{MANIFEST}")
    return folder


def _dictionary(store, root: str, wanted: int) -> bytes:
    if not wanted:
        return b""
    with store.open_input_file(f"{root}/{DICTIONARY}") as f:
        data = f.read()
    if _hash(data) != wanted:
        raise ValueError("the dictionary is not the one this index was written with")
    return data


def _index(store, root: str, shard: int) -> tuple[int, int, np.ndarray]:
    with store.open_input_file(f"{root}/ids-{shard:05d}.idx") as f:
        magic, width, known, count = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError("not a token index")
        return width, known, np.frombuffer(f.read(count * ENTRY.itemsize), ENTRY)


def read_one(folder: str, shard: int, place: int) -> np.ndarray:
    """The ids of the document at ``place`` of a shard: one index read, one short frame read."""
    import zstandard

    store, root = file_system(folder)
    width, known, index = _index(store, root, shard)
    shared = _dictionary(store, root, known)
    entry = index[place]
    with store.open_input_file(f"{root}/ids-{shard:05d}.bin") as f:
        frame = f.read_at(int(entry["size"]), int(entry["at"]))
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
    return np.frombuffer(plain.decompress(frame), f"<u{width}").astype("<u4")


def read_documents(folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document with an id (null: those without), in the files' order; none if there is none.

    The manifest tells the shards, a binary search of their indexes the places.
    """
    import pyarrow.parquet as pq

    store, root = file_system(folder)
    out = []
    for s in sorted(pq.read_table(f"{root}/{MANIFEST}", filesystem=store).to_pylist(), key=lambda s: s["shard"]):
        first, last = s["first"], s["last"]
        if (first is not None) if doc_id is None else last is None or last < doc_id or (first is not None and first > doc_id):
            continue
        _, _, index = _index(store, root, s["shard"])
        nulls = int(index["null"].sum())  # they come first
        if doc_id is None:
            places = range(nulls)
        else:
            ids = index["doc_id"][nulls:]
            places = range(nulls + int(np.searchsorted(ids, doc_id)), nulls + int(np.searchsorted(ids, doc_id, "right")))
        out += [read_one(folder, s["shard"], k) for k in places]
    return out


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32): every document, read back from the files.

    ``start`` counts the ids of all documents before it, in the files' order.
    One task reads one shard, a frame at a time.
    """
    prepare_workers(spark)
    manifest = spark.read.schema("shard int, n_docs long, n_tokens long").parquet(f"{folder}/{MANIFEST}")
    shards = manifest.count()
    placed = prefix_sums(manifest, "shard", "n_tokens", "base").select("shard", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, root = file_system(folder)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                width, known, index = _index(store, root, shard)
                shared = _dictionary(store, root, known)
                plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
                with store.open_input_stream(f"{root}/ids-{shard:05d}.bin") as f:
                    for lo in range(0, len(index), 500):
                        some = index[lo : lo + 500]
                        ids = [
                            np.frombuffer(plain.decompress(f.read(int(s))), f"<u{width}").astype("<u4").tobytes()
                            for s in some["size"]
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(some["doc_id"].astype("i8"), mask=some["null"].astype(bool)),
                                pa.array(some["start"].astype("i8") + base),
                                pa.array(some["n_tokens"].astype("i8")),
                                pa.array(ids, pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    return placed.repartition(max(1, shards), "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary"
    )
