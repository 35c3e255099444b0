"""Token ids of texts, and counts of documents in flat token files without an index (operator 8).

A token file is nothing but little-endian unsigned identifiers of 2 or 4 bytes, one document after the other, each ended by
an end-of-document identifier. ``write_token_files`` makes such files; ``scan_documents`` finds the documents again:
files are cut into blocks, each block is searched for the end identifier with a vector comparison, and documents that
lie across blocks are stitched with a running count over the (few) rows of blocks.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.base import dealt, qualified, slices, stored
from twinproof.session import scratch

VOCABULARY = "byte_bpe_50k.json"
END = 2


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizer library.

    The rank table of the same vocabulary gives the same ids several times faster. The library itself encodes what the two could see
    differently: texts that hold the string of a special token, and texts with characters beyond the common scripts.
    """

    def __init__(self, path: str):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        self.fast = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.rare = re.compile("[^\x00-\u2bff]")

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special) or not text.isascii() and self.rare.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- flat token files ---------------------------------------------------------------------------------------------

def open_store(folder: str):
    """The file system of a folder and the folder's name in it; folders come from the driver ``qualified``."""
    if re.match(r"\w+:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
    return fs.LocalFileSystem(), folder


def write_token_files(docs: DataFrame, id_col: str, text_col: str, folder: str, end: int, vocabulary: str | None = None, width: int = 4) -> DataFrame:
    """Encode every text and write the ids to flat files in ``folder``; a row per file: path, n_bytes, ids.

    ``ids`` names the documents of a file in their order (the files hold no identifiers). A file gets a name of its
    own in each attempt of a task, and only files in the returned, stored rows count: what a lost executor leaves
    half-written is never read. A NULL or empty text is a document of no tokens. Each file closes at about 16 MB.
    """
    path, folder = vocabulary or vocabulary_path(), qualified(docs.sparkSession, folder)
    kind = f"<u{width}"
    stop = np.array([end], dtype=kind).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(folder)
        encode, out, held, ids, name = encoder(path), None, 0, [], ""

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "n_bytes": [held], "ids": [ids]}, schema=_FILES)

        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    store.create_dir(inner, recursive=True)
                    name, held, ids = f"{inner}/{uuid.uuid4().hex}.tokens", 0, []
                    out = store.open_output_stream(name)
                data = encode(text)
                data = (data if width == 4 else np.frombuffer(data, "<u4").astype(kind).tobytes()) + stop
                out.write(data)
                held += len(data)
                ids.append(i)
                if held >= 16 << 20:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(write, "path string, n_bytes long, ids array<long>"), "token-files")


_FILES = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64()))])
_ENDS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("ends", pa.list_(pa.int64()))])


def scan_documents(files: DataFrame, folder: str, end: int, width: int = 4, block_bytes: int = 4 << 20) -> DataFrame:
    """Documents of flat token files (columns path, n_bytes): path, ordinal, start, n_tokens (the end id not counted).

    Blocks are read and searched independently. Within a block all documents but the first and the last lie whole;
    the position where a document starts is the end before it, found across blocks by a running maximum over one row
    per block. Identifiers after the last end of a file are an unfinished document, which is not reported.
    """
    step, folder = block_bytes // width * width, qualified(files.sparkSession, folder)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, block, size in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(path) as f:
                    data = np.frombuffer(f.read_at(min(step, size - block * step), block * step), dtype=f"<u{width}")
                found = np.flatnonzero(data == end) + block * (step // width)
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "block": [block], "n_tokens": [len(data)], "ends": [found]}, schema=_ENDS)

    blocks = files.select("path", F.expr(f"explode(sequence(0L, greatest(n_bytes - 1, 0L) div {step}))").alias("block"), "n_bytes")
    ends = dealt(blocks, "path", "block").mapInArrow(search, "path string, block long, n_tokens long, ends array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        ends.withColumn("last", F.element_at(F.expr("if(size(ends) = 0, array(-1L), ends)"), -1))
        .select(
            "path", "ends",
            F.coalesce(F.max("last").over(before), F.lit(-1)).alias("behind"),
            F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"),
        )
    )
    pairs = F.arrays_zip(F.concat(F.array("behind"), F.col("ends")).alias("behind"), F.col("ends").alias("stop"))
    each = stitched.filter(F.size("ends") > 0).select("path", "seen", F.posexplode(pairs).alias("i", "d")).filter("d.stop IS NOT NULL")
    return each.select("path", (F.col("seen") + F.col("i")).alias("ordinal"), (F.col("d.behind") + 1).alias("start"),
                       (F.col("d.stop") - F.col("d.behind") - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Tokens of every document, counted in flat files: doc_id, n_tokens, file_tokens (of its file, ends included).

    A NULL or empty text has 0 tokens; repeated rows stay rows of their own; an empty table gives an empty result.
    The end identifier must not occur within texts (for the byte-level vocabulary, id 2 is the character ``#``, so the
    files are closed with ``len(vocabulary)``, an id that the vocabulary does not have).
    """
    path = vocabulary or vocabulary_path()
    end = _free_id(path)
    width = 2 if end < 1 << 16 else 4
    folder = scratch(docs.sparkSession, "tokens")
    files = write_token_files(docs, id_col, text_col, folder, end, path, width)
    found = scan_documents(files, folder, end, width)
    named = files.select("path", F.expr(f"n_bytes div {width}").alias("file_tokens"), F.posexplode("ids").alias("ordinal", "doc_id"))
    return (
        found.join(named.withColumn("ordinal", F.col("ordinal").cast("long")).hint("merge"), ["path", "ordinal"])
        .select("doc_id", "n_tokens", "file_tokens")
    )


def _free_id(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
