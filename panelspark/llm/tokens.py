"""Token files: flat unsigned integers and 64-bit document offsets.

Documents are dealt over range partitions of their id and sorted in them; every
partition is one file of token ids (little-endian, 16 bits where the vocabulary
allows, else 32) with a file of the documents' starts in it (64 bits, one more than
documents).  The base of a file in the whole sequence is the prefix sum of the
lengths of the files before it (a table with one row per file).  A file is written
under a name of its own attempt and renamed when complete, so a task that runs again
replaces it by the same bytes.  Reading maps the files and takes each document's
slice.

The tokenizer drops white space and never joins pieces across it, so texts are cut at
ASCII white space, and each distinct piece is encoded once for a while and looked up.
With ``literals`` a text that contains an added token of the vocabulary literally
(``<|endoftext|>``) goes through the tokenizer whole, which gives the literal its own id as
the library does by default; without, the literal is encoded as other text.

Defined results: null and empty texts have the end id alone; null ids come last;
rows with equal ids follow one another by the hash of their text; an empty table
writes no file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import col, join_small, staged

END_ID = 2
# Distinct pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 600_000
# Texts encoded together, in characters.
_BLOCK = 1 << 21


# Pieces that the short way can cut as the tokenizer does: printable ASCII without the apostrophe
# (contractions) and the accented letters of Latin-1, which are letters, composed and of simple case.
_SIMPLE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# Byte-level vocabularies write a byte as a character: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SHORT_WAY = {"NFC", "Replace", "Lowercase"}


class Encoder:
    """Ids of texts, by way of remembered pieces."""

    def __init__(self, path: str, end_id: int = END_ID, literals: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # for pieces, which hold no added token
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end_id = end_id
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = {x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])}
        added = spec.get("added_tokens") or [] if literals else []
        self.raw = [x["content"] for x in added if not x.get("normalized")]
        # these are looked for in the normalized text
        self.normalized = [x["content"] for x in added if x.get("normalized")]
        if self.whole.normalizer is not None:
            self.normalized = [self.whole.normalizer.normalize_str(c) for c in self.normalized]
        self.short_way = steps == _SHORT_WAY and spec["model"].get("end_of_word_suffix") == "</w>"
        self._forget()

    def _forget(self) -> None:
        self.known = {"": 0, None: 1}  # no ids; the end of a document
        self.flat = np.zeros(1 << 16, np.uint32)
        self.flat[0] = self.end_id
        self.starts = np.zeros(1 << 14, np.int64)
        self.starts[2] = 1
        self.n_flat = 1

    def _long_way(self, pieces: list[str]) -> list[list[int]]:
        """Encodes pieces in one go; the offsets tell which piece a token is of."""
        enc = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        at = np.array([a for a, _ in enc.offsets], np.int64)
        cuts = np.searchsorted(at, np.cumsum([len(p) + 1 for p in pieces])).tolist()
        return [enc.ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        model = self.tokenizer.model
        ids: list[list[int]] = []
        rest: list[int] = []
        for n, piece in enumerate(pieces):
            if self.short_way and _SIMPLE.fullmatch(piece):
                own: list[int] = []
                for part in _PARTS.findall(piece.lower()):
                    own += [t.id for t in model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES))]
                ids.append(own)
            else:
                ids.append([])
                rest.append(n)
        for i in range(0, len(rest), 5000):
            some = rest[i : i + 5000]
            for n, own in zip(some, self._long_way([pieces[n] for n in some]), strict=True):
                ids[n] = own
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        length = np.array([len(x) for x in ids], np.int64)
        total = self.n_flat + int(length.sum())
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        if len(self.known) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(self.known)), np.int64)])
        self.flat[self.n_flat : total] = np.fromiter((t for x in ids for t in x), np.uint32, total - self.n_flat)
        self.starts[first + 1 : first + 1 + len(ids)] = self.n_flat + np.cumsum(length)
        self.n_flat = total

    def _has_added(self, text: str) -> bool:
        if any(c in text for c in self.raw):
            return True
        if self.normalized and self.whole.normalizer is not None:
            text = self.whole.normalizer.normalize_str(text)
        return any(c in text for c in self.normalized)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and the starts (one more than texts)."""
        added = {i for i, t in enumerate(texts) if t and self._has_added(t)}
        if not added:
            return self._by_pieces(texts)
        ids, at = self._by_pieces([None if i in added else t for i, t in enumerate(texts)])
        own = [
            np.array([*self.whole.encode(t, add_special_tokens=False).ids, self.end_id], ids.dtype) if i in added else ids[at[i] : at[i + 1]]
            for i, t in enumerate(texts)
        ]
        return np.concatenate(own), np.cumsum([0, *map(len, own)])

    def _by_pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        pieces = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        flat = pieces.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        of_word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        piece = of_word[flat.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        ends = pieces.offsets.to_numpy()[1:].astype(np.int64) - int(pieces.offsets[0].as_py())
        piece = np.insert(piece, ends, 1)
        begin = self.starts[piece]
        length = self.starts[piece + 1] - begin
        to = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(to[-1]) + np.repeat(begin - to[:-1], length)]
        return ids, to[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def _encoder(path: str, end_id: int, literals: bool) -> Encoder:
    """One encoder per Python worker, so that its tasks share what it remembers."""
    if (path, end_id, literals) not in _encoders:
        _encoders[path, end_id, literals] = Encoder(path, end_id, literals)
    return _encoders[path, end_id, literals]


def _files(uri: str):
    """The file system and path of a folder in the shared store."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(use_mmap=True), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


@dataclass
class TokenFiles:
    """A written corpus: ``index`` (part, row, doc id, text hash) by document,
    ``bases`` (part, n_docs, n_ids, base) by file, in ``folder``."""

    folder: str
    dtype: str
    index: DataFrame
    bases: DataFrame


def write(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", folder: str | None = None, end_id: int = END_ID, literals: bool = False) -> TokenFiles:
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    kind = docs.schema[doc_id].dataType.simpleString()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        fs, root = _files(folder)
        encoder, out, starts, done = _encoder(tokenizer, end_id, literals), None, [np.zeros(1, np.int64)], 0
        attempt = f"{root}/_attempt-{part:05d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{attempt}.bin")
            texts, size, first = batch["t"].tolist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= _BLOCK or i == len(texts) - 1:
                    ids, at = encoder.encode(texts[first : i + 1])
                    out.write(ids.astype(dtype).tobytes())
                    starts.append(at[1:] + starts[-1][-1])
                    first, size = i + 1, 0
            n = len(batch)
            yield pd.DataFrame({"part": part, "row": np.arange(done, done + n), "d": batch["d"], "x": batch["x"]})
            done += n
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{attempt}.idx") as f:
                f.write(np.concatenate(starts).astype("<i8").tobytes())
            for end in ("bin", "idx"):
                fs.move(f"{attempt}.{end}", f"{root}/part-{part:05d}.{end}")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(doc_id).alias("d"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("x"), col(text).alias("t"))
    order = [F.col("d").asc_nulls_last(), F.col("x").asc()]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    index = staged(dealt.mapInPandas(put, f"part int, row bigint, d {kind}, x bigint"), "token-index")

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _files(folder)
        for batch in batches:
            ends = []
            for part, n_docs in zip(batch["part"], batch["n_docs"], strict=True):
                with fs.open_input_file(f"{root}/part-{part:05d}.idx") as f:
                    ends.append(int(np.frombuffer(f.read_at(8, 8 * n_docs), "<i8")[0]))
            yield pd.DataFrame({"part": batch["part"], "n_docs": batch["n_docs"], "n_ids": ends})

    parts = index.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs")).mapInPandas(lengths, "part int, n_docs bigint, n_ids bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = staged(parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-bases")
    return TokenFiles(folder, dtype, index, bases)


def read(files: TokenFiles, doc_id: str = "doc_id") -> DataFrame:
    """From the files, for every document: doc id, ``start`` (ids before it),
    ``n_tokens`` and ``ids_crc32`` (crc32 of its ids as 32-bit integers)."""
    folder, dtype = files.folder, files.dtype
    kind = files.index.schema["d"].dataType.simpleString()

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _files(folder)
        width, now, ids, starts = np.dtype(dtype).itemsize, None, None, None
        for batch in batches:
            begin, count, crc = [], [], []
            for part, row, base in zip(batch["part"], batch["row"], batch["base"], strict=True):
                if part != now:
                    now, ids, starts = part, fs.open_input_file(f"{root}/part-{part:05d}.bin"), fs.open_input_file(f"{root}/part-{part:05d}.idx")
                a, b = np.frombuffer(starts.read_at(16, 8 * row), "<i8").tolist()
                one = np.frombuffer(ids.read_at((b - a) * width, a * width), dtype)
                begin.append(base + a)
                count.append(b - a)
                crc.append(zlib.crc32(one.astype("<u4").tobytes()))
            yield pd.DataFrame({"d": batch["d"], "start": begin, "n_tokens": count, "ids_crc32": crc})

    rows = join_small(files.index.select("part", "row", "d"), files.bases.select("part", "base"), ["part"], "inner")
    return rows.mapInPandas(take, f"d {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("d", doc_id)


def encode_corpus(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", literals: bool = False) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back."""
    return read(write(docs, tokenizer, text, doc_id, literals=literals), doc_id)


def public_tokenizer(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary file, the same on every machine; ``spark.panelspark.tokenizer`` (for other files
    than the default, with its name behind a dot) overrides it."""
    given = spark.conf.get("spark.panelspark.tokenizer" + ("" if name == "word_bpe_49k.json" else f".{name}"), None)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)
