"""SentencePiece models on the tokenizers library.

The model file is read field by field from its protobuf wire format; the normaliser, the metaspace marker, the model
(unigram scores, or the merges that BPE scores imply) and byte fallback are rebuilt as a `tokenizers.Tokenizer`.
`Codec` encodes and decodes batches and compares both with the original library. Spark operators on top are at the end.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.chunks import ChunkCache, fresh
from flowlens.llm.tables import arrow, by_bytes

MARK = "▁"
SLICE = 4 << 20  # bytes of text that are cut into parts at once, more only for one longer text
ROWS = 250  # rows that are decoded at once
# Piece types and model types of the SentencePiece protobuf: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields (number, value) of one protobuf message; integers as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at:at + n]
            at += n
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at:at + n]
            at += n
        else:
            raise ValueError(f"unknown wire type {kind}")


@dataclass
class SpModel:
    """What a model file holds that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> SpModel:
        m = cls()
        for number, value in wire(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in wire(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in wire(value):
                    if n == 3:
                        m.model_type = v
                    elif n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 40:
                        m.unk_id = v
            elif number == 3:
                for n, v in wire(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.squeeze = bool(v)
                    elif n == 5:
                        m.escape = bool(v)
        for i, (_, _, kind) in enumerate(m.pieces):
            if kind == UNKNOWN:
                m.unk_id = i
        return m

    @property
    def splittable(self) -> bool:
        """No piece runs from other characters into a marker, so a text may be cut before each run of markers."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """BPE merges in the order that the scores give: every way to make a piece of two others, best pieces first."""
    ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, i in ids.items():
        for cut in range(1, len(p)):
            left, right = p[:cut], p[cut:]
            if left in ids and right in ids:
                found.append((-pieces[i][1], ids[left], ids[right], left, right))
    found.sort()
    return [(left, right) for *_, left, right in found]


def build(data: bytes, bare: bool = False):
    """A `tokenizers.Tokenizer` that encodes and decodes as the model file says; bare: the model alone, for normalised pieces."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = SpModel.parse(data)
    vocab = [(p, s) for p, s, _ in m.pieces]
    if m.model_type == UNIGRAM:
        model = models.Unigram(vocab, unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    elif m.model_type == BPE:
        model = models.BPE({p: i for i, (p, _) in enumerate(vocab)}, merges_of(m.pieces), unk_token=vocab[m.unk_id][0],
                           fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
    tok = Tokenizer(model)
    if bare:
        tok.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        return tok
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    tok.normalizer = normalizers.Sequence(steps)
    if m.splittable and m.escape:
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tok


class Codec:
    """Encodes and decodes batches of texts with the tokenizers library, and says for each text whether

    the ids are those of the sentencepiece library and the decoded ids are the normalised text. If no piece runs from
    other characters into a marker, texts are cut before runs of markers, and every different part is encoded, decoded
    and compared once while the cache holds it; a text is in parity if all its parts are. Otherwise whole texts are.
    """

    def __init__(self, data: bytes, threads: int = 1):
        """threads: of both libraries, for each batch; the tokenizers library decides by TOKENIZERS_PARALLELISM, set here for the process."""
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.threads = threads
        self.model = SpModel.parse(data)
        self.tok = build(data)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        self.by_part = m.splittable and m.escape and m.dummy_prefix and not m.squeeze and not m.charsmap
        self.part = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.bare = build(data, bare=True) if self.by_part else None
        self.cache = ChunkCache(self.parts_encoded)

    def parts_encoded(self, rests: list[str]):
        """Parts are named by what follows their first marker."""
        parts = [MARK + r for r in rests]
        ids = [e.ids for e in self.bare.encode_batch_fast(parts, add_special_tokens=False)]
        want = self.sp.encode([r.replace(MARK, " ") for r in rests], num_threads=self.threads)
        want = [w if r else [self.sp.piece_to_id(MARK)] for r, w in zip(rests, want, strict=True)]  # alone it would be an empty text
        back = self.bare.decode_batch(ids, skip_special_tokens=False)
        return ids, [i == w and b == p for i, w, b, p in zip(ids, want, back, parts, strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of texts, parity of texts) of a column of whole texts; a null text is empty."""
        if self.by_part:
            return self.encode_by_part(fresh(column))
        texts = ["" if t is None else t for t in column.to_pylist()]
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        want = self.sp.encode(texts, num_threads=self.threads)
        back = self.decode(ids)
        good = [i == w and b == self.sp.decode(w) for i, w, b in zip(ids, want, back, strict=True)]
        return np.fromiter((x for i in ids for x in i), np.int64), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64), np.array(good, bool)

    def encode_by_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with single spaces between words and no marker are cut by Arrow, the others one by one."""
        odd = pc.or_(pc.match_substring_regex(texts, f"^$|^ |  | $|{MARK}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        whole, single = np.flatnonzero(~odd), np.flatnonzero(odd)
        split = pc.split_pattern(texts.take(pa.array(whole)), " ")
        cut = [self.part.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.take(pa.array(single)).to_pylist()]
        edges = split.offsets.to_numpy().astype(np.int64)
        found = [self.cache.encode(split.flatten(), edges - edges[0]),
                 self.cache.encode(pa.array([p[1:] for c in cut for p in c], pa.large_string()), np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64))]
        size, begin, good = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        before = 0
        for rows, (ids, off, fine) in zip((whole, single), found, strict=True):
            size[rows], begin[rows], good[rows] = np.diff(off), before + off[:-1], fine
            before += len(ids)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.concatenate([ids for ids, _, _ in found])[np.arange(total) + np.repeat(begin - (ends - size), size)]
        return flat, np.concatenate([[0], ends]).astype(np.int64), good

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 1) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read(), threads)


def encode(docs: DataFrame, model: str, text_col: str = "text", ids: str = "ids", threads: int | None = None) -> DataFrame:
    """docs with ids (array<int>), n_tokens, ids_crc32 of the ids as little-endian 32-bit integers, and parity.

    model: path of a model file, present on every executor. A null text counts as empty and has no ids. Columns of docs
    with these names are replaced; the text is kept. threads: of the libraries in each task, spark.task.cpus by default.
    """
    threads = threads or int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, text_col, SLICE):
                flat, off, good = codec(model, threads).encode(part.column(part.schema.get_field_index(text_col)))
                low = flat.astype("<u4")
                crc = [zlib.crc32(low[a:b]) for a, b in zip(off, off[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)))
                new = [lists, pa.array(np.diff(off)), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, ids, "n_tokens", "ids_crc32", "parity"])

    rows = docs.drop(ids, "n_tokens", "ids_crc32", "parity")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{ids} array<int>, n_tokens long, ids_crc32 long, parity boolean"])
    return rows.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the decoded text of the ids column; null for null ids."""

    def run(batch):
        lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        texts = codec(model).decode([x or [] for x in lists])
        texts = [None if x is None else t for x, t in zip(lists, texts, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    rows = docs.drop(out)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{out} string"])
    return arrow(rows, run, schema, ROWS)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, parity) of each row."""
    return encode(docs.select(id_col, text_col), model, text_col).select(F.col(id_col).alias("doc_id"), "n_tokens", "ids_crc32", "parity")
