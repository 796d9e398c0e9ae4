"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read back by memory map.

A file set is a folder. Each partition, a range of ascending document ids, has three files: the ids of its documents one
after another (16 bits each if the vocabulary allows, else 32; little-endian), its document offsets within them (64-bit,
one more than documents), and its document ids (64-bit signed; the least value for null). `index` is a Parquet table
with one row a partition: names, counts, and the ids and documents before it, which are prefix sums of the counts.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowlens.llm import spans
from flowlens.llm.chunks import ChunkCache, fresh
from flowlens.llm.tables import keep, small_batches
from flowlens.session import scratch_path

GROUP = 256  # words that are encoded as one text
MARKS = '.,;:!?()"*$%&#'
# A run of letters with marks before and after it; letters are those that have one lower-case form of one code point.
PLAIN = r"^(?P<lead>[.,;:!?()\"*$%&#]*)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<trail>[.,;:!?()\"*$%&#]*)$"
PROBES = ["a", "the", "zqxj", "straße", "ÿé", "ontiatth", "aaaaaaaa", "naïve"]
PARTS = 300_000  # parts a worker remembers: some 60 MB
NULL_ID = np.iinfo(np.int64).min
INDEX = "partition long, name string, docs long, ids long, width int"


class RunEncoder:
    """For tokenizers that drop white space and encode every run between it for itself: encodes columns of whole texts.

    Equal runs of a batch are encoded once. If the tokenizer lowers case, ends every word in a marker of its own and
    takes marks beside letters as words, which PROBES show, a PLAIN run is its marks, its word and its marks; words are
    remembered, and new ones encoded GROUP at a time by the model alone and told apart by the marker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.size, bool)
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if suffix:
            self.last[[i for piece, i in self.tok.get_vocab(with_added_tokens=False).items() if piece.endswith(suffix)]] = True
        self.by_word = bool(suffix) and all(self.agrees(p, m) for p in PROBES for m in MARKS)
        self.cache = ChunkCache(self.parts_encoded, PARTS)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def agrees(self, word: str, mark: str) -> bool:
        alone, upper, lead, marked, both = self.whole([word, word.upper() if "ß" not in word and "ÿ" not in word else word, mark * 2, mark, mark * 2 + word + mark])
        bare = self.words.encode(word, add_special_tokens=False).ids
        return alone == upper == bare and both == lead + alone + marked and self.last[alone].sum() == self.last[alone[-1]] == 1

    def parts_encoded(self, texts: list[str]):
        ids: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t.isalpha() and t.islower() and max(t) <= "ÿ" and "ª" not in t and "º" not in t and "µ" not in t] if self.by_word else []
        groups = [plain[at:at + GROUP] for at in range(0, len(plain), GROUP)]
        for group, e in zip(groups, self.words.encode_batch_fast([" ".join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            got = e.ids
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(group) and ends[-1] == len(got):
                begin = 0
                for i, end in zip(group, ends.tolist(), strict=True):
                    ids[i], begin = got[begin:end], end
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            ids[i] = x
        return ids, [True] * len(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of texts) of a column of whole texts; a null text is empty."""
        split = pc.ascii_split_whitespace(fresh(column, spans.LOWER if self.by_word else None))
        edges = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        runs, which = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.by_word:
            cut = pc.extract_regex(runs, PLAIN)
            plain = cut.is_valid()
            parts = [pc.if_else(plain, pc.struct_field(cut, i), pa.scalar(other, pa.string())) for i, other in ((0, ""), (1, None), (2, ""))]
            parts[1] = pc.utf8_lower(parts[1]).fill_null("") if plain.true_count == len(runs) else pc.coalesce(pc.utf8_lower(parts[1]), runs)
            ids, off, _ = self.cache.encode(pa.concat_arrays(parts), np.arange(3 * len(runs) + 1))
            size = np.diff(off).reshape(3, len(runs))
            # the three parts of a run stand one after another: gather them part by part
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(runs)) * 3 + k, size[k]) for k in range(3)]), kind="stable")
            ids, off = ids[order], np.concatenate([[0], np.cumsum(size.sum(axis=0))])
        else:
            ids, off, _ = self.cache.encode(runs, np.arange(len(runs) + 1))
        size = np.diff(off)[which]
        ends = np.cumsum(size)
        count = int(ends[-1]) if len(ends) else 0
        flat = ids[np.arange(count) + np.repeat(off[which] - (ends - size), size)]
        return flat, np.concatenate([[0], ends])[edges - edges[0]]


@lru_cache(maxsize=2)
def run_encoder(path: str) -> RunEncoder:
    return RunEncoder(path)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    path = as_uri(path)
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the file set of docs below folder and return its index; folder must be shared by all executors.

    A null text is empty and gets only the end id. Rows of one id follow each other in the order of their texts. Each
    attempt of a task writes files of its own name; the index names those of the attempts that were committed.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        where, top = open_fs(folder)
        where.create_dir(top, recursive=True)
        encoder = run_encoder(tokenizer)
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        n_docs = n_ids = 0
        with where.open_output_stream(f"{top}/{name}.ids") as ids_, where.open_output_stream(f"{top}/{name}.offsets") as off_, where.open_output_stream(f"{top}/{name}.docs") as doc_:
            off_.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                flat, off = encoder.encode(batch.column(1))
                flat = np.insert(flat, off[1:], end_id)
                ids_.write(flat.astype(f"<u{width}").tobytes())
                off_.write((n_ids + off[1:] + np.arange(1, len(off))).astype("<u8").tobytes())
                doc_.write(batch.column(0).fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
                n_docs, n_ids = n_docs + batch.num_rows, n_ids + len(flat)
        yield pa.RecordBatch.from_pydict({"partition": [part], "name": [name], "docs": [n_docs], "ids": [n_ids], "width": [width]},
                                         schema=pa.schema([("partition", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    counts = keep(ordered.mapInArrow(run, INDEX), "token-counts")
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    index = counts.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("ids", "docs")])
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def mapped(where: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is a file system of the machine, else read."""
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if where.get_file_info(path).size else np.zeros(0, kind)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.readall(), kind)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, in file order, from the files alone."""

    def run(batches):
        where, top = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(where, f"{top}/{row['name']}.ids", f"<u{row['width']}")
                off = mapped(where, f"{top}/{row['name']}.offsets", "<u8").astype(np.int64)
                doc = mapped(where, f"{top}/{row['name']}.docs", "<i8")
                for at in range(0, len(doc), 10_000):
                    to = min(at + 10_000, len(doc))
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(off[at:to], off[at + 1:to + 1], strict=True)]
                    who = pa.array(np.array(doc[at:to], np.int64), mask=np.array(doc[at:to] == NULL_ID))
                    yield pa.RecordBatch.from_arrays([who, pa.array(row["ids_before"] + off[at:to]), pa.array(np.diff(off[at:to + 1])), pa.array(crc, pa.int64())],
                                                     ["doc_id", "start", "n_tokens", "ids_crc32"])

    index = spark.read.parquet(f"{folder}/index")
    spread = index.repartition(max(1, index.count()), "partition")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to a new folder below the shared one and read the files back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    with small_batches(spark):
        write(docs, tokenizer, folder, end_id)
    return read(spark, folder)
