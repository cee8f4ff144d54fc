"""Token-ID output: one compressed wavelet-matrix file per shard.

``encode_corpus`` deals the documents into ranges of doc_id, tokenizes whole texts in
ascending doc_id order, appends the end id to each and closes a shard as soon as it holds
SHARD_TOKENS tokens or its range ends; a document is never split.  ``decode_corpus`` reads the files back;
``Shard`` gives random access, rank, select, counting and occurrence lookup in one file without
unpacking the others.

File format (little-endian):

    magic  8 bytes  b"LWWM\\x01\\0\\0\\0"
    head   u32 length, then zstandard-compressed JSON:
           n tokens, bits, zeros per plane, docs, block sizes of each plane
    docs   three zstandard-compressed int64 arrays: doc_id, tokens, null flags
    planes bits x ceil(n / BLOCK_BITS) zstandard-compressed blocks of bits, most significant first
    ranks  zstandard-compressed u32 array: ones before each block of each plane

Wavelet matrix (Claude, Navarro and Ordonez, 2015): plane k holds bit k of the tokens in the order
that the higher planes give; zeros go to the front and ones to the back, both in order.

Tokens of a text are those of the whole text.  With a tokenizer that drops white space, pieces
between blanks, tabs and line ends never interact, so each different piece is encoded once per worker and
looked up after; ``Pieces`` tries that on a probe and encodes whole texts with any other tokenizer, and goes on
comparing one whole text of every slice.

A plane's block has a directory of the ones before every STEP bits, so rank and select look at STEP bits only.

Edge cases: null and empty texts have the end id alone; a null doc_id sorts after all
others; rows that share a doc_id are ordered by text; a text of any length is encoded whole and stays in one
shard; an empty table gives no shard and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, new_dir, partitions_of, read_table, runs, slices, span_hashes, utf8, written

MAGIC = b"LWWM\x01\0\0\0"
BITS = 16
BLOCK_BITS = 1 << 17
#: Bits between two entries of a block's directory.
STEP = 512
SHARD_TOKENS = 1 << 20
#: Most rows of a range of doc_id, on average.
RANGE_ROWS = 50_000
END_ID = 1
#: Pieces that a worker process keeps encoded (about 50 bytes each); when there are more, the table starts anew.
CACHE_PIECES = 1_000_000
#: Bytes of text that are cut and looked up at once.
SLICE = 1 << 20
#: Longest text that is encoded whole for comparison.
PROBE_BYTES = 1 << 14
PROBE = "Ab cd, E's x1;\tit \u00c4\u00d6\u00df \u00c9t\u00e9."


def _bytes(chosen: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chosen.encode())] = True
    return out


GAP = _bytes(" \t\n\r")
LETTER = _bytes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
MARK = _bytes("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Second bytes of the letters of Latin-1 beyond ASCII (all but the signs for times and division), and of the capitals among them.
LATIN, UPPER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
LATIN[0x80:0xC0] = UPPER[0x80:0x9F] = True
LATIN[[0x97, 0xB7]] = UPPER[0x97] = False


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pieces:
    """Token ids of texts by their pieces.  A plain piece is a word of Latin-1 letters and the ASCII marks after it (the
    apostrophe excepted), which the tokenizer splits there and puts into lower case; every other piece is encoded as it is.

    What was encoded before is found by two 64-bit hashes of its bytes in an open-addressed table; texts are cut,
    hashed and looked up in numpy, and new words are encoded many at a time and cut where a token ends a word."""

    def __init__(self, vocabulary: str, by_pieces: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._coder = whole = Tokenizer.from_file(vocabulary)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        self._as_is = (whole.normalizer, whole.pre_tokenizer)
        self._plain = (normalizers.Sequence([]), plain)
        suffix = getattr(whole.model, "end_of_word_suffix", None)
        vocab = whole.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.by_pieces = False
        self.clear()
        if suffix and by_pieces:
            self.by_pieces = self.by_piece([PROBE.encode()])[0].tobytes() == self.whole([PROBE])[0]

    def _encode(self, how: tuple, texts: list[str]) -> list:
        self._coder.normalizer, self._coder.pre_tokenizer = how
        return self._coder.encode_batch_fast(texts, add_special_tokens=False)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 16-bit numbers."""
        return [np.array(e.ids, dtype=np.uint16).tobytes() for e in self._encode(self._as_is, texts)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words."""
        out = []
        for e in self._encode(self._plain, [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]):
            ids = np.array(e.ids, dtype=np.uint16)
            cuts = (2 * np.flatnonzero(self._ends[ids]) + 2).tolist()
            raw = ids.tobytes()
            out += [raw[a:z] for a, z in zip([0, *cuts], cuts)]
        return out

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.h, self.g = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.uint64)
        self.starts, self.flat = np.zeros((1 << 15) + 1, np.int64), np.zeros(1 << 18, np.uint16)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Row of each pair of hashes, -1 for unknown ones."""
        mask = np.uint64(len(self.slots) - 1)
        at, out, todo = (h & mask).astype(np.int64), np.full(len(h), -1, np.int64), None
        while True:
            row = self.slots[at].astype(np.int64)
            seen = row >= 0
            hit = seen & (self.h[row] == h) & (self.g[row] == g)
            if todo is None:
                out[hit] = row[hit]
                todo = np.flatnonzero(seen & ~hit)
                rest = todo
            else:
                out[todo[hit]] = row[hit]
                rest = np.flatnonzero(seen & ~hit)
                todo = todo[rest]
            if not len(todo):
                return out
            h, g, at = h[rest], g[rest], (at[rest] + 1) & int(mask)

    def _place(self, rows: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (self.h[rows] & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            lost = self.slots[at] != rows
            rows, at = rows[lost], (at[lost] + 1) & mask

    def add(self, h: np.ndarray, g: np.ndarray, ids: list[bytes]) -> None:
        """New rows, whose hashes differ from each other and from all rows."""
        first, self.n = self.n, self.n + len(h)
        ends = self.starts[first] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 2
        size = max(len(self.h), 1 << self.n.bit_length())
        if size > len(self.h):
            self.h, self.g = np.resize(self.h, size), np.resize(self.g, size)
            self.starts = np.resize(self.starts, size + 1)
            self.slots = np.full(2 * size, -1, np.int32)
            self._place(np.arange(first))
        if ends[-1] > len(self.flat):
            self.flat = np.resize(self.flat, 1 << int(ends[-1]).bit_length())
        self.h[first : self.n], self.g[first : self.n] = h, g
        self.flat[self.starts[first] : ends[-1]] = np.frombuffer(b"".join(ids), dtype=np.uint16)
        self.starts[first + 1 : self.n + 1] = ends
        self._place(np.arange(first, self.n))

    def by_piece(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text by its pieces."""
        if self.n > CACHE_PIECES:
            self.clear()
        data = b"\n".join(texts)
        size = len(data)
        raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
        low = raw
        starts, ends = runs(~GAP[raw[:size]])
        letter = LETTER[raw]
        if not data.isascii():
            pair = np.flatnonzero((raw[:-1] == 0xC3) & LATIN[raw[1:]])
            letter[pair] = letter[pair + 1] = True
            low = np.frombuffer(data.translate(LOWER_ASCII) + bytes(8), dtype=np.uint8).copy()
            big = pair[UPPER[raw[pair + 1]]] + 1
            low[big] += 0x20
        else:
            low = np.frombuffer(data.lower() + bytes(8), dtype=np.uint8)
        other, no_mark = np.flatnonzero(~letter), np.flatnonzero(~MARK[raw])
        mid = other[np.searchsorted(other, starts)]
        plain = (mid > starts) & (no_mark[np.searchsorted(no_mark, mid)] == ends)
        two = plain & (mid < ends)
        place = np.cumsum(1 + two) - 1 - two
        a, z = np.empty(len(starts) + two.sum(), np.int64), np.empty(len(starts) + two.sum(), np.int64)
        a[place], z[place] = starts, np.where(plain, mid, ends)
        a[place[two] + 1], z[place[two] + 1] = mid[two], ends[two]
        odd = place[~plain]
        h, g = span_hashes(low, a, z)
        h[odd], g[odd] = span_hashes(raw, a[odd], z[odd])
        row = self.find(h, g)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            _, one, again = np.unique(h[miss], return_index=True, return_inverse=True)
            if (g[miss] != g[miss][one][again]).any():  # two spans with one hash: never yet
                return [np.frombuffer(ids, dtype=np.uint16) for ids in self.whole([t.decode() for t in texts])]
            first = miss[one]
            is_word = np.zeros(len(a), dtype=bool)
            is_word[place[plain]] = True
            is_word = is_word[first]
            small = low.tobytes() if is_word.any() else b""
            ids = np.empty(len(first), dtype=object)
            ids[is_word] = [*self.words([small[i:j].decode() for i, j in zip(a[first[is_word]].tolist(), z[first[is_word]].tolist())])]
            ids[~is_word] = [*self.whole([data[i:j].decode() for i, j in zip(a[first[~is_word]].tolist(), z[first[~is_word]].tolist())])]
            before = self.n
            self.add(h[first], g[first], ids.tolist())
            row[miss] = before + again
        n = self.starts[row + 1] - self.starts[row]
        done = np.cumsum(n)
        all_ids = self.flat[np.repeat(self.starts[row] - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
        begins = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.append(0, done)[np.searchsorted(a, begins)]
        return [all_ids[i:j] for i, j in zip([0, *cuts.tolist()], cuts.tolist())]

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text in UTF-8, without an end id.  Of every slice one text, chosen by its checksum, is also encoded whole."""
        if not self.by_pieces:
            return [np.frombuffer(ids, dtype=np.uint16) for ids in self.whole([t.decode() for t in texts])]
        out = []
        for i, j in slices(texts, SLICE):
            out += self.by_piece(texts[i:j])
            k = min(range(i, j), key=lambda x: (len(texts[x]) > PROBE_BYTES, zlib.crc32(texts[x]), x))
            if len(texts[k]) <= PROBE_BYTES and out[k].tobytes() != self.whole([texts[k].decode()])[0]:
                raise ValueError("this tokenizer doesn't encode the pieces of a text by themselves: use pieces=False")
        return out


@cache
def pieces(vocabulary: str, by_pieces: bool = True) -> Pieces:
    """One per worker process, so that its tasks share what is encoded."""
    return Pieces(vocabulary, by_pieces)


def build_planes(tokens: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """(bits of each plane, most significant first; zeros of each plane)."""
    planes, zeros = [], []
    for k in range(BITS - 1, -1, -1):
        bit = (tokens & np.uint16(1 << k)).astype(bool)
        low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
        planes.append(bit)
        zeros.append(len(low))
        tokens = np.concatenate((tokens.take(low), tokens.take(high)))
    return planes, zeros


def pack_shard(tokens: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """The bytes of a shard file."""
    press = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = build_planes(tokens)
    blocks, sizes, ranks = [], [], []
    for bit in planes:
        row, ones = [], 0
        for at in range(0, len(bit), BLOCK_BITS):
            part = bit[at : at + BLOCK_BITS]
            ranks.append(ones)
            ones += int(np.count_nonzero(part))
            row.append(press(np.packbits(part, bitorder="little").tobytes()))
        blocks += row
        sizes.append([len(b) for b in row])
    docs = [
        press(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()),
        press(np.array(counts, dtype="<i8").tobytes()),
        press(np.array([d is None for d in doc_ids], dtype="<i8").tobytes()),
    ]
    rank = press(np.array(ranks, dtype="<u4").tobytes())
    head = {"n": len(tokens), "bits": BITS, "zeros": zeros, "docs": [len(d) for d in docs], "blocks": sizes, "ranks": len(rank)}
    told = press(json.dumps(head).encode())
    return b"".join([MAGIC, struct.pack("<I", len(told)), told, *docs, *blocks, rank])


class Shard:
    """Reader of one shard file; blocks of planes are unpacked when they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self._unpress = zstandard.ZstdDecompressor().decompress
        (size,) = struct.unpack_from("<I", data, 8)
        self.head = json.loads(self._unpress(data[12 : 12 + size]))
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        at, arrays = 12 + size, []
        for s in self.head["docs"]:
            arrays.append(np.frombuffer(self._unpress(data[at : at + s]), dtype="<i8"))
            at += s
        self.doc_ids = [None if null else int(d) for d, null in zip(arrays[0], arrays[2])]
        self.counts = arrays[1]
        self._data, self._blocks = data, []
        for row in self.head["blocks"]:
            ends = at + np.cumsum(row, dtype=np.int64)
            self._blocks.append(list(zip((ends - row).tolist(), ends.tolist())))
            at += sum(row)
        rank = np.frombuffer(self._unpress(data[at : at + self.head["ranks"]]), dtype="<u4")
        self._ranks = rank.reshape(self.bits, -1)
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, plane: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(bits of a block, ones before each STEP of them): its directory is counted when it is unpacked."""
        got = self._open.get((plane, b))
        if got is None:
            a, z = self._blocks[plane][b]
            raw = np.frombuffer(self._unpress(self._data[a:z]), dtype=np.uint8)
            bits = np.unpackbits(raw, bitorder="little", count=min(BLOCK_BITS, self.n - b * BLOCK_BITS)).view(bool)
            ones = np.add.reduceat(bits, np.arange(0, len(bits), STEP), dtype=np.int64)
            got = self._open[plane, b] = (bits, np.append(0, np.cumsum(ones)))
        return got

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i == 0:
            return 0
        b, inside = divmod(i - 1, BLOCK_BITS)
        bits, ones = self._block(plane, b)
        at = inside // STEP
        return int(self._ranks[plane, b]) + int(ones[at]) + int(np.count_nonzero(bits[at * STEP : inside + 1]))

    def access(self, i: int) -> int:
        """Token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            bit = bool(self._block(p, i // BLOCK_BITS)[0][i % BLOCK_BITS])
            ones = self._rank1(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _down(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i places."""
        lo, hi = self._down(token, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Place of the j-th occurrence (from 0) of the token."""
        lo, hi = self._down(token, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def _select(self, plane: int, bit: int, j: int) -> int:
        starts = np.arange(self._ranks.shape[1]) * BLOCK_BITS
        before = self._ranks[plane].astype(np.int64) if bit else starts - self._ranks[plane]
        b = int(np.searchsorted(before, j, side="right")) - 1
        bits, ones = self._block(plane, b)
        left = j - int(before[b])
        inner = ones if bit else np.minimum(np.arange(len(ones)) * STEP, len(bits)) - ones
        at = int(np.searchsorted(inner, left, side="right")) - 1
        places = np.flatnonzero(bits[at * STEP : (at + 1) * STEP] == bool(bit))
        return b * BLOCK_BITS + at * STEP + int(places[left - int(inner[at])])

    def locate(self, token: int) -> list[int]:
        """All places of the token."""
        return [self.select(token, j) for j in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens, plane by plane from the least significant."""
        out = np.zeros(self.n, dtype=np.uint16)
        for p in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._block(p, b)[0] for b in range(len(self._blocks[p]))] or [np.zeros(0, bool)])
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[: self.zeros[p]]
            up[np.flatnonzero(bit)] = out[self.zeros[p] :] | np.uint16(1 << (self.bits - 1 - p))
            out = up
            self._open = {k: v for k, v in self._open.items() if k[0] != p}
        return out


def write_file(path: str, data: bytes) -> None:
    """Whole or not at all: a second attempt of a task replaces the file by the same bytes."""
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, name)


def read_file(path: str) -> bytes:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def encode_corpus(
    docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    by_pieces: bool = True,
) -> DataFrame:
    """Write the shards to ``folder``; returns a written table of them in order:
    (bucket, shard, path, n_tokens, start).  ``by_pieces``: False encodes whole texts with any tokenizer."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # a range holds so many rows at most, whatever the setting; the first characters of the text split a hot id
    parts = max(partitions_of(spark), src.count() // RANGE_ROWS)
    order = [F.col("id").asc_nulls_last(), F.substring("text", 1, 32).asc_nulls_first()]
    placed = src.repartitionByRange(parts, *order).sortWithinPartitions(order[0], F.col("text").asc_nulls_first())
    schema = "bucket int, shard int, path string, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bucket, shard, size = pieces(vocabulary, by_pieces), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, size
            path = f"{folder}/shard-{bucket:06d}-{shard:06d}.lwwm"
            write_file(path, pack_shard(np.concatenate([t for _, t in held]), [d for d, _ in held], [len(t) for _, t in held]))
            row = {"bucket": pa.array([bucket], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [path], "n_tokens": [size]}
            held.clear()
            shard, size = shard + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                for d, ids in zip(b.column("id").to_pylist(), coder.texts(utf8(b.column("text")))):
                    held.append((d, np.append(ids, np.uint16(end_id))))
                    size += len(ids) + 1
                    if size >= SHARD_TOKENS:
                        yield flush()
        if held:
            yield flush()

    shards = written(placed.mapInArrow(run, schema), "wavelet-shards")
    # one number per range of rows goes to the driver, and back as the start of the range
    total, begins = 0, []
    for r in shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect():
        begins.append((r.bucket, total))
        total += r.n
    begins = spark.createDataFrame(begins, "bucket int, begin long")
    order = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.join(begins, "bucket").withColumn("start", F.col("begin") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return written(placed.drop("begin"), "wavelet-manifest")


def decode_corpus(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the table."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                s = Shard(read_file(path))
                ids = s.tokens().astype("<u4")
                ends = np.cumsum(s.counts)
                firsts = ends - s.counts
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(firsts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(firsts + start), pa.array(s.counts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = shards.select("path", "start").repartition(2 * partitions_of(shards.sparkSession), "path")
    return files.mapInArrow(run, schema)


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = encode_corpus(read_table(spark, sf_dir, "documents"), new_dir(spark, "wavelet"))
    return decode_corpus(shards)


QUERIES = {"op7_wavelet_tokens": op7_wavelet_tokens}
