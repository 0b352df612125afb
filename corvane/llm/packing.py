"""Best-fit packing of token sequences, with lower bounds that certify each partition's bin count.

Tokenising and cutting stay with the documents. The pieces, a few numbers each, are dealt by a hash into partitions
of bounded size; each is packed by best-fit decreasing and compared with its bound from dual feasible functions.
Partitions above their bound exchange the pieces of their unfilled bins and pack them again, until the bins meet the
bound over all pieces or a round brings nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import id_out, take_memory, with_key, written

#: The vocabulary's own normalisation and pre-tokens, as its file states them: fixed values.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What may follow a word of letters as a piece of its own.
ENDS = frozenset(b".,;:!?")
#: Words with other characters than these go to the library as they are.
LATIN = re.compile("[\x00-ſ]*")


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE writes bytes as printable characters: those that are printable as such, others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Token ids, as little-endian 32-bit numbers, of each white-space-delimited word (bytes). Two generations of at
    most `most` words each are remembered."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most, self.old, self.pieces = most, {}, {}
        self.chars = _byte_chars()

    def piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            shown = p if p.isascii() else "".join(map(self.chars.__getitem__, p.encode()))
            ids = self.pieces[p] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.piece(word.lower().decode())
            elif word[:-1].isalpha() and word[-1] in ENDS:
                ids = self.piece(word[:-1].lower().decode()) + self.piece(chr(word[-1]))
            else:
                ids = self.any_word(word.decode())
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def any_word(self, w: str) -> bytes:
        if w.isascii() and w.isprintable():
            parts = ASCII_PIECES.findall(w.lower())
        elif LATIN.fullmatch(w) and w.isprintable() and "İ" not in w:  # NFC leaves these characters as they are
            if w.isalpha():
                return self.piece(w.lower())
            if w[:-1].isalpha() and w[-1].isascii() and ord(w[-1]) in ENDS:
                return self.piece(w[:-1].lower()) + self.piece(w[-1])
            parts = PIECES.findall(w.lower())
        else:
            return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.piece, parts))

    def encode(self, text: bytes) -> bytes:
        """The library's ids for the whole text. White space ends words and leaves no token, so words stand alone."""
        if b"<|" in text:  # special tokens may hold or touch anything
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    take_memory("ids", _ids.clear)
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """Each text's ids and then end_id, cut into pieces of `most` where there are more. Null text: empty."""

    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_ids(vocabulary)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(text.as_buffer().to_pybytes() if text.is_valid else b"") + end
                n = len(ids) // 4
                if n <= most:
                    rows.append((doc, 0, 0, n, zlib.crc32(ids)))
                    continue
                for k, s in enumerate(range(0, n, most)):
                    part = ids[4 * s : 4 * (s + most)]
                    rows.append((doc, k, s, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_key(docs, "doc_id", ("text", "text")).mapInArrow(cut, PIECE_SCHEMA)


def lower_bound(counts: np.ndarray, room: int) -> int:
    """Least bins for counts[x] pieces of each length x: the best of the dual feasible functions f_e, which count a
    length over room - e as a whole bin, one under e as nothing and others as they are."""
    x = np.arange(room + 1)
    n, load = np.cumsum(counts), np.cumsum(counts * x)
    best = -(-int(load[-1]) // room)
    for e in range(1, room // 2 + 1):
        big = int(n[-1] - n[room - e])
        best = max(best, big + -(-int(load[room - e] - load[e - 1]) // room))
    return best


def best_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Open bins are kept by free space, the spaces in use as
    bits of one integer, so the tightest bin that fits is found at once."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    used, made = 0, 0
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        above = used >> x
        if above:
            f = x + (above & -above).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                used &= ~(1 << f)
        else:
            f, b = room, made
            made += 1
        bins[i], offset[i] = b, room - f
        if f > x:
            free[f - x].append(b)
            used |= 1 << (f - x)
    return bins, offset, made


PACKED = "uid long, length int, bin long, offset long, slack int, gap int, bins int"


def _pack(df: DataFrame, room: int, salt: int, size: int, n: int) -> DataFrame:
    """Deal (uid, length) into partitions of about `size` pieces and pack each."""
    parts = max(1, -(-n // size))

    def one(key, t):
        t = t.sort_by("uid")
        lengths = t["length"].to_numpy().astype(np.int64)
        bins, offset, made = best_fit_decreasing(lengths, room)
        filled = np.bincount(bins, lengths, made).astype(np.int64)
        gap = made - lower_bound(np.bincount(lengths, minlength=room + 1), room)
        base = ((salt << 28) + key[0].as_py()) << 31
        full = np.full(lengths.size, gap, np.int32)
        return pa.table({"uid": t["uid"], "length": pa.array(lengths.astype(np.int32)), "bin": bins + base, "offset": offset, "slack": (room - filled[bins]).astype(np.int32), "gap": full, "bins": np.where(offset == 0, 1, 0).astype(np.int32)})

    keyed = df.select("uid", F.col("length").cast("int").alias("length"), F.expr(f"pmod(xxhash64(uid, {salt}), {parts})").cast("int").alias("part"))
    return keyed.groupBy("part").applyInArrow(one, PACKED)


def pack(parts: DataFrame, room: int = 2048, size: int = 60_000, rounds: int = 4) -> DataFrame:
    """(uid, length) with `bin` and `offset` for each piece, gapless in every bin.

    Best-fit decreasing in partitions of about `size` pieces, then up to `rounds` exchanges between the partitions
    whose bins outnumber their bound, each in partitions twice the size of the last. No piece may be longer than `room`.
    """
    total = parts.groupBy("length").agg(F.count("*").alias("n")).where(f"length BETWEEN 0 AND {room}").collect()  # room + 1 rows at most
    counts = np.zeros(room + 1, np.int64)
    for r in total:
        counts[r["length"]] = r["n"]
    n, least = int(counts.sum()), lower_bound(counts, room)
    now = written(_pack(parts, room, 0, size, n), "packed")
    made = now.agg(F.sum("bins")).first()[0] or 0
    for k in range(1, rounds + 1):
        if made <= least:
            break
        # First the partitions above their own bound; then all, as each may meet its bound and they together not.
        moves = (F.col("slack") > 0) & ((F.col("gap") > 0) | F.lit(k > 1))
        loose = now.where(moves)
        m = loose.count()
        if m == 0:
            continue
        again = written(now.where(~moves).unionByName(_pack(loose, room, k, size << k, m)), "packed")
        fewer = again.agg(F.sum("bins")).first()[0] or 0
        if fewer >= made and k > 1 and m <= size << k:
            break
        if fewer <= made:
            now, made = again, fewer
    return now.select("uid", "bin", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, room: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document.

    A null or empty text is the end id alone. Every row is packed, repeated rows and rows without a doc_id too. Other
    columns are ignored.
    """
    cut = written(pieces(docs, vocabulary, room).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    out = cut.join(pack(cut.select("uid", "length"), room), "uid")
    return out.select(id_out(), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
