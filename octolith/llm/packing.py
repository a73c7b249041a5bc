"""Best-fit packing of documents into fixed-size sequences (operator 6).

Best-two-fit: open a bin with the longest piece, fill the gap greedily with the longest pieces that
fit, then, while it tightens the bin, replace its smallest piece with two unpacked pieces that fit
the expanded gap better.

Lengths are integers up to the capacity, so the packer sees only the histogram of lengths (at most
``capacity`` counts, whatever the input).  A step makes one pattern of lengths and repeats it as
often as the counts allow, so its work is bounded by the capacity too.  Each piece then finds its
place by its rank among the pieces of its length: no document is ever gathered in one task.

Nulls and empty texts: a document of the end token alone.  Repeated rows: each row is packed on its
own (the same doc_id may be there twice).  An empty table gives an empty result.  Extra columns are
ignored.  Very long texts are cut into pieces of ``capacity`` tokens; shorter ones never.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import grouped_rank, materialize, table

CAPACITY, END_ID = 4096, 1
#: Words, and stretches without white space, that a worker remembers the ids of.
REMEMBERED = 250_000
#: Pieces of one length are ranked in this many blocks at least, and in one for so many pieces.
BLOCKS, PER_BLOCK = 64, 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# In texts of these characters alone, lower-casing and the split into words are the same in every
# implementation.  Any other text, and one with the start of a special token, goes to the tokenizer whole.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ÿ]|<\|")
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")


class Encoder:
    """Token ids of a text, as little-endian 32-bit octets, of a word-wise tokenizer file.

    White space always ends a word, so a text is split there first and the ids of a whole stretch are
    looked up; only unknown stretches are split into words, and only unknown words encoded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def new_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, from one call: the tokens that end a word tell them apart."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words):
            return {w: self.whole(w) for w in words}
        octets, stops = ids.tobytes(), (4 * stops).tolist()
        return {w: octets[i:j] for w, i, j in zip(words, [0, *stops], stops, strict=False)}

    def encode(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return self.whole(text)
        stretches = text.split()
        parts = list(map(self.stretches.get, stretches))
        if None in parts:
            known, at = self.words, [i for i, part in enumerate(parts) if part is None]
            missing = {x: _WORDS.findall(x.lower()) for x in {stretches[i] for i in at}}
            new = list({w for words in missing.values() for w in words if w not in known})
            fresh = self.new_words(new) if new else {}
            if len(known) < REMEMBERED:  # the common words come early
                known.update(fresh)
            found = {x: b"".join([known[w] if w in known else fresh[w] for w in words]) for x, words in missing.items()}
            if len(self.stretches) < REMEMBERED:
                self.stretches.update(found)
            for i in at:
                parts[i] = found[stretches[i]]
        return b"".join(parts)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: place in its document and CRC-32 of its ids."""
    store = docs.sparkSession.sparkContext.broadcast({})  # a worker's own memory, kept between tasks
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = store.value.setdefault("encoder") or Encoder(tokenizer)
        store.value["encoder"] = encoder
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(d), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin) with how often each is used, from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths, out = sorted(left), []

    def longest(most: int, used: Counter) -> int:
        """The longest length up to ``most`` with a piece that the bin doesn't use yet; 0 if there is none."""
        i = bisect_right(lengths, most)
        while i and left[lengths[i - 1]] <= used[lengths[i - 1]]:
            i -= 1
        return lengths[i - 1] if i else 0

    def best_two(room: int, used: Counter, beat: int) -> tuple[int, int] | None:
        """Two unpacked pieces with the largest sum up to ``room``, if over ``beat``."""
        free = np.array([n for n in lengths[: bisect_right(lengths, room - 1)] if left[n] > used[n]], dtype=np.int64)
        if not len(free):
            return None
        at = np.searchsorted(free, np.minimum(free, room - free), side="right") - 1
        lone = np.array([left[int(n)] - used[int(n)] < 2 for n in free])
        at = np.where((at >= 0) & (free[at] == free) & lone, at - 1, at)
        total = np.where(at >= 0, free + free[at], 0)
        k = int(total.argmax())
        return (int(free[k]), int(free[at[k]])) if total[k] > beat else None

    while lengths:
        bin_, used = [lengths[-1]], Counter([lengths[-1]])
        gap = capacity - bin_[0]
        while gap and (n := longest(gap, used)):
            bin_.append(n)
            used[n] += 1
            gap -= n
        while gap and len(bin_) > 1:
            small = min(bin_)
            used[small] -= 1
            two = best_two(gap + small, used, small)
            if two is None:
                used[small] += 1
                break
            bin_.remove(small)
            bin_ += two
            used.update(two)
            gap = capacity - sum(bin_)
        used = Counter(bin_)
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del lengths[bisect_right(lengths, n) - 1]
        out.append((sorted(bin_, reverse=True), times))
    return out


def _slots(counts: dict[int, int], patterns: list[tuple[list[int], int]]) -> tuple[dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """Where each length's ranks begin on one axis; begin, first sequence and offset of the runs on that axis."""
    base, at = {}, 0
    for n in sorted(counts):
        base[n] = at
        at += counts[n]
    begin, first, offset, free, sequence = [], [], [], dict(base), 0
    for lengths, times in patterns:
        place = 0
        for n in lengths:
            begin.append(free[n]), first.append(sequence), offset.append(place)
            free[n] += times
            place += n
        sequence += times
    order = np.argsort(np.array(begin, dtype=np.int64))
    return base, *(np.array(x, dtype=np.int64)[order] for x in (begin, first, offset))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut_pieces(docs, tokenizer, capacity), "pieces")
    counts = {int(r.length): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    base, begin, first, offset = _slots(counts, plan_bins(counts, capacity))
    starts = np.zeros(capacity + 1, dtype=np.int64)
    for n, at in base.items():
        starts[n] = at
    plan = docs.sparkSession.sparkContext.broadcast((starts, begin, first, offset))  # its size depends on the capacity only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, begin, first, offset = plan.value
        for b in batches:
            at = starts[b.column(3).to_numpy()] + b.column(5).to_numpy()
            k = np.searchsorted(begin, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[k] + at - begin[k]), pa.array(offset[k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    crowded = {n: c // PER_BLOCK for n, c in counts.items() if c // PER_BLOCK > BLOCKS}
    blocks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for n_blocks in sorted(crowded.items()) for x in n_blocks]), F.col("length")), F.lit(BLOCKS)) if crowded else F.lit(BLOCKS)
    ranked = grouped_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), blocks))
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def tokenizer_path(tokenizer: str) -> str:
    """A path as it is; the name of a public vocabulary file where this worker has it."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def default_tokenizer() -> str:
    return "word_bpe_49k.json"


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
