"""Best-fit packing of token sequences by exact complements.

Lengths are at most the capacity, so their counts are a table of bounded size (capacity rows), however
many documents there are. The plan is made on these counts: from the longest length down, a gap is
looked up among single lengths, sums of two and sums of three; a combination that fills it exactly is
used as often as its lengths are available, and only where there is none the best fit goes in and
the smaller gap is looked up again. The plan says which ranks of a length go where; ranks are
distributed prefix sums, so no task ever sees all pieces of a length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import per_worker, stored, table, with_sum_before
from chatseam.llm.registry import query

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY = 4096
END = 1

# Characters for which the cuts below are those of the tokenizer: Latin letters in composed form, no separators.
_PLAIN = re.compile("[\x00-\x1b\x20-ɏ]*").fullmatch
_UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\w\s]|_)+").findall
_CHUNK = re.compile(r"[^ \n\r\t]+").findall
# Words remembered by a worker; beyond them it starts anew.
REMEMBERED = 500_000


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers, remembering the ids of words.

    The tokenizer drops white space and cuts the rest into units that no merge crosses, so a unit's
    ids don't depend on its neighbours. Words of plain Latin characters are cut into units here, other
    texts only at blanks; every unit is encoded by the tokenizer itself, once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_unit = np.array([str(self.tokenizer.id_to_token(k)).endswith("</w>") for k in range(size)])
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _learn_units(self, missing: list[str]) -> None:
        """Encode many units in one text; each one's last token says that it ends a unit."""
        encoded = self.tokenizer.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, "<u4")
        ends = np.flatnonzero(self.ends_unit[ids]) + 1
        if len(ends) != len(missing):
            for unit, alone in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self.units[unit] = np.array(alone.ids, "<u4").tobytes()
            return
        data, start = ids.tobytes(), 0
        for unit, end in zip(missing, (4 * ends).tolist(), strict=True):
            self.units[unit] = data[start:end]
            start = end

    def _learn_words(self, missing: list[str]) -> None:
        """A word's ids are those of its units; units are fewer than words and are learnt once for all."""
        cut = [_UNIT(word) for word in missing]
        units = list({unit for found in cut for unit in found if unit not in self.units})
        for at in range(0, len(units), 4096):
            self._learn_units(units[at : at + 4096])
        for word, found in zip(missing, cut, strict=True):
            self.words[word] = b"".join([self.units[unit] for unit in found])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        for name in ("units", "words", "chunks"):
            if len(getattr(self, name)) > REMEMBERED:
                setattr(self, name, {})
        get, found, unknown, rest = self.words.get, [], {}, {}
        for text in texts:
            text = text or ""
            if _PLAIN(text) and "<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
                words = text.lower().split()
                parts = list(map(get, words))
                if None in parts:
                    places = [at for at, part in enumerate(parts) if part is None]
                    unknown[len(found)] = [(at, words[at]) for at in places]
                found.append(parts)
            else:
                rest[len(found)] = _CHUNK(text)
                found.append([])
        self._learn_words(list({word for places in unknown.values() for _, word in places}))
        for row, places in unknown.items():
            for at, word in places:
                found[row][at] = self.words[word]
        missing = list({word for words in rest.values() for word in words if word not in self.chunks})
        if missing:
            for word, encoded in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self.chunks[word] = np.array(encoded.ids, "<u4").tobytes()
        for row, words in rest.items():
            found[row] = [self.chunks[word] for word in words]
        return [b"".join(parts) for parts in found]


def token_pieces(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every document's ids, closed by ``end`` and cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers. Null and empty texts are the end alone.
    Repeated rows and null ids each come back. An empty table gives an empty result; other columns
    are not read. Whole texts are encoded, some at a time.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, close = per_worker(f"words {tokenizer}", lambda: WordTokenizer(tokenizer)), np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                owners, places, starts, lengths, pieces = [], [], [], [], []
                for owner, data in enumerate(encoder.encode(part.column(1).to_pylist())):
                    data += close
                    for place, start in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[start : start + 4 * capacity]
                        owners.append(owner)
                        places.append(place)
                        starts.append(start // 4)
                        lengths.append(len(piece) // 4)
                        pieces.append(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owners, pa.int64())), pa.array(places, pa.int32()),
                        pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return documents.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


class Available:
    """Counts of lengths, and an index of which sums two of them give."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        # pairs[s]: in how many ways two available lengths give s.
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        present = np.flatnonzero(self.count)
        for length in present.tolist():
            self.pairs[length + present[present > length]] += 1
        self.pairs[2 * np.flatnonzero(self.count > 1)] += 1

    def take(self, length: int, n: int) -> None:
        before, after = int(self.count[length]), int(self.count[length]) - n
        self.count[length] = after
        if before > 1 >= after:
            self.pairs[2 * length] -= 1
        if after == 0:
            self.pairs[length + np.flatnonzero(self.count)] -= 1

    def pair(self, left: np.ndarray, total: int) -> tuple[int, int] | None:
        """Two lengths that give ``total``, as near to each other as there are; ``left`` are the counts."""
        if total < 2:
            return None
        small = np.arange(1, total // 2 + 1)
        fits = (left[small] > 0) & (left[total - small] > 0)
        if total % 2 == 0 and left[total // 2] < 2:
            fits[-1] = False
        found = np.flatnonzero(fits)
        return (total - int(small[found[-1]]), int(small[found[-1]])) if len(found) else None

    def exact(self, left: np.ndarray, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths whose sum is the gap."""
        if left[gap] > 0:
            return (gap,)
        if self.pairs[gap] > 0 and (two := self.pair(left, gap)):
            return two
        first = np.arange(max(gap - 2, 0), (gap + 2) // 3 - 1, -1)
        first = first[(left[first] > 0) & (self.pairs[gap - first] > 0)] if gap > 2 else first[:0]
        for length in first[::-1].tolist():
            left[length] -= 1
            two = self.pair(left, gap - length)
            left[length] += 1
            if two:
                return (length, *two)
        return None


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``(how often, lengths)`` of sequences that together use every length as often as it is there.

    Each entry uses up one of its lengths but for a rest smaller than the times it stands in the
    entry, so there are at most some ``capacity`` times a small number of entries.
    """
    available, out = Available(counts, capacity), []
    for longest in range(capacity, 0, -1):
        while available.count[longest] > 0:
            left, parts, gap = available.count.copy(), [longest], capacity - longest
            left[longest] -= 1
            while gap > 0:
                more = available.exact(left, gap)
                if more is None:
                    fitting = np.flatnonzero(left[: gap + 1])
                    if not len(fitting):
                        break
                    more = (int(fitting[-1]),)
                for length in more:
                    left[length] -= 1
                    gap -= length
                parts += more
            lengths, times = np.unique(parts, return_counts=True)
            often = int((available.count[lengths] // times).min())
            for length, n in zip(lengths.tolist(), times.tolist(), strict=True):
                available.take(length, often * n)
            out.append((often, sorted(parts, reverse=True)))
    return out


def _slots(steps: Sequence[tuple[int, Sequence[int]]]) -> np.ndarray:
    """Rows of length, first rank, first sequence, times in a sequence, offset; sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for often, parts in steps:
        offset = 0
        for length in dict.fromkeys(parts):
            times = parts.count(length)
            rows.append((length, used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + often * times
            offset += length * times
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T


def pack(pieces: DataFrame, capacity: int = CAPACITY, ties: Sequence[str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``: sequences of at most ``capacity``.

    Offsets of a sequence follow on each other from 0. Rows whose length is null, under 1 or over
    ``capacity`` have null in both. Repeated rows get a place each. Columns of those two names are
    replaced, all others stay. ``ties`` names the columns whose hash orders rows of the same
    length (default: all but maps); equal rows are interchangeable.

    The driver sees one count a length (``capacity`` at most). The plan that goes to the workers has under a
    hundred rows for each of its entries, a few megabytes at most.
    """
    names = [name for name in pieces.columns if name not in ("sequence_id", "offset")]
    ties = [name for name, kind in pieces.dtypes if name in names and "map<" not in kind] if ties is None else list(ties)
    inside = F.col("length").between(1, capacity)
    rows = stored(
        pieces.select(
            F.when(inside, F.col("length").cast("bigint")).alias("_length"),
            F.xxhash64(*[F.col(f"`{name}`") for name in ties]).bitwiseAND(2**60 - 1).alias("_key"),
            F.struct(*[F.col(f"`{name}`") for name in names]).alias("_rest"),
        )
    )
    counts = {r["_length"]: r["count"] for r in rows.where("_length is not null").groupBy("_length").count().collect()}
    length, rank, sequence, times, offset = _slots(plan(counts, capacity))
    starts = (length << 44) + rank

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        own = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
        own_rank = ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(starts, (own << 44) + own_rank, side="right") - 1
        beyond = own_rank - rank[at]
        return pa.StructArray.from_arrays(
            [pa.array(sequence[at] + beyond // times[at]), pa.array(offset[at] + beyond % times[at] * own)],
            ["sequence_id", "offset"],
        )

    def back(rest: Column, placed: Column) -> list[Column]:
        return [rest.getField(name).alias(name) for name in names] + [
            placed.getField(name).cast("bigint").alias(name) for name in ("sequence_id", "offset")
        ]

    ranked = with_sum_before(rows.where("_length is not null"), "_length", F.col("_key"), F.lit(1).cast("bigint"), "_rank")
    placed = ranked.select("_rest", place("_length", "_rank").alias("_placed")).select(*back(F.col("_rest"), F.col("_placed")))
    nowhere = F.lit(None).cast("struct<sequence_id: bigint, offset: bigint>")
    return placed.unionByName(rows.where("_length is null").select(*back(F.col("_rest"), nowhere)))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, doc_ids, starts``: the packed sequences themselves.

    A sequence holds at most the capacity, so its group is small. ``starts`` are the offsets at
    which a document's piece begins, for attention that stays within documents.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (
        packed.where("sequence_id is not null")
        .groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, part: total + part["length"]).alias("length"),
            F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"])).alias("ids"),
            F.transform("parts", lambda part: part["doc_id"]).alias("doc_ids"),
            F.transform("parts", lambda part: part["offset"]).alias("starts"),
        )
    )


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
