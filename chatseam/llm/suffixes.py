"""Removal of repeated byte strings with per-shard suffix arrays.

Every string of ``length`` bytes has an anchor: the smallest hash among its grams. Equal strings have equal
anchors, so they meet if regions around anchors are grouped by anchor hash. Regions whose anchor
occurs once can't repeat and never leave their document's task. The others, distinct by content,
fill shards; a shard sorts all its suffixes by prefix doubling that only refines groups still open (Larsson and
Sadakane), up to the length asked for. Regions of very common anchors are dealt to several shards, whose sorted
strings are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import small_batches, stored, table
from chatseam.llm.registry import query

LENGTH = 200
GRAM = 64
CHUNK = 1 << 19
SHARD_BYTES = 1 << 21
LAST = 2**63 - 1
# A filter of 32 MB at most; more anchors only make it pass more regions.
MOST_FILTER_BITS = 1 << 28
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)]) for b in (_BASE, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: len(x) - width + 1], behind[width - 1 : len(x)])


def anchors(data: bytes, powers: tuple[np.ndarray, np.ndarray], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """``hash, first, last`` of every anchor, in slices: the strings that start at ``first .. last`` have this anchor.

    A string's anchor is its gram of smallest hash, the leftmost one of equals, which depends on the string alone.
    """
    low = np.uint64((1 << 20) - 1)
    for at in range(0, len(data) - length + 1, CHUNK):
        raw = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(CHUNK + length - 1, len(data) - at))
        n = len(raw)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw + np.uint64(1)) * powers[0][:n], out=sums[1:])
        hashes = _mixed((sums[gram:] - sums[:-gram]) * powers[1][: n - gram + 1])
        places = np.arange(len(hashes), dtype=np.uint64)
        chosen = (_sliding_min((hashes & ~low) | places, length - gram + 1) & low).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        ends = np.r_[starts[1:], len(chosen)] - 1
        yield hashes[chosen[starts]], starts + at, ends + at


def _filter_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four bits of one block of 512."""
    block = (hashes >> np.uint64(20)) % np.uint64(bits // 512) * np.uint64(512)
    return [(block + ((_mixed(hashes + np.uint64(1)) >> np.uint64(9 * k)) & np.uint64(511))).astype(np.int64) for k in range(4)]


def refine(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of every suffix among all by its first ``length`` bytes; equal ranks are equal strings.

    Ranks start from packed words of 8 bytes; each round doubles the depth for suffixes in groups that
    are still open, the others are settled. A rank is the place of its group's first suffix in the suffix array.
    """
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = text
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    rank = np.zeros(n, dtype=np.int64)
    active, depth = np.arange(n), 8
    base = np.zeros(n, dtype=np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        # Place in the suffix array: the old group's place, and how far into it.
        old = base[order]
        first_of_old = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        place = np.arange(len(order)) - np.repeat(first_of_old, np.diff(np.r_[first_of_old, len(order)])) + old
        group = np.cumsum(new) - 1
        value = place[new][group]
        rank[active[order]] = value
        open_ = np.bincount(group)[group] > 1
        if depth >= length or not open_.any():
            return rank
        active = active[np.sort(order[open_])]
        step = min(depth, length - depth)
        base = rank[active]
        ahead = active + step
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (base.astype(np.uint64) << np.uint64(32)) | following.astype(np.uint64)
        depth += step


def repeated_starts(regions: list[bytes], counts: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of a string of ``length`` bytes in a region: region, rank of the string, occurrences of the string."""
    sizes = np.fromiter(map(len, regions), dtype=np.int64, count=len(regions))
    begins = np.cumsum(sizes) - sizes
    rank = refine(np.frombuffer(b"".join(regions), dtype=np.uint8), length)
    region = np.repeat(np.arange(len(regions)), sizes - length + 1)
    offset = np.arange(len(region)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
    own = rank[begins[region] + offset]
    total = np.bincount(own, weights=np.asarray(counts, dtype=float)[region])
    return region, own, total[own]


def _runs(flags: np.ndarray) -> np.ndarray:
    """Runs of set flags as pairs of first and last."""
    edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1], axis=1).astype(np.int32)


def _document(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)), "_text_id": F.xxhash64("text")})


def repeated_runs(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 20_000) -> DataFrame:
    """``id, text_id, runs`` of documents with repeated strings; a run is a pair of first and last start."""
    small_batches(documents.sparkSession)
    texts = _document(documents.select("doc_id", "text")).select("_id", "_text_id", F.col("text").cast("binary")).where(F.octet_length("text") >= length)
    signed = np.int64

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK + length)
        for batch in batches:
            found = [h for data in batch.column(2).to_pylist() for h, _, _ in anchors(data, powers, length, gram)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(signed))], ["h"])

    shared = stored(texts.mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    entries, anchors_in_all = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most 100,000 anchors are common enough to be dealt to several shards.
    limit = max(hot, anchors_in_all // 100_000)
    salts = {r["h"]: -(-r["n"] // limit) for r in shared.where(F.col("n") > limit).collect()}
    bits = int(np.clip(entries * 12 // 512 * 512 + 512, 512, MOST_FILTER_BITS))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_filter_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 5), pa.array(np.int64(1) << (places & 31))], ["word", "bit"])

    collected = shared.select("h").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    sieve = np.zeros(bits // 32, dtype=np.uint32)
    sieve[collected.column("word").to_numpy()] = collected.column("bits").to_numpy().astype(np.uint32)
    known = documents.sparkSession.sparkContext.broadcast((sieve, salts))

    def regions(data: bytes, powers) -> Iterator[tuple[int, int, bytes]]:
        """Hash, first start and bytes of every region whose anchor may occur elsewhere."""
        sieve = known.value[0]
        for h, first, last in anchors(data, powers, length, gram):
            keep = np.ones(len(h), dtype=bool)
            for place in _filter_places(h, bits):
                keep &= (sieve[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1
            for x, a, b in zip(h[keep].view(signed).tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                yield x, a, data[a : b + length]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK + length)
        for batch in batches:
            counts: dict[tuple[int, bytes], int] = {}
            for data in batch.column(2).to_pylist():
                for h, _, region in regions(data, powers):
                    counts[h, region] = counts.get((h, region), 0) + 1
            salt = [xxhash.xxh3_64_intdigest(r) % known.value[1].get(h, 1) for h, r in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in counts], pa.int64()), pa.array(salt, pa.int32()), pa.array([r for _, r in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())],
                ["h", "salt", "region", "n"],
            )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kinds: 0 runs of a region; 1 a string that its shard has once, 2 one that it has more often (common anchors only)."""
        names = ["kind", "h", "r", "runs", "d1", "d2"]

        def rows(kind, h, r, runs, digests):
            pairs = np.frombuffer(b"".join(digests), dtype=">i8").astype(signed).reshape(-1, 2) if digests else np.zeros((len(h), 2), signed)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), kind, np.int32)), pa.array(h, pa.int64()), pa.array(r, pa.int64()), pa.array(runs, pa.binary()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)

        def name(region: bytes) -> int:
            return int(np.uint64(xxhash.xxh3_64_intdigest(region)).astype(signed))

        def shard(members: list[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
            owner, rank, total = repeated_starts([m[1] for m in members], [m[2] for m in members], length)
            bounds = np.searchsorted(owner, np.arange(len(members) + 1))
            out, single, multiple = [], [], {}
            for k, (h, region, _) in enumerate(members):
                a, b = bounds[k], bounds[k + 1]
                runs = _runs(total[a:b] > 1)
                if len(runs):
                    out.append((h, name(region), runs.tobytes()))
                if h in known.value[1]:
                    for s in range(b - a):
                        digest = xxhash.xxh3_128_digest(region[s : s + length])
                        if total[a + s] > 1:
                            multiple[rank[a + s]] = (h, 0, b"", digest)
                        else:
                            single.append((h, name(region), np.array([s, s], np.int32).tobytes(), digest))
            if out:
                yield rows(0, *zip(*out, strict=True), [])
            for kind, found in ((1, single), (2, list(multiple.values()))):
                if found:
                    yield rows(kind, *zip(*found, strict=True))

        def alone(members) -> bool:
            return len(members) == 1 and members[0][0] not in known.value[1]

        full: list[tuple[int, bytes, int]] = []
        group: list[tuple[int, bytes, int]] = []
        size, at = 0, None

        def close():
            """A group ends: one region by itself repeats wholly or not at all."""
            nonlocal size
            if alone(group):
                h, region, n = group[0]
                if n > 1:
                    return [(h, name(region), np.array([0, len(region) - length], np.int32).tobytes())]
                # Strings of one region have their anchor at different places, so they all differ.
                return []
            full.extend(group)
            size += sum(len(m[1]) for m in group)
            return []

        for batch in batches:
            whole = []
            for h, salt, region, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (h, salt) != at:
                    whole += close() if group else []
                    group, at = [], (h, salt)
                    if size >= SHARD_BYTES:
                        yield from shard(full)
                        full, size = [], 0
                group.append((h, region, n))
            if whole:
                yield rows(0, *zip(*whole, strict=True), [])
        whole = close() if group else []
        if whole:
            yield rows(0, *zip(*whole, strict=True), [])
        if full:
            yield from shard(full)

    sorted_ = stored(
        texts.mapInArrow(distinct, "h long, salt int, region binary, n long")
        .groupBy("h", "salt", "region").agg(F.sum("n").alias("n"))
        .repartition("h", "salt").sortWithinPartitions("h", "salt")
        .mapInArrow(sort, "kind int, h long, r long, runs binary, d1 long, d2 long")
    )
    strings = sorted_.where("kind > 0")
    several = strings.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    merged = strings.where("kind = 1").join(several, ["d1", "d2"]).select("h", "r", "runs")
    covers = sorted_.where("kind = 0").select("h", "r", "runs").unionByName(merged)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(CHUNK + length)
        for batch in batches:
            out = [
                (h, int(np.uint64(xxhash.xxh3_64_intdigest(region)).astype(signed)), first, k)
                for k, data in enumerate(batch.column(2).to_pylist())
                for h, first, region in regions(data, powers)
            ]
            if out:
                h, r, first, owner = (pa.array(x, pa.int64()) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([h, r, batch.column(0).take(owner), batch.column(1).take(owner), first], ["h", "r", "id", "text_id", "first"])

    found = texts.mapInArrow(occurrences, "h long, r long, id long, text_id long, first long").join(covers, ["h", "r"])
    return found.groupBy("id", "text_id").agg(F.collect_set(F.struct("first", "runs")).alias("runs"))


def _cut(length: int):
    @F.arrow_udf("struct<kept: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint>")
    def cut(text: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for data, parts in zip(text.to_pylist(), runs.to_pylist(), strict=True):
            data = data or b""
            if not parts:
                out.append({"kept": data, "n_bytes": len(data), "n_removed": 0, "n_spans": 0})
                continue
            change = np.zeros(len(data) + 1, dtype=np.int32)
            for part in parts:
                pairs = np.frombuffer(part["runs"], dtype=np.int32).reshape(-1, 2) + part["first"]
                np.add.at(change, pairs[:, 0], 1)
                np.add.at(change, pairs[:, 1] + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            left = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            out.append({"kept": left, "n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": len(_runs(gone))})
        return pa.array(out, pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]))

    return cut


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans``: texts without the bytes of strings of ``length`` bytes that start anywhere else too.

    Strings are judged on the input and within documents, which they never cross. ``kept`` is binary: a cut may
    split a character. Null text counts as empty and, like texts shorter than ``length``, loses nothing. Repeated rows are
    other places, so they lose all their strings. Null ids take part. Very long texts are anchored in slices. An empty table gives an empty result.
    """
    runs = repeated_runs(documents, length, gram).select(F.col("id").alias("_id"), F.col("text_id").alias("_text_id"), F.col("runs").alias("_runs"))
    joined = _document(documents.select("doc_id", "text")).join(runs, ["_id", "_text_id"], "left")
    return joined.select("doc_id", _cut(length)(F.col("text").cast("binary"), "_runs").alias("c")).select("doc_id", "c.*")


@query("op6_suffixes")
def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
