"""Terms, vocabularies and class-based topic keywords."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatseam.functions.text import tokens, with_bigrams
from chatseam.session import saved

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Parts into which the rows of one term are split; a power of two.
SALTS = 64
# Bytes of text counted at once; a longer text is counted alone.
BYTES = 2**23
# What lies between words: see TOKEN_PATTERN.
BETWEEN = r"[^\p{L}\p{N}_]+"


def terms(text: Column, stop_words: Iterable[str] = (), bigrams: bool = True) -> Column:
    """Words and, with ``bigrams``, pairs of neighbours after stop words are gone."""
    words = tokens(text, stop_words)
    return with_bigrams(words) if bigrams else words


def document_frequencies(
    documents: DataFrame,
    text: str = "raw_text",
    min_df: int = 5,
    stop_words: Iterable[str] = (),
    bigrams: bool = True,
) -> DataFrame:
    """``(term, documents)`` for terms in at least ``min_df`` documents.

    Each batch of documents gives a term once with its number of documents, so plain sums suffice.
    """
    batches = postings(documents, None, text, stop_words, bigrams)
    summed = batches.groupBy("term").agg(F.sum("documents").alias("documents"))
    return summed.where(F.col("documents") >= min_df)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows brought together or taken apart to about ``BYTES`` of ``size``."""
    held: list[pa.RecordBatch] = []
    room = BYTES
    for batch in batches:
        ends = np.cumsum(batch.column("size").to_numpy())
        at, done = 0, 0
        while at < len(ends):
            to = max(int(np.searchsorted(ends, done + room, side="right")), at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                room -= int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
            if at < len(ends):
                yield pa.Table.from_batches(held)
                held, room = [], BYTES
    if held:
        yield pa.Table.from_batches(held)


def _posted(
    text: pa.Array, stop_words: list[str], bigrams: bool, owner: np.ndarray | None = None
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of lower-cased texts, where the rows of each end, those rows, and how often each has the term.

    With ``owner`` the texts of one owner count as one row, the owner's.
    """
    words = pc.split_pattern_regex(text, BETWEEN)
    encoded = words.flatten().dictionary_encode()
    names, code = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    long, stops = pc.greater(pc.utf8_length(names), 1), pc.is_in(names, pa.array(stop_words, names.type))
    wanted = pc.and_not(long, stops).to_numpy(zero_copy_only=False)[code]
    code, row = code[wanted], row[wanted]

    def grouped(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        both, n = np.unique(code * len(words) + (row if owner is None else owner[row]), return_counts=True)
        of, rows = np.divmod(both, len(words))
        found, sizes = np.unique(of, return_counts=True)
        return found, sizes, rows, n

    found, sizes, rows, n = grouped(code, row)
    named = names.take(pa.array(found))
    if bigrams:
        same = row[1:] == row[:-1]
        pairs, place = np.unique(code[:-1][same] * len(names) + code[1:][same], return_inverse=True)
        _, more_sizes, more_rows, more_n = grouped(place, row[1:][same])
        left, right = np.divmod(pairs, max(1, len(names)))
        joined = pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right)), pa.scalar(" ", names.type))
        named = pa.concat_arrays([named, joined])
        sizes, rows, n = (np.concatenate(x) for x in ((sizes, more_sizes), (rows, more_rows), (n, more_n)))
    return named, np.cumsum(sizes), rows, n


def postings(documents: DataFrame, key: str | None, text: str, stop_words: Iterable[str], bigrams: bool) -> DataFrame:
    """A term once for each batch of documents: ``(term, keys, ns)``, or ``(term, documents)`` without a key."""
    stops = sorted(set(stop_words))
    lower = F.lower(F.col(text)).alias("text")
    rows = documents.select(*([F.col(key).alias("key")] if key else []), lower).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    lists = f"keys array<{rows.schema['key'].dataType.simpleString()}>, ns array<bigint>" if key else "documents bigint"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            named, ends, rows, n = _posted(part.column("text").combine_chunks(), stops, bigrams)
            if not key:
                yield pa.RecordBatch.from_arrays([named, pa.array(np.diff(ends, prepend=0))], ["term", "documents"])
                continue
            keys = part.column("key").combine_chunks().take(pa.array(rows))
            # In pieces, as a row holds many keys.
            for at in range(0, len(named), 20_000):
                to = min(at + 20_000, len(named))
                begins = np.r_[0, ends][at : to + 1]
                cut = slice(begins[0], begins[-1])
                offsets = pa.array((begins - begins[0]).astype(np.int32))
                columns = [named.slice(at, to - at), *(pa.ListArray.from_arrays(offsets, x) for x in (keys[cut], pa.array(n[cut])))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "keys", "ns"])

    return rows.mapInArrow(post, f"term string, {lists}")


def counted(words: Column) -> Column:
    """``(term, n)`` of an array, counted within the row: sorted, equal words lie side by side."""

    def runs(found: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(found))
        starts = F.filter(places, lambda at: (at == 1) | (F.element_at(found, at) != F.try_element_at(found, F.greatest(at - 1, F.lit(1)))))
        return F.transform(F.array(starts), lambda begins: _lengths(found, begins))[0]

    def _lengths(found: Column, begins: Column) -> Column:
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(found) + 1))
        return F.zip_with(
            begins, ends, lambda at, end: F.struct(F.element_at(found, at).alias("term"), (end - at).cast("bigint").alias("n"))
        )

    # Empty arrays go first, as a sequence from 1 to 0 would count down. The sorted words
    # become a lambda variable, so that they are cut out of the text and sorted once.
    present = F.filter(F.array(F.array_sort(words)), lambda found: F.size(found) > 0)
    return F.flatten(F.transform(present, runs))


def term_counts(
    documents: DataFrame,
    key: str = "message_id",
    text: str = "raw_text",
    stop_words: Iterable[str] = (),
    bigrams: bool = True,
) -> DataFrame:
    """``(key, term, n)``, keys that several documents share taken together.

    Each document counts its terms within its row. The rows are shuffled once, by term and one of ``SALTS`` parts of the
    keys; what groups by key and term, or by term and part, needs no further shuffle.
    """
    rows = documents.select(key, F.inline(counted(terms(F.col(text), stop_words, bigrams))))
    return _combined(rows, key).select(key, "term", "n")


def _combined(rows: DataFrame, key: str) -> DataFrame:
    # Neither key can be null here. Else a join would add that as a filter to its use of the rows, and they
    # would be shuffled once for each use.
    salted = rows.where(F.col("term").isNotNull()).withColumn("_salt", F.xxhash64(key).bitwiseAND(F.lit(SALTS - 1)))
    parts = salted.repartition("term", "_salt")
    return parts.groupBy(key, "term", "_salt").agg(F.sum("n").alias("n"))


def _parts(names: pa.Array, parts: int) -> np.ndarray:
    """A part for each term, from its bytes alone."""
    if len(names) > 50_000:
        # In pieces, as every byte becomes a number.
        return np.concatenate([_parts(names.slice(at, 50_000), parts) for at in range(0, len(names), 50_000)])
    if not len(names):
        return np.empty(0, np.int64)
    names = names.cast(pa.large_binary())
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    factors = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    hashes = np.add.reduceat((data + np.uint64(1)) * factors[np.arange(len(data)) - np.repeat(starts, lengths)], starts)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((hashes >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _packed(names: pa.Array) -> bytes:
    """Terms, which hold no line ends, in few bytes."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.scalar("\n", names.type))
    return pa.compress(joined[0].as_buffer(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> pa.Array:
    with pa.CompressedInputStream(pa.BufferReader(data), "zstd") as stream:
        return pc.split_pattern(pa.array([stream.read()], pa.binary()).cast(pa.string()), "\n").values


def vocabulary_counts(
    documents: DataFrame,
    key: str = "message_id",
    text: str = "raw_text",
    min_df: int = 5,
    stop_words: Iterable[str] = (),
    bigrams: bool = True,
) -> DataFrame:
    """Term counts restricted to terms found in at least ``min_df`` documents.

    A document's counts are many times its text, so they never travel. Texts are shuffled once into batches of about
    half of ``BYTES`` (``_salt``), by key, as documents that share their key are one. Each batch sends its terms once, packed, to
    the parts of the vocabulary; these add up documents and send back one bit for each term. The batch is then counted again and gives
    what the vocabulary has, so what is grouped by key afterwards has met in one task.
    """
    stops = sorted(set(stop_words))
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches, parts = 2 * size // BYTES + 1, size // (2 * BYTES) + 1
    # The salt can't be null, which the planner must see: else the join would add that as a filter to its use of the
    # texts, and they would be shuffled once for each use.
    salt = F.coalesce(F.pmod(F.xxhash64(key), F.lit(batches)), F.lit(0))
    texts = documents.select(salt.alias("_salt"), F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).repartition("_salt")
    key_type = texts.schema["key"].dataType.simpleString()

    def counts(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        # Rows come in any order; terms are listed in the order of texts, which is the same each time.
        table = table.sort_by("text")
        keys = table.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        named, ends, rows, n = _posted(table.column("text").combine_chunks(), stops, bigrams, keys.indices.to_numpy())
        part = _parts(named, parts)
        order = np.argsort(part, kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        return keys.dictionary, named, ends, rows, n, dict(zip(found.tolist(), np.split(order, starts)[1:], strict=True))

    def listed(table: pa.Table) -> pa.Table:
        _, named, ends, _, _, of_part = counts(table)
        # More than min_df documents are as good as min_df.
        found = np.minimum(np.diff(ends, prepend=0), min_df).astype(np.int32)
        rows = [(part, _packed(named.take(pa.array(places))), found[places].tobytes()) for part, places in of_part.items()]
        columns = [[table.column("_salt")[0].as_py()] * len(rows), *(list(zip(*rows, strict=True)) or [[]] * 3)]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_salt", "part", "terms", "documents"])

    def judged(table: pa.Table) -> pa.Table:
        documents = [np.frombuffer(x, np.int32) for x in table.column("documents").to_pylist()]
        code = pa.concat_arrays([_unpacked(x) for x in table.column("terms").to_pylist()]).dictionary_encode().indices.to_numpy()
        kept = (np.bincount(code, np.concatenate(documents)) >= min_df)[code]
        bits = [np.packbits(x).tobytes() for x in np.split(kept, np.cumsum([len(x) for x in documents])[:-1])]
        return pa.table([table.column("_salt"), table.column("part"), pa.array(bits, pa.binary())], ["_salt", "part", "kept"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bits in zip(batch.column("rows"), batch.column("bits"), strict=True):
                keys, named, ends, owners, n, of_part = counts(pa.Table.from_struct_array(rows.values))
                kept = np.zeros(len(named), bool)
                for one in bits.as_py():
                    places = of_part[one["part"]]
                    kept[places] = np.unpackbits(np.frombuffer(one["kept"], np.uint8), count=len(places)).astype(bool)
                sizes = np.diff(ends, prepend=0)
                wanted = np.flatnonzero(np.repeat(kept, sizes))
                term = np.repeat(np.arange(len(named)), sizes)
                columns = []
                for at in range(0, len(wanted), 100_000):
                    some = wanted[at : at + 100_000]
                    columns = [keys.take(pa.array(owners[some])), named.take(pa.array(term[some])), pa.array(n[some])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "term", "n"])
                del keys, named, columns
                pa.default_memory_pool().release_unused()

    lists = texts.groupBy("_salt").applyInArrow(listed, "_salt long, part long, terms binary, documents binary")
    bits = lists.groupBy("part").applyInArrow(judged, "_salt long, part long, kept binary")
    answers = bits.groupBy("_salt").agg(F.collect_list(F.struct("part", "kept")).alias("bits"))
    whole = texts.groupBy("_salt").agg(F.collect_list(F.struct("key", "text")).alias("rows"))
    found = whole.join(answers, "_salt").select("rows", "bits").mapInArrow(choose, f"key {key_type}, term string, n long")
    return found.select(F.col("key").alias(key), "term", "n")


def class_term_weights(
    documents: DataFrame,
    topic: str,
    text: str = "raw_text",
    min_df: int = 1,
    stop_words: Iterable[str] = (),
    bigrams: bool = True,
) -> DataFrame:
    """Class-based TF-IDF: ``(topic, term, n, weight)``.

    The documents of a topic count as one long document: a term's share of the
    topic times ``log(1 + words per topic / count of the term)``. ``min_df``
    therefore counts topics. Terms are combined per topic before the shuffle;
    what remains per term is at most one row per topic.
    """
    exploded = documents.where(F.col(topic).isNotNull()).select(
        F.col(topic).alias("topic"), F.explode(terms(F.col(text), stop_words, bigrams)).alias("term")
    )
    counts = exploded.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    per_term = Window.partitionBy("term")
    kept = (
        counts.withColumn("_all", F.sum("n").over(per_term))
        .withColumn("_df", F.count(F.lit(1)).over(per_term))
        .where(F.col("_df") >= min_df)
    )
    # Three uses: the weights, the topics' sizes and their average.
    kept = saved(kept)
    sizes = kept.groupBy("topic").agg(F.sum("n").alias("_size"))
    average = sizes.agg(F.avg("_size")).scalar()
    weight = F.col("n") / F.col("_size") * F.log(1 + average / F.col("_all"))
    return kept.join(sizes, "topic").select("topic", "term", "n", weight.alias("weight"))


def topic_keywords(weights: DataFrame, top: int = 10, outlier=-1) -> DataFrame:
    """The ``top`` terms of every topic but the outliers, ranked by weight, then by term."""
    kept = weights if outlier is None else weights.where(F.col("topic") != F.lit(outlier))
    # Rounding keeps equal weights equal whatever the order of summation.
    window = Window.partitionBy("topic").orderBy(F.round("weight", 12).desc(), "term")
    return kept.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def topic_info(
    documents: DataFrame, keywords: DataFrame, topic: str, name_words: int = 4, limit: int = 20, outlier=-1
) -> DataFrame:
    """``(topic, count, name, words)`` of the largest topics."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda pair: pair["term"])
    listed = keywords.groupBy("topic").agg(words.alias("words"))
    sized = documents.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic"))
    sized = sized.agg(F.count(F.lit(1)).alias("count"))
    if outlier is not None:
        sized = sized.where(F.col("topic") != F.lit(outlier))
    name = F.concat_ws("_", F.col("topic").cast("string"), F.slice("words", 1, name_words))
    return (
        sized.join(listed, "topic", "left")
        .select("topic", "count", name.alias("name"), "words")
        .orderBy(F.desc("count"), "topic")
        .limit(limit)
    )


def attach_topics(documents: DataFrame, topics: DataFrame, key: str = "message_id") -> DataFrame:
    """Give each document its topic by key instead of by position."""
    return documents.join(topics, key)
