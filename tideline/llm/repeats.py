"""Removal of long byte strings that occur more than once, by run-length indexes over repetitive pieces.

Where. Each string of ``LENGTH`` bytes is named by the smallest hash among its ``GRAM``-byte grams, so equal
strings have equal names. Neighbouring starts of one name make a piece; pieces whose name occurs nowhere else hold no
repeat and go no further. A first pass over the texts counts names. A second one lays out the pieces of repeated names,
which it knows from one bit per name in a map of at most ``MOST_BITS`` bits; names that share a bit with a repeated one
come along and are found to be alone later, so a crowded map costs work, never results.

What. Pieces of one name that are equal (by a 128-bit hash) are one kind. A task lays out the bytes of a kind once. The kinds
of a name make a suffix order and its Burrows-Wheeler transform, kept as runs; a kind enters once, with a sampled match of
its whole length at its start if there are more pieces of it. Only at run ends is the longest match with a neighbour computed: inside a run both
neighbours continue a longer match one byte to the left, so the match is one shorter than at the byte before, and
one pass over the text streams the matching statistics of every byte. Starts with a match of ``LENGTH`` are repeats,
in every piece of their kind. From the third piece of a kind in one task on, a piece is known to repeat and meets no index.

Both passes over all texts are maps; what is shuffled is one name per kind and portion of text, two rows at most per kind and task
for the index, the repeated runs, and the texts once for their digest. Names with more than ``PIECES`` kinds are too large for
one index: their strings are compared by 128-bit hashes, aggregated before the shuffle, which any share of
the rows in one name does not slow.

Edge cases: null texts count as empty; shorter texts lose nothing. Matches do not cross documents; strings
may overlap their copies. Repeated rows are each other's copies. A name is content, so its rows may
be anywhere; null keys are keys. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import stash, utf8_length

GRAM = 64
#: Most starts of one piece (long runs of one gram are cut), bytes that are hashed, and bytes that are sorted at once.
STARTS, HASHED_AT_ONCE, SORTED_AT_ONCE = 192, 1_000_000, 1_500_000
#: A byte that UTF-8 never has, behind every piece.
SEPARATOR = 0xFF
#: Most kinds of pieces of one name in one index.
PIECES = 4096
#: Most bits of the map of repeated names: 64 MB go to every executor at most, whatever the number of names.
MOST_BITS = 1 << 29
#: Kinds that a task remembers at once.
REMEMBERED = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def sliding(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial modulo 2 ** 64 before each byte, and the factors that move a stretch to the front."""
    power = np.full(len(data), _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    back = np.full(len(data), _INVERSE)
    back[0] = 1
    return total, np.multiply.accumulate(back)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def pieces_of(texts: list[bytes], length: int):
    """For texts of at least ``length`` bytes: text, name, start, starts, sketch (equal for equal pieces) and whether the name may lie
    twice inside, of each piece; then where it begins in all texts joined."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total, back = prefix_sums(data)
    hashes = mixed((total[GRAM:] - total[:-GRAM]) * back[: len(data) - GRAM + 1])
    width = length - GRAM + 1
    names = sliding(hashes, width)
    valid = np.zeros(len(names) + 1, np.int64)
    np.add.at(valid, begins, 1)
    np.add.at(valid, ends - length + 1, -1)
    valid = np.cumsum(valid)[:-1].astype(bool)
    first = valid & np.append(True, (names[1:] != names[:-1]) | ~valid[:-1])
    first[begins] = True
    starts = np.flatnonzero(first)
    after = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1  # behind the last start of each text
    stops = np.minimum(np.append(starts[1:], len(names)), after[np.searchsorted(after, starts, "right")])
    long = stops - starts > STARTS
    if long.any():
        cut = [np.arange(s, e, STARTS) for s, e in zip(starts[long], stops[long], strict=True)]
        more = np.concatenate(cut)
        upto = np.concatenate([np.append(c[1:], e) for c, e in zip(cut, stops[long], strict=True)])
        starts, stops = np.concatenate([starts[~long], more]), np.concatenate([stops[~long], upto])
        order = np.argsort(starts)
        starts, stops = starts[order], stops[order]
    own = names[starts]
    sketch = mixed((total[stops - 1 + length] - total[starts]) * back[starts])
    # A name that lies twice in a piece is the smallest of some window at two places next to each other.
    reach = np.concatenate([np.zeros(width - 1, np.uint64), names, np.zeros(width - 1, np.uint64)])
    least = np.flatnonzero(~sliding(~reach, width) == hashes)
    again = hashes[least[1:]][(hashes[least[1:]] == hashes[least[:-1]]) & (np.diff(least) <= width)]
    text = np.searchsorted(ends, starts, "right")
    return text, own, starts - begins[text], stops - starts, sketch, np.isin(own, again), starts


def _portions(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows of a batch long enough to repeat, with their bytes, some megabytes at once."""
    rows, bodies, size = [], [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        body = (text or "").encode()
        if len(body) < length:
            continue
        if rows and size + len(body) > HASHED_AT_ONCE:
            yield rows, bodies
            rows, bodies, size = [], [], 0
        rows.append(i)
        bodies.append(body)
        size += len(body)
    if rows:
        yield rows, bodies


def _names(length: int):
    """Texts to one row per different piece of a portion: its name, and whether it or its name is there twice."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bodies in _portions(batch, length):
                _, name, _, _, sketch, twice, _ = pieces_of(bodies, length)
                _, at, count = np.unique(name * _BASE + sketch, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name[at].view(np.int64)), pa.array((count > 1) | twice[at])], names=["name", "twice"])

    return names


def bit_map(names: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits (a power of two) where the low bits of each name are set."""
    place = F.col("name").bitwiseAND(F.lit(bits - 1))
    parts = names.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(max(bits >> 15, 1) * 4096, np.uint8)
    for row in parts.toLocalIterator():
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def in_map(name: np.ndarray, known: np.ndarray) -> np.ndarray:
    place = name & np.uint64(len(known) * 8 - 1)
    return (known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _laid_out(length: int, repeated: Broadcast, crowded: Broadcast | None, strings: bool):
    """Texts to the pieces of repeated names: those of crowded names if ``strings``, else all others.

    The first piece of a kind in a task has its bytes; from the third one on, a piece has no name, as no index is needed.
    """

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}
        for batch in batches:
            for rows, texts in _portions(batch, length):
                text, name, start, n, _, _, begin = pieces_of(texts, length)
                hit = in_map(name, repeated.value)
                if crowded is not None:
                    hit &= in_map(name, crowded.value) == strings
                hit = np.flatnonzero(hit)
                view = memoryview(b"".join(texts))
                kinds, bodies, known = [], [], np.zeros(len(hit), bool)
                for i, (s, m) in enumerate(zip(begin[hit].tolist(), n[hit].tolist(), strict=True)):
                    body = view[s : s + m - 1 + length]
                    kind = xxhash.xxh3_128_intdigest(body)
                    met = seen.get(kind)
                    kinds.append(kind)
                    bodies.append(bytes(body) if met is None or strings and not met else None)
                    known[i] = bool(met)
                    seen[kind] = met is not None
                    if len(seen) > REMEMBERED:
                        seen.clear()
                halves = np.array([divmod(k, 1 << 64) for k in kinds], np.uint64).reshape(-1, 2).view(np.int64)
                at = pa.array(np.array(rows)[text[hit]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k").take(at), batch.column("t").take(at), pa.array(start[hit].astype(np.int32)), pa.array(n[hit].astype(np.int32)),
                        pa.array(name[hit].view(np.int64), mask=known), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bodies, pa.binary()),
                    ],
                    names=["k", "t", "start", "n", "name", "k1", "k2", "body"],
                )

    return laid_out


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes at least: by eight bytes, then by doubling among those that tie."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    places, rank, known = np.arange(n), np.empty(n, np.int64), 8
    while True:
        # A suffix ranks as the first place of those it ties with.
        new = np.append(True, key[1:] != key[:-1])
        head = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        rank[order[places]] = head
        tied = ~(new & np.append(new[1:], True))
        places, head = places[tied], head[tied]
        if known >= depth or not len(places):
            return order
        suffix = order[places]
        later = np.where(suffix + known < n, rank[np.minimum(suffix + known, n - 1)] + 1, 0)
        key = head << 32 | later
        sort = np.argsort(key)
        order[places], key = suffix[sort], key[sort]
        known *= 2


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to ``most``; words[i] holds the eight bytes at i."""
    found = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    last = len(words) - 1
    for done in range(0, most, 8):
        differ = words[np.minimum(a[alive] + done, last)] ^ words[np.minimum(b[alive] + done, last)]
        same = differ == 0
        out = alive[~same]
        # Leading zero bytes: the words are big-endian.
        bits = differ[~same]
        lead = np.zeros(len(bits), np.int64)
        for byte in range(7, 0, -1):
            lead += bits < np.uint64(1) << np.uint64(8 * byte)
        found[out] = done + lead
        alive = alive[same]
        if not len(alive):
            break
    found[alive] = most
    return found


def matching_statistics(data: np.ndarray, most: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Length of the longest match of each suffix elsewhere in ``data``, up to ``most``.

    ``known`` are places and the matches they have with copies that ``data`` does not repeat.
    """
    n = len(data)
    order = suffix_order(data, most)
    before = data[order - 1].astype(np.int16)  # the transform
    before[order == 0] = -1
    ends = np.ones(n, bool)
    ends[1:-1] = (before[1:-1] != before[:-2]) | (before[1:-1] != before[2:])
    ends[before == SEPARATOR] = True  # no match is followed from one piece into the next
    samples = np.flatnonzero(ends)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n + 1, np.uint64)
    for i in range(8):
        words[:n] = words[:n] << np.uint64(8) | padded[i : i + n]
    place = order[samples]
    above = common_prefix(words, place, order[np.maximum(samples - 1, 0)], most) * (samples > 0)
    below = common_prefix(words, place, order[np.minimum(samples + 1, n - 1)], most) * (samples < n - 1)
    reach = np.zeros(n, np.int64)
    reach[place] = np.maximum(above, below) + place
    if known is not None:
        reach[known[0]] = np.maximum(reach[known[0]], known[0] + known[1])
    return np.maximum.accumulate(reach) - np.arange(n)


def kinds_repeated(bodies: list[bytes], several: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, offset and number of each run of repeated starts; ``several`` are the kinds with more than one piece, n the starts."""
    data = np.frombuffer(b"".join(b + bytes([SEPARATOR]) for b in bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    begins = np.cumsum(sizes + 1) - sizes - 1
    repeated = matching_statistics(data, length + STARTS, (begins[several], sizes[several])) >= length
    owner = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    hit = repeated[begins[owner] + offset]
    same = np.append(owner[1:] == owner[:-1], False)
    edge = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & np.append(False, same[:-1])))
    stop = np.flatnonzero(hit & ~(np.append(hit[1:], False) & same)) + 1
    return owner[edge], offset[edge], stop - edge


def _indexed(length: int):
    """Arrow batches of pieces sorted by name and kind, those with bytes first, to their repeated starts: k, t, start and n."""

    def flush(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        keys = np.stack([rows.column(c).to_numpy() for c in ("name", "k1", "k2")], 1)
        fresh = np.append(True, (keys[1:] != keys[:-1]).any(1))
        heads = np.flatnonzero(fresh)
        pieces = np.diff(np.append(heads, len(keys)))
        n = rows.column("n").to_numpy()
        bodies = rows.column("body").take(pa.array(heads)).to_pylist()
        kind, offset, run = kinds_repeated(bodies, pieces > 1, n[heads], length)
        # Every piece of a kind has the runs of the kind.
        times = pieces[kind]
        which = np.repeat(np.arange(len(kind)), times)
        row = heads[kind][which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        at = pa.array(row)
        columns = [rows.column("k").combine_chunks().take(at), rows.column("t").combine_chunks().take(at)]
        columns += [pa.array((rows.column("start").to_numpy()[row] + offset[which]).astype(np.int32)), pa.array(run[which].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["k", "t", "start", "n"])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            unnamed = whole.column("name").is_null()
            if whole.column("name").null_count:
                known = whole.filter(unnamed)
                yield pa.RecordBatch.from_arrays([known.column(c) for c in ("k", "t", "start", "n")], names=["k", "t", "start", "n"])
                whole = whole.filter(whole.column("name").is_valid())
            names = whole.column("name").to_numpy()
            lengths = np.diff(np.frombuffer(whole.column("body").buffers()[1], np.int32)[whole.column("body").offset :][: len(names) + 1]) if len(names) else []
            filled = np.append(0, np.cumsum(lengths))
            for s, e in _groups(names):
                part = whole.slice(s, e - s)
                more = int(filled[e] - filled[s])
                if waiting and size + more > SORTED_AT_ONCE and names[s] != waiting[-1].column("name")[-1].as_py():
                    yield flush(waiting)
                    waiting, size = [], 0
                waiting.append(part)
                size += more
        if waiting:
            yield flush(waiting)

    return indexed


def _groups(names: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of whole names (within the batch) of a few hundred pieces."""
    cuts = np.append(np.flatnonzero(np.diff(names)) + 1, len(names))
    begin = 0
    for cut in cuts:
        if cut - begin >= 512 or cut == len(names):
            if cut > begin:
                yield begin, int(cut)
            begin = int(cut)


def _hashed(length: int):
    """Pieces to one row a string: k, t, start and two hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, n, start = batch.column("body")[i].as_py(), batch.column("n")[i].as_py(), batch.column("start")[i].as_py()
                found = np.array([divmod(xxhash.xxh3_128_intdigest(body[s : s + length]), 1 << 64) for s in range(n)], np.uint64)
                at = pa.array(np.full(n, i))
                columns = [batch.column("k").take(at), batch.column("t").take(at), pa.array(np.arange(start, start + n, dtype=np.int32))]
                columns += [pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "t", "start", "h1", "h2"])

    return hashed


def repeated_starts(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, t (hash of the text), start and n: runs of starts of strings that also start elsewhere."""
    kind = docs.schema[key].dataType
    run = [T.StructField("k", kind), T.StructField("t", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]
    piece = [*run, *(T.StructField(c, T.LongType()) for c in ("name", "k1", "k2")), T.StructField("body", T.BinaryType())]
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))

    pieces = rows.select("text").mapInArrow(_names(length), "name long, twice boolean")
    often = stash(pieces.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice")).where("c > 1 or twice"), "names")
    count, most = often.agg(F.count(F.lit(1)), F.coalesce(F.max("c"), F.lit(0))).first()
    context = docs.sparkSession.sparkContext
    repeated = context.broadcast(bit_map(often, min(MOST_BITS, 1 << max(20, (16 * count).bit_length()))))
    crowded = context.broadcast(bit_map(often.where(F.col("c") > PIECES), 1 << 20)) if most > PIECES else None

    laid_out = rows.mapInArrow(_laid_out(length, repeated, crowded, False), T.StructType(piece))
    placed = laid_out.repartition(F.coalesce("name", F.xxhash64("t", "start")))
    in_order = placed.sortWithinPartitions("name", "k1", "k2", F.col("body").isNull())
    starts = in_order.mapInArrow(_indexed(length), T.StructType(run))
    if crowded is not None:
        large = stash(rows.mapInArrow(_laid_out(length, repeated, crowded, True), T.StructType(piece)), "crowded")
        schema = T.StructType([*run[:3], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
        strings = stash(large.where(F.col("body").isNotNull()).mapInArrow(_hashed(length), schema), "strings")
        twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        starts = starts.union(strings.join(twice, ["h1", "h2"], "left_semi").select("k", "t", "start", F.lit(1).alias("n")))
        starts = starts.union(large.where(F.col("body").isNull()).select("k", "t", "start", "n"))
    return starts


def _cut(length: int):
    """Rows with the runs of repeated starts to the digest of what is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                body = (text or "").encode()
                kept, at, gone, count = [], 0, 0, 0
                for start, stop in merged(runs or [], length):
                    kept.append(body[at:start])
                    gone, count, at = gone + stop - start, count + 1, stop
                kept.append(body[at:])
                rest = b"".join(kept)
                removed.append(gone)
                spans.append(count)
                digests.append(hashlib.sha256(rest).hexdigest())
            columns = [batch.column("k"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut


def merged(runs: list[dict], length: int) -> Iterator[tuple[int, int]]:
    """Byte spans that runs of starts cover; spans that touch are one."""
    start = stop = -1
    for run in sorted((r["start"], r["n"]) for r in runs):
        if run[0] > stop:
            if stop > 0:
                yield start, stop
            start, stop = run[0], run[0] + run[1] - 1 + length
        else:
            stop = max(stop, run[0] + run[1] - 1 + length)
    if stop > 0:
        yield start, stop


def spans(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, t and runs, the repeated starts of every text that has some."""
    starts = repeated_starts(docs, length, key, text)
    return starts.groupBy("k", "t").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def remove(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found = spans(docs, length, key, text).select(F.col("k").alias("pk"), F.col("t").alias("pt"), "runs")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"), utf8_length(F.col(text)).alias("n_bytes"))
    same = F.col("k").eqNullSafe(F.col("pk")) & (F.col("t") == F.col("pt"))
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.join(found, same, "left").mapInArrow(_cut(length), schema)
