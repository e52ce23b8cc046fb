"""Language of texts and of the spans inside them.

Training counts letter n-grams (one to three letters with word edges) per language in a bounded sample of
labelled rows. A word's script narrows its candidate languages to those that use the script; its
n-grams give each candidate a log probability. Viterbi decoding over the words, with a penalty for
each change of language, labels spans. A text takes the language of most letters; its score is
the mean probability of that language over the letters of the text.

Most texts need no decoding step by step: if no run of words prefers another language by more than half a
penalty, no changes can pay, however many, and the best path is one span. This is decided for many texts at once;
only the others are decoded, in lockstep.

Edge cases: null texts, texts without a letter, and texts whose letters no learned language uses give
``und`` with score 0 and no span; so does everything if nothing was learned. Rows without a label
are not learned from. Ties go to the first language in alphabetical order. Repeated rows are
predicted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BITS = 16
#: First code point of ranges and the script that begins there.
SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"),
    (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"),
    (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])

#: Letters whose n-grams are looked up at once, and text that is decoded at once, in one Python worker.
CHARS_AT_ONCE, DECODED_AT_ONCE = 1_500_000, 12_000_000
#: Least log probability of a language for one word, and least share of a language's letters in a script it uses.
FLOOR, SCRIPT_SHARE = -8.0, 0.01


#: What a prediction over row numbers gives.
SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", SPANS)])


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # n-gram bucket x language
    uses: np.ndarray  # script x language


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Letters:
    """The words (runs of letters) of some texts, letter by letter."""

    grams: list[np.ndarray]  # n-gram buckets: of each letter, with the one before, with both neighbours
    last: np.ndarray  # bucket of each word's last letter with the edge after it
    first: np.ndarray  # first letter of each word
    script: np.ndarray  # of each word
    letters: np.ndarray  # of each word
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def letters_of(texts: list[str]) -> Letters:
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[points]
    edged = np.where(letter, points, 2).astype(np.uint64)
    at = np.flatnonzero(letter)
    before, here, after = edged[at - 1], edged[at], edged[at + 1]

    def bucket(h: np.ndarray, order: int) -> np.ndarray:
        return ((h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)

    shift, prime = np.uint64(21), np.uint64(0x100000001B3)
    grams = [
        bucket(here, 1),
        bucket(before << shift | here, 2),
        bucket(before * prime ^ here << shift ^ after, 3),
    ]
    first = np.flatnonzero(before == 2)
    last = bucket(here[np.append(first[1:], len(at))[: len(first)] - 1] << shift | np.uint64(2), 2)
    ends = np.cumsum([1] + [len(t) + 1 for t in texts])
    return Letters(
        grams,
        last,
        first,
        _SCRIPT_OF[np.searchsorted(_STARTS, here[first].astype(np.int64), "right") - 1],
        np.diff(first, append=len(at)),
        np.searchsorted(at[first], ends),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts (kind 0) and letters by script (kind 1) of each language in a partition."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = pd.DataFrame({"text": batch.column("text").to_pylist(), "lang": batch.column("lang").to_pylist()})
        for lang, texts in rows.groupby("lang")["text"]:
            for part in portions([t.lower() for t in texts], CHARS_AT_ONCE):
                found = letters_of(part)
                for keys in (*found.grams, found.last):
                    grams[lang] = grams.get(lang, 0) + np.bincount(keys, minlength=1 << BITS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(found.script, found.letters, len(_NAMES))
    for kind, table in ((0, grams), (1, scripts)):
        for lang, counts in table.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"kind": np.full(len(at), kind), "lang": [lang] * len(at), "bucket": at, "n": counts[at].astype(np.int64)}
            )


def portions(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Runs of whole texts of about ``chars`` characters; a longer text is alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def train(docs: DataFrame, rows_per_language: int = 4000, text: str = "text", lang: str = "lang") -> Model:
    """Learn from about ``rows_per_language`` labelled rows of each language, all where there are fewer.

    The sample is drawn by the hash of the text. What comes to the driver is one row per language
    and n-gram bucket, at most 65,536 for each language.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    share = labelled.groupBy(lang).agg((F.lit(float(rows_per_language)) / F.count(F.lit(1))).alias("share")).collect()
    if not share:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    keep = F.element_at(F.create_map(*[F.lit(x) for r in share for x in (r[0], r[1])]), F.col(lang))
    drawn = F.pmod(F.xxhash64(text), F.lit(1_000_000)) < keep * 1_000_000
    sample = labelled.where(drawn).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = (
        sample.mapInArrow(_counted, "kind long, lang string, bucket long, n long")
        .groupBy("kind", "lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted({r[0] for r in share})
    grams, scripts = np.zeros((1 << BITS, len(languages))), np.zeros((len(_NAMES), len(languages)))
    column = counts["lang"].map({x: i for i, x in enumerate(languages)})
    for kind, into in ((0, grams), (1, scripts)):
        of = counts["kind"] == kind
        into[counts["bucket"][of], column[of]] = counts["n"][of]
    log_p = np.log(grams + 0.5) - np.log(grams.sum(0) + 0.5 * len(grams))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    return Model(languages, log_p.astype(np.float32), uses)


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each language for each word, the letters that count, and the words of each text.

    A word in a script that no language uses scores 0 and has no letters that count.
    """
    scores, sizes, counts = [], [], []
    for part in portions(texts, CHARS_AT_ONCE):
        found = letters_of(part)
        counts.append(np.diff(found.bounds, prepend=0)[1:])
        if not len(found.first):
            continue
        each = model.log_p[found.grams[0]]
        each += model.log_p[found.grams[1]]
        each += model.log_p[found.grams[2]]
        raw = (np.add.reduceat(each, found.first, axis=0) + model.log_p[found.last]) / 3
        able = model.uses[found.script]
        known = able.any(1)
        raw[~able] = -np.inf
        raw[~known] = 0
        raw -= raw.max(1, keepdims=True)
        raw -= np.log(np.exp(raw).sum(1, keepdims=True))
        out = np.maximum(raw, FLOOR)
        out[~known] = 0
        scores.append(out)
        sizes.append(found.letters * known)
    empty = np.zeros((0, len(model.languages)), np.float32)
    return np.concatenate([empty, *scores]), np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate(counts)


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; texts are decoded side by side, longest first."""
    k = scores.shape[1]
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
    back = [np.empty(0, np.int8)] * longest
    value = scores[starts].astype(np.float64)
    final = np.zeros(len(starts), np.int64)
    for t in range(1, longest):
        m = alive[t]
        if m < len(value):
            final[m : len(value)] = value[m:].argmax(1)
            value = value[:m]
        top = value.argmax(1)
        jump = value[np.arange(m), top] - penalty
        stay = value >= jump[:, None]
        back[t] = np.where(stay, np.arange(k, dtype=np.int8), top.astype(np.int8)[:, None])
        value = np.where(stay, value, jump[:, None]) + scores[starts[:m] + t]
    final[: len(value)] = value.argmax(1)
    path = np.empty(len(scores), np.int8)
    state = final
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        path[starts[:m] + t] = state[:m]
        if t:
            state[:m] = back[t][np.arange(m), state[:m]]
    return path


def decode(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Language of every word of texts that lie one after another; bounds[i]:bounds[i + 1] is text i."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    starts, ends = bounds[full], bounds[full + 1]
    path = np.zeros(len(scores), np.int8)
    if not len(full):
        return path
    owner = np.repeat(np.arange(len(full)), ends - starts)
    totals = np.add.reduceat(scores.astype(np.float64), starts, axis=0)
    best = totals.argmax(1)
    base = scores[np.arange(len(scores)), best[owner]].astype(np.float64)
    far = 20.0 * (len(scores) + 1)
    gain = np.zeros(len(full))
    for j in range(scores.shape[1]):
        run = np.cumsum(scores[:, j] - base) - owner * far  # a new text starts below all before
        before = np.concatenate([[0.0], run[:-1]])
        before[starts] -= far * (np.arange(len(full)) > 0)
        low = np.minimum.accumulate(before)
        gain = np.maximum(gain, np.maximum.reduceat(run - low, starts))
    path[:] = best[owner]
    # s spans gain s * gain at most over one language and cost (s - 1) * penalty, so up to half the penalty none pay.
    mixed = np.flatnonzero(gain > penalty / 2)
    if len(mixed):
        part = np.concatenate([np.arange(s, e) for s, e in zip(starts[mixed], ends[mixed], strict=True)])
        cut = np.concatenate([[0], np.cumsum((ends - starts)[mixed])])
        path[part] = viterbi(scores[part], cut[:-1], cut[1:], penalty)
    return path


def predictor(model: Broadcast[Model], penalty: float):
    """A function over Arrow batches (key, text) to (key, lang_pred, score, spans)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Model = model.value
        names = np.array([*learned.languages, UNKNOWN], dtype=object)
        k = len(learned.languages)

        def one(texts: list[str]):
            scores, size, counts = word_scores(learned, texts)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            path = decode(scores, bounds, penalty)
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
            per = np.stack([np.bincount(owner, size * (path == j), len(texts)) for j in range(k)], 1) if k else None
            lang, score = np.full(len(texts), k), np.zeros(len(texts))
            total = np.bincount(owner, size, len(texts))
            ok = total > 0
            if k:
                lang[ok] = per.argmax(1)[ok]
                chosen = scores[np.arange(len(size)), np.minimum(lang[owner], k - 1)]
                score[ok] = (np.bincount(owner, size * np.exp(chosen), len(texts))[ok] / total[ok]).clip(0, 1)
            change = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(path, prepend=-1)) if len(size) else np.zeros(0, int)
            change = change[ok[owner[change]]]
            width = np.diff(np.append(change, len(size)))
            last = np.minimum(change + width, bounds[1:][owner[change]])
            offsets = np.searchsorted(owner[change], np.arange(len(texts) + 1))
            fields = [
                pa.array((change - bounds[owner[change]]).astype(np.int32)),
                pa.array((last - change).astype(np.int32)),
                pa.array(names[path[change]], pa.string()),
            ]
            spans = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, ["first_word", "n_words", "lang"])
            )
            return pa.array(names[lang], pa.string()), pa.array(score), spans

        for batch in batches:
            texts, begin = [(t or "").lower() if k else "" for t in batch.column("text").to_pylist()], 0
            for part in portions(texts, DECODED_AT_ONCE):
                columns = [batch.column(0).slice(begin, len(part)), *one(part)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"])
                begin += len(part)

    return predict


def held_out(key: Column) -> Column:
    """Rows that training must not see: checksum of the key modulo 4 is 2."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def identify(docs: DataFrame, model: Model, penalty: float = 6.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (first word, words, language) of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>"
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(predictor(shared, penalty), schema)


def annotate(docs: DataFrame, model: Model, penalty: float = 6.0, text: str = "text") -> DataFrame:
    """All columns, and __lang and __score of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared, penalty)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text)], names=["doc_id", "text"])
            found = pa.Table.from_batches(predict(iter([rows])), RESULT).combine_chunks()
            columns = [*batch.columns, *(pa.concat_arrays(found.column(c).chunks) if batch.num_rows else pa.array([], found.schema.field(c).type) for c in ("lang_pred", "score"))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__lang", "__score"])

    added = [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())]
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *added]))
