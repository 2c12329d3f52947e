"""Quality rules by distribution divergence.

Each language has two reference histograms: one of character classes and one of the language's common words. `labelled_references` measures them on
a bounded sample of rows labelled good, so junk has no part in them; `language_references` on all documents of a table, where no row is labelled. A
document is compared to the references by Jensen-Shannon distance (base 2) and takes its nearest; over the limit in either histogram it is
rejected. A histogram's own noise falls with the root of its letters, and so does the limit on classes. The limit on words is a share of the
distance that a text without any common word has to the reference, so such a text is over it in every language, whatever its length. Texts
too short for a histogram to say anything (fewer letters or words than the guards) are not judged by it. Base rules reject very short and very repetitive texts.

Languages outside COMMON_WORDS, and null ones, share one reference (""). Nulls and empty texts have no words and fail the base rule; very long texts are
measured whole; a null doc_id stays null; repeated rows are judged each by itself; a distance equal to its limit is kept; an empty table gives an empty
result and references without counts judge nothing. Columns other than doc_id, text and lang are not read (lang may be absent); `keep_good` passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import BoundedCache, windows, word_hashes
from pairloom.plans.ship import ship

#: Common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be at by this have from or are an not but which you they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha sí".split(),
}

#: Character classes by byte: lower case, upper case, digits, white space, sentence marks, other ASCII marks, bytes of other characters, exclamation marks, bars.
CLASSES = 9
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(x) for x in ".,;:'\"()-?"]] = 4
_CLASS[128:] = 6
_CLASS[ord("!")], _CLASS[ord("|")] = 7, 8
#: Bytes of words: letters, with A-Z lower-cased; all else parts them.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SYMBOLS = b"#*$%&|<>"

#: The limit on the Jensen-Shannon distance of classes is CLASS_LIMIT + CLASS_NOISE / root of the letters, which of 16,906 rows labelled good one was over; that
#: of words is a share of the distance of a text without common words. The least letters and words that a histogram is judged on.
CLASS_LIMIT, CLASS_NOISE, WORD_SHARE, LEAST_LETTERS, LEAST_WORDS = 0.06, 3.4, 0.9, 200, 60
#: Rows labelled good on which references are measured: about so many, twice as many at most.
LABELLED = 20_000
#: The references are measured again over the documents within this of the first result.
REFERENCE_LIMIT = 0.25

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _word_bins(lang: str) -> dict[bytes, int]:
    return {w.encode(): i + 1 for i, w in enumerate(COMMON_WORDS.get(lang, ()))}


_BINS = {lang: _word_bins(lang) for lang in COMMON_WORDS}
WIDTH = {lang: len(b) + 1 for lang, b in _BINS.items()} | {"": 1}


def class_histogram(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES)


def _language(lang: str | None) -> str:
    return lang if lang in COMMON_WORDS else ""


def word_histogram(words: list[bytes], lang: str) -> np.ndarray:
    """Counts of all other words, then of each common word of lang."""
    bins = _BINS.get(lang, {})
    found = [bins[w] for w in words if w in bins]
    out = np.bincount(np.array(found, np.int64), minlength=WIDTH[lang])
    out[0] = len(words) - len(found)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence, base 2, of two count vectors; 0 where either has no counts."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


def base_metrics(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words)) - (len(text) - len(text.decode("utf-8")) if not text.isascii() else 0)
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    repeat = 0
    if len(words) >= 3:
        grams = windows(word_hashes(words), 3)
        _, where, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = count[where] > 1
        if again.any():
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i : i + len(again)] |= again
            repeat = int(covered.sum())
    return len(words), chars, n_symbols, dup, repeat


def _add(sums: dict, text: bytes, lang: str, near: dict) -> None:
    classes = class_histogram(text)
    if lang in near and js_distance(classes, near[lang]["class"]) > REFERENCE_LIMIT:
        return
    for kind, h in (("class", classes), ("word", word_histogram(text.translate(_LETTERS).split(), lang))):
        sums[lang, kind] = sums[lang, kind] + h if (lang, kind) in sums else h


def _histograms(batches: Iterator[pa.RecordBatch], near: dict) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str], np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            _add(sums, text.as_py() or b"", _language(lang.as_py()), near)
    rows = [(k, kind, i, int(n)) for (k, kind), h in sums.items() for i, n in enumerate(h)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=["lang", "kind", "bin", "n"])


def _inputs(docs: DataFrame) -> list:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return [F.col("text").cast("binary").alias("text"), lang.alias("lang")]


def _summed(inputs: DataFrame, near: dict) -> dict[str, dict[str, np.ndarray]]:
    """At most five languages of some forty bins come to the driver."""
    sums = inputs.mapInArrow(lambda batches: _histograms(batches, near), "lang string, kind string, bin int, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in sums.collect():
        h = out.setdefault(r.lang, {"class": np.zeros(CLASSES, np.int64), "word": np.zeros(WIDTH[r.lang], np.int64)})
        h[r.kind][r.bin] = r.n
    return out


def labelled_references(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> dict[str, dict[str, np.ndarray]]:
    """The histograms of every language over the documents whose label (doc_id, quality) is 1, about `most` of them (drawn by a hash of doc_id, twice as many ids
    at most). Where no such document is at hand, those of language_references."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, most / max(1, good.count()))
    chosen = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * most)
    rows = ship(docs).select("doc_id", *_inputs(docs)).join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "lang")
    return _summed(rows, {}) or language_references(docs)


def language_references(docs: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """The histograms of every language over all documents.

    Measured twice: over every document, then over those within the limit of the first result, so that rejects don't shape what they are held against.
    """
    inputs = ship(docs).select(*_inputs(docs))
    near: dict[str, dict[str, np.ndarray]] = {}
    for _ in range(2):
        near = near | _summed(inputs, near)
    return near


def word_limits(references: dict) -> dict[str, float]:
    """The limit on the distance of words for each language whose reference has common words."""
    none = {k: np.bincount([0], minlength=WIDTH[k]) for k in references if WIDTH[k] > 1 and references[k]["word"][1:].any()}
    return {k: WORD_SHARE * js_distance(h, references[k]["word"]) for k, h in none.items()}


def judge(text: bytes, lang: str | None, references: dict, limits: dict[str, float]) -> tuple:
    """The base metrics, base_failed, the distances to the nearest reference (null where the guards hold) and kept.

    The words are held against the document's own language first, and against the others only if that is over its limit.
    """
    metrics = n_words, _, _, _, repeat = base_metrics(text)
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    classes = class_histogram(text)
    by_class = by_word = None
    familiar = True
    letters = int(classes[0] + classes[1] + classes[6])
    if letters >= LEAST_LETTERS and references:
        by_class = min(js_distance(classes, h["class"]) for h in references.values())
        words = text.translate(_LETTERS).split()
        if len(words) >= LEAST_WORDS and limits:
            for k in sorted(limits, key=lambda k: k != lang):
                d = js_distance(word_histogram(words, k), references[k]["word"])
                by_word = d if by_word is None else min(d, by_word)
                familiar = d <= limits[k]
                if familiar:
                    break
    return (*metrics, failed, by_class, by_word, not failed and (by_class or 0) <= CLASS_LIMIT + CLASS_NOISE / max(letters, 1) ** 0.5 and familiar)


_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
_NAMES = [*METRICS, "base_failed", "class_distance", "word_distance", "kept"]


def quality_report(docs: DataFrame, references: dict | None = None) -> DataFrame:
    """doc_id, the base metrics, base_failed, class_distance, word_distance (null where not judged), kept: a row per row of docs."""
    references = language_references(docs) if references is None else references
    limits = word_limits(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_py() or b"", k.as_py(), references, limits) for t, k in zip(batch.column(1), batch.column(2))]
            columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=["doc_id", *_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ship(docs).select("doc_id", *_inputs(docs)).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{m} long' for m in METRICS)}, base_failed boolean, class_distance double, word_distance double, kept boolean")


def keep_good(docs: DataFrame, references: dict | None = None) -> DataFrame:
    """The rows that the rules keep, with all their columns; a filter of each batch, without a shuffle."""
    references = language_references(docs) if references is None else references
    limits = word_limits(references)
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [None] * batch.num_rows if lang is None else batch.column(lang).to_pylist()
            kept = [judge((t.as_py() or "").encode("utf-8"), k, references, limits)[-1] for t, k in zip(batch.column(at), langs)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ship(docs).mapInArrow(run, docs.schema)
