"""Missing and wrong language labels (problem 9).

Language-bitmask n-gram filters: one Bloom filter per language, stored bit-sliced, so that one lookup of an n-gram (the AND
of ``HASHES`` slots) returns the set of all languages that hold it. A line's n-grams give one popcount per language;
each is corrected for the false positives that the language's fill makes probable, and the best corrected share decides.

The filters are learnt from a bounded sample of labelled rows (``SAMPLE`` documents of at most ``LONGEST`` code points,
chosen by hash): first by the labels as delivered, wrong ones among them, then again by the lines' languages as decided by
the first filters, which removes wrong labels and mixed texts from the training. An n-gram belongs to a language if its
rate there is a fair share of its highest rate anywhere. Every text is then judged, whole.

A twelfth bit stands for "none". Its n-grams are runs of three characters, at least one of them no letter or space (digits
are all one digit), that are about equally frequent in the labelled documents of many languages: the joints of data lines,
whatever words they use. They are learnt with the first filters, by documents, and kept through the second fit; a line
mostly made of them has no language.

The counts become filters on the executors: rates, masks and slots are plain expressions, and only the slots, of which
there are ``SLOTS``, reach the driver.

Defined results: null, empty and letterless texts, and lines of names, data or markup, have no language and give no
row; confidence is the lead of the best language over the next as a share of the best.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut, widen

LANGUAGES = ["en", "ko", "de", "ru", "es", "fr", "pl", "pt", "zh", "ja", "uk"]
# Other spellings of the languages' names and codes.
SPELLINGS = {
    "en": "eng english", "ko": "kor korean", "de": "deu ger german deutsch", "ru": "rus russian", "es": "spa spanish español castilian",
    "fr": "fra fre french français", "pl": "pol polish polski", "pt": "por portuguese português", "zh": "zho chi chinese cmn",
    "ja": "jpn japanese jp", "uk": "ukr ukrainian",
}
LABELS = {s: c for c, names in SPELLINGS.items() for s in [c, *names.split()]}
SAMPLE = 20_000  # labelled documents learnt from, at most about
LONGEST = 20_000  # code points of a document learnt from, at most
SLOTS = 1 << 20
HASHES = 4
GRAMS = (2, 3, 4, 5)  # pairs only of letters without case and words, as Chinese has them
RATE = (0.20, 0.20)  # share of the highest rate that an n-gram needs, by labels and by decided lines
NONE = len(LANGUAGES)  # the bit of what is no language
EVEN = 0.3  # an n-gram of no language has this share of its highest document rate in ...
MOST = 0.5  # ... at least this share of the languages, and makes up this share of a line without language
LEAST_LETTERS = 6  # a line with fewer letters has no language of its own
LEAST_SHARE = 0.45  # of its n-grams must be the language's
LEAST_LEAD = 0.05  # over the next language
ODD_LEAD = 0.12  # over the text's main language, for a line unlike most of its text
ROWS = 2_000  # documents judged at a time
CHARS = 1_000_000  # code points judged at a time


def label_code(label: str | None) -> str | None:
    """The language a label names; None if it names none of those written."""
    t = (label or "").strip().lower()
    return LABELS.get(t) or LABELS.get(t.replace("_", "-").split("-")[0])


def label_column(label):
    """``label_code`` as a Column."""
    t = F.lower(F.trim(label))
    names = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(names, t), F.element_at(names, F.split(F.regexp_replace(t, "_", "-"), "-").getItem(0)))


#: Tags and special tokens: no language.
MARKUP = re.compile(r"<[^<>\s]{1,40}>|\[[A-Z_]{2,20}\]")


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@cache
def space_table() -> np.ndarray:
    return np.array([chr(i).isspace() for i in range(0x110000)])


@cache
def accents() -> dict[int, str]:
    out = {0x142: "l", 0x111: "d", 0xF8: "o"}
    for p in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(p))
        if len(d) > 1:
            out[p] = d[0]
    return out


def code_points(texts: list[str]) -> np.ndarray:
    """All texts without tags, case-folded and composed, each closed by a NUL."""
    joined = "\0".join(unicodedata.normalize("NFC", MARKUP.sub(" ", t).replace("\0", " ")).casefold() for t in texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def hashed(points: np.ndarray):
    """(n-gram hashes, line number of each, letters of each line, text number of each line).

    An n-gram lies within a word; the word's ends count as one blank.
    """
    letter = letter_table()[points]
    newline, end = points == 10, points == 0
    cut = newline | end
    line = np.concatenate(([0], np.cumsum(cut)[:-1]))
    lines = int(cut.sum())
    letters = np.bincount(line[letter], minlength=lines)
    text_of = np.concatenate(([0], np.cumsum(end[cut])[:-1])) if lines else np.zeros(0, dtype=np.int64)
    p = np.where(letter, points, 32).astype(np.uint64)
    keep = letter | np.concatenate((letter[1:], [False])) | np.concatenate(([False], letter[:-1]))
    p, l, line = p[keep], letter[keep], line[keep]
    out, where = [], []
    run, inner = p.copy(), np.ones(len(p), dtype=bool)  # the hash of the run so far; whether all within it are letters
    for n in range(2, max(GRAMS) + 1):
        if len(p) < n:
            break
        run = run[:-1] * np.uint64(0x100000001B3)
        run += p[n - 1 :]
        inner = inner[:-1] & l[n - 2 : n - 2 + len(run)] if n > 2 else inner[:-1]
        if n not in GRAMS:
            continue
        ok = inner & (line[: len(run)] == line[n - 1 :])
        if n == 2:  # of two, both letters
            ok &= l[:-1] & l[1:] & (p[:-1] >= 0x2E80)
        else:
            ok &= l[: len(run)] | l[n - 1 :]
        h = run[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(32)))
        where.append(line[: len(ok)][ok])
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), letters, text_of
    return np.concatenate(out), np.concatenate(where), letters, text_of


def joints(points: np.ndarray, dense: bool = False):
    """(hashes of runs of three characters with one that is no letter or space, line of each, number of runs by line).

    ``dense``: only of lines that may be mostly such runs. A character is in three runs, so such a line has at least
    MOST / 3 as many odd characters as runs; others are passed over, with no runs reported.
    """
    newline = (points == 10) | (points == 0)
    line = np.concatenate(([0], np.cumsum(newline)[:-1]))
    lines = int(newline.sum())
    odd = ~letter_table()[points] & ~space_table()[points] & ~newline
    size = np.bincount(line[~newline], minlength=lines)
    runs = np.maximum(size - 2, 0)
    if dense:
        keep = (3 * np.bincount(line[odd], minlength=lines) >= MOST * runs)[line]
        points, line, odd = points[keep], line[keep], odd[keep]
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), runs
    # one digit for all, and a number of any length is one digit
    digit = (points >= 48) & (points <= 57)
    again = np.concatenate(([False], digit[1:] & digit[:-1]))
    points, line, odd = np.where(digit, 48, points)[~again], line[~again], odd[~again]
    end = (points == 10) | (points == 0)
    runs = np.maximum(np.bincount(line[~end], minlength=lines) - 2, 0)
    p = points.astype(np.uint64)
    ok = ~(end[:-2] | end[1:-1] | end[2:]) & (odd[:-2] | odd[1:-1] | odd[2:])
    h = (p[:-2] << np.uint64(42) | p[1:-1] << np.uint64(21) | p[2:])[ok] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32)), line[:-2][ok], runs


class Filters:
    """Bit-sliced Bloom filters: slot -> bitmask of languages, and of none."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.false = np.array([float((slots >> np.uint16(k) & 1).mean()) ** HASHES for k in range(NONE + 1)])

    @staticmethod
    def places(h: np.ndarray):
        a, b, last = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1), np.uint64(SLOTS - 1)
        for k in range(HASHES):  # SLOTS is a power of two
            yield ((a + np.uint64(k) * b) & last).astype(np.int64)

    @classmethod
    def build(cls, grams: dict[int, np.ndarray]) -> Filters:
        slots = np.zeros(SLOTS, dtype=np.uint16)
        for k, h in grams.items():
            for at in cls.places(h):
                slots[at] |= np.uint16(1 << k)
        return cls(slots)

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), (1 << NONE + 1) - 1, dtype=np.uint16)
        for at in self.places(h):
            out &= self.slots[at]
        return out

    def lines(self, points: np.ndarray, grams=None):
        """Per line: language number or -1, lead, confidence, letters, text number, share of each language."""
        h, where, letters, text_of = grams or hashed(points)
        n = np.bincount(where, minlength=len(letters)).astype(float)
        m = self.masks(h)
        share = np.zeros((len(letters), len(LANGUAGES)))
        for k in range(len(LANGUAGES)):
            hits = np.bincount(where[(m & np.uint16(1 << k)) != 0], minlength=len(letters))
            share[:, k] = np.maximum(0, hits / np.maximum(n, 1) - self.false[k]) / (1 - self.false[k])
        order = np.sort(share, axis=1)
        best, lead = order[:, -1], order[:, -1] - order[:, -2]
        lang = np.where((letters >= LEAST_LETTERS) & (best >= LEAST_SHARE) & (lead >= LEAST_LEAD) & ~self.none(points), share.argmax(axis=1), -1)
        return lang, lead, lead / np.maximum(best, 1e-9), letters, text_of, share

    def none(self, points: np.ndarray) -> np.ndarray:
        """Whether each line is mostly made of what is no language."""
        h, where, runs = joints(points, dense=True)
        hits = np.bincount(where[(self.masks(h) >> np.uint16(NONE)) & 1 != 0], minlength=len(runs))
        share = np.maximum(0, hits / np.maximum(runs, 1) - self.false[NONE]) / (1 - self.false[NONE])
        return share >= MOST


def _counts(sample: DataFrame, filters=None) -> DataFrame:
    """(lang, h, n) of the sample: n-grams by label or by decided line; by label also the joints, by documents (lang + 32)."""

    def run(batches):
        f = Filters(filters.value) if filters else None
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
                label = np.array([LANGUAGES.index(x) for x in labels])
                got: dict[int, list] = {}
                for accented in (True, False):  # as written, and with lost accents
                    points = code_points(texts if accented else [t.casefold().translate(accents()) for t in texts])
                    grams = h, where, _, text_of = hashed(points)
                    k = f.lines(points, grams)[0][where] if f else label[text_of[where]]
                    for lang in np.unique(k):
                        if lang >= 0:
                            got.setdefault(int(lang), []).append(h[k == lang])
                    if accented and not f:
                        h, where, _ = joints(points)
                        order = np.lexsort((h, text_of[where]))
                        h, of = h[order], text_of[where][order]
                        once = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))) if len(h) else np.zeros(0, dtype=bool)
                        h, k = h[once], label[of[once]]
                        for lang in np.unique(k):
                            got[int(lang) + 32] = [h[k == lang]]
                for lang, hs in got.items():
                    u, n = np.unique(np.concatenate(hs), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(u), lang, np.int32)), "h": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return widen(sample.select("text", "label")).mapInArrow(run, "lang int, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")).where("n >= 3")


def _rates(counts: DataFrame, total: dict[int, int]) -> DataFrame:
    """(h, rates, top): the rate of an n-gram in each language that has it, and the highest."""
    of = F.element_at(F.create_map(*(F.lit(x) for kv in total.items() for x in kv)), F.col("lang"))
    rates = counts.select("h", F.struct("lang", (F.col("n") / of).alias("rate")).alias("r")).groupBy("h").agg(F.collect_list("r").alias("rates"), F.max("r.rate").alias("top"))
    return rates.where("top is not null")


def _masks(counts: DataFrame, total: dict[int, int], share: float) -> DataFrame:
    """(h, mask): the languages of an n-gram are those whose rate is a fair share of its highest rate."""
    near = F.filter("rates", lambda r: r["rate"] >= share * F.col("top"))
    return _rates(counts, total).select("h", F.aggregate(near, F.lit(0), lambda m, r: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), r["lang"]))).alias("mask"))


def _even(counts: DataFrame, documents: dict[int, int]) -> DataFrame:
    """(h, mask): joints about equally frequent in the documents of many languages, for the bit of none."""
    rates = _rates(counts.withColumn("lang", F.col("lang") - 32), documents)
    near = F.size(F.filter("rates", lambda r: r["rate"] >= EVEN * F.col("top")))
    return rates.where(near >= max(2.0, MOST * len(documents))).select("h", F.lit(1 << NONE).alias("mask"))


def _slots(masks: DataFrame) -> np.ndarray:
    """The bit-sliced filters: every n-gram sets its mask at its places; no more than ``SLOTS`` rows leave the executors."""
    a, b = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32).bitwiseOR(1)
    places = F.array(*((a + b * k).bitwiseAND(SLOTS - 1) for k in range(HASHES)))
    t = masks.select(F.explode(places).alias("at"), "mask").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros(SLOTS, dtype=np.uint16)
    slots[t.column("at").to_numpy()] = t.column("mask").to_numpy().astype(np.uint16)
    return slots


def fit(documents: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Filters:
    labelled = documents.select("doc_id", "text", label_column(F.col("lang")).alias("label")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest)
    )
    count = lambda d: {LANGUAGES.index(r["label"]): r["n"] for r in d.groupBy("label").agg(F.count("*").alias("n")).collect()}
    by_label = count(labelled)
    n = sum(by_label.values())
    if n > sample:
        span = 1 << 31
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * sample / n))
        by_label = count(labelled)
    if not by_label:
        return Filters(np.zeros(SLOTS, dtype=np.uint16))

    def slots(counts, share):
        total = {r["lang"]: r["n"] for r in counts.where("lang < 32").groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
        return _slots(_masks(counts.where("lang < 32"), total, share)) if total else np.zeros(SLOTS, dtype=np.uint16)

    counts = cut(_counts(labelled))
    none = _slots(_even(counts.where("lang >= 32"), by_label))
    shared = documents.sparkSession.sparkContext.broadcast(slots(counts, RATE[0]) | none)
    return Filters(slots(cut(_counts(labelled, shared)), RATE[1]) | none)


LINE = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_langs", pa.int32()), ("label", pa.string())])


def classify(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Of each text with a language: line_no -1 with the language of most of its letters, and each line with a language.

    Columns: doc_id, line_no, lang, confidence, n_langs (languages in the text), label (as understood, or null).
    """
    filters = filters or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(filters.slots)

    def pieces(b):
        texts = b.column(1).to_pylist()
        lo, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= CHARS or k + 1 - lo >= ROWS or k + 1 == len(texts):
                yield lo, texts[lo : k + 1]
                lo, size = k + 1, 0

    def run(batches):
        f = Filters(shared.value)
        names = np.array(LANGUAGES, dtype=object)
        for b in batches:
            for lo, texts in pieces(b):
                lang, lead, conf, letters, text_of, share = f.lines(code_points([t or "" for t in texts]))
                count = len(texts)
                mass = np.zeros((count, len(LANGUAGES)))
                sure = lang >= 0
                np.add.at(mass, (text_of[sure], lang[sure]), letters[sure])
                main = mass.argmax(axis=1)
                # a line unlike most of its text needs a clear lead, or it goes with the text
                at_line = np.arange(len(lang))
                odd = sure & (lang != main[text_of]) & (share[at_line, lang] - share[at_line, main[text_of]] < ODD_LEAD)
                lang = np.where(odd, main[text_of], lang)
                mass[:] = 0
                np.add.at(mass, (text_of[sure], lang[sure]), letters[sure])
                main, has = mass.argmax(axis=1), mass.sum(axis=1) > 0
                langs = (mass > 0).sum(axis=1).astype(np.int32)
                line_no = np.arange(len(text_of)) - np.searchsorted(text_of, text_of)
                weight = np.bincount(text_of[sure], weights=(letters * conf)[sure], minlength=count) / np.maximum(mass.sum(axis=1), 1)
                ids = b.column(0).slice(lo, count)
                labels = pa.array([label_code(x) for x in b.column(2).slice(lo, count).to_pylist()], pa.string())
                for at, no, l, c in (
                    (np.flatnonzero(has), np.full(int(has.sum()), -1), main[has], weight[has] * mass.max(axis=1)[has] / mass.sum(axis=1)[has]),
                    (text_of[sure], line_no[sure], lang[sure], conf[sure]),
                ):
                    take = pa.array(at.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), pa.array(no.astype(np.int32)), pa.array(names[l], pa.string()), pa.array(c.astype(float)), pa.array(langs[at]), labels.take(take)], schema=LINE
                    )

    return widen(documents.select("doc_id", "text", "lang")).mapInArrow(run, "doc_id long, line_no int, lang string, confidence double, n_langs int, label string")


def found(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, line_no, lang): texts whose label is missing or wrong, and the lines of texts in several languages."""
    c = classify(documents, filters)
    return c.where("(line_no = -1 and (label is null or label <> lang)) or (line_no >= 0 and n_langs > 1)").select("doc_id", "line_no", "lang")
