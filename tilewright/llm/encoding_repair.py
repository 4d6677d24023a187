"""Text that was decoded with the wrong character encoding (problem 1).

Model. A field value was written in encoding *w*, read in encoding *r*; the pair is the latent chain of the record.
``identity`` means that nothing went wrong. Each (source, field) pool has its own prior over chains, and
expectation-maximisation estimates these priors from the evidence of all records of the pool:

* the language model: character trigrams of every value of the corpus, counted over all rows (garbled rows are the
  minority and scatter over the chains, so the clean spelling of a word always outweighs a garbled one). The counts are
  kept in two rows of hashed slots of fixed size, of which the smaller counts: no n-gram is left out, however many
  there are, and what a shared slot adds is far below the discount of rare contexts;
* the evidence of a value: for each chain that can be undone, the log-likelihood ratio of the undone text to the text
  as it stands. A value may be garbled in some words only, so each word either went through the chain or not;
* E step: posterior of each chain, on the executors, over the whole evidence of the distinct values; M step: the pool's
  prior is the mean posterior, drawn towards the prior of its field by ``SHRINK`` uploads' worth, so that sources with
  few rows lean on the others. Pools stay a table; only the priors of the fields reach the driver in each round. Rounds
  end when no more than ``MOVES`` of the rows' weight moves between garbled and not, over all pools.

Defined results: null, empty and blank texts are identity; a text with U+FFFD is always a case (bytes were lost) and is
restored as far as it survives; colour codes (below U+0020) are ignored for the decision and dropped from the
restored text; records delivered twice give one case.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import Shared, collect_at_most, collect_bounded, cut, widen

IDENTITY = "identity"
# Read encoding -> encodings the text may really have been written in.
CHAINS = {
    "western": "utf-8 cp949 cp1251 koi8-r cp866 gbk big5 cp932 euc_jp cp1250 cp1253 cp1254 cp1257 mac_roman cp437 cp850",
    "iso8859-15": "utf-8",
    "mac_roman": "utf-8 cp949 cp1251 koi8-r cp1252 cp1250 cp1254 gbk cp932 euc_jp cp1253",
    "cp437": "utf-8 cp949 cp1251 cp1252 cp1250 cp1254 cp932 gbk",
    "cp850": "utf-8 cp949 cp1251 cp1252 cp1250 cp1254",
    "cp852": "utf-8 cp1250",
    "cp1250": "utf-8 cp1252 cp949 cp1251",
    "cp1251": "utf-8 cp949 koi8-r cp866 cp1252 cp1250 mac_cyrillic gbk euc_jp",
    "koi8-r": "utf-8 cp949 cp1251 cp866 cp1252 cp1250",
    "cp866": "utf-8 cp1251 koi8-r cp949",
    "mac_cyrillic": "utf-8 cp1251",
    "cp1253": "utf-8 cp1252",
    "cp1254": "utf-8",
    "gbk": "utf-8 cp949 euc_jp big5 cp932 cp1251 cp1252",
    "cp949": "utf-8 gbk euc_jp cp932",
    "cp932": "utf-8 gbk cp949 euc_jp",
    "big5": "utf-8 gbk cp949",
    "euc_jp": "utf-8 gbk cp949",
}
#: The double chain: UTF-8 read as Western, written as UTF-8 and read as Western again.
TWICE = "utf-8>western twice"
PAIRS = [(f"{w}>{r}", w, r) for r, ws in CHAINS.items() for w in ws.split()]
RANK = {c: i for i, c in enumerate([IDENTITY, *(name for name, *_ in PAIRS), TWICE])}  # order among equals
MULTIBYTE = {"cp949", "gbk", "big5", "cp932", "euc_jp"}
SLOTS = 1 << 20  # slots of n-gram counts in each of two rows
POOLS = 2_000  # pools whose priors are broadcast; those of more are joined to the rows
FIELD_NAMES = 64  # bound on the fields
ROUNDS = 12  # of EM, at most
MOVES = 1e-4
SHRINK = 6.0  # uploads that the prior of a pool's field is worth
ROWS = 25_000  # distinct values to a task
SPLIT = re.compile(r"""([\x00-\x20\-.,():'"!*#/_|\[\]]+)""")
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
CONTROL = re.compile(r"[\x00-\x1f]")
ODD = re.compile(r"[\xaa\xb2\xb3\xb9\xba\xbc-\xbe]|[\xc0-\u024f]{3}")
UNSEEN = re.compile("[\xa0\xad\u2000-\u200f\u202f\u205f-\u2064\u3000\ufeff]+")
TRAIL = re.compile(r"[^\x00-\x7f][@\[\\\]^_`{|}~]")
PARTLY = 0.3  # a priori share of garbled values in which only some words went through the chain
RARE = 1e-4  # contexts with less than this share of the corpus are discounted: a rare spelling must not vouch for itself
SEQUENCE_NATS = 3.0  # a Western text that is valid multi-byte UTF-8 by chance: about one in twenty per sequence


def _charmap(codec: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for b in range(256):
        try:
            out.setdefault(ord(bytes([b]).decode(codec)), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):  # C1 controls stand for the bytes that the table leaves undefined
        out.setdefault(b, b)
    return out


MAPS = {r: _charmap("cp1252" if r == "western" else r) for r in CHAINS if r not in MULTIBYTE}
for _b in range(0x80, 0x100):  # "western" is Latin-1 or Windows-1252, told apart by no byte
    MAPS["western"].setdefault(_b, _b)


def to_bytes(text: str, read: str) -> bytes | None:
    """The bytes that ``read`` would have shown as ``text``; None if it shows no such text."""
    try:
        return codecs.charmap_encode(text, "strict", MAPS[read])[0] if read in MAPS else text.encode(read)
    except (UnicodeEncodeError, UnicodeError):
        return None


def _decode(data: bytes, written: str, text: str) -> str | None:
    try:
        out = data.decode(written)
    except UnicodeDecodeError as e:
        if written == "utf-8" and SEQUENCE.search(data) and e.reason == "unexpected end of data":
            out = data[: e.start].decode("utf-8")  # the value was cut off within a character
        else:
            return None
    return None if out == text or not out or CONTROL.search(out) else out


def undo(text: str, written: str, read: str) -> str | None:
    """``text`` read again in the encoding it was written in; None if that cannot be or changes nothing."""
    data = to_bytes(text, read)
    return None if data is None else _decode(data, written, text)


def undone(text: str) -> Iterator[tuple[str, str, str, bytes]]:
    """(chain, written, undone text, bytes) of every chain that can be undone."""
    for read, writtens in CHAINS.items():
        data = to_bytes(text, read)
        if data is not None:
            for written in writtens.split():
                t = _decode(data, written, text)
                if t is not None:
                    yield f"{written}>{read}", written, t, data


def undo_lossy(text: str, written: str, read: str) -> str | None:
    """As ``undo`` for a text that lost bytes to U+FFFD: what survives is restored, the rest stays U+FFFD."""
    data = to_bytes(text.replace("\ufffd", "\x1a"), read)
    if data is None:
        return None
    out = re.sub("\ufffd*\x1a\ufffd*", "\ufffd", data.decode(written, "replace"))
    return None if out == text else out


class Counts:
    """Hashed n-gram counts: the smaller of two slots. ``get`` is that of a dict, with its own bounded memory."""

    def __init__(self, slots: np.ndarray, total: int):
        self.slots, self.total, self.seen = slots, total, {}

    def get(self, gram: str, default: int = 0) -> int:
        got = self.seen.get(gram)
        if got is None:
            h = xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), 42)  # as Spark's xxhash64
            got = min(int(self.slots[h & (SLOTS - 1)]), int(self.slots[SLOTS + (h >> 32 & (SLOTS - 1))]))
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[gram] = got
        return got


class LanguageModel:
    """Interpolated character trigrams over case-folded words."""

    def __init__(self, counts: Counts):
        self.n = counts
        self.total = max(1, counts.total)
        self.rare = 2 + RARE * self.total
        self.cache: dict[str, float] = {}

    def word(self, w: str) -> float:
        got = self.cache.get(w)
        if got is None and len(parts := UNSEEN.split(w)) > 1:  # odd spaces and invisible characters are no sign of a wrong encoding
            got = self.cache[w] = sum(map(self.word, filter(None, parts))) - 3.0 * (len(parts) - 1)
        if got is None:
            n, s, got = self.n, f"\x02{w.casefold()}\x03", 0.0
            for i in range(1, len(s)):
                c1 = n.get(s[i], 0) / self.total
                p2, b = n.get(s[i - 1], 0), n.get(s[i - 1 : i + 1], 0)
                p = 0.04 * c1 + 2e-7 + 0.16 * b / (p2 + self.rare)
                if i > 1:
                    p += 0.8 * n.get(s[i - 2 : i + 1], 0) / (n.get(s[i - 2 : i], 0) + self.rare)
                got += math.log(p)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[w] = got
        return got


def plain(word: str) -> bool:
    """Whether a word looks like a word: letters and digits, no run of three accented Latin letters."""
    return word.isascii() or (word.isalnum() and not ODD.search(word))


def ngrams(text: str, first: bool = False) -> Iterator[str]:
    for w in SPLIT.split(CONTROL.sub("", text)):
        if w and not SPLIT.fullmatch(w) and not (first and not plain(w)):
            s = f"\x02{w.casefold()}\x03"
            for i in range(len(s)):
                yield s[i]
                if i:
                    yield s[i - 1 : i + 1]
                    if i > 1:
                        yield s[i - 2 : i + 1]


class Repairer:
    """Evidence, posterior and repair of single values; kept per Python worker."""

    def __init__(self, counts: tuple[np.ndarray, int], priors: dict[tuple[str, str], dict[str, float]] | None = None):
        self.lm, self.priors = LanguageModel(Counts(*counts)), priors or {}
        self.words: dict[str, dict[str, tuple[float, str]]] = {}
        self.values: dict[tuple, tuple] = {}

    def _word(self, w: str) -> dict[str, tuple[float, str]]:
        """Chain -> (log-likelihood ratio, undone word) of one word; only chains that can be undone."""
        got = self.words.get(w)
        if got is None:
            got, base = {}, self.lm.word(w)
            for name, written, t, data in undone(w):
                gain = self.lm.word(t) - base
                if written == "utf-8":
                    k = len(SEQUENCE.findall(data))
                    gain += SEQUENCE_NATS * min(k, 3)
                    if name == "utf-8>western" and (t2 := undo(t, "utf-8", "western")) is not None:
                        g2 = self.lm.word(t2) - base + SEQUENCE_NATS * min(k, 3)
                        if g2 > -5:
                            got[TWICE] = (g2, t2)
                if gain > -5:
                    got[name] = (gain, t)
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[w] = got
        return got

    def evidence(self, text: str) -> dict[str, tuple[float, str]]:
        """Chain -> (log-likelihood ratio to identity, restored text)."""
        text = CONTROL.sub("", text)
        if text.isascii():
            return {}
        parts = SPLIT.split(text)
        odd = [(i, self._word(w)) for i, w in enumerate(parts) if w and not w.isascii()]
        out: dict[str, tuple[float, str]] = {}
        for chain in {c for _, e in odd for c in e}:
            whole, mixed, new = 0.0, 0.0, list(parts)
            for i, e in odd:
                g, t = e.get(chain, (-math.inf, ""))
                whole += g
                mixed += math.log(0.5 * math.exp(min(g, 600.0)) + 0.5)
                if g > 0:
                    new[i] = t
            if new != parts:
                top = max(whole, mixed)
                gain = top + math.log((1 - PARTLY) * math.exp(max(whole - top, -700)) + PARTLY * math.exp(mixed - top))
                out[chain] = (gain, "".join(new))
        if TRAIL.search(text):  # a separator may be the second byte of a character
            base = sum(self.lm.word(w) for w in parts if w and not SPLIT.fullmatch(w))
            for name, written, read in PAIRS:
                if written in MULTIBYTE and (t := undo(text, written, read)) is not None:
                    g = sum(self.lm.word(w) for w in SPLIT.split(t) if w and not SPLIT.fullmatch(w)) - base
                    if g > max(4.0, out.get(name, (0.0, ""))[0]):
                        out[name] = (g, t)
        return out

    def posterior(self, pool: tuple[str, str], text: str, prior: list[float] | None = None) -> tuple[str, float, str]:
        """The most probable chain, the probability that the text is garbled, the restored text.

        ``prior``: the pool's, where it is not among those this object was given.
        """
        if prior is not None and pool not in self.priors:
            if len(self.priors) > 2 * POOLS:
                self.priors = {k: v for k, v in self.priors.items() if k[0] == "*"}
            self.priors[pool] = dict(zip(CODES, prior))
        key = (pool, text)
        got = self.values.get(key)
        if got is None:
            got = self._posterior(pool, text)
            if len(self.values) > 100_000:
                self.values.clear()
            self.values[key] = got
        return got

    def _posterior(self, pool, text):
        prior = self.priors.get(pool) or self.priors.get(("*", pool[1])) or {}
        lost = "�" in text
        found = self.evidence(text)
        floor = 1e-6
        score = {c: g + math.log(max(prior.get(c, 0.0), floor)) for c, (g, _) in found.items()}
        here = math.log(max(prior.get(IDENTITY, 0.9), floor))
        top = max([here, *score.values()])
        whole = sum(math.exp(s - top) for s in score.values()) + math.exp(here - top)
        garbled = 1 - math.exp(here - top) / whole
        best = max(score, key=lambda c: (score[c], -RANK[c]), default=None)
        if lost:
            return (best or "lost bytes", 1.0, self._lossy(pool, CONTROL.sub("", text)))
        if best is None or garbled < 0.5:
            return (IDENTITY, garbled, text)
        return (best, garbled, found[best][1])

    def _lossy(self, pool, text: str) -> str:
        parts = SPLIT.split(text)
        for i, w in enumerate(parts):
            if "�" in w:
                parts[i] = max(
                    [w, *(t for _, written, read in PAIRS if (t := undo_lossy(w, written, read)))],
                    key=lambda t: sum(map(self.lm.word, t.split("\ufffd"))) - 12 * t.count("\ufffd"),
                )
            elif not w.isascii():
                e = self._word(w)
                if e and (b := max(e.values()))[0] > 0:
                    parts[i] = b[1]
        return "".join(parts)


def source_of(path):
    """The pool of a record: the first part of its path, in either style; null paths share the pool ''."""
    return F.coalesce(F.lower(F.split(F.regexp_replace(path, r"\\", "/"), "/").getItem(0)), F.lit(""))


CODES = list(RANK)  # a chain's place in evidence and priors


def ngram_counts(grams: DataFrame) -> tuple[np.ndarray, int]:
    """``grams(gram, n)`` as hashed slots, and the number of characters; at most 2 * SLOTS + 1 rows leave the executors."""
    h = F.xxhash64("gram")
    places = F.array(h.bitwiseAND(SLOTS - 1), F.shiftrightunsigned(h, 32).bitwiseAND(SLOTS - 1) + SLOTS, F.when(F.length("gram") == 1, -1))
    t = grams.select(F.explode(places).alias("at"), "n").where("at is not null").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = t.column("at").to_numpy(), t.column("n").to_numpy()
    slots = np.zeros(2 * SLOTS, dtype=np.int64)
    slots[at[at >= 0]] = n[at >= 0]
    return slots, int(n[at < 0].sum())


class Model:
    """What ``fit`` learnt: n-gram counts, priors of the fields, and the table of pools (source, field, prior).

    ``priors`` has the fields' and, if there are at most ``POOLS``, the pools' priors, to be broadcast; otherwise ``beside``
    joins each row's prior to it.
    """

    def __init__(self, counts, fields: dict[str, list[float]], pools: DataFrame):
        self.counts, self.pools = counts, pools
        rows = collect_at_most(pools, POOLS)
        self.few = rows is not None
        self.priors = {("*", f): dict(zip(CODES, p)) for f, p in fields.items()} | {(r["source"], r["field"]): dict(zip(CODES, r["prior"])) for r in rows or []}

    def share(self, spark):
        return Shared(spark, (self.counts, self.priors))

    def beside(self, df: DataFrame, source: str, fields: tuple[str, ...]) -> DataFrame:
        """``df`` with the prior of its row's pool for each field as ``prior_<field>``; null where it is broadcast anyway."""
        for f in fields:
            if self.few:
                df = df.withColumn(f"prior_{f}", F.lit(None).cast("array<double>"))
            else:
                pools = self.pools.where(F.col("field") == f).select(F.col("source").alias("pool_source"), F.col("prior").alias(f"prior_{f}"))
                df = _salted(df, pools, F.col(source) == F.col("pool_source"), "left").drop("pool_source")
        return df


SALT = 16  # a pool with many rows is met by so many copies of its prior


def _salted(rows: DataFrame, pools: DataFrame, on, how: str) -> DataFrame:
    """An equality join in which no pool's rows all meet in one task."""
    r = rows.withColumn("salt_l", F.floor(F.rand(7) * SALT).cast("int"))
    p = pools.withColumn("salt_r", F.explode(F.array(*map(F.lit, range(SALT)))))
    return r.join(p, on & (F.col("salt_l") == F.col("salt_r")), how).drop("salt_l", "salt_r")


def fit(values: DataFrame, rounds: int = ROUNDS) -> Model:
    """Language model and EM priors from ``values(source, field, text)``, over all rows.

    One aggregation gives the distinct values with their counts (partial sums on the map side, so a value on a third of
    all rows is no hot key).
    """
    seen = cut(
        values.where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0))
        .groupBy("source", "field", "text")
        .agg(F.count("*").alias("n"))
    )
    tasks = max(values.sparkSession.sparkContext.defaultParallelism, -(-seen.count() // ROWS))
    seen = cut(seen.repartition(tasks))  # few bytes, but much work: the adaptive planner would make one task of them

    def count(model):
        def run(batches):
            rep = model.state(Repairer) if model else None
            total: dict[str, int] = {}
            for b in batches:
                for text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if rep and not text.isascii():
                        text = rep.posterior(("*", ""), text)[2].replace("\ufffd", "")
                    for g in ngrams(text, not rep):
                        total[g] = total.get(g, 0) + n
                if len(total) > 500_000:
                    yield _gram_batch(total)
                    total = {}
            yield _gram_batch(total)

        return seen.select("text", "n").mapInArrow(run, "gram string, n long")

    send = lambda counts: Shared(values.sparkSession, counts)
    counts = ngram_counts(count(None))  # first model: words that look like words
    counts = ngram_counts(count(send(counts)))  # second model: every value, garbled ones as restored by the first
    model = send(counts)

    def weigh(batches):
        rep = model.state(Repairer)
        for b in batches:
            found = [sorted((RANK[c], min(g, 600.0)) for c, (g, _) in rep.evidence(t).items()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array([[{"c": c, "g": g} for c, g in f] for f in found], EVIDENCE)], names=["source", "field", "n", "ev"]
            )

    evidence = seen.select("source", "field", "text", "n").mapInArrow(weigh, "source string, field string, n long, ev array<struct<c:int,g:double>>")
    fields, pools = maximise(evidence, rounds)
    return Model(counts, fields, pools)


EVIDENCE = pa.list_(pa.struct([("c", pa.int32()), ("g", pa.float64())]))


def _gram_batch(total: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"gram": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})


def maximise(evidence: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, list[float]], DataFrame]:
    """EM over ``evidence(source, field, n, ev)``: the prior of each field, and the table of pools (source, field, prior).

    Values without evidence, or with the same, are one row of a pool. Each round is one pass: posteriors beside the pool's
    prior, summed up by pool and chain; the code -1 carries the weight that identity gained.
    """
    ev = cut(evidence.groupBy("source", "field", "ev").agg(F.sum("n").cast("double").alias("n")))
    by_field = collect_bounded(ev.groupBy("field").agg(F.sum("n").alias("n"), F.count_distinct(F.coalesce("source", F.lit(""))).alias("pools")), FIELD_NAMES, "fields")
    rows, few = sum(r["n"] for r in by_field), sum(r["pools"] for r in by_field) <= POOLS
    start = [0.9] + [0.1 / (len(CODES) - 1)] * (len(CODES) - 1)
    fields = {r["field"]: start for r in by_field}
    pools = ev.select("source", "field").distinct().withColumn("prior", F.array(*map(F.lit, start)))
    last = None
    for _ in range(rounds if by_field else 0):
        same = pools.select(F.col("source").alias("s"), F.col("field").alias("f"), "prior")
        on = F.col("source").eqNullSafe(F.col("s")) & F.col("field").eqNullSafe(F.col("f"))
        j = ev.join(F.broadcast(same), on) if few else _salted(ev, same, on, "inner")
        weight = F.transform("ev", lambda e: F.struct(e["c"].alias("c"), (F.get("prior", e["c"]) * F.exp(e["g"])).alias("w")))
        j = j.select("source", "field", "n", F.concat(F.array(F.struct(F.lit(0).alias("c"), F.get("prior", F.lit(0)).alias("w"))), weight).alias("ws"))
        j = j.withColumn("z", F.aggregate("ws", F.lit(0.0), lambda a, w: a + w["w"]))
        j = j.withColumn("moved", F.get("ws", F.lit(0))["w"] * (1 / F.col("z") - 1))
        each = F.concat(F.array(F.struct(F.lit(-1).alias("c"), F.col("moved").alias("w"))), F.transform("ws", lambda w: F.struct(w["c"].alias("c"), (w["w"] / F.col("z")).alias("w"))))
        mass = cut(j.select("source", "field", "n", F.explode(each).alias("e")).groupBy("source", "field", "e.c").agg(F.sum(F.col("n") * F.col("e.w")).alias("m")))
        sums = {(r["field"], r["c"]): r["m"] for r in mass.groupBy("field", "c").agg(F.sum(F.when(F.col("c") < 0, F.abs("m")).otherwise(F.col("m"))).alias("m")).collect()}  # fields x chains
        for f in fields:
            own = [sums.get((f, c), 0.0) + (0.05 if c else 1.0) for c in range(len(CODES))]
            fields[f] = [x / sum(own) for x in own]
        towards = F.create_map(*(x for f, p in fields.items() for x in (F.lit(f), F.array(*map(F.lit, p)))))
        pools = mass.where("c >= 0").groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("ms"), F.sum("m").alias("all"))
        drawn = F.transform(F.element_at(towards, F.col("field")), lambda p, c: (F.coalesce(F.try_element_at("ms", c), F.lit(0.0)) + SHRINK * p) / (F.col("all") + SHRINK))
        pools = pools.select("source", "field", drawn.alias("prior"))
        moved = sum(m for (_, c), m in sums.items() if c == -1)
        if last is not None and abs(moved - last) < MOVES * rows:  # what small pools are drawn back by stays alike
            break
        last = moved
    return fields, pools


FIELDS = ("map_name", "map_data_name")


def metadata_values(metadata: DataFrame) -> DataFrame:
    """(source, field, text) of both name fields, one row each."""
    return metadata.select(
        source_of(F.col("replay_path")).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS))).alias("v"),
    ).select("source", "v.field", "v.text")


def judge(rep: Repairer, field: str, sources: pa.Array, texts: pa.Array, priors: pa.Array):
    """((chain, garbled, restored) of each distinct (source, text) that may be garbled, place of each row in them or -1).

    ASCII texts and nulls are -1; rows without a source too.
    """
    s, t = sources.dictionary_encode(), texts.dictionary_encode()
    words, names = t.dictionary.to_pylist(), s.dictionary.to_pylist()
    may = np.array([not w.isascii() for w in words] + [False])
    si, ti = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (s, t))
    rows = np.flatnonzero(may[ti] & (si >= 0))
    pairs, first, where = np.unique(si[rows] * max(1, len(words)) + ti[rows], return_index=True, return_inverse=True)
    got = []
    for pair, row in zip(pairs.tolist(), rows[first].tolist()):
        si_, ti_ = divmod(pair, max(1, len(words)))
        prior = priors[row].as_py() if priors[row].is_valid else None
        got.append(rep.posterior((names[si_], field), words[ti_], prior))
    place = np.full(len(texts), -1)
    place[rows] = where
    return got, place


def repair(metadata: DataFrame, model: Model | None = None, cases: bool = False) -> DataFrame:
    """One row per upload and name field: chain, probability of being garbled, restored text (long form).

    Columns: replay_id, field_name, original, chain, garbled, restored. Null texts give no row. ``cases``: garbled ones only.
    """
    model = model or fit(metadata_values(metadata))
    shared = model.share(metadata.sparkSession)

    def run(batches):
        rep = shared.state(lambda parts: Repairer(*parts), "repairer")
        for b in batches:
            for k, field in enumerate(FIELDS):
                texts = b.column(2 + k)
                got, place = judge(rep, field, b.column(1), texts, b.column(4 + k))
                got.append((IDENTITY, 0.0, None))  # what place -1 means
                chains, p, new = (list(x) for x in zip(*got))
                bad = np.array([c != IDENTITY for c in chains])[place]
                keep = np.flatnonzero(bad if cases else texts.is_valid().to_numpy(zero_copy_only=False))
                at = pa.array(np.where(place < 0, len(got) - 1, place)[keep])
                original = texts.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(keep)), pa.array([field] * len(keep), pa.string()), original, pa.array(chains, pa.string()).take(at),
                    pa.array(p, pa.float64()).take(at), pa.array(new, pa.string()).take(at).fill_null(original) if len(keep) else original,
                ], schema=OUT)

    rows = model.beside(widen(metadata.select("replay_id", source_of(F.col("replay_path")).alias("s"), *FIELDS)), "s", FIELDS)
    return rows.mapInArrow(run, "replay_id long, field_name string, original string, chain string, garbled double, restored string")


OUT = pa.schema([("replay_id", pa.int64()), ("field_name", pa.string()), ("original", pa.string()), ("chain", pa.string()), ("garbled", pa.float64()), ("restored", pa.string())])


def found(metadata: DataFrame, model=None) -> DataFrame:
    """(replay_id, field_name) of each garbled field, once per upload however often it was delivered."""
    return (
        repair(metadata, model, cases=True).select("replay_id", "field_name").distinct()
    )
