"""Typed map names to the entries of the reference list (problem 5).

A name is first repaired (problem 1) and brought to its one form (problem 2), all in one pass over the Arrow batches.
Then

1. an Aho-Corasick automaton over all canonical and alternative names, letters and digits only, finds embedded
   mentions; a mention must begin and end where a word does (a version mark may be glued to it); the longest
   mention wins, as the list writes it before one without accents; two entries mentioned at that length are a tie. A left-over "Neo" or "SE" names another entry, which the list does not have;
2. what is left goes to token-set similarity: candidates by shared character pairs, then word by word, in any order,
   with tolerance for slips (swapped, doubled, missing, wrong letters), dropped vowels and cut-off ends. The best entry
   must be good enough and clearly better than the next;
3. everything else is reported with catalog_id 0.

Defined results: null and blank names give no row; ties between entries go to none (0); an empty list maps all to 0.
The list is sent to the executors while it has at most ``MAX_FORMS`` names; a longer list is worked off in blocks of
that size. A block gives what it knows of a name (``Resolver.evidence``), and the rules above decide once over all blocks,
so the result is the same for any size of block.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import encoding_repair, lookalikes
from tilewright.session import Shared, cut, widen

MAX_FORMS = 20_000
APOSTROPHE = re.compile("['’‘`´]")
TOKEN = re.compile(r"[^\W\d_]+|\d+")
OWN_ENTRY = {"neo", "se"}  # words that make a name an entry of its own
# Words that may stand around a name without being part of it.
TAGS = set("v ver version r rev b beta a obs no final fixed n scm scx ladder league map neo se d q new copy edit".split())
LEAST = 0.72  # similarity a match needs
AHEAD = 0.04  # by which it must lead


def fold(text: str) -> str:
    """Without accents (for Latin, Greek and Cyrillic letters); Hangul and kana stay as they are."""
    out = []
    for c in text:
        d = unicodedata.normalize("NFD", c)
        out.append(d[0] if len(d) > 1 and unicodedata.category(d[1]) == "Mn" and d[0] < "֐" else c)
    return "".join(out)


def tokens(text: str) -> list[str]:
    text = APOSTROPHE.sub("", unicodedata.normalize("NFC", text))
    return [unicodedata.normalize("NFC", t.casefold()) for t in TOKEN.findall(text)]


def edits(a: str, b: str, most: int) -> int:
    """Edits with adjacent swaps; ``most + 1`` when there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, low = [i], i
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
            low = min(low, v)
        if low > most:
            return most + 1
        before, last = last, row
    return last[-1]


VOWELS = str.maketrans("", "", "aeiouаеёиоуыэюяαεηιουω")


@lru_cache(maxsize=200_000)
def word_similarity(typed: str, word: str) -> float:
    """1 for equal words; slips, a cut-off end and dropped vowels cost a share of the word's length."""
    if typed == word:
        return 1.0
    n = max(len(typed), len(word))
    most = max(1, (n + 1) // 3)
    best = 0.0
    d = edits(typed, word, most)
    if d <= most:
        best = 1 - d / n
    if len(typed) >= 3 and len(word) > len(typed) and word.startswith(typed):
        best = max(best, 0.55 + 0.45 * len(typed) / len(word))
    if len(word) >= 5 and len(typed) >= 3 and typed.translate(VOWELS) == word.translate(VOWELS) and len(typed) < len(word):
        best = max(best, 0.85)
    return best


class Resolver:
    """The automaton and the similarity index over one block of the list."""

    def __init__(self, catalog: list[tuple[int, str | None, str | None]]):
        self.forms: list[tuple[int, list[str], str]] = []
        for cid, name, alt in catalog:
            for form in (name, alt):
                if form and (t := tokens(form)):
                    self.forms.append((cid, t, "".join(t)))
        self.auto = ahocorasick.Automaton()
        for k, (cid, _, flat) in enumerate(self.forms):
            for key in {flat, fold(flat)} if len(flat) > 2 else {flat}:
                old = self.auto.get(key, None)
                own = key == flat
                if old is None or (own and not old[2]):
                    self.auto.add_word(key, (len(key), k, own))
                elif own == old[2] and self.forms[old[1]][0] != cid:
                    self.auto.add_word(key, (len(key), -1, own))  # two entries of one name: no decision
        if self.forms:
            self.auto.make_automaton()
        self.pairs: dict[str, list[int]] = {}
        for k, (_, t, _) in enumerate(self.forms):
            for g in self._grams(t):
                self.pairs.setdefault(g, []).append(k)
        self.sizes = np.array([len(self._grams(t)) for _, t, _ in self.forms], dtype=float)
        self.pairs = {g: np.array(v) for g, v in self.pairs.items()}
        self.seen: dict[str, tuple[int, str, float]] = {}

    @staticmethod
    def _grams(toks: list[str]) -> set[str]:
        s = "".join(fold(t) for t in toks)
        return {s[i : i + 2] for i in range(len(s) - 1)} | {f"^{fold(t)[0]}" for t in toks}

    def resolve(self, name: str) -> tuple[int, str, float]:
        """(catalog id or 0, how, score)."""
        got = self.seen.get(name)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            got = self.seen[name] = self._resolve(name)
        return got

    def _resolve(self, name: str) -> tuple[int, str, float]:
        toks = tokens(name)
        if not toks or not self.forms:
            return 0, "none", 0.0
        hit = self._mention(toks) or self._mention([fold(t) for t in toks])
        return hit or self._similar(toks)

    def evidence(self, name: str) -> dict:
        """What this block adds to the decision over all blocks: its longest mention as typed (``m1``) and without
        accents (``m2``), and its two most similar entries; nothing that a mention of three letters already outdoes."""
        toks = tokens(name)
        out = {"name": name, "m1": None, "m2": None, "near": []}
        if not toks or not self.forms:
            return out
        for m, t in (("m1", toks), ("m2", [fold(t) for t in toks])):
            if (got := self._longest(t)) is not None:
                n, at, own, cid, how = got
                out[m] = {"n": -n, "folded": not own, "at": at, "one": cid is not None, "cid": cid, "how": how}
                if n >= 3:
                    return out
        out["near"] = [{"score": -s, "cid": cid} for cid, s in self._ranked(toks)[:2]]
        return out

    def _mention(self, toks: list[str]) -> tuple[int, str, float] | None:
        got = self._longest(toks)
        if got is None:
            return None
        cid, how = got[3:]
        if cid is None:
            return 0, "ambiguous", 0.0
        return (cid, how, 1.0) if how == "mention" else (0, how, 0.0)

    def _longest(self, toks: list[str]) -> tuple[int, int, bool, int | None, str] | None:
        """(length, place, as written, catalog id or None for several, what it means) of the longest mention."""
        flat = "".join(toks)
        starts, at = {}, 0
        for k, t in enumerate(toks):
            starts[at] = k
            at += len(t)
        starts[at] = len(toks)
        rest = lambda a, n: [toks[i] for at, i in starts.items() if i < len(toks) and not a <= at < a + n]
        spans = []
        for end, (n, k, own) in self.auto.iter(flat):
            a, b = end + 1 - n, end + 1
            if a not in starts:
                continue
            if b not in starts:  # a version mark may be glued to the name
                nxt = min(x for x in starts if x > b)
                if n < 3 or flat[b:nxt] not in TAGS - OWN_ENTRY:
                    continue
            if n < 3 and any(not t.isdigit() and t not in TAGS for t in rest(a, n)):
                continue  # a letter or two among other words is no mention
            spans.append((n, -a, k, own))
        if not spans:
            return None
        n, own = max((n, own) for n, _, _, own in spans)
        longest = sorted((-a, k) for m, a, k, o in spans if (m, o) == (n, own))
        a, k = longest[0]
        entries = {self.forms[k][0] if k >= 0 else None for _, k in longest}
        return n, a, own, entries.pop() if len(entries) == 1 else None, "other entry" if OWN_ENTRY & set(rest(a, n)) else "mention"

    def _similar(self, toks: list[str]) -> tuple[int, str, float]:
        ranked = self._ranked(toks)
        if not ranked or ranked[0][1] < LEAST:
            return 0, "none", ranked[0][1] if ranked else 0.0
        if len(ranked) > 1 and ranked[0][1] - ranked[1][1] < AHEAD:
            return 0, "ambiguous", ranked[0][1]
        return ranked[0][0], "similar", ranked[0][1]

    def _ranked(self, toks: list[str]) -> list[tuple[int, float]]:
        """(catalog id, similarity), most similar first."""
        words = [t for t in toks if not t.isdigit()]
        core = [t for t in words if t not in TAGS] or words
        special = OWN_ENTRY & set(words)
        if not core or sum(map(len, core)) < 3:
            return []
        count = np.zeros(len(self.forms))
        grams = self._grams(core)
        for g in grams:
            if g in self.pairs:
                count[self.pairs[g]] += 1
        dice = 2 * count / (self.sizes + len(grams))
        best: dict[int, float] = {}
        for k in np.flatnonzero(dice >= 0.3):
            cid, form, _ = self.forms[k]
            if OWN_ENTRY & set(form) != special:
                continue
            s = self.similarity(core, [w for w in form if w not in OWN_ENTRY] or form)
            best[cid] = max(best.get(cid, 0.0), s)
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))

    @staticmethod
    def similarity(typed: list[str], form: list[str]) -> float:
        """Token-set similarity in any order; also of the words run together, for lost or added spaces."""
        typed, form = [fold(t) for t in typed], [fold(t) for t in form]
        left, total, worst = list(typed), 0.0, 1.0
        for w in sorted(form, key=len, reverse=True):
            scored = [(word_similarity(t, w), t) for t in left]
            s, t = max(scored, default=(0.0, ""))
            if s > 0:
                left.remove(t)
            total += s * len(w)
            worst = min(worst, s if len(w) > 3 else max(s, 0.6))
        n = sum(map(len, form))
        extra = sum(len(t) for t in left)
        words = total / (n + 0.5 * extra) if worst >= 0.55 else 0.0
        a, b = "".join(typed), "".join(form)
        most = max(1, len(b) // 5)
        d = edits(a, b, most)
        joined = 1 - d / max(len(a), len(b)) if d <= most and len(b) >= 6 else 0.0
        if joined and len(typed) == len(form) and worst < 0.5:
            joined = 0.0
        if len(typed) == 1 and len(form) > 1 and len(a) >= 0.7 * len(b) and b.startswith(a):
            joined = max(joined, 0.55 + 0.45 * len(a) / len(b))
        return max(words, joined)


def resolve(metadata: DataFrame, results: DataFrame, catalog: DataFrame, model=None, max_forms: int = MAX_FORMS) -> DataFrame:
    """(src_table, row_id, catalog_id, how, score), one row per name that is neither null nor blank."""
    spark = metadata.sparkSession
    model = model or encoding_repair.fit(encoding_repair.metadata_values(metadata))
    shared = model.share(spark)
    names = lookalikes.typed_names(metadata, results, model).where(F.col("map_name").isNotNull() & (F.trim(F.regexp_replace("map_name", r"[\s\p{Z}]+", "")) != ""))
    listed = catalog.select("catalog_id", "canonical_name", "alt_name").where("catalog_id IS NOT NULL")
    total = listed.count()
    blocks = max(1, -(-total // max_forms))
    if blocks == 1:
        block = Shared(spark, sorted((r[0], r[1], r[2]) for r in listed.collect()))
        got = names.mapInArrow(lookalikes.clean_batches(shared, finisher(block)), "src_table string, row_id long, catalog_id long, how string, score double")
        return got.dropDuplicates(["src_table", "row_id"])
    clean = cut(names.mapInArrow(lookalikes.clean_batches(shared), lookalikes.SCHEMA).select("src_table", "row_id", F.col("clean_name").alias("name")).dropDuplicates(["src_table", "row_id"]))
    each = cut(clean.select("name").distinct())
    out = None
    for k in range(blocks):
        # at most about max_forms rows reach the driver and the executors at a time; all rows of an entry are in one block
        part = listed.where(F.pmod(F.xxhash64("catalog_id"), F.lit(blocks)) == k)
        block = Shared(spark, sorted((r[0], r[1], r[2]) for r in part.collect()))
        got = widen(each).mapInArrow(witness(block), EVIDENCE_SQL)
        out = got if out is None else out.unionByName(got)
    return clean.join(_decide(out), "name").select("src_table", "row_id", "catalog_id", "how", "score")


_MENTION = [("n", pa.int32()), ("folded", pa.bool_()), ("at", pa.int32()), ("one", pa.bool_()), ("cid", pa.int64()), ("how", pa.string())]
EVIDENCE = pa.schema([("name", pa.string()), ("m1", pa.struct(_MENTION)), ("m2", pa.struct(_MENTION)), ("near", pa.list_(pa.struct([("score", pa.float64()), ("cid", pa.int64())])))])
_MENTION_SQL = "struct<n:int,folded:boolean,at:int,one:boolean,cid:bigint,how:string>"
EVIDENCE_SQL = f"name string, m1 {_MENTION_SQL}, m2 {_MENTION_SQL}, near array<struct<score:double,cid:bigint>>"


def _decide(evidence: DataFrame) -> DataFrame:
    """(name, catalog_id, how, score) by the rules of ``Resolver``, from the evidence of all blocks."""
    # lengths and scores are negative, so the least struct is the best: longest, as written, first
    best = [F.min(m).alias(m) for m in ("m1", "m2")]
    # of the longest mentions, whether one is undecided, and the least and the greatest entry
    rank = lambda m, *more: F.when(F.col(m).isNotNull(), F.struct(F.col(f"{m}.n"), F.col(f"{m}.folded"), *more))
    last = [x for m in ("m1", "m2") for x in (F.min(rank(m, F.col(f"{m}.one").alias("one"))).alias(f"{m}_one"), F.min(rank(m, F.col(f"{m}.cid").alias("cid"))).alias(f"{m}_low"), F.min(rank(m, (-F.col(f"{m}.cid")).alias("cid"))).alias(f"{m}_high"))]
    g = evidence.groupBy("name").agg(*best, *last, F.array_sort(F.array_distinct(F.flatten(F.collect_set("near")))).alias("near"))
    how = []
    for m in ("m1", "m2"):
        several = ~F.col(f"{m}_one.one") | (F.col(f"{m}_low.cid") != -F.col(f"{m}_high.cid"))
        how.append(F.when(F.col(m).isNotNull(), F.when(several, "ambiguous").otherwise(F.col(f"{m}.how"))))
    first, second = -F.get("near", F.lit(0))["score"], -F.get("near", F.lit(1))["score"]
    alike = F.when(first.isNull() | (first < LEAST), "none").when(first - second < AHEAD, "ambiguous").otherwise("similar")
    g = g.select("name", "m1", "m2", "near", how[0].alias("h1"), how[1].alias("h2"), alike.alias("h3"), F.coalesce(first, F.lit(0.0)).alias("s3"))
    told = F.coalesce("h1", "h2")
    cid = F.when(told == "mention", F.when(F.col("h1").isNotNull(), F.col("m1.cid")).otherwise(F.col("m2.cid"))).when(told.isNull() & (F.col("h3") == "similar"), F.get("near", F.lit(0))["cid"]).otherwise(0)
    return g.select("name", cid.cast("long").alias("catalog_id"), F.coalesce("h1", "h2", "h3").alias("how"), F.when(told == "mention", 1.0).when(told.isNotNull(), 0.0).otherwise(F.col("s3")).alias("score"))


def witness(block):
    def run(batches):
        r = block.state(Resolver)
        for b in batches:
            yield pa.RecordBatch.from_pylist([r.evidence(n) for n in b.column(0).to_pylist()], schema=EVIDENCE)

    return run


def finisher(block):
    def start():
        r = block.state(Resolver)

        def run(names):
            got = [r.resolve(n) if n is not None else (0, "none", 0.0) for n in names]
            return [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([float(g[2]) for g in got], pa.float64())]

        return run

    return start


def found(metadata: DataFrame, results: DataFrame, catalog: DataFrame, model=None) -> DataFrame:
    return resolve(metadata, results, catalog, model).select("src_table", "row_id", "catalog_id")
