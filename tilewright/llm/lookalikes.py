"""Text that looks the same but differs in its characters (problem 2).

DuckDB runs inside the Arrow partitions: each batch's distinct names go through one embedded SQL statement made of
``translate``, ``nfc_normalize`` and regular expressions. Order of the steps: colour codes and invisible characters
are dropped, every space becomes U+0020, compatibility forms of letters and numbers become plain ones (one-to-one forms
by ``translate``, ligatures and the like by a lookup per character), composition, and at last, word by word, look-alike
letters take the script of the word's own letters. A word with unmistakable letters of two scripts, such as a name with
a version mark glued to it, is left alone.

A name is a *case* if a step changed a letter, number, space, invisible character or full-width form, be it only of a
full stop. Colour codes, decoration and punctuation of its own width (ASCII, or CJK marks) are no case; nor are words wholly in another script, or names that are garbled (problem 1).

Defined results: null stays null and is no case; an empty text stays empty. Tables are built from the Unicode data of
the Python in use; only the look-alike pairs are fixed values.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import encoding_repair
from tilewright.session import widen

# Look-alike letters, the same place in each pair of lines.
CYRILLIC = "АВСЕНІЈКМОРЅТХУасԁеһіјкорԛѕԝхуӏѵ"
CYRILLIC_LATIN = "ABCEHIJKMOPSTXYacdehijkopqswxylv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχγη"
GREEK_LATIN = "ABEZHIKMNOPTYXaikvoptuxyn"
#: Invisible characters, as ranges of code points.
INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE01EF),
]


def _cls(ranges) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _ranges(points):
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return out


@cache
def tables() -> tuple[str, str, dict[str, str], str]:
    """(one-to-one forms, their plain forms, forms of several characters, character class of all forms)."""
    one, plain, many = [], [], {}
    for p in range(0x80, sys.maxunicode + 1):
        c = chr(p)
        kind = unicodedata.category(c)
        if kind[0] not in "LN" and kind not in ("Mn", "Mc"):
            continue
        to = unicodedata.normalize("NFKC", c)
        if to == c or unicodedata.normalize("NFC", c) == to or not unicodedata.decomposition(c).startswith("<"):
            continue
        if 0x1100 <= p < 0x1200 or kind[0] == "M":
            continue
        if len(to) == 1:
            one.append(c)
            plain.append(to)
        else:
            many[c] = to.replace("⁄", "/")
    return "".join(one), "".join(plain), many, _cls(_ranges(sorted(map(ord, [*one, *many]))))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    one, plain, many, compat = tables()
    many_class = _cls(_ranges(sorted(map(ord, many))))
    invisible = _cls(INVISIBLE)
    to_latin = (CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN)
    # letters that settle a word as Latin, since no letter of another script looks like them
    latin_only = "".join(c for c in string.ascii_letters if c not in CYRILLIC_LATIN + GREEK_LATIN) + "\\x{c0}-\\x{24f}\\x{1e00}-\\x{1eff}"
    wide = "".join(chr(p) for p in [*range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF5F)])
    narrow = unicodedata.normalize("NFKC", wide)  # full-width punctuation: a compatibility form like full-width letters
    cyr_like, greek_like = CYRILLIC, GREEK
    first = {}
    for c, l in zip(CYRILLIC, CYRILLIC_LATIN):
        if c not in "ЈЅԁһјԛѕԝӏѵ":  # letters that no word of the tables' Cyrillic languages has
            first.setdefault(l, c)
    to_cyr = ("".join(first), "".join(first.values()))
    first = {}
    for c, l in zip(GREEK, GREEK_LATIN):
        first.setdefault(l, c)
    to_greek = ("".join(first), "".join(first.values()))
    own_cyr = f"regexp_matches(regexp_replace(w, '[{cyr_like}]', '', 'g'), '\\p{{Cyrillic}}')"
    own_greek = f"regexp_matches(regexp_replace(w, '[{greek_like}]', '', 'g'), '\\p{{Greek}}')"
    tr = lambda w, t: f"translate({w}, {_quoted(t[0])}, {_quoted(t[1])})"
    scripts = "(regexp_matches(w, '\\p{Latin}')::int + regexp_matches(w, '\\p{Cyrillic}')::int + regexp_matches(w, '\\p{Greek}')::int)"
    fixed = f"""CASE
        WHEN NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN w
        WHEN {scripts} > 1 AND regexp_matches(w, '[{latin_only}]') AND ({own_cyr} OR {own_greek}) THEN w
        WHEN regexp_matches(w, '^[\\p{{Cyrillic}}\\p{{Greek}}]+[vV]$') AND ({own_cyr} OR {own_greek}) THEN w
        WHEN {scripts} > 1 THEN CASE WHEN regexp_matches(w, '[{latin_only}]') THEN {tr('w', to_latin)}
             WHEN {own_cyr} THEN {tr('w', to_cyr)} WHEN {own_greek} THEN {tr('w', to_greek)} ELSE {tr('w', to_latin)} END
        WHEN latin_name AND NOT {own_cyr} AND NOT {own_greek} THEN {tr('w', to_latin)}
        ELSE w END"""
    return f"""
    WITH a AS (SELECT i, s, regexp_replace(s, '[\\x00-\\x1f]', '', 'g') AS bare FROM batch),
    b AS (SELECT *, regexp_replace(regexp_replace(bare, '[{invisible}]', '', 'g'), '[\\p{{Zs}}\\x{{2028}}\\x{{2029}}\\x{{85}}]', ' ', 'g') AS seen FROM a),
    parts AS (SELECT i, unnest(string_split(seen, '')) AS x, generate_subscripts(string_split(seen, ''), 1) AS k
              FROM b WHERE regexp_matches(seen, '[{many_class}]')),
    spelled AS (SELECT i, string_agg(coalesce(t, x), '' ORDER BY k) AS long FROM parts LEFT JOIN forms ON f = x GROUP BY i),
    c AS (SELECT b.*, regexp_matches(seen, '[{compat}]') AS is_form,
                 CASE WHEN regexp_matches(seen, '[{compat}]') THEN translate(coalesce(long, seen), {_quoted(one)}, {_quoted(plain)}) ELSE seen END AS flat
          FROM b LEFT JOIN spelled USING (i)),
    d AS (SELECT *, nfc_normalize(flat) AS whole FROM c),
    e AS (SELECT *, regexp_extract_all(whole, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') AS words,
                 regexp_matches(whole, '\\p{{Latin}}') AND NOT regexp_matches(regexp_replace(whole, '[{cyr_like}{greek_like}]', '', 'g'), '[\\p{{Cyrillic}}\\p{{Greek}}]') AS latin_name FROM d),
    f AS (SELECT *, array_to_string(list_transform(words, lambda w: {fixed}), '') AS alike FROM e)
    SELECT i, {tr('coalesce(alike, whole)', (wide, narrow))} AS clean,
           (is_form OR regexp_matches(bare, '[\\x{{ff01}}-\\x{{ff5e}}]') OR nfc_normalize(bare) <> bare OR regexp_matches(bare, '[{invisible}]')
            OR regexp_matches(replace(bare, ' ', ''), '[\\p{{Zs}}\\x{{2028}}\\x{{2029}}]')
            OR coalesce(alike, whole) <> whole) AS is_case
    FROM f ORDER BY i"""


class Cleaner:
    """One embedded DuckDB per Python worker."""

    def __init__(self):
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        many = tables()[2]
        self.con.register("forms", pa.table({"f": list(many), "t": list(many.values())}))
        self.sql = _sql()
        self.seen: dict[str, tuple[str, bool]] = {}

    def run(self, names: list[str]) -> list[tuple[str, bool]]:
        """(clean name, is a case) of each name; no nulls among them."""
        new = [n for n in dict.fromkeys(names) if n not in self.seen and not n.isascii()]
        if new:
            if len(self.seen) > 100_000:
                self.seen.clear()
                new = [n for n in dict.fromkeys(names) if not n.isascii()]
            self.con.register("batch", pa.table({"i": pa.array(range(len(new)), pa.int64()), "s": pa.array(new, pa.string())}))
            for (i, clean, case), n in zip(self.con.execute(self.sql).fetchall(), new):
                self.seen[n] = (clean, case)
            self.con.unregister("batch")
        return [self.seen[n] if not n.isascii() else (encoding_repair.CONTROL.sub("", n), False) for n in names]


SCHEMA = "src_table string, row_id long, map_name string, restored string, clean_name string, is_garbled boolean, is_case boolean"


def stack(metadata: DataFrame, results: DataFrame) -> DataFrame:
    """The typed names of both tables: src_table, row_id, source, map_name; deliveries and copies are not yet merged."""
    return metadata.select(
        F.lit("map_metadata").alias("src_table"), F.col("replay_id").alias("row_id"), encoding_repair.source_of(F.col("replay_path")).alias("source"), "map_name"
    ).unionByName(results.select(F.lit("map_results").alias("src_table"), F.col("result_id").alias("row_id"), F.lit(None).cast("string").alias("source"), "map_name"))


def clean_batches(shared, finish=None):
    """A mapInArrow function over ``stack``: problem 1's repair where a source is known, then the embedded SQL.

    ``finish(names) -> list of arrays`` may turn the clean names into further columns in the same pass.
    """

    def run(batches):
        rep = shared.state(lambda parts: encoding_repair.Repairer(*parts), "repairer")
        cleaner = shared.state(lambda _: Cleaner(), "cleaner")
        more = finish() if finish else None
        for b in batches:
            # each distinct spelling of a batch is worked on once, then taken back to its rows
            got, place = encoding_repair.judge(rep, "map_name", b.column(2), b.column(3), b.column(4))
            bad = np.array([c != encoding_repair.IDENTITY for c, *_ in got] + [False])[place]
            d = b.column(3).dictionary_encode()
            words = d.dictionary.to_pylist()
            fixed = {k: len(words) + i for i, k in enumerate(k for k, g in enumerate(got) if g[0] != encoding_repair.IDENTITY)}
            words += [got[k][2] for k in fixed]
            to = np.array([fixed.get(k, -1) for k in range(len(got))] + [-1])[place]
            index = d.indices.to_numpy(zero_copy_only=False)
            at = pa.array(np.where(bad, to, np.where(np.isnan(index.astype(float)), 0, index)).astype(np.int64), mask=~b.column(3).is_valid().to_numpy(zero_copy_only=False))
            clean = cleaner.run(words)
            if more:
                columns = more([c for c, _ in clean])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(c.take(at) for c in columns)], names=["src_table", "row_id", "catalog_id", "how", "score"])
            else:
                case = pa.array([c for _, c in clean], pa.bool_()).take(at).fill_null(False).to_numpy(zero_copy_only=False)
                out = [
                    b.column(0), b.column(1), b.column(3), pa.array(words, pa.string()).take(at), pa.array([c for c, _ in clean], pa.string()).take(at),
                    pa.array(bad), pa.array(case & ~bad),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["src_table", "row_id", "map_name", "restored", "clean_name", "is_garbled", "is_case"])

    return run


def typed_names(metadata: DataFrame, results: DataFrame, model) -> DataFrame:
    """``stack`` spread over all cores, each row with the prior of its pool where that is not broadcast."""
    return model.beside(widen(stack(metadata, results)), "source", ("map_name",))


def normalise(metadata: DataFrame, results: DataFrame, model=None) -> DataFrame:
    """One row per delivered name: its one consistent form (``clean_name``) and whether it was a case."""
    model = model or encoding_repair.fit(encoding_repair.metadata_values(metadata))
    return typed_names(metadata, results, model).mapInArrow(clean_batches(model.share(metadata.sparkSession)), SCHEMA)


def found(metadata: DataFrame, results: DataFrame, model=None) -> DataFrame:
    """(src_table, row_id) of each case, once however often a row was delivered."""
    return normalise(metadata, results, model).where("is_case").select("src_table", "row_id").distinct()
