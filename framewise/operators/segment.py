"""Several values packed in one field: dictionary-guided segmentation into one row per value."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.plans.scale import free_name

#: Separators outside quotes: space, comma, semicolon, slash, bar, plus, ampersand and the word "and".
SEPARATOR = r"[\s,;/|+&]"
#: Entries of one automaton. A larger dictionary is handled in blocks of this size.
BLOCK = 100_000
#: How a dictionary entry vouches for text: as it stands, or by the form of a value.
WHOLE, FORM = 0, 1
_SEP = re.compile(SEPARATOR)
_WORD = re.compile(r"and(?=[\s,;/|+&\"']|\Z)", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")
_UPPER, _LOWER = re.compile(r"[A-Z]+"), re.compile(r"[a-z]+")


def form(value: str) -> str:
    """Written form of a value: runs of capital letters, of small letters and of digits as one sign each."""
    return _DIGITS.sub("9", _LOWER.sub("a", _UPPER.sub("A", value)))


def _form(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")


def known_values(df: DataFrame, column: str) -> DataFrame:
    """The dictionary that the data give, column ``value``: whole cells without separators or quotes, and texts
    in quotes. Distinct, from one map-side aggregate."""
    c = F.trim(F.col(f"`{column}`"))
    single = df.where(~c.rlike(SEPARATOR + "|[\"']") & (c != "")).select(c.alias("value"))
    quoted = df.where(c.rlike("[\"']")).select(F.explode(F.regexp_extract_all(c, F.lit("\"(?:[^\"]|\"\")*+\"|'(?:[^']|'')*+'"), F.lit(0))).alias("q"))
    mark = F.substring("q", 1, 1)
    inner = F.trim(F.replace(F.substring("q", 2, 1_000_000_000).substr(F.lit(1), F.length("q") - 2), F.concat(mark, mark), mark))
    return single.union(quoted.select(inner.alias("value")).where("value <> ''")).distinct()


def dictionary_entries(words: DataFrame) -> DataFrame:
    """(entry, kind): what of the known values the segmentation needs.

    Values without a separator stand for all values of their form, so their forms are enough. A value that
    holds a separator has to be kept as it is. So entries grow with the forms and the values with separators, not with the values.
    """
    v = F.col("value")
    plain = words.where(~v.rlike(SEPARATOR)).select(_form(v).alias("entry"), F.lit(FORM).alias("kind"))
    return plain.union(words.where(v.rlike(SEPARATOR)).select(v.alias("entry"), F.lit(WHOLE).alias("kind"))).distinct()


def _quoted(text: str, i: int) -> tuple[int, str] | None:
    """End and content of the quoted value that opens at ``i``; it has to be closed and end its piece."""
    mark, j, n, parts = text[i], i + 1, len(text), []
    while (k := text.find(mark, j)) >= 0:
        parts.append(text[j:k])
        if k + 1 < n and text[k + 1] == mark:
            parts.append(mark)
            j = k + 2
            continue
        return (k + 1, "".join(parts)) if k + 1 == n or _SEP.match(text, k + 1) else None
    return None


def pieces(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, content if quoted) of the pieces between separators, quoted values whole."""
    out, i, n = [], 0, len(text)
    while i < n:
        if _SEP.match(text, i):
            i += 1
        elif i and (m := _WORD.match(text, i)) and _SEP.match(text, i - 1):
            i = m.end()
        elif text[i] in "\"'" and (q := _quoted(text, i)):
            out.append((i, q[0], q[1].strip()))
            i = q[0]
        else:
            m = _SEP.search(text, i)
            j = m.start() if m else n
            out.append((i, j, None))
            i = j
    return out


def cover(text: str, whole: Iterable[tuple[int, int]], vouched: Iterable[tuple[int, int]]) -> list[str]:
    """The values of ``text`` under the best cover by what the dictionary knows.

    ``whole`` are the (start, end) of known values with separators in them, ``vouched`` the pieces between
    separators that have the form of a known value. Dynamic programming over the pieces, from the right, chooses
    values that are a vouched piece, a known value over several pieces, a quoted value, or a stretch of pieces
    that nothing vouches for. It minimises the stretches, then the pieces in them, then those inside known values. So a
    known value keeps its separators unless each of its parts has the form of a value itself, and text that
    the dictionary knows nothing of is never cut up.
    """
    parts = pieces(text)
    count = len(parts)
    start_at, end_at = {p[0]: k for k, p in enumerate(parts)}, {p[1]: k for k, p in enumerate(parts)}
    spans: dict[int, list[int]] = {}
    for a, b in whole:
        if a in start_at and b in end_at and end_at[b] > start_at[a]:
            spans.setdefault(start_at[a], []).append(end_at[b] + 1)
    alone = {start_at[a] for a, b in vouched if a in start_at and end_at.get(b) == start_at[a]}
    # best[k]: (cost of the pieces from k, where the first value ends, whether it is a stretch)
    best: list[tuple[tuple[int, int, int], int, bool]] = [((0, 0, 0), count, False)] * (count + 1)
    for k in range(count - 1, -1, -1):
        options = []
        if parts[k][2] is not None or k in alone:
            options.append((best[k + 1][0], k + 1, False))
        for end in spans.get(k, []):
            u, v, w = best[end][0]
            options.append(((u, v, w + end - k), end, False))
        if parts[k][2] is None and k not in alone:
            # A stretch goes on into the one behind it, which then isn't counted again.
            (u, v, w), end, stretch = best[k + 1]
            options.append(((u, v + 1, w), end, True) if k + 1 < count and stretch else ((u + 1, v + 1, w), k + 1, True))
        best[k] = min(options)
    out, k = [], 0
    while k < count:
        _, end, _ = best[k]
        value = parts[k][2] if parts[k][2] is not None and end == k + 1 else text[parts[k][0] : parts[end - 1][1]]
        if value:
            out.append(value)
        k = end
    return out


def _automaton(entries: Iterable[tuple[str, int]]):
    """(automaton of the values with separators, of the forms)."""
    import ahocorasick

    made = []
    for kind in (WHOLE, FORM):
        a = ahocorasick.Automaton()
        for w, k in entries:
            if k == kind:
                a.add_word(w if kind == WHOLE else f"\n{w}\n", len(w))
        if len(a):
            a.make_automaton()
        made.append(a)
    return made


def _found(automata, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Matches of known values, and the pieces whose form the other automaton finds (one search over all forms, a line each)."""
    values, forms = automata
    whole = [(e - n + 1, e + 1) for e, n in values.iter(text)] if len(values) else []
    vouched: list[tuple[int, int]] = []
    plain = [p for p in pieces(text) if p[2] is None]
    if len(forms) and plain:
        lines, place, at = ["\n"], {}, 1
        for a, b, _ in plain:
            f = form(text[a:b])
            lines.append(f + "\n")
            place[at - 1] = (a, b)
            at += len(f) + 1
        for e, n in forms.iter("".join(lines)):
            if (span := place.get(e - n - 1)) is not None:
                vouched.append(span)
    return whole, vouched


def split_packed(df: DataFrame, column: str, dictionary: DataFrame | None = None, value: str = "value", pos: str = "pos", at_least: int = 1, block: int = BLOCK) -> DataFrame:
    """One row per value of each cell of ``column``, with its place from 1; other columns are kept.

    ``dictionary`` (column ``value``) holds known whole values; by default ``known_values`` of the data.
    Cells are searched for its entries with Aho-Corasick automata and segmented by ``cover``. Marks around a quoted
    value are taken off, doubled marks inside become one; an open quote is an ordinary character.
    Null cells and cells without any value give no row; repeated rows give repeated results. Names that
    are taken get ``_2``. Cells with fewer than ``at_least`` values are left out.

    One-value cells never reach Python. The dictionary is reduced to ``dictionary_entries`` and counted: up to
    ``block`` entries are sent to the tasks as one automaton; a larger one is split by hash into blocks that are
    searched one after the other, and a cell's matches go along in an array column, so no block exceeds the bound.
    """
    spark = df.sparkSession
    words = known_values(df, column) if dictionary is None else dictionary.select(F.trim("value").alias("value")).where("value <> ''").distinct()
    c = F.col(f"`{column}`")
    value, pos = free_name(value, df.columns), free_name(pos, df.columns)
    keep = [F.col(f"`{x}`") for x in df.columns]
    simple = ~c.rlike(SEPARATOR + "|[\"']")
    one = df.where(simple & (c != "")).select(*keep, F.lit(1).alias(pos), c.alias(value))
    many = df.where(~simple)
    entries = dictionary_entries(words).persist()
    n = entries.count()
    blocks = max(1, -(-n // block))
    if blocks == 1:
        out = many.withColumn("__fw_s", _covering(_send(spark, entries))(c))
    else:
        blocks *= 2  # hash blocks differ in size
        out = many.withColumn("__fw_m", F.array().cast("array<int>"))
        for b in range(blocks):
            part = entries.where(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == b)
            out = out.withColumn("__fw_m", F.concat("__fw_m", _matching(_send(spark, part))(c)))
        out = out.withColumn("__fw_s", _cover_given(c, F.col("__fw_m")))
    entries.unpersist()
    exploded = out.where(F.size("__fw_s") >= at_least).select(*keep, F.posexplode("__fw_s").alias("__fw_p", value)).select(*keep, (F.col("__fw_p") + 1).alias(pos), value)
    return exploded if at_least > 1 else one.union(exploded)


def _send(spark, entries: DataFrame):
    """A block of the dictionary, at most about BLOCK entries, for the tasks."""
    return spark.sparkContext.broadcast([(r[0], r[1]) for r in entries.collect()])


def _covering(shared):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automata = _automaton(shared.value)

        @lru_cache(maxsize=50_000)
        def values(text: str) -> list[str]:
            return cover(text, *_found(automata, text))

        for s in cells:
            codes, texts = pd.factorize(s)
            done = [values(t) for t in texts]
            yield pd.Series([done[k] if k >= 0 else None for k in codes], index=s.index, dtype=object)

    return run


def _matching(shared):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automata = _automaton(shared.value)
        for s in cells:
            found = [([], []) if t is None else _found(automata, t) for t in s]
            yield pd.Series([[x for kind, spans in enumerate(f) for a, b in spans for x in (kind, a, b)] for f in found], index=s.index, dtype=object)

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cover_given(cells: pd.Series, matches: pd.Series) -> pd.Series:
    def one(t: str | None, m) -> list[str] | None:
        if t is None:
            return None
        spans: tuple[list, list] = ([], [])
        for k in range(0, len(m), 3):
            spans[m[k]].append((m[k + 1], m[k + 2]))
        return cover(t, *spans)

    return pd.Series([one(t, m) for t, m in zip(cells, matches)], dtype=object)
