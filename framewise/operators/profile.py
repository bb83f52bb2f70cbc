"""Column-level data quality profile, from file footers and dictionaries where they suffice and scans where they don't."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.operators.impute import known_number, known_text
from framewise.plans.scale import cut, join_small

FOOTER = "file string, row_group int, column string, n_rows long, n_nulls long, least string, most string, dictionary boolean, by_least string, by_most string"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Kinds of columns that chunks are counted by and for; with any other the frame is aggregated by Spark.
WHOLE, PLAIN = ("tinyint", "smallint", "int", "bigint", "string", "date"), (*NUMBERS, "string")
#: Rows of a chunk that a task decodes at once.
SLICE = 65_536


def _open(path: str):
    """(pyarrow file system, path in it) of a file as Spark names it."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path)


def plain_files(df: DataFrame) -> list[str]:
    """The Parquet files of a frame that is nothing but their rows, with columns left out at most; else an empty list.

    A filter, a limit, a computed or renamed column, a partition column, a file system that footers can't be read from: all give the empty list.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() == "Project":
        items = plan.projectList()
        if any(items.apply(k).getClass().getSimpleName() != "AttributeReference" for k in range(items.size())):
            return []
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation" or not plan.relation().partitionSchema().isEmpty():
        return []
    files = df.inputFiles()
    if not all(f.endswith(".parquet") for f in files):
        return []
    try:
        for f in files[:1]:
            _open(f)
    except Exception:  # a scheme without a reader
        return []
    return list(files)


def read_footers(spark: SparkSession, files: Sequence[str], columns: Sequence[str], by: str | None) -> DataFrame:
    """One row per row group and column: counts and extrema as the Parquet footer states them.

    ``least``/``most`` are null where the footer has no exact extrema (absent, or texts that may be
    truncated); ``dictionary`` tells whether all pages are dictionary-encoded. Footers are read by the
    tasks, one file each at a time; no data page is touched.
    """
    wanted = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        def text(stats, x):
            exact = stats is not None and stats.has_min_max and not (isinstance(x, (str, bytes)) and len(x) >= 32)
            return str(x) if exact else None

        for batch in batches:
            rows = []
            for file in batch["file"]:
                fs, path = _open(file)
                with fs.open_input_file(path) as f:
                    meta = pq.ParquetFile(f).metadata
                    place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        rg = meta.row_group(g)
                        b = rg.column(place[by]).statistics if by in place else None
                        bl, bm = (text(b, b.min), text(b, b.max)) if b is not None and b.has_min_max and b.null_count == 0 else (None, None)
                        for c in wanted:
                            if c not in place:
                                continue
                            col = rg.column(place[c])
                            s = col.statistics
                            nulls = s.null_count if s is not None and s.has_null_count else -1
                            lo, hi = (text(s, s.min), text(s, s.max)) if s is not None and s.has_min_max else (None, None)
                            # A plain page beside a dictionary shows as PLAIN twice, or in the page counts of the writer; one PLAIN is the dictionary's own.
                            encoded = col.has_dictionary_page and list(col.encodings).count("PLAIN") <= 1 and not set(col.encodings) - {"PLAIN", "PLAIN_DICTIONARY", "RLE_DICTIONARY", "RLE", "BIT_PACKED"}
                            rows.append((file, g, c, rg.num_rows, nulls, lo, hi, encoded, bl, bm))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOOTER.split(", ")])

    n = max(1, min(len(files), 8 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(n).mapInPandas(run, FOOTER)


def _enough(kinds: Mapping[str, str]) -> Column:
    """Whether a footer tells every value of a chunk: nothing but nulls, or a single exact text or integer without nulls."""
    exact = [c for c, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint", "string")]
    constant = F.col("column").isin(exact) & (F.col("n_nulls") == 0) & (F.col("least") == F.col("most"))
    return F.coalesce((F.col("n_nulls") == F.col("n_rows")) | constant, F.lit(False))


COUNTED = "load string, column string, text string, number double, n long, route string"


def count_chunks(foot: DataFrame, by: str | None, kinds: Mapping[str, str]) -> DataFrame:
    """(load, column, text or number, n, route) of every value in the chunks of ``foot``, counted by chunk.

    A chunk (a row group's column) whose footer is ``enough`` is not read; what its rows belong to comes from the footer
    of ``by``, or, if the row group holds several loads, from that column alone. Of the other chunks, those of texts
    that are dictionary-encoded are read as codes and their dictionary, so a value is decoded once a chunk, not once a row;
    any other is decoded. ``route`` tells which way was taken: footer, dictionary or scan. Nulls and NaNs count as null.
    """
    numbers = {c for c, k in kinds.items() if k in NUMBERS}
    cells = F.to_json(F.collect_list(F.struct("column", "n_rows", "n_nulls", "least", "dictionary", "enough")), {"ignoreNullFields": "false"})
    groups = foot.groupBy("file", "row_group").agg(cells.alias("cells"), F.first("by_least").alias("by_least"), F.first("by_most").alias("by_most"))
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        def rows(load, column, value, n, route):
            number = column in numbers
            return load, column, None if number or value is None else str(value), float(value) if number and value is not None else None, int(n), route

        for batch in batches:
            for r in batch.itertuples(index=False):
                known, todo = [], []
                for c in json.loads(r.cells):
                    (known if c["enough"] else todo).append(c)
                one = by is None or (r.by_least is not None and r.by_least == r.by_most)
                fixed = {c["column"]: c["least"] if c["n_nulls"] == 0 else None for c in known}
                if one:
                    yield pd.DataFrame([rows(r.by_least if by else None, c["column"], fixed[c["column"]], c["n_rows"], "footer") for c in known], columns=names)
                    if not todo:
                        continue
                want = [c["column"] for c in todo] + ([] if one else [by] if by not in {c["column"] for c in todo} else [])
                packed = [c["column"] for c in todo if c["dictionary"] and c["column"] not in numbers]
                fs, path = _open(r.file)
                with fs.open_input_file(path) as f:
                    for part in pq.ParquetFile(f, read_dictionary=packed).iter_batches(batch_size=SLICE, row_groups=[r.row_group], columns=want):
                        if one:
                            code, loads = np.zeros(len(part), np.int64), [r.by_least if by else None]
                        else:
                            found, loads = pd.factorize(part.column(by).to_pandas().astype(object))
                            code, loads = np.where(found < 0, len(loads), found), [str(x) for x in loads] + [None]
                            for column, value in fixed.items():
                                yield pd.DataFrame([rows(loads[k], column, value, n, "footer") for k, n in enumerate(np.bincount(code)) if n], columns=names)
                        for c in todo:
                            column = part.column(c["column"])
                            if pa.types.is_dictionary(column.type):
                                place, values, route = column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary.to_pylist(), "dictionary"
                            else:
                                place, values = pd.factorize(column.to_pandas())
                                route = "scan"
                            pair, n = np.unique(code * (len(values) + 1) + place + 1, return_counts=True)
                            at, which = np.divmod(pair, len(values) + 1)
                            text = [None if k == 0 else values[k - 1] for k in which]
                            yield pd.DataFrame([rows(loads[k], c["column"], v, m, route) for k, v, m in zip(at, text, n)], columns=names)

    tasks = 4 * foot.sparkSession.sparkContext.defaultParallelism
    return groups.repartition(tasks, "file", "row_group").mapInPandas(run, COUNTED)


def _exploded(df: DataFrame, by: str | None, kinds: Mapping[str, str]) -> DataFrame:
    """(load, column, text or number, n, route): the same by a scan of Spark's, with load in its own type; counted before the shuffle."""
    cell = lambda c, k: F.struct(F.lit(c).alias("column"), (F.lit(None) if k in NUMBERS else F.col(f"`{c}`")).cast("string").alias("text"), (F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`")) if k in NUMBERS else F.lit(None)).cast("double").alias("number"))
    load = F.col(f"`{by}`") if by else F.lit(None).cast("string")
    parts = F.array(*[cell(c, k) for c, k in kinds.items()])
    return df.select(load.alias("load"), F.explode(parts).alias("p")).groupBy("load", "p.column", "p.text", "p.number").agg(F.count(F.lit(1)).alias("n")).withColumn("route", F.lit("scan"))


def count_files(df: DataFrame, foot: DataFrame, by: str | None, kinds: Mapping[str, str]) -> DataFrame:
    """``count_chunks`` where footers or dictionaries serve all of a file's chunks of a column, a scan of the column in that file where they don't.

    Numbers have no dictionary that pays, so those that footers don't tell are scanned by Spark, as are texts of plain pages.
    """
    numbers = [c for c, k in kinds.items() if k in NUMBERS]
    cheap = F.col("enough") | (F.col("dictionary") & ~F.col("column").isin(numbers) if numbers else F.col("dictionary"))
    needs = foot.groupBy("file", "column").agg(F.bool_and(cheap).alias("cheap"))
    groups = needs.where("not cheap").groupBy("file").agg(F.sort_array(F.collect_list("column")).alias("cs")).groupBy("cs").agg(F.collect_list("file").alias("files")).collect()  # as long as the file list the driver plans with
    kind = df.schema[by].dataType if by else None
    out = count_chunks(foot.join(needs.where("cheap").select("file", "column"), ["file", "column"], "left_semi"), by, kinds)
    out = out.withColumn("load", F.col("load").cast(kind) if by else F.col("load"))
    for g in groups:
        out = out.unionByName(_exploded(df.sparkSession.read.schema(df.schema).parquet(*g["files"]), by, {c: kinds[c] for c in g["cs"]}))
    return out


def table_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column of a whole table: ``n_rows``, ``n_nulls``, ``null_rate``, ``least``, ``most`` (numbers as numbers in
    ``low``/``high``), ``n_distinct``, and by which way chunks came in: ``from_footer``, ``from_dictionary``, ``from_scan``.

    Rows, nulls and extrema are those of the footers wherever these are exact, with no data page read. For distinct
    values, footers of constant chunks suffice, dictionaries give the candidates of dictionary-encoded texts, and
    only the other chunks are decoded. NaN counts as null and is no extremum. Where a footer lacks exact nulls or extrema (a long text,
    a column with NaN), those come from the counted values. Frames that aren't plain Parquet files are aggregated by
    Spark. A table without rows gives 0 rows, null extrema.
    """
    kinds = {c: k for c, k in df.dtypes if c in columns and k in PLAIN}
    files = plain_files(df)
    names = list(kinds)
    if files:
        foot = cut(read_footers(df.sparkSession, files, names, None).withColumn("enough", _enough(kinds)))
        raw = count_files(df, foot, None, kinds)
    else:
        foot, raw = None, _exploded(df, None, kinds)
    counted = cut(raw.groupBy("column", "text", "number").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("route") == w, F.col("n"))).alias(w) for w in ("footer", "dictionary", "scan")]))
    empty = F.col("text").isNull() & F.col("number").isNull()
    stats = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("n_nulls"), F.min("text").alias("least"), F.max("text").alias("most"),
        F.min(F.col("number") + F.lit(0.0)).alias("low"), F.max(F.col("number") + F.lit(0.0)).alias("high"), F.sum((~empty).cast("long")).alias("n_distinct"),
        *[F.coalesce(F.sum(w), F.lit(0)).alias(f"from_{w}") for w in ("footer", "dictionary", "scan")])
    if foot is not None:
        number = F.col("column").isin([c for c, k in kinds.items() if k in NUMBERS]) if any(k in NUMBERS for k in kinds.values()) else F.lit(False)
        bare = F.col("n_nulls") == F.col("n_rows")
        side = lambda c: F.coalesce(F.max(F.when(F.col(c).isNull() & ~bare, 1)), F.lit(0)) == 0
        told = foot.groupBy("column").agg(
            (side("least") & side("most")).alias("exact"), F.min(F.when(~number, F.col("least"))).alias("fl"), F.max(F.when(~number, F.col("most"))).alias("fm"),
            F.min(F.when(number, F.col("least").cast("double")) + F.lit(0.0)).alias("fn"), F.max(F.when(number, F.col("most").cast("double")) + F.lit(0.0)).alias("fx"))
        stats = stats.join(F.broadcast(told), "column", "left")  # one row a column
        for c, f in (("least", "fl"), ("most", "fm"), ("low", "fn"), ("high", "fx")):
            stats = stats.withColumn(c, F.when(F.coalesce("exact", F.lit(False)), F.col(f)).otherwise(F.col(c)))
    frame = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    out = frame.join(stats, "column", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(F.col("column").alias("column_name"), zero("n_rows"), zero("n_nulls"), (F.col("n_nulls") / F.col("n_rows")).alias("null_rate"), "least", "most", "low", "high", zero("n_distinct"), *[zero(f"from_{w}") for w in ("footer", "dictionary", "scan")])


def _known(c: str, kind: str) -> Column:
    return known_number(F.col(c), low=float("-inf"), unknown=(-1.0, -9.0, -99.0, -999.0, 999.0, 9999.0)) if kind in NUMBERS else known_text(F.col(c))


def _form(value: Column, kind: str) -> Column:
    """Written form of a value: sign and decimals of numbers; of texts the whole text with each character as its class."""
    if kind in NUMBERS:
        x = value.cast("double")
        scaled = [F.abs(x) * F.lit(10.0**k) for k in range(5)]
        whole = [F.abs(s - F.round(s)) < 1e-6 for s in scaled]
        decimals = F.lit("9")
        for k in reversed(range(5)):
            decimals = F.when(whole[k], F.lit(str(k))).otherwise(decimals)
        tens = F.when(F.pmod(F.abs(x), F.lit(10.0)) == 0, F.lit("t")).otherwise(F.lit(""))
        return F.when(x.isNotNull(), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), decimals, tens))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{N}", "9"), r"\s", "_")


def _start(form: Column) -> Column:
    """Coarse form of a text: the first three runs of its form. Small shifts show here that drown in the many whole forms."""
    return F.substring(F.regexp_replace(form, r"([Aa9_])\1+", "$1"), 1, 3)


def _numbers(value: Column) -> Column:
    """The numbers that the digits of a text make, in their order."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: x.cast("double"))


def _sizes(value: Column) -> Column:
    """Rough sizes (a quarter of an octave) of the least and greatest number in a text; empty without one."""
    size = lambda x: F.round(F.log2(1 + x) * 4).cast("int").cast("string")
    numbers = _numbers(value)
    return F.when(value.isNotNull(), F.concat_ws("-", size(F.array_min(numbers)), size(F.array_max(numbers))))


def _bin(value: Column, kind: str) -> Column:
    """Distribution bin: a quarter of an octave for numbers, the first letter or digit for texts (their numbers: ``_sizes``)."""
    if kind in NUMBERS:
        x = value.cast("double")
        return (F.signum(x) * F.round(F.log2(1 + F.abs(x)) * 4)).cast("string")
    return F.upper(F.regexp_extract(value, r"[\p{L}\p{N}]", 0))


def value_counts_by_load(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(load, column, value, n, n_footer, n_dictionary): counts of known values, and how many rows footers or dictionaries told of.

    A frame that is the plain rows of Parquet files is counted by ``count_files``; any other - with a
    filter, a limit or a computed column - is aggregated as it stands. Either way values are judged known or not after they
    are counted, once each.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in columns if c in kinds]
    own = {c: kinds[c] for c in columns}
    files = plain_files(df) if columns and kinds[by] in WHOLE and all(k in PLAIN for k in own.values()) else []
    if not columns:
        return df.sparkSession.createDataFrame([], f"load {kinds[by]}, column string, value string, n long, n_footer long, n_dictionary long")
    if files:
        foot = cut(read_footers(df.sparkSession, files, columns, by).withColumn("enough", _enough(own)))
        raw = count_files(df, foot, by, own)
    else:
        raw = _exploded(df, by, own)
    told = lambda w: F.coalesce(F.sum(F.when(F.col("route") == w, F.col("n"))), F.lit(0))
    raw = raw.groupBy("load", "column", "text", "number").agg(F.sum("n").alias("n"), told("footer").alias("n_footer"), told("dictionary").alias("n_dictionary"))
    value = F.coalesce(_known("text", "string"), _known("number", "double").cast("string"))
    return raw.groupBy("load", "column", value.alias("value")).agg(*[F.sum(c).alias(c) for c in ("n", "n_footer", "n_dictionary")])


def _divergence(counts: DataFrame, what: str) -> DataFrame:
    """Total-variation distance of each load's shares of ``what`` from those of all other loads, and the one that chance gives a load of its size."""
    own = counts.groupBy("load", "column", what).agg(F.sum("n").alias("n"))
    total = cut(own.groupBy("load", "column").agg(F.sum("n").alias("t")))
    pooled = own.groupBy("column", what).agg(F.sum("n").alias("pn"))
    everything = total.groupBy("column").agg(F.sum("t").alias("pt"))
    # Half the sum over the load's own bins of |p - q|, plus half the mass of the others outside these bins.
    x = join_small(join_small(join_small(own, pooled, ["column", what], "inner"), total, ["load", "column"], "inner"), everything, ["column"], "inner")
    p, q = F.col("n") / F.col("t"), F.when(F.col("pt") > F.col("t"), (F.col("pn") - F.col("n")) / (F.col("pt") - F.col("t"))).otherwise(F.col("n") / F.col("t"))
    shift = x.groupBy("load", "column").agg(((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias(f"{what}_shift"))
    # Half the summed mean absolute deviations of binomial shares (de Moivre). They follow from how many bins hold how many
    # values, to a quarter of an octave, so that no load meets every bin.
    spectrum = cut(pooled.groupBy("column", F.round(F.log2("pn") * 4).alias("octave")).agg(F.count(F.lit(1)).alias("bins"), F.avg("pn").alias("pn")))
    s = join_small(join_small(total, spectrum, ["column"], "inner"), everything, ["column"], "inner").withColumn("q", F.col("pn") / F.col("pt"))
    mad = F.when(F.col("t") * F.col("q") < 1, 2 * F.col("q") * F.pow(1 - F.col("q"), F.col("t"))).otherwise(F.sqrt(2 * F.col("q") * (1 - F.col("q")) / (F.lit(math.pi) * F.col("t"))))
    return cut(shift).join(s.groupBy("load", "column").agg((F.sum(F.col("bins") * mad) / 2).alias(f"{what}_chance")), ["load", "column"])


def profile(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """One row per load and column.

    ``n_rows``, ``n_missing`` (null, NaN, blank and stand-ins for "unknown"), ``missing_share``,
    ``n_distinct``, ``distinct_share`` (of known values), ``least``/``most`` (as text; numbers in their
    order), ``low``/``high`` (1 % and 99 % of numbers; of texts, of the first number in them), ``n_forms``
    and ``top_form`` (written forms), ``n_footer``/``n_dictionary`` (rows that file footers or dictionaries told of), ``form_shift``, ``start_shift``, ``bin_shift`` and ``size_shift``
    (total-variation distance of written forms, of the starts of texts' forms, of value bins and of the
    sizes of the numbers in texts from those of the other loads), each with the ``_chance`` that a load of
    its size has anyway. A load without known values has null statistics. An empty table gives
    no row. Everything follows from distinct values with counts, made by map-side aggregates.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in columns if c in kinds]
    nums = [c for c in columns if kinds[c] in NUMBERS]
    counts = value_counts_by_load(df, by, columns)
    is_num = F.col("column").isin(nums) if nums else F.lit(False)
    form = F.when(is_num, _form(F.col("value"), "double")).otherwise(_form(F.col("value"), "string"))
    bins = F.when(is_num, _bin(F.col("value"), "double")).otherwise(_bin(F.col("value"), "string"))
    # Values are needed for counts and extrema only; the cut keeps them with their form, bin and sizes.
    x = F.when(is_num, F.col("value").cast("double"))
    counts = counts.withColumns({"x": x, "y": F.when(is_num, x).otherwise(F.get(_numbers(F.col("value")), F.lit(0))), "form": form, "bin": bins, "size": F.when(~is_num, _sizes(F.col("value")))})
    small = cut(counts.groupBy("load", "column", "form", "bin", "size").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_footer", "n_dictionary")], F.count("value").alias("d"), F.min("value").alias("lt"), F.max("value").alias("mt"), F.min("x").alias("lx"), F.max("x").alias("mx"), F.min("y").alias("ly"),
        F.percentile_approx("y", [0.5], 1000).alias("mid")))
    known = small.where("form is not null")
    stats = small.groupBy("load", "column").agg(
        F.sum("n").alias("n_rows"), F.sum("n_footer").alias("n_footer"), F.sum("n_dictionary").alias("n_dictionary"), F.coalesce(F.sum(F.when(F.col("form").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.sum("d").alias("n_distinct"),
        F.coalesce(F.min("lx").cast("string"), F.min("lt")).alias("least"), F.coalesce(F.max("mx").cast("string"), F.max("mt")).alias("most"), F.count_distinct("form").alias("n_forms"))
    forms = known.groupBy("load", "column", "form").agg(F.sum("n").alias("n")).groupBy("load", "column").agg(F.max_by("form", F.struct("n", "form")).alias("top_form"))
    upto = Window.partitionBy("load", "column").orderBy("ly", "bin", "form", "size")
    ranked = known.where("ly is not null").withColumn("u", F.sum("n").over(upto)).withColumn("t", F.sum("n").over(Window.partitionBy("load", "column")))
    ends = ranked.groupBy("load", "column").agg(F.min(F.when(F.col("u") >= 0.01 * F.col("t"), F.col("mid")[0])).alias("low"), F.min(F.when(F.col("u") >= 0.99 * F.col("t"), F.col("mid")[0])).alias("high"))
    out = stats
    texts = known.where(~is_num).withColumn("start", _start(F.col("form")))
    for other in (forms, ends, _divergence(known, "form"), _divergence(texts, "start"), _divergence(known, "bin"), _divergence(texts, "size")):
        out = out.join(other, ["load", "column"], "left")
    present = F.col("n_rows") - F.col("n_missing")
    return out.withColumn("missing_share", F.col("n_missing") / F.col("n_rows")).withColumn("distinct_share", F.when(present > 0, F.col("n_distinct") / present)).select(
        F.col("load").alias(by), F.col("column").alias("column_name"), "n_rows", "n_missing", "missing_share", "n_distinct", "distinct_share", "least", "most", "low", "high", "n_forms", "top_form", "n_footer", "n_dictionary", *[f"{k}_{x}" for k in ("form", "start", "bin", "size") for x in ("shift", "chance")])


def departures(profiled: DataFrame, by: str, limit: float = 8.0) -> DataFrame:
    """Profile rows that depart from those of the other loads, with ``what`` departs and the score.

    Each statistic is compared, by column, with its median over the loads; its distance counts in
    robust deviations (1.4826 x median absolute deviation, and at least a small floor). Distinct counts
    are first freed of the load's size by a trimmed log-log line. ``score`` is the largest of the
    statistics, ``what`` its name; rows with a score of at most ``limit`` are left out.
    """
    p = profiled.withColumn("known", (F.col("n_rows") - F.col("n_missing")).cast("double"))
    p = p.withColumn("ln", F.log(F.col("known"))).withColumn("ld", F.log(F.col("n_distinct").cast("double")))
    col = Window.partitionBy("column_name")
    mid = lambda c: F.percentile_approx(c, 0.5, 10_000).over(col)
    # Trimmed line of log distinct on log known: loads near the median ratio fix the slope.
    p = p.withColumn("r0", F.col("ld") - F.col("ln"))
    p = p.withColumn("m0", mid("r0")).withColumn("a0", mid(F.abs(F.col("r0") - F.col("m0"))))
    near = F.abs(F.col("r0") - F.col("m0")) <= 4 * F.col("a0") + 0.02
    p = p.withColumn("slope", F.coalesce(F.regr_slope(F.when(near, F.col("ld")), F.when(near, F.col("ln"))).over(col), F.lit(1.0)))
    noise = F.sqrt(F.col("known"))
    bend = lambda c: F.signum(c) * F.log1p(F.abs(c))
    # statistic: (expression, least deviation that counts, whether only a rise counts)
    tested = {
        "missing": (F.log((F.col("missing_share") + 0.01) / (1.01 - F.col("missing_share"))), 0.06, False),
        "distinct": (F.col("ld") - F.least(F.greatest(F.col("slope"), F.lit(0.0)), F.lit(1.0)) * F.col("ln"), 0.03, False),
        "low": (bend(F.col("low")), 0.08, False),
        "high": (bend(F.col("high")), 0.05, False),
        "form": (F.col("form_shift") - F.col("form_chance"), 0.004, True),
        "start": (F.col("start_shift") - F.col("start_chance"), 0.004, True),
        "distribution": (F.col("bin_shift") - F.col("bin_chance"), 0.006, True),
        "size": (F.col("size_shift") - F.col("size_chance"), 0.006, True),
    }
    for k, (x, floor, rise) in tested.items():
        p = p.withColumn(f"x_{k}", x)
        p = p.withColumn(f"c_{k}", mid(f"x_{k}"))
        p = p.withColumn(f"d_{k}", F.col(f"x_{k}") - F.col(f"c_{k}"))
        p = p.withColumn(f"z_{k}", F.coalesce((F.col(f"d_{k}") if rise else F.abs(F.col(f"d_{k}"))) / F.greatest(1.4826 * mid(F.abs(F.col(f"d_{k}"))), F.lit(floor) + F.lit(0.15 if rise else 0.6) / noise), F.lit(0.0)))
    # The ends of the range sit where values are rare; they only count if mass moved with them.
    mass = F.greatest(*[F.col(f"z_{k}") for k in ("form", "start", "distribution", "size")], F.lit(0.0))
    p = p.withColumns({f"z_{k}": F.least(F.col(f"z_{k}"), 3 * mass) for k in ("low", "high")})
    score = F.greatest(*[F.col(f"z_{k}") for k in tested])
    what = F.lit(None).cast("string")
    for k in reversed(tested):
        what = F.when(F.col(f"z_{k}") == F.col("score"), F.lit(k)).otherwise(what)
    return p.withColumn("score", score).where(F.col("score") > limit).withColumn("what", what).select(by, "column_name", "what", "score", *[f"z_{k}" for k in tested])
