"""Filling missing values from similar records: K-prototypes clusters with group and parent fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.plans.scale import cut, free_name, join_salted, join_small, split_code, store

#: Written forms that stand for "unknown", compared in lower case without outer spaces.
UNKNOWN_WORDS = ["", "?", "??", "-", "--", ".", "*", "n/a", "n.a.", "n.a", "na", "nan", "none", "null", "nil", "unk", "unknown", "undefined", "not known", "missing", "u"]
SPACES = " \t\r\n\u00a0"
#: Numbers that stand for "unknown" where every true value is at least 0.
UNKNOWN_NUMBERS = [999.0, 9999.0, 99999.0]


def known_text(c: Column, code: str | None = None) -> Column:
    """``c`` without outer spaces, null where it tells no value. What matches the pattern ``code`` is a value even if listed."""
    text = F.trim(c, F.lit(SPACES))
    unknown = F.lower(text).isin(UNKNOWN_WORDS)
    if code:
        unknown = unknown & ~text.rlike(code)
    return F.when(~unknown, text)


def known_number(c: Column, low: float = 0.0, unknown: Sequence[float] = tuple(UNKNOWN_NUMBERS)) -> Column:
    """``c`` as double, null where it is null, NaN, below ``low`` or one of the ``unknown`` stand-ins."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (x >= low) & ~x.isin([float(v) for v in unknown]), x)


def known_code(c: Column, allowed: Sequence[int]) -> Column:
    """``c`` where it is one of the ``allowed`` codes, else null."""
    return F.when(c.isin(list(allowed)), c)


@dataclass
class KPrototypesImputer:
    """Fill missing numeric and categorical cells from records of the same group or cluster.

    ``values`` maps a column to the expression of its known value (null = missing); ``numeric`` and
    ``categorical`` name the features of the clustering, as expressions (None: the known value of that name). Each ``target`` is filled by
    the first of these that has a value, and ``<target>_method`` tells which:

    * ``group``   - the mode of the records with the same ``group_key`` (only ``group_targets``),
    * ``cluster`` - the median (numeric) or mode of the record's K-prototypes cluster,
    * ``parent``  - the same over the records with equal values of ``parent``,
    * ``global``  - the same over all records; ``none`` where no record has a value.

    ``<target>_filled`` holds the known or filled value, ``<target>_method`` is null on known cells.
    Features that a record lacks don't count in its distance. A record that lacks the target is in the cluster that its other
    features choose; so the clusters' medians and modes of a target are those of the records that lie there without looking at
    the target either. A cluster's value counts from ``support`` known records, below that the parent's does.

    Prototypes start at the most frequent combinations of the targets' categories and are refined over all rows. Features
    are stored once, narrow, in the checkpoint folder; a pass is one scan of them with a map-side aggregate by (cluster,
    categories). Numeric features are scaled by median and quartiles and held within three deviations, so that wrong measures don't pull
    at the prototypes; medians are ``percentile_approx`` sketches of accuracy 10,000. Ties of modes take the smallest
    value (in groups: that of the largest hash); repeated rows count as often as they occur; an empty table gives
    an empty result; columns of the input whose names clash with new ones stay and the new ones get ``_2``.
    """

    values: Mapping[str, Column]
    targets: Sequence[str]
    numeric: Mapping[str, Column]
    categorical: Mapping[str, Column]
    parent: Sequence[str] = ()
    group_key: Column | None = None
    group_targets: Sequence[str] = ()
    k: int = 16
    max_iter: int = 5
    gamma: float = 1.0
    tol: float = 1e-3
    support: int = 20
    prototypes: list[tuple[list[float | None], list[int | None]]] = field(default_factory=list)

    def _features(self, df: DataFrame) -> DataFrame:
        """``df`` with the known values, and from them the features; two steps, so that each is evaluated once."""
        known = df.withColumns({f"__fw_v_{t}": c for t, c in self.values.items()})
        own = lambda name, c: F.col(f"__fw_v_{name}") if c is None else c
        nums = {f"__fw_n{i}": own(n, c).cast("double") for i, (n, c) in enumerate(self.numeric.items())}
        cats = {f"__fw_c{i}": F.when(own(n, c).isNotNull(), F.xxhash64(own(n, c).cast("string"))) for i, (n, c) in enumerate(self.categorical.items())}
        return known.withColumns(nums | cats)

    def _names(self) -> tuple[list[str], list[str]]:
        return [f"__fw_n{i}" for i in range(len(self.numeric))], [f"__fw_c{i}" for i in range(len(self.categorical))]

    def _scaled(self, features: DataFrame) -> DataFrame:
        """Numeric features in robust deviations, within three of the median; nulls stay null."""
        nums, _ = self._names()
        z = {c: (F.col(c) - F.lit(self.center[i])) / F.lit(self.spread[i]) for i, c in enumerate(nums)}
        return features.withColumns(z).withColumns({c: F.when(F.col(c) > 3, F.lit(3.0)).when(F.col(c) < -3, F.lit(-3.0)).otherwise(F.col(c)) for c in nums})

    def _scores(self, blind: str | None = None) -> Column:
        """Scores of the prototypes, the nearest has the least, over scaled features; ``blind`` is a feature that doesn't count.

        Only what differs between prototypes is computed: of (z - m)^2 over a row's known features
        m^2 - 2 z m, of the mismatches minus the matches; what all prototypes share, and the scaling by the
        number of known features, can't change which is nearest. Features enter as plain non-null numbers (``_plain``).
        """
        skip_n, skip_c = [list(x).index(blind) if blind in x else -1 for x in (self.numeric, self.categorical)]
        scores = []
        for means, modes in self.prototypes:
            score = F.lit(0.0)
            for i, m in enumerate(means):
                if m is not None and i != skip_n:
                    score = score + F.lit(m * m) * F.col(f"__fw_o{i}") - F.lit(2 * m) * F.col(f"__fw_z{i}")
            for i, m in enumerate(modes):
                if m is not None and i != skip_c:
                    score = score - F.when(F.col(f"__fw_x{i}") == F.lit(m).cast("long"), F.lit(self.gamma)).otherwise(F.lit(0.0))
            scores.append(score)
        return F.array(split_code(scores[0]), *scores[1:])

    def _plain(self, scaled: DataFrame) -> DataFrame:
        nums, cats = self._names()
        plain = {f"__fw_z{i}": F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(nums)} | {f"__fw_o{i}": F.when(F.col(c).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)) for i, c in enumerate(nums)}
        return scaled.withColumns(plain | {f"__fw_x{i}": F.coalesce(F.col(c), F.lit(0).cast("long")) for i, c in enumerate(cats)})

    def _clustered(self, scaled: DataFrame, name: str = "__fw_cluster", blind: str | None = None) -> DataFrame:
        """``scaled`` with the index of the nearest prototype in ``name``."""
        nums, cats = self._names()
        gone = [f"__fw_{x}{i}" for x in "zo" for i in range(len(nums))] + [f"__fw_x{i}" for i in range(len(cats))]
        work = self._plain(scaled).withColumn("__fw_d", self._scores(blind)).drop(*gone)
        return work.withColumn(name, F.array_position("__fw_d", F.array_min("__fw_d")).cast("int") - 1).drop("__fw_d")

    def _summary(self, clustered: DataFrame) -> list:
        """Means and modes by cluster, from one scan: rows (cluster, column, mean or mode)."""
        nums, cats = self._names()
        cells = clustered.groupBy("__fw_cluster", *cats).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(nums)], *[F.count(c).alias(f"m{i}") for i, c in enumerate(nums)])
        parts = F.array(
            *[F.struct(F.lit(f"n{i}").alias("what"), F.lit(None).cast("long").alias("code"), F.col(f"s{i}").alias("s"), F.col(f"m{i}").alias("m")) for i in range(len(nums))],
            *[F.struct(F.lit(f"c{i}").alias("what"), F.col(c).alias("code"), F.lit(None).cast("double").alias("s"), F.when(F.col(c).isNotNull(), F.col("n")).otherwise(F.lit(0)).alias("m")) for i, c in enumerate(cats)],
        )
        by_code = cells.select("__fw_cluster", F.explode(parts).alias("p")).groupBy("__fw_cluster", "p.what", "p.code").agg(F.sum("p.s").alias("s"), F.sum("p.m").alias("m"))
        return by_code.where("m > 0").groupBy("__fw_cluster", "what").agg(F.max_by("code", F.struct("m", -F.col("code"))).alias("code"), F.sum("s").alias("s"), F.sum("m").alias("m")).collect()  # at most k x features rows

    def fit(self, df: DataFrame) -> "KPrototypesImputer":
        """Refine the prototypes over all rows of ``df`` and take the typical values of clusters, parents and all rows."""
        nums, cats = self._names()
        parent = [f"__fw_p{i}" for i in range(len(self.parent))]
        value = {t: f"__fw_v_{t}" for t in self.targets}
        # What the passes need, stored once; each of them scans this table, not the source.
        kept = self._features(df).withColumns({p: F.col(f"__fw_v_{c}") for p, c in zip(parent, self.parent)})
        features = store(kept.select(*nums, *cats, *parent, *dict.fromkeys(value.values())))
        row = features.agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000) for c in nums], F.lit(0)).first()
        quartiles = [q or [0.0, 0.0, 0.0] for q in row[: len(nums)]]
        wide = features.agg(*[F.stddev_pop(F.when(F.abs(F.col(c)) < 1e12, F.col(c))) for c in nums], F.lit(0)).first()
        self.center = [float(q[1]) for q in quartiles]
        # Where half the rows are equal the quartiles say nothing; then all rows' deviation does.
        self.spread = [float(q[2] - q[0]) / 1.349 or float(wide[i] or 0.0) or 1.0 for i, q in enumerate(quartiles)]
        features = self._scaled(features)
        lead = [c for c, name in zip(cats, self.categorical) if name in self.targets] or cats
        rest = [c for c in cats if c not in lead]
        first = features.groupBy(*lead).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in nums], *[F.mode(c, True).alias(c) for c in rest])
        whole = F.lit(True)
        for c in lead:
            whole = whole & F.col(c).isNotNull()
        first = first.orderBy(F.desc(whole), F.desc("n"), *lead).limit(self.k).collect()  # complete combinations first
        self.prototypes = [([r[c] for c in nums], [r[c] for c in cats]) for r in first]
        for _ in range(self.max_iter if self.prototypes else 0):
            rows = self._summary(self._clustered(features))
            means: dict[int, list] = {r["__fw_cluster"]: [None] * len(nums) for r in rows}
            modes: dict[int, list] = {j: [None] * len(cats) for j in means}
            for r in rows:
                i = int(r["what"][1:])
                if r["what"][0] == "n":
                    means[r["__fw_cluster"]][i] = r["s"] / r["m"]
                else:
                    modes[r["__fw_cluster"]][i] = r["code"]
            new = [(means.get(j, a), modes.get(j, b)) for j, (a, b) in enumerate(self.prototypes)]
            moved = max((abs((x or 0.0) - (y or 0.0)) for (a, _), (b, _) in zip(new, self.prototypes) for x, y in zip(a, b)), default=0.0)
            same = all(p == q for (_, p), (_, q) in zip(new, self.prototypes))
            self.prototypes = new
            if same and moved < self.tol:
                break
        self._by_cluster = {}
        for t, v in value.items():
            if not self.prototypes:
                break
            found = self._clustered(features.where(F.col(v).isNotNull()), "__fw_cluster", t).groupBy("__fw_cluster").agg(self._typical(t, v).alias("x"), F.count(F.lit(1)).alias("n"))
            self._by_cluster[t] = {r["__fw_cluster"]: r["x"] for r in found.collect() if r["n"] >= self.support}  # at most k rows
        agg = [self._typical(t, v).alias(f"__fw_u_{t}") for t, v in value.items()]
        everyone = features.agg(*agg).first()
        self._everyone = {t: everyone[i] for i, t in enumerate(value)}
        whole = F.lit(True)
        for p in parent:
            whole = whole & F.col(p).isNotNull()
        self._by_parent = cut(features.where(whole).groupBy(*parent).agg(*agg)) if parent else None
        return self

    def _typical(self, t: str, c: str) -> Column:
        return F.percentile_approx(c, 0.5, 10_000) if self._is_numeric(t) else F.mode(c, True)

    def _is_numeric(self, t: str) -> bool:
        return t in self.numeric

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<target>_filled`` and ``<target>_method``."""
        if not self.prototypes:
            self.fit(df)
        value = {t: f"__fw_v_{t}" for t in self.targets}
        parent = [f"__fw_p{i}" for i in range(len(self.parent))]
        known = self._features(df).withColumns({p: F.col(f"__fw_v_{c}") for p, c in zip(parent, self.parent)})
        kind = dict(known.dtypes)
        rows = self._clustered(self._scaled(known)) if self.prototypes else known.withColumn("__fw_cluster", F.lit(0))
        if self.group_key is not None and self.group_targets:
            rows = self._with_groups(known.withColumn("__fw_key", self.group_key), rows.withColumn("__fw_key", self.group_key), value)
        if parent:
            rows = join_small(rows, self._by_parent, parent)
        out: dict[str, Column] = {}
        taken = list(df.columns)
        for t, v in value.items():
            lit = lambda x, k=kind[v]: F.lit(x).cast(k)
            typical = F.array(*[lit(self._by_cluster.get(t, {}).get(j)) for j in range(len(self.prototypes))]) if self.prototypes else F.array(lit(None))
            levels = [(F.col(v), None)]
            if self.group_key is not None and t in self.group_targets:
                levels.append((F.col(f"__fw_k_{t}"), "group"))
            levels += [(F.get(typical, F.col("__fw_cluster")), "cluster")] + ([(F.col(f"__fw_u_{t}"), "parent")] if parent else []) + [(lit(self._everyone[t]), "global")]
            method = F.lit("none")
            for c, name in reversed(levels):
                method = F.when(c.isNotNull(), F.lit(name).cast("string")).otherwise(method)
            for name, c in ((f"{t}_filled", F.coalesce(*[c for c, _ in levels])), (f"{t}_method", method)):
                taken.append(got := free_name(name, taken))
                out[got] = c
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in out.items()])

    def _with_groups(self, known: DataFrame, rows: DataFrame, value: Mapping[str, str]) -> DataFrame:
        """Modes by group, looked up only for the rows that lack a group target; the others bypass the shuffle."""
        targets = [t for t in self.targets if t in self.group_targets]
        lacking = F.lit(False)
        for t in targets:
            lacking = lacking | F.col(value[t]).isNull()
        lacking = lacking & F.col("__fw_key").isNotNull()
        need, rest = rows.where(lacking), rows.where(~lacking)
        keys = known.where(lacking).select("__fw_key").distinct()
        joint = known.where("__fw_key is not null").groupBy("__fw_key", *[value[t] for t in targets]).agg(F.count(F.lit(1)).alias("n"))
        cells = joint.join(keys, "__fw_key", "left_semi").select("__fw_key", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(value[t]).cast("string").alias("v"), F.col("n")) for t in targets])).alias("c"))
        modes = cells.where("c.v is not null").groupBy("__fw_key", "c.t", "c.v").agg(F.sum("c.n").alias("n"))
        kind = dict(rows.dtypes)
        order = F.struct(F.col("n"), F.xxhash64("v"))
        table = modes.groupBy("__fw_key").agg(*[F.max_by(F.when(F.col("t") == t, F.col("v")), F.when(F.col("t") == t, order)).cast(kind[value[t]]).alias(f"__fw_k_{t}") for t in targets])
        filled = join_salted(need, table, ["__fw_key"], "left", 8)
        blank = rest.withColumns({f"__fw_k_{t}": F.lit(None).cast(kind[value[t]]) for t in targets})
        return filled.unionByName(blank)


def filled_cells(out: DataFrame, row_id: str, targets: Sequence[str]) -> DataFrame:
    """One row ``(row_id, field_name, method)`` per cell that the imputer marked as filled."""
    marks = F.array(*[F.struct(F.lit(t).alias("field_name"), F.col(f"{t}_method").alias("method")) for t in targets])
    return out.select(row_id, F.explode(F.filter(marks, lambda m: m["method"].isNotNull())).alias("m")).select(row_id, "m.field_name", "m.method")
