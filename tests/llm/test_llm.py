"""Operators for language-model data against brute force, with the defined results of odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm.clusters import contracted_clusters, markov_cluster, similarity_clusters
from framewise.llm.mixing import mix
from framewise.llm.packing import Bins, fill_report, pack
from framewise.llm.quantiles import LISTED, Sketch, encode, merge, percentiles, sketch
from framewise.llm.repetition import chi2_cdf, chi2_quantile, minimum_covariance_determinant, repeated_passages, repeated_words, repetition_statistics, repetitive_documents, robust_outliers

# Percentiles


def test_encoding_keeps_order():
    x = np.array([-np.inf, -1e300, -5.5, -1e-40, -0.0, 0.0, 1e-40, 3.25, 7e20, np.inf])
    k = encode(x)
    assert (np.diff(k.astype(np.int64)) >= 0).all() and k[4] == k[5]


def exact_rank_error(sorted_values, value, q):
    n, want = len(sorted_values), max(1, np.ceil(round(q * len(sorted_values), 9)))
    v = np.float32(value)
    lo, hi = np.searchsorted(sorted_values, v, "left"), np.searchsorted(sorted_values, v, "right")
    return max(0, lo + 1 - want, want - hi) / n


def test_percentiles_within_the_stated_error(spark):
    rng = np.random.default_rng(1)
    data = {"a": np.round(rng.gamma(2, 20, 6000), 2), "b": rng.integers(0, 90, 3000).astype(float), None: rng.normal(0, 1e6, 500)}
    rows = [(k, float(v), int(i % 3)) for k, vs in data.items() for i, v in enumerate(vs)] + [("a", None, 0), ("b", float("nan"), 0), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, load int").repartition(6)
    whole = sketch(df, ["k"], ["v"])
    found = percentiles(whole, ["k"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()
    assert {r["k"] for r in found} == {"a", "b", None}
    for r in found:
        vs = np.sort(data[r["k"]].astype(np.float32))
        assert r["n"] == len(vs)
        assert exact_rank_error(vs, r["value"], r["q"]) <= r["rank_error"]
    # Sketches of loads add up to the sketch of all.
    parts = merge(sketch(df, ["k", "load"], ["v"]), ["k"])
    a = {(r["k"], r["q"]): r["value"] for r in found}
    b = {(r["k"], r["q"]): r["value"] for r in percentiles(parts, ["k"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert a == b


def test_deletions_undo_insertions(spark):
    rows = [(float(i), 1) for i in range(1000)] + [(float(i), -1) for i in range(500, 1000)] + [(3.0, None)]
    s = sketch(spark.createDataFrame(rows, "v double, w int"), [], ["v"], weight="w")
    r = percentiles(s, [], [0.5]).first()
    assert r["n"] == 500 and abs(r["value"] - 249) <= 500 * max(r["rank_error"], 0.01)
    assert percentiles(sketch(spark.createDataFrame([], "v double"), [], ["v"]), [], [0.5]).count() == 0
    assert Sketch().quantiles([0.5]) == [None]


def test_listed_and_counted_sketches_add_up_alike():
    rng = np.random.default_rng(3)
    x, y = encode(rng.normal(size=3 * LISTED)), encode(np.round(rng.normal(size=500), 1))
    one = Sketch()
    one.add(np.concatenate([x, y]), np.ones(len(x) + len(y), np.int64))
    parts = [Sketch() for _ in range(4)]
    for k, p in enumerate(np.array_split(x, 3)):
        p_weights = np.ones(len(p), np.int64)
        parts[k].add(p, p_weights)
    parts[3].add(y, np.ones(len(y), np.int64))
    total = Sketch()
    for p in parts:
        total.merge(Sketch.of(p.n, p.body()))
    assert parts[3].levels is None and total.n == one.n
    assert all((a == b).all() for a, b in zip(total.counters(), one.counters()))


def test_loads_add_up_in_a_tree(spark):
    """More sketches of a group than one task adds up."""
    rows = [(k, float(v)) for k in range(100) for v in range(k % 7 + 1)]
    loads = sketch(spark.createDataFrame(rows, "load int, v double"), ["load"], ["v"])
    assert loads.count() == 100
    r = percentiles(merge(loads, []), [], [0.5, 1.0]).collect()
    every = sorted(v for _, v in rows)
    assert {x["q"]: (x["n"], x["value"]) for x in r} == {0.5: (len(every), every[-(-len(every) // 2) - 1]), 1.0: (len(every), 6.0)}


# Clusters


def test_markov_clustering_of_two_cliques(spark):
    edges = [(i, j, 1.0) for g in (range(5), range(10, 15)) for i in g for j in g] + [(4, 10, 0.05), (10, 4, 0.05)]
    out = markov_cluster(spark.createDataFrame(edges, "i long, j long, w double")).collect()
    of = {r["node"]: r["attractor"] for r in out}
    assert len(of) == 10 and len({of[i] for i in range(5)}) == 1 and len({of[i] for i in range(10, 15)}) == 1 and of[0] != of[10]


def bridged():
    """Two dense 5 x 5 grids of nodes behind a thin bridge."""
    flows = []
    for side in (0, 100):
        at = {(x, y): side + 5 * x + y for x in range(5) for y in range(5)}
        flows += [(at[a], at[b], 10.0) for a in at for b in at if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1]
    return flows + [(24, 100, 0.5), (100, 24, 0.5)]


def test_contraction_keeps_wide_clusters_whole_and_thin_bridges_cut(spark):
    flows = spark.createDataFrame(bridged(), "i long, j long, f double")
    found = {r["node"]: r["component"] for r in contracted_clusters(flows).collect()}
    assert len({found[i] for i in range(25)}) == 1 and len({found[100 + i] for i in range(25)}) == 1 and found[0] != found[100]
    # What is connected is one component here: components alone give other rows.
    from framewise.operators.graph import connected_components

    edges = flows.selectExpr("i AS a", "j AS b").where("a <> b")
    assert connected_components(flows.selectExpr("i AS node").distinct(), edges).select("component").distinct().count() == 1


def test_unsettled_flow_is_an_error(spark):
    with pytest.raises(RuntimeError):
        markov_cluster(spark.createDataFrame(bridged(), "i long, j long, w double"), max_iter=1)


def flowers(spark, factor=1.0):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.05, (n, 4)).clip(np.array(c) - 0.15, np.array(c) + 0.15) for c, n in (((1, 1, 1, 1), 300), ((3, 3, 3, 3), 150), ((1, 3, 1, 3), 40))])
    rows = [(i + 1, *map(float, factor * r), "own") for i, r in enumerate(x)] + [(1000, *[9.0 * factor] * 4, "alone"), (1001, None, 1.0, 1.0, 1.0, "gap"), (1002, float("nan"), 1.0, 1.0, 1.0, "gap"), (1003, float("inf"), 1.0, 1.0, 1.0, "gap")]
    rows += [(2000 + i, *[5.0 * factor] * 4, "copies") for i in range(8)] + [(3000 + i, *[7.0 * factor] * 4, "few") for i in range(7)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, cluster_key string")


def test_similarity_clusters(spark):
    df = flowers(spark)
    got = similarity_clusters(df, "id", ["a", "b", "c", "d"])
    members = {r["id"]: r["cluster_key"] for r in got.members.collect()}
    sizes = {k: sum(v == k for v in members.values()) for k in set(members.values())}
    assert set(sizes) == {1, 301, 451, 2000} and sizes[2000] == 8
    assert all(members.get(i + 1) == (1 if i < 300 else 301 if i < 450 else 451) for i in range(490) if i + 1 in members) and len(members) > 480
    summary = {r["cluster_key"]: r for r in got.summary.collect()}
    assert {k: r["size"] for k, r in summary.items()} == sizes
    assert all(members[i] == k for k, r in summary.items() for i in r["typical"])
    assert similarity_clusters(df.limit(0), "id", ["a", "b", "c", "d"]).members.count() == 0
    # Without Markov clustering, every node its own cluster, other rows come out; another unit gives the same.
    scaled = {r["id"]: r["cluster_key"] for r in similarity_clusters(flowers(spark, 1024.0), "id", ["a", "b", "c", "d"]).members.collect()}
    assert scaled == members


def test_clusters_are_those_of_the_flow(spark, monkeypatch):
    from framewise.llm import clusters

    monkeypatch.setattr(clusters, "contracted_clusters", lambda flows, *_: flows.selectExpr("j AS node", "j AS component", "1D AS flow").distinct())
    apart = similarity_clusters(flowers(spark), "id", ["a", "b", "c", "d"]).members
    assert apart.select("cluster_key").distinct().count() > 4


# Containers


def test_bins_take_the_least_sufficient_space():
    b = Bins(10, most=2)
    assert b.put(6, ["a"]) == [] and b.put(5, ["b"]) == []
    assert b.put(4, ["c"]) == [(0, ["a", "c"])]
    b.put(9, ["d"])
    assert b.put(8, ["e"]) == [(1, ["d"])]


@pytest.mark.parametrize("parts", [1, 7])
def test_pack(spark, parts):
    rnd = random.Random(2)
    sizes = [rnd.choice([0, 1, 3, 17, 40, 99, 100, 101, 250, 1000]) for _ in range(900)] + [None]
    items = spark.createDataFrame([(i, n, "own") for i, n in enumerate(sizes)], "id long, n long, kind string").repartition(parts)
    kinds = spark.createDataFrame([("s", 100), ("l", 999), ("no", 0), ("null", None)], "kind string, cap int")
    packed = pack(items, "id", "n", kinds, "kind", "cap", open_bins=4, merge_of=1)
    rows = packed.collect()
    for kind, cap in (("s", 100), ("l", 999)):
        mine = [r for r in rows if r["kind"] == kind]
        load: dict = {}
        whole: dict = {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
            whole.setdefault(r["id"], []).append((r["piece"], r["start"], r["tokens"]))
        assert max(load.values()) <= cap and set(whole) == set(range(901))
        for i, ps in whole.items():
            ps.sort()
            n = sizes[i] or 0
            assert [p[0] for p in ps] == list(range(1, len(ps) + 1)) and sum(p[2] for p in ps) == n
            assert all(a[1] + a[2] == b[1] for a, b in zip(ps, ps[1:])) and (len(ps) == 1 or n > cap)
    assert {r["kind"] for r in rows} == {"s", "l"}
    assert all(r["used_share"] > 0.85 for r in fill_report(packed, kinds, "kind", "cap").collect())
    assert pack(items.limit(0), "id", "n", kinds, "kind", "cap").count() == 0


# Mixtures


def test_mix(spark):
    rnd = random.Random(3)
    docs = [(i, s, rnd.randrange(1, 50)) for i, s in enumerate(["a"] * 3000 + ["b"] * 200 + ["c"] * 100)] + [(9000, None, 10), (9001, "a", None), (9002, "a", -5)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "id long, source string, n long, repeats int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 20), ("c", 0.1, 1), ("gone", 0.1, 9), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mix(df, "id", "source", "n", targets)
    total = sum(max(n or 0, 0) for _, _, n in docs)
    size = {s: sum(max(n or 0, 0) for _, x, n in docs if x == s) for s in "abc"}
    got = {r["source"]: r for r in m.shares().collect()}
    for s, share in (("a", 0.5), ("b", 0.3)):
        assert not got[s]["short"] and 0 <= share * total - got[s]["actual_tokens"] < 60
    assert {s for s, r in got.items() if r["short"]} == {"c", "gone"}
    assert got["c"]["actual_tokens"] == size["c"] and got["gone"]["actual_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
    uses = {r["id"]: r["repeats_2"] for r in m.records.collect()}
    assert max(uses.values()) <= 20 and all(v == 1 for k, v in uses.items() if k < 3000)
    # Larger budgets choose supersets, and runs agree.
    small = {r["id"] for r in mix(df.repartition(7), "id", "source", "n", targets, total // 2).records.where("source = 'a'").collect()}
    assert small < {r["id"] for r in m.records.where("source = 'a'").collect()}
    assert mix(df.limit(0), "id", "source", "n", targets).records.count() == 0


# Repetition


def brute(words, k=8):
    n, mask, first = len(words), [False] * len(words), {}
    for i in range(n - k + 1):
        g = tuple(words[i : i + k])
        if g in first and first[g] + k <= i:
            mask[i : i + k] = [True] * k
        first.setdefault(g, i)
    return mask


def test_repeated_words_against_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        words = [rnd.choice("abc") for _ in range(rnd.randrange(60))]
        assert repeated_words(words) == sum(brute(words))
    passage = ["w" + chr(97 + i) for i in range(9)]
    assert repeated_words(passage * 2) == 9
    assert repeated_words(passage[:7] * 2) == 0


def test_statistics_of_odd_texts(spark):
    passage = "The quick, brown fox 12 jumps over a lazy dog today!"
    texts = [None, "", "one", "12 34 !!", passage + "\n" + passage.upper().replace("12", "99"), "a " * 100_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r[0]: r for r in repeated_passages(df, "doc_id", "text").collect()}
    assert [got[i]["n_words"] for i in range(4)] == [0, 0, 1, 0]
    assert got[4]["repeated_words"] == 10 and got[4]["repeated_share"] == 0.5
    assert got[5]["n_words"] == 100_000 and got[5]["repeated_words"] == 100_000 - 8
    stats = {r[0]: r for r in repetition_statistics(df, "doc_id", "text").collect()}
    assert all(stats[i][c] == 0 for i in range(4) for c in ("phrases_again", "top_phrase"))
    assert stats[4]["phrases_again"] == 8 / 18 and stats[5]["top_phrase"] == 1.0


def texts_of(spark, share):
    """600 texts, of which ``share`` repeat themselves."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(600):
        base = " ".join(word() for _ in range(60))
        rows.append((i, (base + " ") * 3 if i % 100 < 100 * share else base, "en" if i % 3 else None, "s" if i % 5 else "tiny"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)


def test_outliers_are_the_repetitive_ones(spark):
    df = texts_of(spark, 0.03)
    out = robust_outliers(repetition_statistics(df, "doc_id", "text", ["lang", "source"]), ["lang", "source"])
    want = {i for i in range(600) if i % 100 < 3}
    assert {r["doc_id"] for r in out.where("rejected").collect()} >= want
    assert out.where("rejected").count() < 60 and out.count() == 600
    assert robust_outliers(repetition_statistics(df.limit(0), "doc_id", "text", ["lang"]), ["lang"]).count() == 0
    assert {r["doc_id"] for r in repetitive_documents(df, "doc_id", "text", ["lang", "source"]).collect()} == want


def test_candidates_come_from_the_robust_estimate(spark, monkeypatch):
    """A fifth of the texts is repetitive: plain means and covariances take them in and reject none; the robust estimate finds all."""
    from framewise.llm import repetition

    df, want = texts_of(spark, 0.2), {i for i in range(600) if i % 100 < 20}
    assert {r["doc_id"] for r in repetitive_documents(df, "doc_id", "text", []).collect()} == want

    def plain(points, weights, floors, *_):
        mean = weights @ points / weights.sum()
        d = points - mean
        return mean, (d * weights[:, None]).T @ d / weights.sum() + np.diag(floors**2)

    monkeypatch.setattr(repetition, "minimum_covariance_determinant", plain)
    assert repetitive_documents(df, "doc_id", "text", []).count() == 0


def test_minimum_covariance_determinant():
    rng = np.random.default_rng(5)
    cov = np.array([[1.0, 0.6], [0.6, 0.5]])
    points = np.vstack([rng.multivariate_normal([1, 2], cov, 4000), rng.normal(9, 0.2, (800, 2))])
    mean, found = minimum_covariance_determinant(points, np.ones(len(points)), np.array([1e-3, 1e-3]))
    assert np.abs(mean - [1, 2]).max() < 0.1 and np.abs(found - cov).max() < 0.12
    again = minimum_covariance_determinant(np.repeat(points, 2, axis=0)[::2], np.ones(len(points)), np.array([1e-3, 1e-3]))
    assert np.allclose(again[0], mean)
    assert abs(chi2_cdf(9.487729, 4) - 0.95) < 1e-6 and abs(chi2_quantile(0.975, 3) - 9.348404) < 1e-5
    one = minimum_covariance_determinant(np.ones((5, 2)), np.ones(5), np.array([0.1, 0.1]))
    assert np.isfinite(one[1]).all()


def test_words_ignore_case_punctuation_digits():
    text = "Alpha, beta 1 gamma."
    assert re.findall(r"[^\W\d_]+", text.lower()) == ["alpha", "beta", "gamma"]
    assert F is not None


def test_fill_report_has_every_kind(spark):
    packed = spark.range(1500).selectExpr("concat('k', id) AS kind", "'0-0' AS container_id", "5L AS tokens")
    got = fill_report(packed, packed.selectExpr("kind", "10 AS cap"), "kind", "cap").collect()
    assert len(got) == 1500 and all(r["used_share"] == 0.5 for r in got)
