"""Splits of exact sizes that keep label marginals, folds, samples and seeded orders."""

from __future__ import annotations

from math import ceil, log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalars import stable_hash
from rankloom.operators.lineage import cut

#: Different labels that a stratified split may keep to their shares.
MOST_LABELS = 100_000


def _running(cells: DataFrame, count: str, order: str, by: list[str] = ()) -> Column:
    """The sum of a count over the cells before each."""
    w = Window.partitionBy(*by) if by else Window
    return F.coalesce(F.sum(count).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, order: str, name: str, rows: int = 1 << 18, most: int = 4096) -> DataFrame:
    """Appends the 0-based place in a numeric or time order; null: no place.

    No window runs over all rows: quantiles of the order cut it into ranges of about `rows` rows, at most `most` ranges,
    however its values are spread; rows are numbered within a range, after the counts of the ranges before.
    """
    from pyspark.ml.feature import Bucketizer

    value, has = F.col(order).cast("double"), F.col(order).isNotNull()
    cells = min(most, df.where(has).count() // rows + 1)
    bounds = []
    if cells > 1:
        bounds = df.where(has).agg(F.percentile_approx(value, [k / cells for k in range(1, cells)], 20 * cells)).first()[0]
    cut = df.withColumn("_range", F.when(has, 0.0))
    if bounds:
        edges = [-float("inf"), *sorted(set(bounds)), float("inf")]
        cut = Bucketizer(splits=edges, inputCol="_value", outputCol="_range", handleInvalid="keep").transform(df.withColumn("_value", F.when(has, value).otherwise(float("nan"))))
        cut = cut.withColumn("_range", F.when(has, F.col("_range"))).drop("_value")
    sums = cut.where(has).groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_range", _running(sums, "_n", "_range").alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    return cut.join(F.broadcast(before), "_range", "left").withColumn(name, place.cast("long")).drop("_range", "_before")  # at most `most` rows


def label_text(columns: list[str]) -> Column:
    return F.concat_ws("|", *(F.lower(F.col(c).cast("string")) for c in columns))


def hash_rank(df: DataFrame, key: str, seed: int, namespace: str, labels: list[str] = (), rows: int = 1 << 16) -> DataFrame:
    """Appends place: the 0-based rank by (labels, seeded hash).

    Rows are ranked within a cell of labels and the hash's first digits, of which there are enough for about `rows` rows
    in a cell; the counts of cells give the offsets, first of the labels, then of the cells within one.
    """
    digits = min(6, max(1, ceil(log(max(df.count(), 1) / rows + 1, 16))))
    h = stable_hash(seed, namespace, F.col(key))
    df = df.withColumn("_h", h).withColumn("_l", label_text(list(labels)) if labels else F.lit("")).withColumn("_b", F.substring("_h", 1, digits))
    cells = df.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_n"))
    of = cells.groupBy("_l").agg(F.sum("_n").alias("_all"))
    of = of.select("_l", _running(of, "_all", "_l").alias("_first"))
    before = cells.join(of, "_l").select("_l", "_b", (F.col("_first") + _running(cells, "_n", "_b", ["_l"])).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_l", "_b").orderBy("_h", key)) - 1 + F.col("_before")
    return df.join(before, ["_l", "_b"]).withColumn("place", place.cast("long")).drop("_h", "_l", "_b", "_before")


def systematic(df: DataFrame, key: str, labels: list[str], sizes: dict[str, int], seed: int, namespace: str) -> DataFrame:
    """Appends split: group g of size z owns the slots (k + 0.5) N / z; row j by (labels, hash) takes the j-th slot."""
    total = sum(sizes.values())
    ranked = hash_rank(df, key, seed, namespace, labels)
    spark = df.sparkSession
    order = {g: i for i, g in enumerate(sizes)}
    slots = None
    for g, z in sizes.items():
        own = spark.range(z).select(F.lit(g).alias("split"), ((F.col("id") + 0.5) * (total / z)).alias("at"), F.lit(order[g]).alias("o"))
        slots = own if slots is None else slots.unionByName(own)
    cut = slots.withColumn("_range", F.floor(F.col("at") / 65536))
    sums = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    j = F.row_number().over(Window.partitionBy("_range").orderBy("at", "o")) - 1 + F.col("_before")
    slots = cut.join(before, "_range").select("split", j.cast("long").alias("place"))
    return ranked.join(slots, "place").drop("place")


def folds(df: DataFrame, key: str, labels: list[str], k: int, seed: int) -> DataFrame:
    """Appends fold: sizes differ by one at most, labels spread evenly."""
    return hash_rank(df, key, seed, "fold", labels).withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def _text(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("none")))


def margins(split: DataFrame, labels: list[str]) -> DataFrame:
    """field, value, split, n, share: rows of a split with a label, and what its size gives it of all rows with the label.

    Splits without a row of a label have a row here too. Null labels count as "none".
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), _text(c).alias("value")) for c in labels))).alias("l")
    had = split.select("split", pairs).groupBy("l.field", "l.value", "split").agg(F.count(F.lit(1)).alias("n"))
    total = had.groupBy("field", "value").agg(F.sum("n").alias("_total"))
    sizes = had.where(F.col("field") == labels[0]).groupBy("split").agg(F.sum("n").alias("_size"))
    whole = sizes.agg(F.sum("_size").alias("_all"))
    want = total.crossJoin(F.broadcast(sizes.crossJoin(F.broadcast(whole))))  # a row for each split
    both = want.join(had, ["field", "value", "split"], "left")
    return both.select("field", "value", "split", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.col("_total") * F.col("_size") / F.col("_all")).alias("share"))


def swaps(codes: np.ndarray, group: np.ndarray, apart: np.ndarray, most: int = 100_000, wide: int = 512) -> list[tuple[int, int]]:
    """Pairs of rows to swap between their groups, one after the other, so that every label's count nears its share.

    codes (row, field): numbers of the labels; group: each row's; apart (label, group): count less share, changed in place.
    Each swap is the one that lowers the sum of fourth powers of `apart` most: of two tuples of labels only the labels in
    which they differ move. Rows of one tuple and group are alike, so the search is over tuples, the `wide` best on each side.
    """
    tuples, kind = np.unique(codes, axis=0, return_inverse=True)
    hot = np.zeros((len(tuples), len(apart)))
    hot[np.repeat(np.arange(len(tuples)), codes.shape[1]), tuples.ravel()] = 1
    groups = apart.shape[1]
    rows = {}
    for i, (k, g) in enumerate(zip(kind.ravel().tolist(), group.tolist(), strict=True)):
        rows.setdefault((k, g), []).append(i)
    done: list[tuple[int, int]] = []
    power = lambda x: x**4

    def best(g: int, h: int):
        out = power(apart[:, g] - 1) - power(apart[:, g]) + power(apart[:, h] + 1) - power(apart[:, h])
        into = power(apart[:, g] + 1) - power(apart[:, g]) + power(apart[:, h] - 1) - power(apart[:, h])
        a, b = (np.array([k for k in range(len(tuples)) if rows.get((k, x))], int) for x in (g, h))
        if not len(a) or not len(b):
            return 0.0, 0, 0
        u, v = hot[a] @ out, hot[b] @ into
        a, b = a[np.argsort(u, kind="stable")[:wide]], b[np.argsort(v, kind="stable")[:wide]]
        gain = (hot[a] @ out)[:, None] + (hot[b] @ into)[None] - (hot[a] * (out + into)) @ hot[b].T
        at = np.unravel_index(gain.argmin(), gain.shape)
        return float(gain[at]), int(a[at[0]]), int(b[at[1]])

    while len(done) < most and np.abs(apart).max(initial=0) >= 1:
        found = min(((*best(g, h), g, h) for g in range(groups) for h in range(g + 1, groups)), default=(0.0,))
        if found[0] >= -1e-9:
            break
        _, a, b, g, h = found
        i, j = rows[a, g].pop(), rows[b, h].pop()
        rows.setdefault((a, h), []).append(i)
        rows.setdefault((b, g), []).append(j)
        apart[:, g] += hot[b] - hot[a]
        apart[:, h] += hot[a] - hot[b]
        done.append((i, j))
    return done


def stratified(df: DataFrame, key: str, labels: list[str], sizes: dict[str, int], seed: int, namespace: str, candidates: int = 200_000, rounds: int = 8) -> DataFrame:
    """Appends split, of exact sizes, with every label's count in each group less than one row off its share.

    Even slots over the rows in the order of their labels give each tuple of labels its share within a row, without the
    driver. What a label is off by then is the sum over many tuples; a few swaps of rows between groups mend it. Rows that
    may swap are picked by a seeded hash, some of each label and group, at most about `candidates` of them: they meet on the
    driver, as the table of labels and groups does, whatever the number of rows or tuples. Each round takes other rows;
    rounds end once no label is off, or none gets better: not every set of labels has such a split. Keys are distinct.
    """
    n = df.count()
    if n != sum(sizes.values()):
        raise ValueError(f"sizes add up to {sum(sizes.values())}, there are {n} rows")
    spark, names = df.sparkSession, list(sizes)
    dealt = out = cut(systematic(df, key, labels, sizes, seed, namespace))
    moved: dict = {}
    for turn in range(rounds):
        table = margins(out, labels).limit(MOST_LABELS * len(names) + 1).collect()
        if len(table) > MOST_LABELS * len(names):
            raise ValueError(f"over {MOST_LABELS} different labels; use systematic()")
        number = {x: i for i, x in enumerate(sorted({(r.field, r.value) for r in table}))}
        count, apart = np.ones((len(number), len(names))), np.zeros((len(number), len(names)))
        for r in table:
            at = number[r.field, r.value], names.index(r.split)
            count[at], apart[at] = r.n, r.n - r.share
        off = np.abs(apart).max(initial=0)
        if off < 1:
            break
        rate = np.minimum(1.0, max(8.0, candidates / max(1, apart.size)) / np.maximum(count, 1))
        rates = spark.createDataFrame([(f, v, names[g], float(rate[i, g])) for (f, v), i in number.items() for g in range(len(names))], "_f string, _v string, split string, _rate double")
        drawn = F.conv(F.substring(stable_hash(seed, f"{namespace}:swap{turn}", F.col(key)), 1, 13), 16, 10).cast("double") / float(16**13)
        keyed = out.select(F.col(key).alias("_key"), "split", drawn.alias("_drawn"), *(_text(c).alias(f"_l{i}") for i, c in enumerate(labels)))
        for i, c in enumerate(labels):
            own = rates.where(F.col("_f") == c).select(F.col("_v").alias(f"_l{i}"), "split", F.col("_rate").alias(f"_r{i}"))
            keyed = keyed.join(F.broadcast(own), [f"_l{i}", "split"])  # a row for each label and group
        picked = keyed.where(F.col("_drawn") < F.greatest(*(f"_r{i}" for i in range(len(labels))), F.lit(0.0)))
        picked = picked.select("_key", "split", *(f"_l{i}" for i in range(len(labels)))).limit(4 * candidates + 1).toPandas().sort_values("_key", ignore_index=True)
        codes = np.array([[number[c, v] for v in picked[f"_l{i}"]] for i, c in enumerate(labels)]).T.reshape(-1, len(labels))
        group = np.array([names.index(g) for g in picked["split"]], int)
        own = group.copy()
        for i, j in swaps(codes, group, apart):
            own[i], own[j] = own[j], own[i]
        changed = np.flatnonzero(own != group)
        if not len(changed):
            break
        moved |= {picked["_key"][i].item() if hasattr(picked["_key"][i], "item") else picked["_key"][i]: names[own[i]] for i in changed}
        # At most `candidates` rows a round.
        to = spark.createDataFrame(list(moved.items()), df.select(F.col(key).alias("_key"), F.lit("").alias("_to")).schema)
        out = dealt.join(F.broadcast(to), F.col(key) == F.col("_key"), "left").select(*df.columns, F.coalesce("_to", "split").alias("split"))
    return out


def two_stage(df: DataFrame, key: str, labels: list[str], sizes: dict[str, int], parts: dict[str, dict[str, int]], seed: int, namespace: str) -> DataFrame:
    """Appends split: first into the groups of `sizes`, then those that `parts` names into parts of their own."""
    first = stratified(df, key, labels, sizes, seed, namespace)
    out = first.where(~F.col("split").isin(list(parts)))
    for group, own in parts.items():
        out = out.unionByName(stratified(first.where(F.col("split") == group).drop("split"), key, labels, own, seed, f"{namespace}-{group}"))
    return out


def balance(split: DataFrame, labels: list[str], slack: float = 1.0) -> DataFrame:
    """split, n_rows, and balanced: whether no label's count is `slack` rows or more from the split's share of all."""
    n = split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    worst = margins(split, labels).groupBy("split").agg((F.max(F.abs(F.col("n") - F.col("share"))) < slack).alias("balanced"))
    return n.join(worst, "split")


def deviation(reference: DataFrame, subset: DataFrame, labels: list[str]) -> DataFrame:
    """One row: the largest difference of any label's percentage."""
    from rankloom.operators.profile import marginals

    a = marginals(reference, labels)
    b = marginals(subset, labels).select("field", "value", F.col("pct").alias("other"))
    return a.join(b, ["field", "value"], "left").agg(F.round(F.max(F.abs(F.col("pct") - F.coalesce("other", F.lit(0.0)))), 4).alias("deviation"))


def balanced(spark, n: int, values: list[str], seed: int, name: str = "value") -> DataFrame:
    """n rows (pos, value): each value n / k times, in seeded order."""
    rows = hash_rank(spark.range(n).withColumnRenamed("id", "pos"), "pos", seed, "balanced")
    return rows.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))).drop("place")


def exact_share(df: DataFrame, key: str, share: float, n: int, seed: int, name: str) -> DataFrame:
    """A boolean column with exactly round(n share) true values."""
    return hash_rank(df, key, seed, name).withColumn(name, F.col("place") < round(n * share)).drop("place")


def quotas(df: DataFrame, key: str, shares: dict[str, float], n: int, seed: int, name: str) -> DataFrame:
    """A column of strata with exact quotas; the first takes what rounding leaves."""
    sizes = {s: round(n * w) for s, w in shares.items()}
    first = next(iter(sizes))
    sizes[first] += n - sum(sizes.values())
    edge, expr = 0, None
    for s, z in sizes.items():
        edge += z
        expr = F.when(F.col("place") < edge, s) if expr is None else expr.when(F.col("place") < edge, s)
    return hash_rank(df, key, seed, name).withColumn(name, expr).drop("place")


def uniform_int(seed: int, namespace: str, key: Column, low: int, high: int) -> Column:
    """A whole number in [low, high] from a seeded hash."""
    h = F.conv(F.substring(stable_hash(seed, namespace, key), 1, 8), 16, 10).cast("long")
    return F.lit(low) + h % (high - low + 1)


def generate_risks(spark, n: int, seed: int, golden: DataFrame | None = None) -> DataFrame:
    """n distinct plausible risks that aren't golden: twice as many are drawn, and the first n that are new are kept."""
    from rankloom.functions.scalars import content_id
    from rankloom.operators.quality import ENUMS, RISK_FIELDS

    key = F.col("id")
    u = lambda name, lo, hi: uniform_int(seed, name, key, lo, hi).cast("int")
    one = lambda name: F.element_at(F.array(*map(F.lit, ENUMS[name])), u(name, 1, len(ENUMS[name])))
    df = spark.range(2 * n).withColumns({c: one(c) for c in ENUMS})
    kind = F.col("building_type")
    df = df.withColumn("dwelling_units", F.when(kind == "single-family", 1).when(kind == "two-family", 2).when(kind == "multi-family", u("units", 3, 8)).otherwise(u("units2", 1, 2)))
    df = df.withColumn("living_space_sqm", F.col("dwelling_units") * u("sqm", 60, 140)).withColumn("construction_year", u("year", 1900, 2020))
    df = df.withColumn("rebuild_sum", F.least(F.lit(3_000_000), F.greatest(F.lit(40_000), F.floor(F.col("living_space_sqm") * u("cost", 1500, 3500) / 1000) * 1000)).cast("long"))
    df = df.withColumn("postal_code", F.lpad(u("plz", 1000, 99999).cast("string"), 5, "0")).withColumn("owner_occupied", u("own", 1, 10) <= 7).withColumn("with_deductible", u("ded", 1, 10) <= 4)
    df = df.withColumn("scenario_id", content_id(RISK_FIELDS))
    first = df.groupBy("scenario_id").agg(F.min_by(F.struct(*RISK_FIELDS), "id").alias("risk"), F.min("id").alias("id"))
    if golden is not None:
        first = first.join(golden.select("scenario_id").distinct(), "scenario_id", "left_anti")
    return first.orderBy("id").limit(n).select("scenario_id", "risk.*")
