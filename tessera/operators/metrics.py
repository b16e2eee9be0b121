"""Exact evaluation statistics of scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite
from tessera.operators.ordered import quantiles, running_sums
from tessera.session import checkpointed


def _by_score(df: DataFrame, y: str, x: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """Distinct finite scores per key with the weights ``pos`` and ``neg`` of the classes, ``rows``, and ``cum_neg`` of those below."""
    w, x = F.col(weight) if weight else F.lit(1), F.col(x).cast("double")
    d = df.filter(F.col(y).isNotNull() & finite(x)).groupBy(*keys, x.alias("__x"))
    d = d.agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"), F.count("*").alias("rows"))
    return running_sums(d, keys, "__x", ["neg"], exclusive=True)


def _area(r: DataFrame, keys: list[str]) -> DataFrame:
    area = F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0))
    out = r.groupBy(*keys).agg(area.alias("__a"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("rows").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("__a") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return out.select(*keys, value.alias("auc"), "n_pos", "n_neg", "n", "lo", "hi")


def auc(df: DataFrame, y: str, x: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve per key, ties counted half; null with one class only.

    Rows are first summed to distinct scores, so the running sum is over those, and the input is read once.
    """
    keys = keys or []
    return _area(_by_score(df, y, x, keys, weight), keys).select(*keys, "auc", "n_pos", "n_neg")


def safe_auc(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """As ``auc``, but null below four rows and 0.5 for a constant score."""
    a = _area(_by_score(df, y, x, keys), keys)
    value = F.when((F.col("n") < 4) | F.col("auc").isNull(), None).when(F.col("lo") == F.col("hi"), 0.5).otherwise(F.col("auc"))
    return a.select(*keys, value.alias("auc"), F.greatest(value, 1 - value).alias("auc_abs"), "n")


def ece(df: DataFrame, y: str, p: str, bins: int = 15, keys: list[str] | None = None) -> DataFrame:
    """Expected calibration error over equal bins, closed on the left, the last on both sides."""
    keys = keys or []
    b = F.least(F.lit(bins - 1), F.aggregate(F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.lit(0), lambda s, e: s + (F.col(p) >= e).cast("int")))
    g = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(p).alias("conf"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def threshold_at_fpr(df: DataFrame, y: str, p: str, target: float = 0.05) -> DataFrame:
    """The least observed score whose false-positive rate is at most ``target``.

    1.0 without negatives; just above the largest score where none fits.
    """
    d = df.groupBy(F.col(p).cast("double").alias("s")).agg(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))
    r = checkpointed(running_sums(d, [], "s", ["neg"], descending=True))
    total = r.agg(F.sum("neg").alias("n"), F.max("s").alias("top"))
    fits = F.min(F.when(F.col("cum_neg") <= F.lit(target) * F.col("n"), F.col("s")))
    ulp = F.col("top") + F.greatest(F.abs(F.col("top")), F.lit(1e-300)) * 2.220446049250313e-16
    return r.crossJoin(F.broadcast(total)).groupBy("n", "top").agg(fits.alias("t")).select(F.when(F.col("n") == 0, 1.0).otherwise(F.coalesce("t", ulp)).alias("threshold"))  # total is one row


def split_metrics(df: DataFrame, y: str, p: str, threshold: Column, keys: list[str]) -> DataFrame:
    """Confusion and rates at a threshold, Brier, AUC and calibration per key."""
    hit = F.col(p) >= threshold
    c = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if((F.col(y) == 1) & hit).alias("tp"), F.count_if((F.col(y) == 0) & hit).alias("fp"), F.count_if((F.col(y) == 0) & ~hit).alias("tn"), F.count_if((F.col(y) == 1) & ~hit).alias("fn"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
    )
    ratio = lambda a, b: F.col(a) / F.greatest(F.lit(1), b)
    c = c.select(
        "*", ratio("tp", F.col("tp") + F.col("fn")).alias("tpr"), ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ((F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("n"))).alias("accuracy"),
    )
    return c.join(auc(df, y, p, keys).select(*keys, "auc"), keys).join(ece(df, y, p, keys=keys), keys)


def mutual_information(df: DataFrame, y: str, z: str, keys: list[str] | None = None) -> DataFrame:
    """Plug-in mutual information of two binary columns, in bits."""
    keys = keys or []
    c = df.filter(F.col(y).isNotNull() & F.col(z).isNotNull()).groupBy(*keys, y, z).count()
    w = lambda *k: F.sum("count").over(Window.partitionBy(*keys, *k) if keys or k else Window.partitionBy(F.lit(0)))  # noqa: E731  at most four rows a key
    p, py, pz = F.col("count") / w(), w(y) / w(), w(z) / w()
    c = c.select(*keys, F.when(p > 1e-12, p * F.log2(p / (py * pz))).otherwise(0.0).alias("t"))
    return c.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum("t")).alias("mi_bits"))


def binary_information(prior: Column, rate1: Column, rate0: Column) -> Column:
    """Mutual information in bits from a prior of y = 1 and the two conditional rates of z = 1."""
    pz = prior * rate1 + (1 - prior) * rate0
    cell = lambda p, q, r: F.when(p > 1e-12, p * F.log2(p / (q * r))).otherwise(0.0)
    return cell(prior * rate1, prior, pz) + cell(prior * (1 - rate1), prior, 1 - pz) + cell((1 - prior) * rate0, 1 - prior, pz) + cell((1 - prior) * (1 - rate0), 1 - prior, 1 - pz)


def cohen_d(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    """(mean of 1 - mean of 0) over the pooled sample deviation; null below two rows a class."""
    keys = keys or []
    v = lambda k, f: f(F.when(F.col(y) == k, F.col(x).cast("double")))
    a = df.groupBy(*keys).agg(*[v(k, f).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.when((F.col("n1") < 2) | (F.col("n0") < 2) | (pooled <= 1e-12), None).otherwise((F.col("m1") - F.col("m0")) / pooled)
    return a.select(*keys, d.alias("cohen_d"))


def z_shift(train: DataFrame, other: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Mean absolute z of ``other`` under the mean and deviation of ``train`` per key; null if that is 0."""
    m = train.groupBy(*keys).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    z = F.when(F.col("s") > 1e-12, F.abs((F.col(x) - F.col("m")) / F.col("s")))
    return other.join(m, keys).groupBy(*keys).agg(F.avg(z).alias("z_shift"))


def overlap(df: DataFrame, y: str, x: str, shares: tuple[float, float] = (0.01, 0.99), bins: int = 60) -> DataFrame:
    """Overlap of the two classes' densities over equal bins between two quantiles of all values; those beyond are clipped."""
    d = df.select(F.col(y).alias("y"), F.col(x).cast("double").alias("x")).filter(finite(F.col("x")))
    d = d.crossJoin(F.broadcast(quantiles(d, "x", list(shares))))  # one row
    v = F.greatest(F.least("x", "q1"), "q0")
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(v - F.col("q0"), F.col("q1") - F.col("q0")) * bins), F.lit(0)).cast("int"))
    c = d.groupBy(b.alias("bin")).agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    everything = Window.partitionBy(F.lit(0))  # a row per bin
    c = c.select(F.least(F.col("a") / F.sum("a").over(everything), F.col("b") / F.sum("b").over(everything)).alias("o"))
    return c.agg(F.sum("o").alias("overlap"))


_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]  # distribution function at mean 1


def _replicate_aucs(df: DataFrame, y: str, x: str, id_col: str, replicates: int, seed: str) -> DataFrame:
    """replicate and auc: the AUC where every row counts as often as a Poisson quantile of a hash of replicate and id says.

    Rows are sorted over all tasks by score; a task makes its rows' multiplicities, adds up its own part of every
    replicate's area, and the negatives of the tasks before are added for the rest. Rows of equal score may lie in
    several tasks, so each also gives its first and last score's sums, by which ties over tasks are counted half.
    """
    d = df.filter(F.col(y).isNotNull() & finite(F.col(x).cast("double")))
    d = d.select(F.col(x).cast("double").alias("x"), (F.col(y) == 1).alias("y"), (F.col(y) == 0).alias("n"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    d = d.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", F.xxhash64("id")).sortWithinPartitions("x")

    def run(batches):
        from hashlib import md5

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        heads = [f"{seed}|{k}|".encode() for k in range(replicates)]

        def times(ids: list[str]) -> np.ndarray:
            """Multiplicities by row and replicate: the first six bytes of a hash as a share of one, under the distribution function."""
            raw = b"".join(b"\0\0" + md5(h + i).digest()[:6] for i in map(str.encode, ids) for h in heads)
            return np.searchsorted(_POISSON, np.frombuffer(raw, ">u8") / float(1 << 48), "right").reshape(len(ids), replicates).astype(np.float64)

        pos, neg, area = (np.zeros(replicates) for _ in range(3))
        score, here_pos, here_neg, ends = None, np.zeros(replicates), np.zeros(replicates), []

        def close():
            nonlocal pos, neg, area
            area = area + here_pos * (neg + here_neg / 2)
            pos, neg = pos + here_pos, neg + here_neg
            ends[1:] = [(score, here_pos, here_neg)]  # the first score and the latest

        for b in batches:
            if not len(b):
                continue
            v, one, zero = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            ids, first = b.column(3).to_pylist(), np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            sums = ((v[f], part) for f, g in zip(first.tolist(), [*first[1:].tolist(), len(v)], strict=True) for part in (slice(k, min(k + 1000, g)) for k in range(f, g, 1000)))
            for s, part in sums:  # a thousand rows of equal score at most
                m = times(ids[part])
                pp, nn = one[part] @ m, zero[part] @ m
                if s != score and score is not None:
                    close()
                    here_pos, here_neg = np.zeros(replicates), np.zeros(replicates)
                score, here_pos, here_neg = s, here_pos + pp, here_neg + nn
        if score is not None:
            close()
            for edge, p, n, z in [(None, pos, neg, area), *((v, p, n, np.zeros(replicates)) for v, p, n in ends)]:
                cols = [pa.array(np.arange(replicates), pa.int32()), pa.array(np.full(replicates, TaskContext.get().partitionId()), pa.int32()), pa.array([edge] * replicates, pa.float64()), *(pa.array(c) for c in (p, n, z))]
                yield pa.RecordBatch.from_arrays(cols, names=["replicate", "part", "edge", "pos", "neg", "area"])

    parts = checkpointed(d.mapInArrow(run, "replicate int, part int, edge double, pos double, neg double, area double"))
    below = lambda *keys: F.coalesce(F.sum("neg").over(Window.partitionBy("replicate", *keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # noqa: E731  a row per task
    whole = parts.filter("edge IS NULL").withColumn("area", F.col("area") + F.col("pos") * below())
    whole = whole.groupBy("replicate").agg(F.sum("area").alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ties = parts.filter("edge IS NOT NULL").withColumn("counted", F.col("pos") * (below("edge") + F.col("neg") / 2))
    ties = ties.groupBy("replicate", "edge").agg((F.sum("pos") * F.sum("neg") / 2 - F.sum("counted")).alias("t")).groupBy("replicate").agg(F.sum("t").alias("t"))
    return whole.join(ties, "replicate").filter("p > 0 AND n > 0").select("replicate", ((F.col("a") + F.col("t")) / (F.col("p") * F.col("n"))).alias("auc"))


def bootstrap_auc(df: DataFrame, y: str, x: str, id_col: str, replicates: int = 300, seed: str = "boot") -> DataFrame:
    """Percentile interval of the AUC over Poisson replicates; reruns agree and nothing is resampled on the driver."""
    a = _replicate_aucs(df, y, x, id_col, replicates, seed)
    return a.agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"), F.count("*").alias("replicates"))


def bootstrap_delta(df: DataFrame, y: str, a: str, b: str, id_col: str, replicates: int = 2000, seed: str = "boot") -> DataFrame:
    """AUC of score ``a`` less that of ``b``, its percentile interval over paired replicates and the two-sided p.

    Both scores meet the same Poisson multiplicities. These are independent between the classes and an AUC is a
    mean within each, so a class's size varies but not its share: this stands for the stratified draw too.
    """
    d = df.filter(F.col(y).isNotNull() & finite(F.col(a).cast("double")) & finite(F.col(b).cast("double")))
    d = d.select(F.col(id_col).alias("__id"), F.col(y).alias("__y"), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    whole = auc(d, "__y", "__a").select(F.col("auc").alias("u")).crossJoin(auc(d, "__y", "__b").select(F.col("auc").alias("v"))).select((F.col("u") - F.col("v")).alias("delta"))  # a row each
    r = _replicate_aucs(d, "__y", "__a", "__id", replicates, seed).join(_replicate_aucs(d, "__y", "__b", "__id", replicates, seed).withColumnRenamed("auc", "other"), "replicate")
    r = r.select((F.col("auc") - F.col("other")).alias("delta"))
    share = lambda c: F.avg(c.cast("double"))
    p = 2 * F.least(share(F.col("delta") <= 0), share(F.col("delta") >= 0))
    out = r.agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"), p.alias("p"), F.count("*").alias("replicates"))
    return whole.crossJoin(out)  # a row each


def feature_audit(df: DataFrame, features: list[str], slices: dict[str, tuple[Column, str]]) -> DataFrame:
    """Absolute AUC of every feature on every slice (a condition and a label column), in one job."""
    parts = [F.when(cond & F.col(y).isNotNull(), F.struct(F.lit(name).alias("slice"), F.col(y).cast("int").alias("y"))) for name, (cond, y) in slices.items()]
    d = df.withColumn("__s", F.explode(F.array_compact(F.array(*parts)))).select("__s.slice", "__s.y", *[F.col(f).cast("double").alias(f) for f in features])
    long = d.unpivot(["slice", "y"], features, "feature", "x")
    return safe_auc(long, "y", "x", ["feature", "slice"])


def aligned_difference(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per column, the largest and mean absolute difference of rows with equal keys."""
    j = a.select(*keys, *cols).alias("a").join(b.select(*keys, *cols).alias("b"), keys)
    long = j.select(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in cols]).unpivot([], cols, "column", "d")
    return long.groupBy("column").agg(F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"), F.count("d").alias("n"))


def fisher_distance(df: DataFrame, y: str, features: list[str]) -> float:
    """Distance of the class means under the pooled covariance, shrunk as Ledoit and Wolf propose.

    Nulls take the column's median. Rows are folded into sums of products (features squared) in one pass;
    only those sums, and the sum of fourth-order terms, come to the driver.
    """
    import numpy as np

    med = df.agg(*[F.median(f).alias(f) for f in features]).first()
    d = df.select(F.col(y).alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(float(med[f]))).alias(f) for f in features])
    means = {r["y"]: np.array([r[f] for f in features]) for r in d.groupBy("y").agg(*[F.avg(f).alias(f) for f in features]).collect()}
    c = d.select(*[(F.col(f) - F.when(F.col("y") == 1, float(means[1][i])).otherwise(float(means[0][i]))).alias(f) for i, f in enumerate(features)])
    k = len(features)
    norm = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    one = c.agg(F.count("*").alias("n"), F.avg(norm * norm).alias("q"), *[F.avg(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]).first()
    s = np.array([[one[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    mu = np.trace(s) / k
    spread = ((s - mu * np.eye(k)) ** 2).sum()
    noise = min(spread, (one["q"] - (s * s).sum()) / one["n"])
    share = noise / spread if spread > 0 else 1.0
    delta = means[1] - means[0]
    return float(np.sqrt(max(0.0, delta @ np.linalg.pinv((1 - share) * s + share * mu * np.eye(k)) @ delta)))
