"""Mixing sources to target weights, with soft membership of documents in domains.

Only DataFrame operations are used. A naive Bayes classifier, learned from the table's own domain labels by one grouped
count, predicts each document's posterior over the domains from its words, language, length, lines, word length and from its
label, which is trusted with probability ``trust`` (an unlabelled document goes by the other features alone). The words speak
through ``markers``: words that occur in some domains' texts more than in others', chosen by their chi-square on a bounded
``sample`` of labelled texts; which markers a whole text contains gives log odds of the domains, and the domain they favour,
and whether clearly, is one feature, whose reliability the grouped count over all documents measures.

Documents with equal features have equal posteriors, so they share a rate; cells of equal features are summed map-side. A
text is read twice: for the cells, and for the document's own cell when rates are handed back.

The rates x >= 0 minimise the weighted squares of (expected tokens of a domain - target tokens), the weights being the
domains' present shares. Each step of projected gradient descent sums the residuals over the cells (one number a domain
comes to the driver) and moves x by the posterior-weighted residuals, never below zero. In this metric the largest
eigenvalue is 1, so a step length of 1 is safe whatever the data. Targets that are not met after the last step (or cannot be,
as no documents of such posteriors exist) are reported by a warning with the largest gap.

A document's rate is how often it should be drawn for the mix; ``copies`` rounds it by a hash of its id, so that the copies
add up to the rates in expectation. All documents are returned, also those with rate 0.

Sizes: domains are at most ``max_domains`` (more raise an error), cells at most 64 languages x 41 lengths x 8 line counts x 8
word lengths x 2 domains x (domains + 1); the rates are broadcast only when there are at most ``broadcast_cells`` cells, else joined.

Defined results: a null text counts as empty and has no tokens; null labels and labels outside the targets are
unlabelled; targets for labels that no row has are left out, and the others share their weight; without targets, or without tokens or labels, every rate is 1; repeated rows are mixed one by one; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .components import stored

FEATURES = ("own", "lang", "size", "lines", "wide", "says")


def token_count(text: Column) -> Column:
    """White-space separated words of a text; none for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def log_bin(n: Column, most: int = 40) -> Column:
    return F.least(F.lit(most), F.floor(F.log2(n + 1)).cast("int"))


def label_number(label: Column, domains: list[str]) -> Column:
    own = F.lit(-1)
    for k, name in enumerate(domains):
        own = F.when(label == name, k).otherwise(own)
    return own.cast("int")


def fit_markers(df: DataFrame, domains: list[str], domain_col: str, text_col: str, markers: int = 24, sample: int = 4000, longest: int = 1 << 16) -> tuple[list[str], list[float], list[list[float]]]:
    """Marker words, and the log odds of the domains: for a text without any, and what each marker that it contains adds.

    Learned from at most ``sample`` labelled texts of at most ``longest`` bytes, the first by hash.
    """
    k = len(domains)
    rows = df.select(label_number(F.col(domain_col), domains).alias("own"), F.col(text_col).alias("text")).where("own >= 0")
    some = stored(hashed_sample(rows, ["text", "own"], sample, F.expr(f"octet_length(text) between 1 and {longest}")))  # a bounded sample
    docs = {r["own"]: r["count"] for r in some.groupBy("own").count().collect()}  # at most a row for each domain
    n = sum(docs.values())
    if len(docs) < 2:
        return [], [0.0] * k, []
    share = F.element_at(F.expr("map(" + ", ".join(f"{d}, {c / n!r}D" for d, c in docs.items()) + ")"), F.col("own"))
    words = some.select("own", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where("length(word) between 3 and 24").groupBy("word", "own").count()
    by_word = words.groupBy("word").agg(F.sum("count").alias("df"), F.sum(F.col("count") * F.col("count") / share).alias("x"))
    best = by_word.where(f"df >= 5 and df <= {0.9 * n!r}").withColumn("gain", F.col("x") / F.col("df") - F.col("df")).orderBy(F.desc("gain"), "word").limit(markers)
    chosen = [r["word"] for r in best.collect()]
    if not chosen:
        return [], [0.0] * k, []
    held = some.groupBy("own").agg(*(F.sum(F.contains("text", F.lit(w)).cast("int")).alias(f"m{i}") for i, w in enumerate(chosen))).collect()
    p = [[0.5] * k for _ in chosen]
    for r in held:
        for i in range(len(chosen)):
            p[i][r["own"]] = (r[f"m{i}"] + 0.5) / (docs[r["own"]] + 1.0)
    none = [sum(math.log(1 - p[i][d]) for i in range(len(chosen))) for d in range(k)]
    return chosen, none, [[math.log(p[i][d]) - math.log(1 - p[i][d]) for d in range(k)] for i in range(len(chosen))]


def said_domain(text: Column, fitted: tuple[list[str], list[float], list[list[float]]] | None) -> Column:
    """Twice the domain that the markers in the text favour, and one more if they do so clearly; -1 without markers."""
    if not fitted or not fitted[0]:
        return F.lit(-1)
    chosen, none, odds = fitted
    numbers = lambda row: "array(" + ", ".join(f"{v!r}D" for v in row) + ")"
    table, start = F.expr("array(" + ", ".join(map(numbers, odds)) + ")"), F.expr(numbers(none))
    here = F.filter(F.array(*(F.when(F.contains(text, F.lit(w)), i) for i, w in enumerate(chosen))), lambda i: i.isNotNull())
    total = F.aggregate(here, start, lambda a, i: F.zip_with(a, F.get(table, i), lambda x, y: x + y))

    def judged(s: Column) -> Column:
        best = F.array_max(s)
        clear = F.coalesce(best - F.get(F.sort_array(s, False), F.lit(1)), F.lit(0.0)) >= 1
        return (2 * (F.array_position(s, best) - 1) + clear.cast("int")).cast("int")

    return F.get(F.transform(F.array(total), judged), F.lit(0))  # the sums are made once


def with_cell(df: DataFrame, domains: list[str], domain_col: str, text_col: str, lang_col: str, fitted: tuple[list[str], list[float], list[list[float]]] | None = None) -> DataFrame:
    """``df`` with ``mix``: the number of tokens and the features of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = F.struct(token_count(text).alias("tokens"), F.length(text).alias("chars"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).alias("breaks"))
    lang = F.pmod(F.xxhash64(F.coalesce(F.col(lang_col).cast("string"), F.lit(""))), F.lit(64)).cast("int")

    def features(x: Column) -> Column:
        t = x["tokens"]
        return F.struct(
            t.alias("tokens"), label_number(F.col(domain_col), domains).alias("own"), lang.alias("lang"), log_bin(t).alias("size"), log_bin(x["breaks"], 7).alias("lines"),
            F.greatest(F.lit(0), F.least(F.lit(7), F.when(t > 0, x["chars"] / t).otherwise(0).cast("int") - 2)).alias("wide"), said_domain(text, fitted).alias("says"),
        )

    return df.withColumn("mix", F.get(F.transform(F.array(read), features), F.lit(0)))  # each text is counted once


def domain_names(df: DataFrame, domain_col: str, max_domains: int) -> list[str]:
    rows = df.select(F.col(f"`{domain_col}`").cast("string").alias("d")).where("d is not null").distinct().limit(max_domains + 1).collect()
    if len(rows) > max_domains:
        raise ValueError(f"more than {max_domains} domains; give targets for those to mix")
    return sorted(r["d"] for r in rows)


def flattened(tokens: dict[str, float], power: float) -> dict[str, float]:
    flat = {d: float(n) ** power for d, n in sorted(tokens.items()) if n}
    return {d: v / sum(flat.values()) for d, v in flat.items()}


def source_targets(df: DataFrame, domain_col: str = "source", text_col: str = "text", power: float = 0.5, max_domains: int = 256) -> dict[str, float]:
    """Targets that flatten the present mix: a domain's share of all tokens to the power ``power``."""
    names = domain_names(df, domain_col, max_domains)
    rows = df.groupBy(F.col(f"`{domain_col}`").cast("string").alias("d")).agg(F.sum(token_count(F.col(f"`{text_col}`"))).alias("n")).where(F.col("d").isin(names)).collect()
    return flattened({r["d"]: r["n"] for r in rows}, power)


def posteriors(cells: DataFrame, k: int, trust: float) -> DataFrame:
    """``cells`` (features, docs, tokens) with ``post``: the probabilities of the domains."""
    seen = cells.where("own >= 0")
    kinds = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("own") == d, F.col("docs"))), F.lit(0)).cast("double") for d in range(k)))
    total = seen.groupBy().agg(kinds(None).alias("total"))
    out = cells.crossJoin(F.broadcast(total))  # one row
    score = F.transform("total", lambda n: F.log(n + 1))
    out = out.withColumn("score", score)
    for f in FEATURES[1:]:
        by = seen.groupBy(f).agg(kinds(f).alias("n"))
        out = out.join(by, f, "left").withColumn("score", F.when(F.col("n").isNull(), F.col("score")).otherwise(F.zip_with("score", F.zip_with("n", "total", lambda n, t: F.log((n + 0.5) / (t + 32))), lambda a, b: a + b))).drop("n")
    known = F.transform("score", lambda s, i: s + F.when(F.col("own") < 0, 0.0).otherwise(F.when(F.col("own") == i, float(_log(trust))).otherwise(float(_log((1 - trust) / max(k - 1, 1))))))
    out = out.withColumn("score", known).withColumn("score", F.transform("score", lambda s: F.exp(s - F.array_max("score"))))
    whole = F.aggregate("score", F.lit(0.0), lambda a, s: a + s)
    return out.withColumn("whole", whole).withColumn("post", F.transform("score", lambda s: s / F.col("whole"))).select(*FEATURES, "docs", "tokens", "post")


def _log(x: float) -> float:
    return math.log(max(x, 1e-12))


def rate_after(steps: list[list[float]]) -> Column:
    """The rate of a cell after gradient steps with the given scaled residuals, from 1, projected to x >= 0."""
    x = F.lit(1.0)
    if not steps:
        return x
    dot = lambda r: F.aggregate(F.zip_with("post", r, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.array(*(F.array(*map(F.lit, r)) for r in steps)), x, lambda x, r: F.greatest(F.lit(0.0), x - dot(r)))


def fit_rates(cells: DataFrame, weights: list[float], steps: int = 60, tolerance: float = 1e-6, missed: float = 0.01) -> DataFrame:
    """``cells`` with ``rate``; a gap of more than ``missed`` after the last step is reported."""
    k = len(weights)
    share = lambda x: [F.sum(F.col("tokens") * x * F.col("post")[i]).alias(f"s{i}") for i in range(k)]
    first = cells.agg(*share(F.lit(1.0))).first()
    total = sum(v or 0.0 for v in first)
    if not total:
        return cells.withColumn("rate", F.lit(1.0))
    pi = [max(v / total, 1e-9) for v in first]
    moves: list[list[float]] = []
    for _ in range(steps):
        now = first if not moves else cells.agg(*share(rate_after(moves))).first()
        gap = [v / total - w for v, w in zip(now, weights)]
        if max(map(abs, gap)) < tolerance:
            break
        moves.append([g / p for g, p in zip(gap, pi)])
    else:
        left = max(abs(v / total - w) for v, w in zip(cells.agg(*share(rate_after(moves))).first(), weights))
        if left > missed:
            warnings.warn(f"after {steps} steps a domain's share of tokens is {left:.4f} off its target", stacklevel=2)
    return cells.withColumn("rate", rate_after(moves))


def mix(df: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", domain_col: str = "source", text_col: str = "text", lang_col: str = "lang", trust: float = 0.95, max_domains: int = 256, broadcast_cells: int = 200_000, power: float = 0.5) -> DataFrame:
    """``row`` (all columns of ``df``) and ``mix`` (tokens, rate and copies), for each row of ``df``.

    Without ``targets``, those are the domains' present shares of tokens to the power ``power``.
    """
    if targets is not None and len(targets) > max_domains:
        raise ValueError(f"{len(targets)} domains; at most {max_domains} can be mixed")
    label = F.col(f"`{domain_col}`").cast("string")
    if targets is None:
        names = domain_names(df, domain_col, max_domains)
    else:
        names = sorted(r["d"] for r in df.select(label.alias("d")).where(F.col("d").isin(list(targets))).distinct().collect()) if targets else []  # at most max_domains
    columns = [F.col(f"`{c}`") for c in df.columns]
    wanted = df.select(F.struct(*columns).alias("row"), *(F.col(f"`{c}`").alias(a) for c, a in ((id_col, "id"), (text_col, "text"), (lang_col, "language"))), label.alias("domain"))
    fitted = fit_markers(wanted, names, "domain", "text") if names else None
    marked = with_cell(wanted, names, "domain", "text", "language", fitted)
    keys = [F.col(f"mix.{f}").alias(f) for f in FEATURES]
    cells = stored(marked.select(*keys, F.col("mix.tokens").alias("tokens")).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))
    if targets is None:
        by_own = {r["own"]: r["n"] for r in cells.where("own >= 0").groupBy("own").agg(F.sum("tokens").alias("n")).collect()}  # at most max_domains
        targets = flattened({names[k]: n for k, n in by_own.items()}, power)
    weights = [targets.get(n, 0.0) for n in names]
    if names and sum(weights) > 0 and not cells.where("own >= 0").isEmpty():
        rates = stored(fit_rates(stored(posteriors(cells, len(names), trust)), [w / sum(weights) for w in weights]))
    else:
        rates = cells.withColumn("rate", F.lit(1.0))
    rates = rates.select(F.struct(*FEATURES).alias("cell"), "rate")
    if cells.count() <= broadcast_cells:
        rates = F.broadcast(rates)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    left = marked.select("row", F.struct(*keys).alias("cell"), F.col("mix.tokens").alias("tokens"), draw.alias("draw"))
    x = F.coalesce("rate", F.lit(1.0))
    return left.join(rates, "cell", "left").select("row", F.struct("tokens", x.alias("rate"), (F.floor(x) + (F.col("draw") < x - F.floor(x)).cast("int")).cast("int").alias("copies")).alias("mix"))
