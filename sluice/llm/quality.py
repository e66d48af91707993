"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _release, aside

#: At most this many labelled rows are gathered to fit the rules.
SAMPLE = 12_000
#: Columns that score adds.
MADE = ("score", "predicted")
TREES, DEPTH, LEAST, STEPS, LASSO = 40, 3, 25, 400, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """What rules look at, computed from the whole text alone; all are 0 or more and defined for empty texts (null is empty)."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    # What is counted is little of most texts, so what isn't counted goes once, before each count reads the text.
    rest = F.translate(text, "abcdefghijklmnopqrstuvwxyz \n", "")
    count = lambda s: F.length(rest) - F.length(F.translate(rest, s, ""))  # noqa: E731  (all of the characters of s)
    words = F.split(F.trim(text), r"\s+")
    lines = F.split(text, "\n")
    n_words = F.size(words)
    capital = count("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ")
    digits = count("0123456789")
    symbols = count("#$%&*@^~=+_<>{}[]\\/")
    return {
        "chars": F.length(text).cast("double"),
        "words": n_words.cast("double"),
        "word_chars": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_chars": n / F.size(lines),
        "capitals": capital / n,
        "digits": digits / n,
        "symbols": symbols / n,
        "exclamations": count("!") / n_words,
        "bars": count("|") / n_words,
        "commas": count(",") / n_words,
        "stops": count(".") / n_words,
        "repeats": F.length(F.regexp_replace(text, r"(?<!\S)(\S+)(?=\s\1(?!\S))", "")) / n,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, bound), and its weight in the log odds."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        holds = None
        for name, above, bound in self.terms:
            term = F.col(name) > bound if above else F.col(name) <= bound
            holds = term if holds is None else holds & term
        return F.when(holds, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rules:
    base: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1, over columns named as in statistics()."""
        odds = F.lit(self.base)
        for r in self.rules:
            odds = odds + r.column()
        return 1 / (1 + F.exp(-odds))


def _paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray, tried: np.ndarray, depth: int, path: tuple) -> list[tuple]:
    """The paths to every node of a regression tree for y."""
    out = [path] if path else []
    if depth == 0 or len(y) < 2 * LEAST:
        return out
    best = (1e-9, None, 0.0)
    total, mass = float((y * weight).sum()), float(weight.sum())
    for j in tried:
        order = np.argsort(x[:, j], kind="stable")
        v, w = x[order, j], weight[order]
        left, m = np.cumsum(y[order] * w)[:-1], np.cumsum(w)[:-1]
        ok = v[1:] > v[:-1]
        ok[: LEAST - 1] = False
        ok[len(ok) - LEAST + 1 :] = False
        if ok.any():
            gain = np.where(ok, left**2 / m + (total - left) ** 2 / np.maximum(mass - m, 1e-12) - total**2 / mass, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return out
    _, j, bound = best
    above = x[:, j] > bound
    for side in (False, True):
        own = above == side
        out += _paths(x[own], y[own], weight[own], tried, depth - 1, (*path, (j, side, bound)))
    return out


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 5) -> Rules:
    """Boosted shallow trees on random halves give paths; each path is a rule; a lasso logistic regression over all rules keeps few of them with a weight."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return Rules(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    # A margin model only to get varied trees: each is fitted to what those before left.
    odds = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: dict[tuple, None] = {}
    holds = lambda path: np.logical_and.reduce([(x[:, j] > b) == side for j, side, b in path])
    for _ in range(TREES):
        rest = y - 1 / (1 + np.exp(-odds))
        own = rng.random(len(y)) < 0.5
        tried = rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]
        found = _paths(x[own], rest[own], np.ones(int(own.sum())), tried, DEPTH, ())
        for path in found:
            paths[path] = None
        inner = {path[:-1] for path in found}
        for path in (p for p in found if p not in inner):
            at = holds(path)
            p = 1 / (1 + np.exp(-odds[at]))
            odds[at] += 0.3 * rest[at].sum() / max((p * (1 - p)).sum(), 1.0)
    kept = list(paths)
    if not kept:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = np.empty((len(y), len(kept)), np.float32)  # at most sample x rules
    for j, path in enumerate(kept):
        a[:, j] = holds(path)
    # Accelerated proximal gradient; the intercept is not penalised.
    step = 4.0 / (float(np.linalg.eigvalsh((a.T @ a).astype(float))[-1]) / len(y) + 1)
    w = z = np.zeros(a.shape[1])
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        rest = 1 / (1 + np.exp(-(a @ z.astype(np.float32) + c).astype(float))) - y
        new = z - step * (a.T @ rest.astype(np.float32)).astype(float) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_b = c - step * rest.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, c = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new, new_b
    rules = [Rule(tuple((names[j], side, bound) for j, side, bound in p), float(v)) for p, v in zip(kept, w, strict=True) if abs(v) > 1e-4]
    return Rules(b, tuple(rules))


def held_out(id_col: Column) -> Column:
    """Rows that never teach: crc32 of the id as text is 1 modulo 3. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Rules:
    """Rules for label (0 or 1) from the labelled rows that are not held_out.

    At most sample rows, those of the smallest hashes of the id, teach; only their statistics (some 14 numbers each) come to the driver. Where ids repeat among docs, of the rows of these ids at most sample teach, by hash and statistics, so the choice doesn't depend on the order of rows. Label, id and other columns are no inputs of the rules. Null labels and ids teach nothing; an id with several labels or texts teaches each.
    """
    taught = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("__label"))
    few = taught.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # a bounded sample, so its broadcast is bounded too
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(few), "__id")
    found = statistics(F.col("__text"))
    rows = joined.select("__id", "__label", *(c.alias(k) for k, c in found.items()))
    rows = rows.orderBy(F.xxhash64("__id"), *rows.columns).limit(sample).toPandas()
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    rules = fit_rules(list(found), rows[list(found)].to_numpy(float), rows["__label"].to_numpy(float))
    _release()
    return rules


def score(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5), in expressions only and without a shuffle. Any text has a score, null and empty ones that of an empty text. Columns of docs with these names are replaced; none may begin with two underscores."""
    docs, names = aside(docs, MADE)
    text, others = names.get(text, text), [c for c in docs.columns if c not in names.values()]
    found = statistics(F.col(text))
    # The number keeps the planner from copying each statistic into every rule, and again into filters on the score: it moves nothing that isn't deterministic. Outside of conditions, statistics share what they have in common.
    packed = docs.withColumn("__stats", F.struct(*(c.alias(k) for k, c in found.items()), F.monotonically_increasing_id().alias("row")))
    open_ = packed.select(*docs.columns, *(F.col(f"__stats.{k}").alias(f"__{k}") for k in found))
    own = Rules(rules.base, tuple(Rule(tuple((f"__{n}", a, b) for n, a, b in r.terms), r.weight) for r in rules.rules))
    scored = open_.withColumn("__score", own.score())
    return scored.select(*others, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
