"""Quality rules: a decision list learned by sequential covering, emitted as an ordered Spark conditional expression.

Main path: DataFrame functions only.  Statistics of a text are array expressions in its own row, so no text is shuffled.
Learning works on the binned statistics of a bounded sample of labelled rows (``max_labelled``, the smallest hashes of the
id): each step grows a rule by the threshold with the best gain over grouped counts of (statistic, bin) until none gains,
prunes it on the third of the sample kept apart, and takes the rows it covers out.  Learning ends where fewer than ``least``
rejected texts are left or the best rule is less precise than ``precision``; neither rules nor terms are capped.  The driver
only ever sees (statistics x bins) counts.

Defined results: a null text has no words; repeated rows are judged each; contradicting labels count by their mean; without
labels of both kinds the list is empty and keeps what the base keeps; ties between thresholds fall to the statistic's and
then the bin's order; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

MAX_LABELLED, BINS = 20_000, 24
#: The statistics the rules may speak of, as SQL over the base measures.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "dup_lines": "double(n_dup_lines)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "short_share": "n_short / greatest(n_words, 1)",
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the base measures of every row.

    A window of 8 words stands as the hash of its words' hashes.  Only where a text's windows are not all different are
    they sorted, which puts equal ones side by side; the words they cover are counted in one pass over their positions.
    """
    text = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"))
    words = text.select("doc_id", "_t", F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')").alias("_w"), F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_l"))
    hashed = words.select("*", F.expr("transform(_w, x -> xxhash64(x))").alias("_h"))
    window = ", ".join(f"get(_h, i + {k})" for k in range(8))
    windows = hashed.select("*", F.expr(f"if(size(_h) < 8, array(), transform(sequence(0, size(_h) - 8), i -> xxhash64({window})))").alias("_v"))
    paired = windows.select("*", F.expr("if(size(array_distinct(_v)) = size(_v), NULL, sort_array(transform(_v, (x, i) -> struct(x AS h, i AS i))))").alias("_s"))
    again = paired.select("*", F.expr("sort_array(transform(filter(_s, (e, k) -> (k > 0 AND get(_s, k - 1).h = e.h) OR get(_s, k + 1).h <=> e.h), e -> e.i))").alias("_p"))
    found = F.struct(
        F.expr("bigint(size(_w))").alias("n_words"),
        F.expr("aggregate(_w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.expr("bigint(regexp_count(_t, '[#*$%&|<>]'))").alias("n_symbols"),
        F.expr("bigint(size(_l) - size(array_distinct(_l)))").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(_p, struct(-8 AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least(8, p - a.last) AS n), a -> a.n), 0L)").alias("n_repeat_words"),
        F.expr("bigint(regexp_count(_t, '!'))").alias("n_bangs"),
        F.expr("bigint(regexp_count(_t, '[A-Z]'))").alias("n_upper"),
        F.expr("bigint(size(filter(_w, x -> length(x) <= 3)))").alias("n_short"),
    )
    # one row of one struct: a generator, so that a filter on a measure is not pushed below and its arrays written out again
    return again.select("doc_id", F.inline(F.array(found)))


def _binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    bins = []
    for f, value in FEATURES.items():
        steps = [F.when(F.expr(value) > e, 1).otherwise(0) for e in edges[f]]  # a bin is the number of edges below the value
        bins.append(sum(steps, F.lit(0)).alias(f))
    return rows.select("_y", "_apart", *bins)


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    if bad == 0:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, precision: float = 0.9, least: int = 5) -> list[list[tuple[str, str, float]]]:
    """Ordered rules; each is a conjunction of (statistic, '<=' or '>', threshold) under which a text is rejected."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("_y"))
    sample = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # at most max_labelled rows of 12 bytes
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample.select("doc_id"), "doc_id", "left_semi")
    rows = shared_table(measures(own).join(sample, "doc_id").withColumn("_apart", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0))
    cuts = rows.agg(*[F.percentile_approx(F.expr(FEATURES[f]), [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    left = shared_table(_binned(rows, edges).groupBy("_y", "_apart", *FEATURES).agg(F.count("*").alias("_n")))
    rules: list[list[tuple[str, str, float]]] = []
    while True:
        rule: list[tuple[str, str, float]] = []
        inside = left.where("NOT _apart")
        while True:
            long = inside.selectExpr("_y", "_n", f"stack({len(FEATURES)}, {', '.join(f'''{k}, {f}''' for k, f in enumerate(FEATURES))}) AS (f, b)")
            table = {(r["f"], r["b"]): (r["bad"], r["good"]) for r in long.groupBy("f", "b").agg(F.sum(F.expr("if(_y = 0, _n, 0)")).alias("bad"), F.sum(F.expr("if(_y = 1, _n, 0)")).alias("good")).collect()}
            bad0, good0 = (sum(v[k] for (f, _), v in table.items() if f == 0) for k in (0, 1))
            if bad0 < least or good0 == 0:
                break
            options = []
            for k, f in enumerate(FEATURES):
                bad = good = 0
                for b, edge in enumerate(edges[f]):  # bin b holds the values up to edge b
                    bad, good = bad + table.get((k, b), (0, 0))[0], good + table.get((k, b), (0, 0))[1]
                    options += [(_gain(bad, good, bad0, good0), -k, -b, f, "<=", edge), (_gain(bad0 - bad, good0 - good, bad0, good0), -k, -b, f, ">", edge)]
            best = max(options, default=(0.0,))
            if best[0] <= 1e-9:
                break
            rule.append(best[3:])
            inside = inside.where(_on_bins(rule[-1:], edges))
        if rule:  # prune: the number of first terms that the part kept apart likes best
            apart = left.where("_apart")
            sums = [F.sum(F.when(_on_bins(rule[:n], edges), x)) for n in range(1, len(rule) + 1) for x in (F.expr("if(_y = 0, _n, 0)"), F.col("_n"))]
            row = apart.agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).first()
            shorter = list(zip(row[::2], row[1::2], strict=True))
            worth = [((2 * (r[0] or 0) - (r[1] or 0)) / r[1] if r[1] else -1.0) for r in shorter]
            n = worth.index(max(worth)) + 1
            bad, every = shorter[n - 1][0] or 0, shorter[n - 1][1] or 0
            rule = rule[:n] if every and bad / every >= precision else []
        if not rule:
            break
        rules.append(rule)
        left = left.where(~_on_bins(rule, edges))
    return rules


def _on_bins(rule: list[tuple[str, str, float]], edges: dict[str, list[float]]) -> Column:
    out = F.lit(True)
    for f, sign, edge in rule:
        b = edges[f].index(edge)
        out = out & ((F.col(f) <= b) if sign == "<=" else (F.col(f) > b))
    return out


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """CASE WHEN first rule THEN false WHEN second rule THEN false ... ELSE true END over the base measures."""
    out = None
    for rule in rules:
        condition = F.lit(True)
        for f, sign, edge in rule:
            condition = condition & (F.expr(FEATURES[f]) <= edge if sign == "<=" else F.expr(FEATURES[f]) > edge)
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(learn(docs, labels))).alias("kept")
    )
