"""Quality by weak supervision, in DataFrame functions only.

Rules over a text's figures vote bad (0), good (1) or abstain. Votes are counted per pattern, a table of at most
3 ** rules rows whatever the corpus; on it expectation-maximisation fits the share of good documents and each rule's
accuracy. A document stays if its posterior probability of being good reaches ``keep_at``.

Abstentions are counted when outcomes are estimated (a rule's votes are weighed by how often it casts them on either kind
of document), but are no evidence themselves: the E-step and the verdict use the same posterior, over cast votes only.
With abstentions as evidence, documents on which every rule abstains would all be rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialise


_SPACE = " \t\n\x0b\x0c\r"
_BREAK = "[ \\t\\n\\x0b\\f\\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows' hashes carry their place in the low 31 bits (no array is longer) and are sorted, so equal ones are
    neighbours; a second sort of the few candidates compares all 64 bits.
    """
    n = F.size(words)
    hashes = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    one = F.array(hashes)

    def among(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, 31), 31) + i.cast("long")))
        top = lambda x: F.shiftright(x, 31)
        near = F.array(tagged)
        likely = F.flatten(F.transform(near, lambda t: F.filter(t, lambda x, i: (top(x) == top(F.get(t, i - 1))) | (top(x) == top(F.get(t, i + 1))))))
        places = F.transform(likely, lambda x: (x - F.shiftleft(F.shiftright(x, 31), 31)).cast("int"))
        pairs = F.array(F.array_sort(F.transform(places, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))))
        found = F.flatten(F.transform(pairs, lambda p: F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]))))
        starts = F.array(F.sort_array(F.transform(found, lambda x: x["i"])))
        return F.element_at(F.transform(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)), 1)

    # the one-element array binds the hashes once, so that no lambda computes them again
    return F.element_at(F.transform(one, among), 1).cast("long")


def figures(docs: DataFrame, text_col: str = "text", also: list[Column] | None = None) -> DataFrame:
    """``also`` columns plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars_all``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    held = docs.select(*(also or []), text.alias("__qf_text"), _words(text).alias("__qf_words"), lines.alias("__qf_lines"))
    words = F.col("__qf_words")
    return held.select(
        *[F.col(f"`{c}`") for c in held.columns if not c.startswith("__qf_")],
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("__qf_text") - F.length(F.translate("__qf_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__qf_lines") - F.size(F.array_distinct("__qf_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _clean() -> Column:
    return (F.col("n_words") >= 80) & (20 * F.col("n_symbols") <= F.col("n_words")) & (100 * F.col("n_dup_lines") <= F.col("n_words")) & (5 * F.col("n_repeat_words") <= F.col("n_words")) & (F.col("word_chars") >= 3 * F.col("n_words")) & (F.col("word_chars") <= 10 * F.col("n_words"))


#: Rule name -> vote from the figures: 0 is bad, 1 is good, null abstains.
RULES = {
    "short": lambda: F.when(F.col("n_words") < 50, 0),
    "word_length": lambda: F.when((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words")), 0),
    "symbols": lambda: F.when(10 * F.col("n_symbols") > 3 * F.col("n_words"), 0),
    "repeated_lines": lambda: F.when(24 * F.col("n_dup_lines") > F.col("n_words"), 0),
    "repeated_words": lambda: F.when(100 * F.col("n_repeat_words") > 40 * F.col("n_words"), 0),
    "clean_prose": lambda: F.when(_clean(), 1),
}
#: Prior pseudo-documents of a rule's outcomes (votes bad, votes good, abstains) on good and on bad documents.
PRIOR = ((0.4, 6.0, 13.6), (8.0, 0.4, 11.6))


def fit(patterns: list[tuple[tuple, int]], *, rounds: int = 200) -> tuple[float, list[tuple]]:
    """Share of good documents, and each rule's outcome probabilities on good and on bad ones, by
    expectation-maximisation over vote patterns and their counts. A rule's accuracy is how far the two differ.
    """
    m = len(patterns[0][0]) if patterns else 0
    start = tuple(tuple(x / sum(c) for x in c) for c in PRIOR)
    share, model = 0.9, [start] * m
    for _ in range(rounds):
        good_n, all_n = 9.0, 10.0
        tally = [[list(c) for c in PRIOR] for _ in range(m)]
        for votes, n in patterns:
            p = posterior(votes, share, model)
            good_n += n * p
            all_n += n
            for t, v in zip(tally, votes, strict=True):
                at = 2 if v is None else v
                t[0][at] += n * p
                t[1][at] += n * (1 - p)
        share = min(max(good_n / all_n, 0.01), 0.99)
        model = [tuple(tuple(x / sum(c) for x in c) for c in t) for t in tally]
    return share, model


def _weight(outcomes: tuple, vote: int) -> float:
    return math.log(outcomes[0][vote] / outcomes[1][vote])


def posterior(votes: tuple, share: float, model: list[tuple]) -> float:
    """Probability of being good; rules that abstain say nothing."""
    odds = math.log(share / (1 - share)) + sum(_weight(o, v) for v, o in zip(votes, model, strict=True) if v is not None)
    return 1 / (1 + math.exp(-odds))


def _posterior_column(share: float, model: list[tuple], votes: list[Column]) -> Column:
    odds = F.lit(math.log(share / (1 - share)))
    for v, o in zip(votes, model, strict=True):
        odds = odds + F.when(v == 1, _weight(o, 1)).when(v == 0, _weight(o, 0)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _fitted(measured: DataFrame, rules: dict) -> tuple[float, list[tuple]]:
    votes = [rule().alias(f"v{i}") for i, rule in enumerate(rules.values())]
    rows = measured.select(*votes).groupBy(*[f"v{i}" for i in range(len(rules))]).count().collect()  # at most 3 ** rules
    return fit(sorted(((tuple(r[:-1]), r[-1]) for r in rows), key=str) or [((None,) * len(rules), 0)])


def score(docs: DataFrame, *, keep_at: float = 0.5, rules: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, the figures, ``base_failed``, ``kept`` and ``p_good``.

    Figures are measured once and written to the shared folder; the fit and the verdicts read them. Defined cases: a
    null text has no words and fails the base; with no documents the fit is its prior and no rows come out; repeated rows
    and null ids are judged row by row.
    """
    rules = rules or RULES
    measured = materialise(figures(docs, text_col, [F.col(f"`{id_col}`")]), "figures")
    share, model = _fitted(measured, rules)
    p = _posterior_column(share, model, [rule() for rule in rules.values()])
    return measured.withColumn("base_failed", base_failed()).withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))


def keep_good(docs: DataFrame, *, keep_at: float = 0.5, rules: dict | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; rows are written with their figures, so that they need no
    key and nothing is measured twice. Defined cases are those of ``score``: rows with a null or empty text go, repeated
    rows and null ids are judged row by row, an empty table stays empty, and columns of any name pass unchanged."""
    rules = rules or RULES
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    measured = materialise(figures(packed, "text", [F.col("row")]), "measured")
    share, model = _fitted(measured, rules)
    p = _posterior_column(share, model, [rule() for rule in rules.values()])
    return measured.where(~base_failed() & (p >= keep_at)).select("row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
