"""Quality rules as weak supervision, with DataFrame functions only.

Rules measure a text and vote good, bad or abstain. How far each rule can be trusted is not set by hand: expectation
maximisation over the counts of vote patterns estimates every rule's hit rates on good and on bad texts, and a text is
kept by its posterior probability instead of by passing every rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.llm.common import let, stored, words_of

GOOD, BAD, ABSTAIN = 1, 0, -1
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent short words of the four languages, by which running text is known.
FUNCTION_WORDS = "the of and to a in is that for it with as was on be by this are der die und in den von zu das mit sich des auf ist im dem nicht ein eine de la le et les des en un du une que est pour qui dans a el los las se del por con una su para es al"

#: Words below which a text fails whatever the rules say, and the share of repeated words above which it does.
MIN_WORDS, MAX_REPEAT = 50, 0.5


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text. Windows are compared by a 64-bit hash."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) >= 3, let(F.sort_array(windows), lambda s: let(repeated(s), covered))).otherwise(0)


def _from_words(words: Column) -> Column:
    common = F.array(*[F.lit(w) for w in dict.fromkeys(FUNCTION_WORDS.split())])
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        _repeat_words(words).cast("bigint").alias("n_repeat_words"),
        F.size(F.array_intersect(words, common)).cast("bigint").alias("n_function_words"),
    )


def _from_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", ":"))).cast("bigint").alias("n_closed_lines"),
    )


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: its `keep` columns (all by default) in the struct `doc`, and what the rules look at.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (of them, equal to an
    earlier line), n_repeat_words, n_function_words (different ones), n_closed_lines, n_upper, n_letters, n_symbol_runs, n_bare (words of
    neither letters nor digits). The whole text is read.
    A null text measures like an empty one (all 0). Columns of the same names are safe inside `doc`.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    upper = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))
    bare = F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"))
    return docs.select(
        F.struct(*[F.col(c) for c in (docs.columns if keep is None else keep)]).alias("doc"),
        F.length(F.translate(t, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        upper.cast("bigint").alias("n_upper"),
        letters.cast("bigint").alias("n_letters"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]+")).cast("bigint").alias("n_symbol_runs"),
        bare.cast("bigint").alias("n_bare"),
        let(words_of(t), _from_words).alias("w"),
        let(lines, _from_lines).alias("l"),
    ).select("doc", "word_chars", "n_symbols", "n_upper", "n_letters", "n_symbol_runs", "n_bare", "w.*", "l.*")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The rules over the columns of `measure`: name and vote."""
    n = F.col("n_words")
    chars, symbols = _share(F.col("word_chars"), n), _share(F.col("n_symbols"), n)
    marked, bare, letters = _share(F.col("n_symbol_runs"), n), _share(F.col("n_bare"), n), _share(F.col("n_letters"), F.col("word_chars"))
    repeat, dup = _share(F.col("n_repeat_words"), n), _share(F.col("n_dup_lines"), F.col("n_lines"))
    upper, closed = _share(F.col("n_upper"), F.col("word_chars")), _share(F.col("n_closed_lines"), F.col("n_lines"))
    return {
        "word_length": _vote((chars < 2.5) | (chars > 12), chars.between(3, 9)),
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "marked_words": _vote(marked > 0.1, marked < 0.02),
        "letters": _vote(letters < 0.75, letters > 0.9),
        "bare_words": _vote(bare > 0.1, bare < 0.02),
        "repeats": _vote(repeat > 0.3, repeat < 0.15),
        "dup_lines": _vote(dup > 0.3, dup < 0.1),
        "upper": _vote(upper > 0.3, upper < 0.15),
        "function_words": _vote(F.col("n_function_words") < 1, F.col("n_function_words") >= 3),
        "closed_lines": _vote(closed < 0.1, closed > 0.5),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MAX_REPEAT))


@dataclass
class VoteModel:
    """prior: share of good texts. on_good, on_bad: a rule's chance to vote GOOD (of its votes) on a good, a bad text."""

    prior: float = 0.8
    on_good: dict[str, float] = field(default_factory=dict)
    on_bad: dict[str, float] = field(default_factory=dict)

    def posterior(self) -> Column:
        """The probability that a text is good, from the vote columns `v_<rule>`; abstaining says nothing."""
        log_odds = F.log(F.lit(self.prior / (1 - self.prior)))
        for r in self.on_good:
            v, a, b = F.col(f"v_{r}"), self.on_good[r], self.on_bad[r]
            log_odds = log_odds + F.when(v == GOOD, F.log(F.lit(a / b))).when(v == BAD, F.log(F.lit((1 - a) / (1 - b)))).otherwise(0.0)
        return 1 / (1 + F.exp(-log_odds))


def fit(votes: DataFrame, names: list[str], steps: int = 30, tolerance: float = 1e-4) -> VoteModel:
    """Expectation maximisation over all rows. They are first counted by vote pattern, at most 3 to the number of rules
    rows, so a step costs the same at every size of the input. Rates stay on the better side of chance (a rule may not
    turn into its opposite) and are smoothed by one vote. An empty table gives the start values."""
    columns = [f"v_{r}" for r in names]
    counts = stored(votes.groupBy(*columns).agg(F.count("*").alias("n")).coalesce(1), "votes")
    model = VoteModel(0.8, dict.fromkeys(names, 0.85), dict.fromkeys(names, 0.25))
    for _ in range(steps):
        weighed = counts.withColumn("p", model.posterior())
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(good).alias("good"), F.sum("n").alias("all")]
        for r in names:
            for side, w in (("g", good), ("b", bad)):
                sums.append(F.sum(F.when(F.col(f"v_{r}") == GOOD, w).otherwise(0.0)).alias(f"{side}_{r}"))
                sums.append(F.sum(F.when(F.col(f"v_{r}") != ABSTAIN, w).otherwise(0.0)).alias(f"{side}n_{r}"))
        row = weighed.agg(*sums).first()
        if not row["all"]:
            return model
        clamp = lambda x, low, high: min(max(x, low), high)
        new = VoteModel(
            clamp(row["good"] / row["all"], 0.05, 0.95),
            {r: clamp((row[f"g_{r}"] + 1) / (row[f"gn_{r}"] + 2), 0.55, 0.995) for r in names},
            {r: clamp((row[f"b_{r}"] + 1) / (row[f"bn_{r}"] + 2), 0.005, 0.45) for r in names},
        )
        moved = max(abs(x - y) for r in names for x, y in ((new.on_good[r], model.on_good[r]), (new.on_bad[r], model.on_bad[r])))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """`measure` with base_failed, posterior and kept (not base_failed, and a posterior of `least` or more) per document.

    The measures are stored once; fitting and scoring read them from there. Every row gets a verdict; equal texts get equal
    ones; empty and null texts have fewer than MIN_WORDS words and are not kept; an empty table gives no rows.
    """
    named = rules()
    measured = stored(measure(docs, text, keep), "measures", "zstd")  # with `keep` None it holds all texts, and lies there while later stages of a pipeline run
    votes = measured.withColumns({f"v_{r}": v for r, v in named.items()})
    model = fit(votes.where(~base_failed()), list(named))  # of what is still to be judged
    return (
        votes.withColumn("posterior", model.posterior())
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
    )
