"""Document quality by weak supervision, with DataFrame functions only.

A few rules look at counts of a text and each votes good (1) or bad (0), or abstains (-1).
None of them is trusted: expectation-maximisation over all documents' votes estimates how
often each rule is right about good and about bad documents, and the share of good ones. The
posterior probability that a document is good replaces a demand that all rules be met.

Counts are taken row by row. The votes are few, so documents reduce to at most 3 ** rules
different patterns with their numbers; the model is fitted on that table inside one row, and
handed back as one probability for each pattern. Nothing else is shuffled.

Words are runs of characters other than space and U+0009 to U+000D. Null and empty texts have
no words; their rules abstain, and they fail the base rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.session import settle

SPACES = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-ZÀ-ÖØ-Þ]"
# Frequent short words of English, German, French and Spanish.
FUNCTION_WORDS = ("the and of to a in is that for was it with der die das und ist von mit den "
                  "auf le la les de et un une des que est el los las y en por con del")
FUNCTION = f"(?<!\\S)(?:{FUNCTION_WORDS.replace(' ', '|')})(?![^\\s.,])"
LETTERS_ONLY = "(?<!\\S)\\p{L}++[.,]?(?!\\S)"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words in repeated windows
ROUNDS = 40
# Start of the model and weight of its prior: most documents are good, a rule seldom accuses a
# good one, and each rule sees only some faults of the bad ones.
SHARE, RIGHT_GOOD, RIGHT_BAD, WEIGHT = 0.8, 0.98, 0.3, 2.0


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and counts of the whole text. Windows of five words are compared as hashes
    first, and as text only where some hash repeats, so the counts are exact."""
    t = F.col("t")
    w = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")
                    ).select("doc_id", "t", F.array_remove(F.split(t, SPACES + "+"), "").alias("w"),
                             F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
                             .alias("lines"))
    n = F.size("w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(
        F.array().cast("array<int>"))
    w = w.withColumn("n", n).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    w = w.withColumn("starts", starts).withColumn("quick", F.transform(
        "starts", lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(WINDOW)])))
    w = w.withColumn("some", F.size(F.array_distinct("quick")) < F.size("starts"))
    w = w.withColumn("sorted", F.when(F.col("some"), F.sort_array(F.transform(
        "starts", lambda i: F.struct(F.concat_ws(" ", *[F.get("w", i + j) for j in range(WINDOW)])
                                     .alias("k"), i.alias("i"))))))
    key = lambda j: F.get("sorted", j)["k"]
    last = F.size("sorted") - 1
    twice = F.filter(F.sequence(F.lit(0), last), lambda j: (
        (j > 0) & (key(j) == key(j - 1))) | ((j < last) & (key(j) == key(j + 1))))
    w = w.withColumn("p", F.when(F.col("some"), F.sort_array(F.transform(
        twice, lambda j: F.get("sorted", j)["i"]))))
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.lit(0), lambda sum_, j: sum_ +
                       F.least(F.lit(WINDOW), F.get("p", j) - F.get("p", j - 1)))
    repeated = F.when(F.size("p") > 1, gaps + WINDOW).when(
        F.size("p") == 1, F.lit(WINDOW)).otherwise(F.lit(0))
    return w.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACES))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct_words"),
        F.regexp_count("t", F.lit(CAPITALS)).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(FUNCTION)).cast("long").alias("n_function_words"),
        F.regexp_count("t", F.lit(LETTERS_ONLY)).cast("long").alias("n_plain_words"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("t", F.lit("[.?](?=\\s|$)")).cast("long").alias("n_stops"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# (good if, bad if) over the counts; where neither holds, or the text is short, it abstains.
RULES = {
    "symbols": ("20 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    "plain words": ("10 * n_plain_words >= 9 * n_words", "n_words >= 30 AND 10 * n_plain_words < 6 * n_words"),
    "function words": ("20 * n_function_words >= n_words", "n_words >= 30 AND 50 * n_function_words < n_words"),
    "repeats": ("20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    "lines": ("n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    "capitals": ("5 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
    "shouts": ("50 * n_shouts <= n_words", "5 * n_shouts > n_words"),
    "variety": ("3 * n_distinct_words > n_words", "8 * n_distinct_words < n_words"),
    "stops": ("60 * n_stops >= n_words", "200 * n_stops < n_words"),
}


def votes() -> Column:
    """The rules' votes, in their order."""
    return F.array(*[F.expr(
        f"CASE WHEN n_words < {LEAST_WORDS} THEN -1 WHEN {good} THEN 1 WHEN {bad} THEN 0 "
        "ELSE -1 END") for good, bad in RULES.values()])


def _log_odds(vote: str, model: str) -> str:
    """Log odds of good against bad for an array of votes."""
    return f"""aggregate(sequence(0, {len(RULES) - 1}), ln({model}.share) - ln(1 - {model}.share),
      (sum_, r) -> sum_ + CASE {vote}[r]
        WHEN 1 THEN ln({model}.good[r]) - ln(1 - {model}.bad[r])
        WHEN 0 THEN ln(1 - {model}.good[r]) - ln({model}.bad[r]) ELSE 0D END)"""


def _rate(weight: str, right: int, start: float) -> str:
    """For each rule, how often its votes are right, weighted by the documents' posteriors."""
    def over(condition: str) -> str:
        return f"""aggregate(sequence(0, size(p) - 1), 0D, (acc, j) -> acc +
          CASE WHEN p[j].votes[r] {condition} THEN p[j].n * {weight} ELSE 0D END)"""

    return f"""transform(sequence(0, {len(RULES) - 1}), r ->
      ({WEIGHT * start}D + {over(f'= {right}')}) / ({WEIGHT}D + {over('>= 0')}))"""


def fitted(patterns: DataFrame) -> DataFrame:
    """votes and quality (posterior probability of good) for each pattern of votes.

    ``patterns`` has votes and n, at most 3 ** rules rows, and becomes one row here. Each fold
    is a round of expectation-maximisation.
    """
    step = f"""aggregate(sequence(1, {ROUNDS}),
      named_struct('share', {SHARE}D, 'good', array_repeat({RIGHT_GOOD}D, {len(RULES)}),
                   'bad', array_repeat({RIGHT_BAD}D, {len(RULES)})),
      (m, round) -> element_at(transform(
        array(transform(p, x -> 1D / (1D + exp(-({_log_odds('x.votes', 'm')}))))),
        q -> named_struct(
          'share', ({WEIGHT * SHARE}D + aggregate(sequence(0, size(p) - 1), 0D,
                    (acc, j) -> acc + p[j].n * q[j]))
                   / ({WEIGHT}D + aggregate(p, 0D, (acc, x) -> acc + x.n)),
          'good', {_rate('q[j]', 1, RIGHT_GOOD)}, 'bad', {_rate('(1D - q[j])', 0, RIGHT_BAD)})), 1))"""
    return (patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
            .where(F.size("p") > 0).select("p", F.expr(step).alias("m"))
            .select("m", F.inline("p"))
            .select("votes", F.expr(f"1D / (1D + exp(-({_log_odds('votes', 'm')})))")
                    .alias("quality")))


def judged(docs: DataFrame, least: float = 0.5, id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior) and kept: not failed at the base,
    and a posterior of at least ``least``. A row for each input row."""
    rows = settle(counts(docs, id, text).withColumn("votes", votes()), "counts")
    # At most 3 ** rules rows, whatever the input, so the broadcast is bounded.
    model = settle(fitted(rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))), "model")
    return rows.join(F.broadcast(model), "votes").withColumn("base_failed", base_failed()).select(
        *[c for c in rows.columns if c != "votes"], "base_failed", "quality",
        (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"))
