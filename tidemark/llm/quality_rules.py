"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation finds how far to trust each.

DataFrame functions only. One pass over the texts makes the counts and the votes; the distinct patterns of votes
(3 to the number of rules at most) with their numbers of documents are all that expectation-maximisation needs, so it runs on a
table of a few hundred rows. A rule that votes is right with one accuracy on good documents and another on poor ones, independently of the
others given the true quality; abstaining says nothing. The accuracies and the share of good
documents are what the votes of all documents say; limits only keep logarithms finite and "good" the side a rule's good votes are on.
The posterior probability of being good replaces "all rules must pass".

Repeats of 5-word windows are found by the windows' XXH64, in one sort per text.

Defined cases: a NULL or empty text has no words, all counts 0 and fails the base rules; every rule abstains on it;
repeated rows each give a row; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

WINDOW = 5
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]+"
#: (name, good when, bad when); otherwise the rule abstains. SQL over the columns of `counts`.
RULES = [
    ("symbols", "100 * n_symbols <= word_chars", "100 * n_symbols > 5 * word_chars"),
    ("marks", "50 * n_marks <= n_words", "20 * n_marks > n_words"),
    ("lines", "n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "n_words >= 30 AND 100 * n_repeat_words <= 2 * n_words", "100 * n_repeat_words > 15 * n_words"),
    ("capitals", "10 * n_capitals <= word_chars", "10 * n_capitals > 4 * word_chars"),
    ("length", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("stops", "n_stops >= 1 AND 40 * n_stops >= n_words", "n_words >= 60 AND n_stops = 0"),
]
ROUNDS = 20
#: First guesses, and limits: accuracy on good documents, on poor ones, share of good.
GUESS = {"good": (0.95, 0.5, 0.9999), "poor": (0.3, 0.0001, 0.9999), "share": (0.8, 0.01, 0.99)}


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks (runs of
    symbols), n_capitals, n_stops of every row."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    parted = docs.select("doc_id", text.alias("t"), words.alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    more = parted.select(
        "doc_id", "w", lines.alias("lines"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.length(F.regexp_replace("t", SYMBOLS, "#")) - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_marks"),
        without(r"[A-Z]+").cast("long").alias("n_capitals"),
        without(r"[.!?](?=[\x20\x09-\x0D]|$)").cast("long").alias("n_stops"),
        F.when(F.size("w") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])
        )).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    repeated = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(covered(F.col("h")))
    return more.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_marks", "n_capitals", "n_stops",
    )


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covered(windows: Column) -> Column:
    """Words that lie in a window whose hash is there twice or more."""
    numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def among(s: Column) -> Column:
        twin = lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(twin(e, i), F.lit(False))), lambda e: e["at"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, at: F.struct((a["n"] + F.least(F.lit(WINDOW), at - a["last"])).alias("n"), at.alias("last"))
    return F.aggregate(bound(numbered, among), start, step, lambda a: a["n"])


def votes(counted: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """`counted` with a column vote_<rule> for each rule: 1 good, -1 bad, 0 abstains."""
    said = {f"vote_{name}": F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)
            for name, good, bad in rules}
    return counted.withColumns(said)


def weight(vote: int, good: float, poor: float) -> float:
    """What a vote adds to the log odds of being good."""
    return math.log(good / (1 - poor)) if vote > 0 else math.log((1 - good) / poor) if vote < 0 else 0.0


def estimated(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS):
    """(share of good documents, accuracies on good, accuracies on poor) from the patterns of votes and their numbers.

    Every estimate starts with two documents' worth of its first guess.
    """
    share, good, poor = GUESS["share"][0], [GUESS["good"][0]] * n_rules, [GUESS["poor"][0]] * n_rules
    held = lambda value, kind: min(max(value, GUESS[kind][1]), GUESS[kind][2])
    for _ in range(rounds):
        total, of_good = 2.0, 2 * GUESS["share"][0]
        sums = [[2 * GUESS["good"][0], 2.0, 2 * GUESS["poor"][0], 2.0] for _ in range(n_rules)]
        for vote, n in patterns:
            odds = math.log(share / (1 - share)) + sum(weight(v, g, b) for v, g, b in zip(vote, good, poor, strict=True))
            p = 1 / (1 + math.exp(-odds))
            total, of_good = total + n, of_good + n * p
            for s, v in zip(sums, vote, strict=True):
                if v:
                    s[0] += n * p * (v > 0)
                    s[1] += n * p
                    s[2] += n * (1 - p) * (v < 0)
                    s[3] += n * (1 - p)
        share = held(of_good / total, "share")
        good, poor = [held(s[0] / s[1], "good") for s in sums], [held(s[2] / s[3], "poor") for s in sums]
    return share, good, poor


def judged(docs: DataFrame, rules: list[tuple[str, str, str]] = RULES, least_probability: float = 0.5) -> DataFrame:
    """The counts, base_failed, quality_probability and kept of every row."""
    voted = staged(votes(counts(docs), rules))
    names = [f"vote_{name}" for name, _, _ in rules]
    found = voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # 3 ** rules rows at most
    share, good, poor = estimated([(tuple(r[n] for n in names), r["n"]) for r in found], len(rules))
    odds = F.lit(math.log(share / (1 - share)))
    for name, g, b in zip(names, good, poor, strict=True):
        odds = odds + F.when(F.col(name) > 0, weight(1, g, b)).when(F.col(name) < 0, weight(-1, g, b)).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    probability = F.round(1 / (1 + F.exp(-odds)), 4)
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), probability.alias("quality_probability"),
        (~failed & (probability >= least_probability)).alias("kept"),
    )


def _sql() -> str:
    """The same in the other engine's SQL: windows by their words, and one pair of tables for each round."""
    split = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    count = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    parts = [
        "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)",
        rf"""w AS (SELECT rid, doc_id, t, {split} AS w,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs)""",
        f"""wins AS (SELECT rid, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS words
            FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w))""",
        "twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, words) > 1)",
        f"""again AS (SELECT rid, sum(n) AS n FROM (SELECT rid,
            least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - {WINDOW})) AS n FROM twice) GROUP BY rid)""",
        rf"""counted AS (SELECT w.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
            {count('[#*$%&|<>]')} AS n_symbols,
            len(regexp_extract_all(t, '{SYMBOLS}')) AS n_marks, {count('[A-Z]')} AS n_capitals,
            len(regexp_extract_all(t || ' ', '[.!?][\x20\x09-\x0D]')) AS n_stops,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
            coalesce(again.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN again ON w.rid = again.rid)""",
        "voted AS (SELECT *, " + ", ".join(
            f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{i}"
            for i, (_, good, bad) in enumerate(RULES)) + " FROM counted)",
        "patterns AS (SELECT " + ", ".join(f"v{i}" for i in range(len(RULES))) + ", count(*) AS n FROM voted GROUP BY ALL)",
        f"m0 AS (SELECT {GUESS['share'][0]}::DOUBLE AS s, " + ", ".join(
            f"{GUESS['good'][0]}::DOUBLE AS a{i}, {GUESS['poor'][0]}::DOUBLE AS b{i}" for i in range(len(RULES))) + ")",
    ]
    odds = "ln(s / (1 - s)) + " + " + ".join(
        f"CASE v{i} WHEN 1 THEN ln(a{i} / (1 - b{i})) WHEN -1 THEN ln((1 - a{i}) / b{i}) ELSE 0 END" for i in range(len(RULES)))

    def share(above: str, below: str, kind: str) -> str:
        guess, least, most = GUESS[kind]
        value = f"({2 * guess} + coalesce(sum({above}), 0)) / (2.0 + coalesce(sum({below}), 0))"
        return f"least(greatest({value}, {least}), {most})::DOUBLE"

    for k in range(ROUNDS):
        parts.append(f"e{k} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns p, m{k})")
        fresh = ", ".join(
            f"{share(f'n * p * (v{i} > 0)::INT', f'n * p * abs(v{i})', 'good')} AS a{i}, "
            f"{share(f'n * (1 - p) * (v{i} < 0)::INT', f'n * (1 - p) * abs(v{i})', 'poor')} AS b{i}" for i in range(len(RULES)))
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT {share('n * p', 'n', 'share')} AS s, {fresh} FROM e{k})")
    parts.append(f"""scored AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        round(1 / (1 + exp(-({odds}))), 4) AS quality_probability FROM voted, m{ROUNDS})""")
    return "WITH " + ",\n".join(parts) + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_probability,
            NOT base_failed AND quality_probability >= 0.5 AS kept FROM scored"""


SQL = _sql()
