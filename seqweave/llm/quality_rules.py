"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each task measures whole texts and turns the measures into votes. A vote pattern
is one number below 3^rules, so the corpus is summed up by a histogram of fixed
size; expectation-maximisation over it estimates, for each rule, how often it
votes good, bad or not at all on good and on bad texts. The posterior of a
text's pattern replaces the demand that all rules pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import slices, words_of
from seqweave.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
NOT_STARTS = WHITE + bytes(range(0x80, 0xC0))
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines",
            "n_upper", "n_lower", "n_digits", "n_shouts")

#: Rules as (name, SQL of a bad vote, SQL of a good vote); neither: the rule abstains. Measures are whole numbers.
RULES = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "2 * word_chars < 5 * n_words or word_chars > 15 * n_words",
     "word_chars between 3 * n_words and 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 2 and n_dup_lines = 0"),
    ("repeats", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= n_words"),
    ("upper_case", "10 * n_upper > 3 * (n_upper + n_lower)", "20 * n_upper <= 3 * (n_upper + n_lower)"),
    ("line_ends", "10 * n_closed_lines < n_lines", "2 * n_closed_lines >= n_lines"),
    ("shouts", "10 * n_shouts > n_words", "100 * n_shouts <= n_words"),
)

#: Rounds of expectation-maximisation; votes that each rule is given beforehand, right and wrong ones.
ROUNDS, RIGHT, WRONG = 50, 8.0, 2.0


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand more than once in the text."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pairs = w[:-1] * len(ids) + w[1:]
    if len(ids) >= 1 << 20:  # so that the next product stays below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, times = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    inside = np.zeros(len(w), bool)
    for j in range(3):
        inside[j : j + len(again)] |= again
    return int(inside.sum())


def measured(text: bytes | None) -> tuple[int, ...]:
    """The measures of one text in UTF-8; null is an empty text."""
    text = text or b""
    words = words_of(text)
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]

    def count(characters):
        return len(text) - len(text.translate(None, characters))

    return (
        len(words), len(text.translate(None, NOT_STARTS)), count(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), sum(line.rstrip(WHITE)[-1:] in b".!?\"" for line in lines),
        count(UPPER), count(LOWER), count(DIGITS), count(b"!"),
    )


def measures(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the measures of every row's text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def work(batches):
        for batch in slices(batches, "_text"):
            rows = np.array([measured(t) for t in batch.column("_text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c) for c in rows.T)],
                                             names=[*keys, *MEASURES])

    form = ", ".join([kinds, *(f"{m} bigint" for m in MEASURES)])
    return docs.select(*keys, F.col("text").cast("binary").alias("_text")).mapInArrow(work, form)


def pattern_sql(rules=RULES) -> str:
    """SQL of a row's vote pattern: base-3 digits, first rule lowest; 0 abstains, 1 is bad, 2 is good."""
    votes = [f"(case when {bad} then 1 when {good} then 2 else 0 end) * {3**k}" for k, (_, bad, good) in enumerate(rules)]
    return " + ".join(votes)


def estimate(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability of good for each pattern, after ``rounds`` rounds that begin from the majority of votes."""
    votes = patterns[:, None] // 3 ** np.arange(rules) % 3
    score = (votes == 2).sum(1) - (votes == 1).sum(1)
    good = 1 / (1 + np.exp(-score.astype(float)))
    prior = np.array([[0.0, WRONG, RIGHT], [0.0, RIGHT, WRONG]]) + [1.0, 0.0, 0.0]
    for _ in range(rounds):
        logs = []
        for k, weight in enumerate((counts * good, counts * (1 - good))):
            total = np.log((weight.sum() + 1) / (counts.sum() + 2))
            for r in range(rules):
                seen = np.bincount(votes[:, r], weight, 3) + prior[k]
                total = total + np.log(seen / seen.sum())[votes[:, r]]
            logs.append(total)
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))
    return good


def judge(docs: DataFrame, rules=RULES, rounds: int = ROUNDS, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. quality is the posterior of the
    document's votes; kept needs ``least`` of it and no base failure. Null and empty texts have no words and fail.
    Repeated rows give repeated results; other columns are not read.
    """
    rows = cut_lineage(measures(docs, "doc_id").withColumn("pattern", F.expr(pattern_sql(rules)).cast("int")))
    seen = rows.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3^rules rows
    patterns, counts = (np.array([r[i] for r in seen], np.int64) for i in (0, 1))
    quality = [float(q) for q in estimate(patterns, counts.astype(float), len(rules), rounds)]
    table = docs.sparkSession.createDataFrame(list(zip(patterns.tolist(), quality, strict=True)), "pattern int, quality double")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return rows.join(F.broadcast(table), "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= least)).alias("kept"), F.round("quality", 6).alias("quality"),
    )


def judge_sql(rules=RULES, rounds: int = ROUNDS, least: float = 0.5) -> str:
    """The same as one DuckDB statement over ``documents``, its rounds written out."""
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"

    def count(characters):
        return f"length(text) - length(regexp_replace(text, '{characters}', '', 'g'))"

    parts = [
        "t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)",
        f"""w AS MATERIALIZED (SELECT rid, unnest(l) AS w, generate_subscripts(l, 1) AS i
            FROM (SELECT rid, regexp_extract_all(text, '{word}') AS l FROM t))""",
        """g AS (SELECT rid, i, w, lead(w, 1) OVER o AS x, lead(w, 2) OVER o AS y FROM w WINDOW o AS (PARTITION BY rid ORDER BY i))""",
        """h AS (SELECT rid, i, w, y IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, x, y) > 1 AS again FROM g)""",
        """k AS (SELECT rid, w, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS inside
            FROM h WINDOW o AS (PARTITION BY rid ORDER BY i))""",
        """a AS MATERIALIZED (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
            count(*) FILTER (inside) AS n_repeat_words FROM k GROUP BY rid)""",
        f"""l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)""",
        f"""b AS MATERIALIZED (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines,
            count(*) FILTER (regexp_matches(line, '[.!?"]{space}*$')) AS n_closed_lines
            FROM l WHERE regexp_matches(line, '{word}') GROUP BY rid)""",
        f"""m AS MATERIALIZED (SELECT rid, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
            {count('[#*$%&|<>]')} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
            coalesce(n_closed_lines, 0) AS n_closed_lines, {count('[A-Z]')} AS n_upper, {count('[a-z]')} AS n_lower,
            {count('[0-9]')} AS n_digits, {count('!')} AS n_shouts FROM t LEFT JOIN a USING (rid) LEFT JOIN b USING (rid))""",
        f"v AS MATERIALIZED (SELECT *, {pattern_sql(rules)} AS pattern FROM m)",
        "c AS MATERIALIZED (SELECT pattern, count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS total FROM v GROUP BY pattern)",
        f"""d AS MATERIALIZED (SELECT pattern, r, pattern // (3 ** r)::BIGINT % 3 AS vote FROM c, range(0, {len(rules)}) x(r))""",
        """p0 AS MATERIALIZED (SELECT pattern, 1 / (1 + exp(-sum(CASE vote WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END)::DOUBLE)) AS good
            FROM d GROUP BY pattern)""",
    ]
    prior = f"CASE vote WHEN 0 THEN 1 WHEN %d THEN {RIGHT} ELSE {WRONG} END"
    whole = 1 + RIGHT + WRONG
    for k in range(1, rounds + 1):
        parts.append(f"""s{k} AS MATERIALIZED (SELECT r, vote, ln((sum(c * good) + {prior % 2}) / (any_value(wg) + {whole})) AS lg,
            ln((sum(c * (1 - good)) + {prior % 1}) / (any_value(wb) + {whole})) AS lb,
            ln((any_value(wg) + 1) / (any_value(total) + 2)) AS tg, ln((any_value(wb) + 1) / (any_value(total) + 2)) AS tb
            FROM d JOIN c USING (pattern) JOIN p{k - 1} USING (pattern),
            (SELECT sum(c * good) AS wg, sum(c * (1 - good)) AS wb FROM c JOIN p{k - 1} USING (pattern)) GROUP BY r, vote)""")
        parts.append(f"""p{k} AS MATERIALIZED (SELECT pattern, 1 / (1 + exp(least(greatest(
            any_value(tb) + sum(lb) - any_value(tg) - sum(lg), -700), 700))) AS good FROM d JOIN s{k} USING (r, vote) GROUP BY pattern)""")
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return f"""WITH {', '.join(parts)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        {failed} AS base_failed, NOT {failed} AND good >= {least} AS kept, round(good, 6) AS quality
        FROM v JOIN p{rounds} USING (pattern)"""
