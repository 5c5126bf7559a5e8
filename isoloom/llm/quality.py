"""Document quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

Every rule reads a few counts of a text and votes good (1), bad (-1) or nothing (0). Filtering by
"all must pass" lets the worst rule decide. Here each rule has an accuracy of its own for good and
for bad documents: how often it votes what, given which. Expectation-maximisation estimates these
and the share of good documents from the votes alone, and a document is kept when the posterior
probability that it is good reaches one half.

All of it is DataFrame and SQL code. Documents are summed up by vote pattern first, so the
estimation runs over at most 3 ** len(RULES) rows whatever the size of the corpus, in one row's
higher-order expression; the pattern table, of the same bound, is joined back by broadcast. The
starting accuracies count as PRIOR_COUNT documents, so that a rule nobody voted on has a value;
`accuracies` tells what the votes made of them.

Repeated windows of words are found by a 64-bit hash of each window within its document.

Defined results: a null text has no words and counts as empty; such documents fail the base rules
(fewer than 20 words) and are not kept; a null doc_id is kept as it is; repeated rows are judged
each on its own; texts of any length are read whole; an empty table gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.runtime import written

WINDOW = 8
ITERATIONS = 25
#: The weight of the starting accuracies, in documents: it fades as the corpus grows.
PRIOR_COUNT = 10.0

#: Common words of English, German, French and Spanish. Fixed values.
COMMON_WORDS = "the of and to in is that for with was on are it be as at by this from or der die und das von zu den mit sich des auf für ist im dem nicht ein eine le la les de et un une du que est dans qui par pour au sur pas avec el los en y las del se por con para su al lo como más".split()

#: Each rule: its name, when it votes bad, when it votes good (SQL over the counts; else it abstains).
RULES = (
    ("symbols", "n_symbols > 0.10 * word_chars", "n_symbols < 0.03 * word_chars"),
    ("shouting", "n_caps > 0.30 * n_words", "n_caps < 0.10 * n_words"),
    ("exclaims", "n_exclaims > 0.20 * n_words", "n_exclaims < 0.05 * n_words"),
    ("tables", "n_bars > 0.20 * n_words", "n_bars < 0.02 * n_words"),
    ("lines", "n_dup_lines > 0.30 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    ("windows", "n_repeat_words > 0.27 * n_words", "n_repeat_words <= 0.05 * n_words"),
    ("common", "n_common < 0.04 * n_words", "n_common > 0.10 * n_words"),
    ("echoes", "n_echoes > 0.15 * n_words", "n_echoes < 0.05 * n_words"),
    ("lengths", "word_chars > 12 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
)
#: Starting probabilities of a vote (bad, none, good) by good and by bad documents, and of a good document.
START_GOOD, START_BAD, START_SHARE = (0.01, 0.09, 0.90), (0.30, 0.20, 0.50), 0.85

_SPACES = r"[ \x09-\x0D]+"


def counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the counts of each text: words, characters, symbols, lines, repeats; the columns `keep` as one, row."""
    row = [F.struct(*keep).alias("row")] if keep else []
    t = docs.select("doc_id", *row, F.coalesce("text", F.lit("")).alias("t"))
    number = lambda c: f"(octet_length(t) - octet_length(replace(t, '{c}', '')))"
    listed = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    row = ["row"] if keep else []
    split = t.select(
        "doc_id",
        *row,
        F.filter(F.split("t", _SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")).alias("lines"),
        F.expr("+".join(map(number, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        F.expr(number("!")).cast("long").alias("n_exclaims"),
        F.expr(number("|")).cast("long").alias("n_bars"),
    )
    windowed = split.withColumn("hashes", F.expr(f"IF(size(words) < {WINDOW}, array(), transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))))"))
    # Places of hashes that recur, in order; each covers up to WINDOW words, as far as the next place.
    repeats = f"""
        transform(array(array_sort(transform(hashes, (h, i) -> struct(h, i)))), s ->
        transform(array(array_sort(filter(transform(sequence(0, size(s) - 1), k ->
            IF(s[k].h <=> get(s, k - 1).h OR s[k].h <=> get(s, k + 1).h, s[k].i, -1)), x -> x >= 0))), f ->
        aggregate(sequence(0, size(f) - 1), 0, (a, k) -> a + least({WINDOW}, coalesce(get(f, k + 1) - f[k], {WINDOW}))))[0])[0]"""
    each = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_exclaims",
        "n_bars",
        F.expr("CAST(size(filter(words, w -> NOT w RLIKE '[a-z]' AND w RLIKE '[A-Z].*[A-Z]')) AS long)").alias("n_caps"),
        F.expr("CAST(size(filter(words, (w, i) -> w <=> get(words, i - 1))) AS long)").alias("n_echoes"),
        F.expr(f"CAST(size(filter(words, w -> lower(w) IN ({listed}))) AS long)").alias("n_common"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CAST(CASE WHEN size(hashes) > size(array_distinct(hashes)) THEN {repeats} ELSE 0 END AS long)").alias("n_repeat_words"),
    )
    # Through a generator, as the optimizer moves no filter over its columns below it. Below, a filter over counts
    # would hold the whole expressions in place of their names and split the text again for every window of words.
    return windowed.select("doc_id", *row, F.inline(F.array(each)))


def pattern_sql() -> str:
    """All votes as one number in base 3 (a digit is the vote + 1), the first rule's digit lowest."""
    return " + ".join(f"{3**i} * (CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END)" for i, (_, bad, good) in enumerate(RULES))


def fitted(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """One row from (pattern, n): p, the patterns, and s, the share of good documents and each rule's accuracies."""
    r = len(RULES)
    array = lambda p: "array(" + ", ".join(f"{x}D" for x in p) + ")"
    table = lambda p: f"array_repeat({array(p)}, {r})"
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("pattern", F.col("n").cast("double").alias("n"), F.expr(f"transform(sequence(0, {r - 1}), i -> int(pattern div int(pow(3, i)) % 3))").alias("v")))).alias("p"), F.lit(PRIOR_COUNT).alias("w"))
    vote = lambda start, q: f"transform(sequence(0, {r - 1}), i -> transform(sequence(0, 2), k -> (w * {array(start)}[k] + aggregate(e, 0D, (a, x) -> a + IF(x.v[i] = k, x.n * {q}, 0D))) / (w + aggregate(e, 0D, (a, x) -> a + x.n * {q}))))"
    start = f"named_struct('share', {START_SHARE}D, 'good', {table(START_GOOD)}, 'bad', {table(START_BAD)})"
    step = f"""transform(array(transform(p, x -> struct(x.v AS v, x.n AS n, {_posterior()} AS q))), e ->
        named_struct('share', (w * {START_SHARE}D + aggregate(e, 0D, (a, x) -> a + x.n * x.q)) / (w + aggregate(e, 0D, (a, x) -> a + x.n)),
        'good', {vote(START_GOOD, 'x.q')}, 'bad', {vote(START_BAD, '(1D - x.q)')}))[0]"""
    return row.select("p", F.expr(f"aggregate(sequence(1, {iterations}), {start}, (s, j) -> {step})").alias("s")) if iterations else row.select("p", F.expr(start).alias("s"))


def _posterior() -> str:
    return f"1D / (1D + exp(-(ln(s.share / (1D - s.share)) + aggregate(sequence(0, {len(RULES) - 1}), 0D, (a, i) -> a + ln(s.good[i][x.v[i]] / s.bad[i][x.v[i]])))))"


def estimated(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(pattern, posterior) from (pattern, n): the probability that a document of these votes is good."""
    return fitted(patterns, iterations).select(F.expr(f"explode(transform(p, x -> struct(x.pattern AS pattern, {_posterior()} AS posterior))) AS e")).select("e.*")


def accuracies(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(rule, vote, good, bad): how often good and bad documents get each vote (-1, 0, 1) of each rule, as estimated."""
    names = "array(" + ", ".join(f"'{name}'" for name, _, _ in RULES) + ")"
    each = F.expr(f"explode(flatten(transform(s.good, (g, i) -> transform(g, (x, k) -> struct({names}[i] AS rule, k - 1 AS vote, x AS good, s.bad[i][k] AS bad))))) AS e")
    return fitted(patterns, iterations).select(each).select("e.*")


def judged(docs: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts, base_failed, the votes' pattern, posterior, kept: one row per document, with the columns `keep` as row.

    Counts are written once. Rows that carry whole texts are not: they are counted a second time instead.
    """
    pattern = F.expr(f"CAST({pattern_sql()} AS int)").alias("pattern")
    voted = counts(docs, keep).select("*", pattern)
    voted = voted if keep else written(voted, "votes")
    patterns = counts(docs).select(pattern) if keep else voted
    posterior = estimated(patterns.groupBy("pattern").agg(F.count("*").alias("n")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = voted.join(F.broadcast(posterior), "pattern").withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def oracle_sql(iterations: int = ITERATIONS) -> str:
    """The same in DuckDB: words and windows as rows, the estimation as a chain of common table expressions."""
    listed = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    number = lambda c: f"(strlen(t) - strlen(replace(t, '{c}', '')))"
    leads = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, WINDOW))])
    start = lambda name, p: f"CASE k WHEN 0 THEN {p[0]} WHEN 1 THEN {p[1]} ELSE {p[2]} END::DOUBLE AS {name}"
    steps = []
    for j in range(iterations + 1):
        steps.append(f"""q{j} AS MATERIALIZED (SELECT v.pattern, any_value(v.n) AS n, 1 / (1 + exp(-(any_value(ln(s.share / (1 - s.share))) + sum(ln(p.good / p.bad))))) AS q
            FROM votes v JOIN p{j} p USING (r, k) CROSS JOIN s{j} s GROUP BY v.pattern)""")
        if j < iterations:
            steps.append(f"""s{j + 1} AS MATERIALIZED (SELECT (any_value(w.w) * {START_SHARE} + sum(q.n * q.q)) / (any_value(w.w) + sum(q.n)) AS share FROM q{j} q CROSS JOIN w)""")
            steps.append(f"""p{j + 1} AS MATERIALIZED (SELECT p0.r, p0.k, (w.w * p0.good + coalesce(f.good, 0)) / (w.w + a.good) AS good, (w.w * p0.bad + coalesce(f.bad, 0)) / (w.w + a.bad) AS bad
            FROM p0 CROSS JOIN w CROSS JOIN (SELECT sum(n * q) AS good, sum(n * (1 - q)) AS bad FROM q{j}) a
            LEFT JOIN (SELECT r, k, sum(q.n * q.q) AS good, sum(q.n * (1 - q.q)) AS bad FROM votes v JOIN q{j} q USING (pattern) GROUP BY r, k) f USING (r, k))""")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS id FROM documents),
    words AS (SELECT id, w, generate_subscripts AS pos FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS generate_subscripts FROM (SELECT id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d))),
    wins AS (SELECT id, pos, CASE WHEN lead(w, {WINDOW - 1}) OVER o IS NOT NULL THEN {leads} END AS win FROM words WINDOW o AS (PARTITION BY id ORDER BY pos)),
    rep AS (SELECT id, pos FROM (SELECT id, pos, count(*) OVER (PARTITION BY id, win) AS n FROM wins WHERE win IS NOT NULL) WHERE n > 1),
    cov AS (SELECT id, count(DISTINCT pos + i) AS n FROM rep, range({WINDOW}) g(i) GROUP BY id),
    per AS (SELECT id, count(*) AS n_words, count(*) FILTER (w = before) AS n_echoes, sum(length(w)) AS word_chars, count(*) FILTER (NOT regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z].*[A-Z]')) AS n_caps, count(*) FILTER (lower(w) IN ({listed})) AS n_common FROM (SELECT *, lag(w) OVER (PARTITION BY id ORDER BY pos) AS before FROM words) GROUP BY id),
    lns AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY id),
    counts AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, {'+'.join(map(number, '#*$%&|<>'))} AS n_symbols, {number('!')} AS n_exclaims, {number('|')} AS n_bars,
        coalesce(n_caps, 0) AS n_caps, coalesce(n_common, 0) AS n_common, coalesce(n_echoes, 0) AS n_echoes, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
        FROM d LEFT JOIN per USING (id) LEFT JOIN lns USING (id) LEFT JOIN cov USING (id)),
    voted AS MATERIALIZED (SELECT *, {pattern_sql()} AS pattern FROM counts),
    pat AS MATERIALIZED (SELECT pattern, count(*) AS n FROM voted GROUP BY pattern),
    votes AS MATERIALIZED (SELECT pattern, n, r, (pattern // (3 ** r)::INT) % 3 AS k FROM pat, range({len(RULES)}) g(r)),
    w AS MATERIALIZED (SELECT {PRIOR_COUNT}::DOUBLE AS w),
    s0 AS (SELECT {START_SHARE}::DOUBLE AS share),
    p0 AS MATERIALIZED (SELECT r, k, {start('good', START_GOOD)}, {start('bad', START_BAD)} FROM range({len(RULES)}) g(r), range(3) h(k)),
    {', '.join(steps)}
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
        (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND q.q >= 0.5 AS kept
    FROM voted JOIN q{iterations} q USING (pattern)"""
