"""Quality by rules that vote or abstain, native.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).  A text is good or bad in one of
a few ways.  How often each rule says bad of each of these kinds is learnt without labels by expectation maximisation,
over all texts: these are first counted by their votes, so a round works on at most 3 to the power of the number of
rules rows, however many texts there are.  A text's posterior probability of being good takes the place of passing all rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: White space between words, and the symbols that count, fixed by the operator's contract.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
BREAK, SOLID = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: A line's end that closes a sentence.
CLOSED = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}][\"')\x{201D}\x{00BB}]*[\x20\x09-\x0D]*$"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed", "n_letters", "n_upper", "n_shouts"]

_WORDS, _LINES, _LETTERS = "nullif(n_words, 0)", "nullif(n_lines, 0)", "nullif(n_letters, 0)"


def _rule(bad: str, good: str) -> str:
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


#: Rules as SQL over the counts; an unknown share abstains.
RULES = {
    "length": _rule("n_words < 50 OR n_words > 100000", "n_words >= 100"),
    "word_length": _rule(f"word_chars < 3 * n_words OR word_chars > 12 * n_words", "2 * word_chars >= 7 * n_words AND word_chars <= 9 * n_words AND n_words > 0"),
    "symbols": _rule("10 * n_symbols > n_words", "50 * n_symbols <= n_words AND n_words > 0"),
    "lines_again": _rule("10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 2", "n_dup_lines = 0 AND n_lines > 1"),
    "words_again": _rule("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words AND n_words > 0"),
    "letters": _rule("100 * n_letters < 75 * word_chars", "100 * n_letters >= 90 * word_chars AND word_chars > 0"),
    "capitals": _rule("100 * n_upper > 30 * n_letters", "100 * n_upper <= 12 * n_letters AND n_letters > 0"),
    "sentences": _rule("100 * n_closed < 10 * n_lines AND n_lines > 2", "100 * n_closed >= 60 * n_lines AND n_lines > 0"),
    "shouts": _rule("10 * n_shouts > n_words", "50 * n_shouts <= n_words AND n_words > 0"),
}
#: A text may be bad in several ways, each of which its own rules see best.
WAYS = {"noise": ("symbols", "letters", "word_length"), "loud": ("capitals", "shouts"), "again": ("lines_again", "words_again"), "shape": ("length", "sentences")}
#: Shares of bad votes to start from: of good texts, of bad ones by the rules of their way and by the others.
BAD_OF_GOOD, BAD_OF_WAY, BAD_OF_OTHERS = 0.03, 0.7, 0.1
#: The share of each way to start from; for how many votes or texts these starts stand; rounds of expectation maximisation.
SHARE_OF_WAY, EARLIER, ROUNDS = 0.05, 20.0, 30
#: A text whose posterior is at least this stays.
LEAST = 0.5
#: The floor that no learnt rule passes.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _repeated(words: Column, n: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more."""
    window = lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i"))
    same = lambda x, y: (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)

    def places(windows: Column) -> Column:
        # in order, equal windows stand together
        again = F.filter(windows, lambda x, k: ((k > 0) & same(x, windows[F.greatest(k - 1, F.lit(0))])) | ((k < n - 3) & same(x, windows[F.least(k + 1, n - 3)])))
        return F.sort_array(F.transform(again, lambda x: x.i))

    covered = lambda at: F.aggregate(
        F.transform(at, lambda x, k: F.when(k == F.size(at) - 1, F.lit(3)).otherwise(F.least(F.lit(3), at[F.least(k + 1, F.size(at) - 1)] - x))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))
    return F.when(n >= 4, _let(_let(windows, places), covered)).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """A struct of ``COUNTS`` (long) of a text; null is as empty.  Exact on texts of any length: nothing is cut off."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BREAK))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SOLID))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w, F.size(w)).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(F.filter(x, lambda y: y.rlike(CLOSED))).cast("long").alias("n_closed")))
    whole = {"n_symbols": without(SYMBOLS), "n_letters": without(r"\p{L}+"), "n_upper": without(r"\p{Lu}+"), "n_shouts": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))}
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.struct(*(v.cast("long").alias(k) for k, v in whole.items())).alias("t"))


def counted(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """(identifier, COUNTS): a row for each row, stored, for the counts are used twice and are much less than the texts.

    Repeated rows and null identifiers stay rows of their own; other columns are left out, so none can clash.
    """
    rows = stored(docs.select(F.col(identifier), counts(F.col(text)).alias("counts")), "counts")
    flat = rows.select(identifier, "counts.w.*", "counts.l.*", "counts.t.*")
    return flat.select(identifier, *COUNTS)


@dataclass(frozen=True)
class Model:
    """The shares of good texts and of those bad in each way; of each of these and each rule, the share of bad votes."""

    shares: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]

    def accuracies(self) -> dict[str, tuple[float, dict[str, float]]]:
        """Of each rule, how often its votes are right on good texts and on those bad in each way."""
        return {r: (1 - self.bad[0][j], {way: self.bad[1 + k][j] for k, way in enumerate(WAYS)}) for j, r in enumerate(RULES)}


_FIRST_SHARES = (1 - SHARE_OF_WAY * len(WAYS), *(SHARE_OF_WAY for _ in WAYS))
_FIRST_BAD = ((BAD_OF_GOOD,) * len(RULES), *(tuple(BAD_OF_WAY if r in own else BAD_OF_OTHERS for r in RULES) for own in WAYS.values()))
START = Model(_FIRST_SHARES, _FIRST_BAD)


def _likelihoods(model: Model) -> str:
    """Of each kind of text, its share times how likely it has these ``votes``: constant arrays, so that all models run one code."""
    kinds, width = len(model.shares), len(RULES)
    shares, bad = (f"array({', '.join(f'{x!r}D' for x in values)})" for values in (model.shares, [b for row in model.bad for b in row]))
    of_vote = f"CASE votes[j] WHEN -1 THEN {bad}[k * {width} + j] WHEN 1 THEN 1 - {bad}[k * {width} + j] ELSE 1D END"
    return f"transform(sequence(0, {kinds - 1}), k -> aggregate(sequence(0, {width - 1}), {shares}[k], (x, j) -> x * {of_vote})) AS likely"


#: The probability that a text with ``likely`` is good.
_POSTERIOR = "likely[0] / aggregate(likely, 0D, (total, x) -> total + x)"


def with_posterior(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of votes with ``posterior``, the probability of being good."""
    of = rows.selectExpr("*", f"array({', '.join(RULES)}) AS votes").selectExpr(*rows.columns, _likelihoods(model))
    return of.selectExpr(*rows.columns, f"{_POSTERIOR} AS posterior")


def with_votes(rows: DataFrame) -> DataFrame:
    """Rows of counts with a column for each rule's vote."""
    return rows.selectExpr("*", *(f"{sql} AS {name}" for name, sql in RULES.items()))


def learn(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """Shares of bad votes by expectation maximisation from the votes of all rows of counts; of no rows, those it starts from."""
    patterns = stored(with_votes(rows).groupBy(F.array(*RULES).alias("votes")).agg(F.count("*").alias("n")), "votes")
    kinds, width = range(len(_FIRST_SHARES)), len(RULES)
    model = START
    for _ in range(rounds):
        of = patterns.selectExpr("votes", "n", _likelihoods(model)).selectExpr("votes", "n", "aggregate(likely, 0D, (total, x) -> total + x) AS total", "posexplode(likely) AS (kind, x)").selectExpr("kind", "n * x / total AS weight", "posexplode(votes) AS (rule, vote)")
        s = {(r.kind, r.rule): r for r in of.groupBy("kind", "rule").agg(F.sum("weight").alias("texts"), F.sum(F.when(F.col("vote") == -1, F.col("weight")).otherwise(0.0)).alias("no"), F.sum(F.when(F.col("vote") != 0, F.col("weight")).otherwise(0.0)).alias("voted")).collect()}
        if not s:
            break
        texts = sum(s[k, 0].texts for k in kinds)
        shares = tuple((s[k, 0].texts + EARLIER * first) / (texts + EARLIER) for k, first in zip(kinds, _FIRST_SHARES))
        bad = tuple(tuple((s[k, j].no + EARLIER * first) / (s[k, j].voted + EARLIER) for j, first in enumerate(row)) for k, row in zip(kinds, _FIRST_BAD))
        model = Model(shares, bad)
    return model


def score(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """(identifier, COUNTS, votes, base_failed, posterior, kept) of each row of ``docs``, by a model learnt from all of them.

    ``kept`` is false below the floor ``BASE_FAILED``, else whether the posterior is ``LEAST`` or more.  Null and
    empty texts have no words and fail the floor.  Equal texts get equal rows.  An empty table gives an empty table.
    """
    rows = counted(docs, identifier, text)
    scored = with_posterior(with_votes(rows), learn(rows)).withColumn("base_failed", F.expr(BASE_FAILED))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= LEAST))


def _sql() -> str:
    """The same over whole texts in another engine: windows counted by grouping, the rounds by recursion."""
    text = "coalesce(text, '')"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    without = lambda pattern: f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"
    closed = CLOSED.replace("'", "''")
    rules = ", ".join(f"{sql} AS {name}" for name, sql in RULES.items())
    kinds = range(len(_FIRST_SHARES))
    of_votes = lambda k: " * ".join(f"CASE {r} WHEN -1 THEN b{k}_{r} WHEN 1 THEN 1 - b{k}_{r} ELSE 1e0 END" for r in RULES)
    weights = [f"(s{k} * {of_votes(k)})" for k in kinds]
    each = f"({' + '.join(weights)})"
    columns = [*(f"s{k}" for k in kinds), *(f"b{k}_{r}" for k in kinds for r in RULES)]
    start = ", ".join(f"{x}::DOUBLE" for x in [*_FIRST_SHARES, *(b for row in _FIRST_BAD for b in row)])
    share = lambda k, r, first: f"(coalesce(sum(n * q{k}) FILTER ({r} = -1), 0) + {EARLIER * first}) / (coalesce(sum(n * q{k}) FILTER ({r} <> 0), 0) + {EARLIER})"
    step = ", ".join([*(f"(sum(n * q{k}) + {EARLIER * first}) / (sum(n) + {EARLIER})" for k, first in zip(kinds, _FIRST_SHARES)), *(share(k, r, first) for k, row in zip(kinds, _FIRST_BAD) for r, first in zip(RULES, row))])
    shares = ", ".join(f"{w} / {each} AS q{k}" for k, w in enumerate(weights))
    return f"""WITH RECURSIVE docs_ AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {text} AS text FROM documents),
words_ AS MATERIALIZED (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs_) q),
windows_ AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS times FROM (SELECT k, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words_ WINDOW o AS (PARTITION BY k ORDER BY i)) q WHERE c IS NOT NULL),
repeat_ AS (SELECT k, count(*) AS n_repeat_words FROM (SELECT DISTINCT k, i + unnest([0, 1, 2]) AS place FROM windows_ WHERE times > 1) q GROUP BY k),
word_ AS (SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars FROM words_ GROUP BY k),
line_ AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '{closed}')) AS n_closed
    FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs_) q WHERE regexp_matches(line, '{SOLID}') GROUP BY k),
counts_ AS MATERIALIZED (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, {without(SYMBOLS)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_closed, 0) AS n_closed, {without('[^' + chr(92) + 'P{L}]+')} AS n_letters, {without(chr(92) + 'p{Lu}+')} AS n_upper, {without('!')} AS n_shouts
    FROM docs_ LEFT JOIN word_ USING (k) LEFT JOIN line_ USING (k) LEFT JOIN repeat_ USING (k)),
votes_ AS MATERIALIZED (SELECT *, {rules} FROM counts_),
patterns_ AS MATERIALIZED (SELECT {', '.join(RULES)}, count(*) AS n FROM votes_ GROUP BY ALL),
em_(step, {', '.join(columns)}) AS (SELECT 0, {start} UNION ALL SELECT step + 1, {step} FROM (SELECT em_.step, p.*, {shares} FROM em_, patterns_ p WHERE step < {ROUNDS}) r GROUP BY step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND {weights[0]} / {each} >= {LEAST} AS kept FROM votes_, em_ WHERE step = {ROUNDS}"""


SQL = _sql()
