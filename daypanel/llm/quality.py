"""Quality rules: a table of thresholds compiled into Spark projections, without user functions.

Every measure comes from the words ``[^\\x20\\x09-\\x0D]+`` of the whole text. Repeated three-word windows are found by sorting
the window hashes of one text inside its row, so nothing is shuffled and a hot source or a long text concerns one row only.

Defined cases: NULL or empty text has zero in every measure and fails the base rules; other columns are left out of the result;
repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import SEPARATORS, bind, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an at not "
    "le la les de des du et un une en que qui dans pour sur par est au avec ce "
    "der die das und den dem ein eine von zu mit auf für ist im nicht sich des als auch "
    "el los las y del que en un una por con para es se al lo como su"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= measure <= high``; ``measure`` is SQL over the columns of :func:`measure`."""

    name: str
    measure: str
    low: float
    high: float

    def compiled(self) -> Column:
        value = F.expr(self.measure)
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))


#: Every ratio is per word; texts without words never get here, they fail the base rules.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols / n_words", 0.0, 0.1),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.02, 1.0),
    Rule("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", 0.0, 0.3),
)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """One row per row of ``df``: the id, ``n_words`` and the counts that the rules use.

    ``n_repeat_words`` counts each word once that lies in a ``window``-word window found twice or more in the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stops = [F.lit(s) for s in dict.fromkeys(STOP_WORDS)]

    def repeated(w: Column) -> Column:
        """Words of ``w`` that lie in a window found twice or more."""
        place = lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(window)]).alias("h"), i.alias("i"))
        grams = F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(0), F.size(w) - window), place))
        return F.when(F.size(w) >= window, bind(F.sort_array(grams), covered)).otherwise(F.lit(0).cast("long"))

    def covered(g: Column) -> Column:
        same = lambda x, j: x["h"] == F.get(g, j)["h"]  # noqa: E731  NULL past the ends, which selects nothing
        twice = F.filter(g, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"].cast("long"),
        )

    of_words = bind(
        words(F.col(text_col).cast("string")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stops))).cast("long").alias("stops"),
            repeated(w).alias("repeated"),
        ),
    )
    of_lines = bind(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]")),
        lambda lines: F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dups")),
    )
    measured = bind(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"),
            F.length(F.regexp_replace(text, SEPARATORS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            m["l"]["n"].alias("n_lines"),
            m["l"]["dups"].alias("n_dup_lines"),
            m["w"]["repeated"].alias("n_repeat_words"),
            m["w"]["stops"].alias("n_stop_words"),
        ),
    )
    # A filter on the result isn't pushed through a generator, so every text is measured once.
    return df.select(F.col(id_col).alias("id"), F.inline(F.array(measured))).withColumnRenamed("id", id_col)


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed`` and ``kept``; a rule whose ratio is undefined fails."""
    passed = F.lit(True)
    for rule in rules:
        passed = passed & F.coalesce(rule.compiled(), F.lit(False))
    kept = F.when(base_failed(), F.lit(False)).otherwise(passed)
    return measured.withColumns({"base_failed": base_failed(), "kept": kept})


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return apply_rules(measure(df, id_col, text_col), rules)


_STOPS = ", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
grams AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER s || ' ' || lead(word, 2) OVER s AS g FROM words
          WINDOW s AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n, sum(length(word)) AS chars,
                  count(*) FILTER (WHERE lower(word) IN ({_STOPS})) AS stops FROM words GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dups FROM
            (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT doc_id, coalesce(counts.n, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(dups, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(stops, 0)::BIGINT AS n_stop_words
      FROM d LEFT JOIN counts USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, CASE WHEN base_failed THEN false ELSE {
    " AND ".join(f"coalesce(({r.measure.replace('/', '::DOUBLE /')}) BETWEEN {r.low} AND {r.high}, false)" for r in RULES)
} END AS kept FROM b"""
