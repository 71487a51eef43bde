"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is cut into the longest phrases
that occur in that sample, one automaton step for each character; the number of phrases times the bits to point into the sample,
per character, is the cross entropy, and the language with the least wins. Whole texts are parsed, the likeliest language (by the first
``HEAD`` characters) first; a language whose phrases already cost more than the best whole text so far cannot win and stops there.

The sample is all that is sent to tasks, where a worker builds the automata once. Documented bounds of the classifier: for each
language ``SAMPLE_ROWS`` distinct texts and ``SAMPLE_CHARS`` characters, shared evenly by the texts and taken from ``PIECES`` places spread over
each, and ``TOTAL_CHARS`` characters for all languages, so each of very many languages gets a smaller sample. The driver holds a row a language.

Defined cases: NULL text, empty text or text without a letter is ``und`` with score 0; languages that are NULL teach nothing; with no
teaching rows, as in an empty table, everything is ``und``; equal entropies go to the smaller code; ids may repeat or be NULL; other columns are
left out; an empty table gives an empty result. A text is held whole in one task, with memory in proportion to its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.llm.common import slices, texts_of

SAMPLE_ROWS = 150
SAMPLE_CHARS = 60_000
TOTAL_CHARS = 12_000_000
PIECES = 4
#: Characters that order the languages; characters parsed between two looks at the cost.
HEAD = 256
STRIDE = 512
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-case letters; whatever stands between letters is one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


class SuffixAutomaton:
    """All substrings of ``text``. A state is the dictionary from a character to the next state."""

    def __init__(self, text: str):
        self.bits = math.log2(len(text) + 1)
        self.root: dict = {}
        after, length, link = [self.root], [0], [-1]
        last = 0
        for ch in text:
            new = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and ch not in after[at]:
                after[at][ch] = new
                at = link[at]
            if at >= 0:
                old = after[at][ch]
                if length[old] == length[at] + 1:
                    link[new] = old
                else:
                    twin = len(after)
                    after.append(dict(after[old]))
                    length.append(length[at] + 1)
                    link.append(link[old])
                    while at >= 0 and after[at].get(ch) == old:
                        after[at][ch] = twin
                        at = link[at]
                    link[old] = link[new] = twin
            last = new
        for state in after:  # numbers to the states themselves: a step is then one lookup
            for ch, number in state.items():
                state[ch] = after[number]

    def phrases(self, text: str, most: float = math.inf) -> tuple[int, int]:
        """Number of phrases when each is the longest match, or one unseen character, and the characters read.

        Reading stops once the number exceeds ``most``.
        """
        root, n = self.root, 0
        state = root
        for start in range(0, len(text), STRIDE):
            for ch in text[start : start + STRIDE]:
                following = state.get(ch)
                if following is None:
                    n += state is not root
                    following = root.get(ch)
                    if following is None:
                        n += 1
                        following = root
                state = following
            if n > most:
                return n, min(start + STRIDE, len(text))
        return n + (state is not root), len(text)


@lru_cache(maxsize=2)
def _automata(sample: tuple[tuple[str, str], ...]) -> list[tuple[str, SuffixAutomaton]]:
    return [(lang, SuffixAutomaton(text)) for lang, text in sample]


def classify(text: str, automata: list[tuple[str, SuffixAutomaton]]) -> tuple[str, float]:
    """The language and a score: how much of the two least costs a character belongs to the runner-up, 0.5 to 1 (1 if it has no rival).

    The cost of a language that stopped early is that of the characters it read.
    """
    letters = normalise(text)
    if not automata or not letters or not _LETTER.search(letters):
        return UNKNOWN, 0.0
    likely = sorted((a.phrases(letters[:HEAD])[0] * a.bits, lang, a) for lang, a in automata)
    best, name, rates = math.inf, "", []
    for _, lang, a in likely:
        n, read = a.phrases(letters, best / a.bits)
        cost = n * a.bits
        rates.append(cost / read)
        if read == len(letters) and (cost, lang) < (best, name):
            best, name = cost, lang
    if len(rates) == 1:
        return name, 1.0
    least, runner_up = sorted(rates)[:2]
    return name, runner_up / (least + runner_up) if least + runner_up else 0.5


def _spread(text: Column, chars: int, pieces: int = PIECES) -> Column:
    """About ``chars`` characters from ``pieces`` places spread evenly over a text; a shorter one stays whole."""
    size, gap = chars // pieces, (F.length(text) - chars // pieces) / max(1, pieces - 1)
    parts = [F.substring(text, (F.floor(gap * i) + 1).cast("int"), F.lit(size)) for i in range(pieces)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *parts))


def learn(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    total_chars: int = TOTAL_CHARS,
) -> tuple[tuple[str, str], ...]:
    """The sample for every language: the distinct texts with the smallest hashes, each with its share of the characters.

    Texts below a bound on the hash are compared; the bound goes by the distinct texts of a language (as estimated, within a few hundredths),
    so copies don't crowd out others: four times the sample is expected below it, or all.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")
    )
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("distinct")).collect()
    if not counted:
        return ()
    chars = min(sample_chars, max(PIECES, total_chars // len(counted)))
    taken_rows = min(sample_rows, max(1, chars // 100))  # texts of a hundred characters at least
    span = 1 << 30
    wanted = [(r["lang"], min(span, math.ceil(span * 4 * taken_rows / max(1, r["distinct"])))) for r in counted]
    limits = df.sparkSession.createDataFrame(wanted, "lang string, below long")
    place = F.pmod(F.col("h"), F.lit(span))
    near = rows.join(F.broadcast(limits), "lang").where(place < F.col("below"))  # a row a language
    distinct = near.select("lang", "h", _spread(F.col("text"), max(PIECES, chars // taken_rows)).alias("text")).dropDuplicates(["lang", "h"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    taken = distinct.withColumn("rank", first).where(F.col("rank") <= taken_rows)
    texts: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["lang"], r["h"])):  # ``total_chars`` characters at most
        texts.setdefault(r["lang"], []).append(normalise(r["text"]))
    return tuple((lang, " ".join(t)[:sample_chars]) for lang, t in sorted(texts.items()))


def _predicting(sample: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(sample)
        for batch in slices(batches):
            found = [classify(t, automata) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["id", "lang_pred", "score"],
            )

    return run


def predict(df: DataFrame, sample: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every row, from the text alone."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predicting(sample), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
