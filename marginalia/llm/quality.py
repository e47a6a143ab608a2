"""Quality rules (operator 7): a table of thresholds compiled into one projection of built-in functions.

All figures of a text are array and string expressions of that one row; nothing is shuffled and no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK = "[ \\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails when ``numerator`` exceeds ``most`` or lies under ``least`` hundredths of ``denominator``."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None


# Common words of the languages measured (en, de, fr, es, it, pt, nl, sv, pl, ru), and letters of their scripts: fixed values.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "der die das und ist nicht ein eine zu den mit von auf für im dem des sich als auch es an "
    "le la les de des et un une est que pour dans qui sur pas par au avec ce il en du "
    "el los las que y del se por con una su para como más al lo no o "
    "il che di non gli della sono è nel anche "
    "os uma não dos mais foi são seu ou "
    "het een dat niet zijn op voor met aan ook "
    "och att det som är inte till av ett "
    "i w nie na się jest że z do jak "
    "и в не на что с он как это по я но к у из за то от для"
).split()
LISTED_SCRIPTS = ("A-Za-z", ("00C0", "024F"), ("0400", "04FF"))

RULES = (
    Rule("word_length_low", "word_chars", "n_words", least=200),
    Rule("word_length_high", "word_chars", "n_words", most=1200),
    Rule("symbols", "n_symbols", "n_words", most=30),
    Rule("stop_words", "n_stop_words", "n_listed_words", least=3),
    Rule("repeated_lines", "dup_line_chars", "line_chars", most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
)
BASE_RULES = (
    Rule("too_few_words", "n_words", "one", least=2000),
    Rule("repeated_words", "n_repeat_words", "n_words", most=30),
)


def letters_class(form: str) -> str:
    """The pattern of a letter of LISTED_SCRIPTS; ``form`` writes a code point as the pattern's engine does."""
    latin, *ranges = LISTED_SCRIPTS
    return "[" + latin + "".join(form.format(a) + "-" + form.format(b) for a, b in ranges) + "]"


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between blanks, tabs and line ends; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in runs of ``window`` words, a power of two, that occur twice or more, the first occurrence included.

    Runs are compared by a 64-bit hash, built from the hashes of their halves.
    """

    def covered(found: Column) -> Column:
        """``found``: sorted starts of repeated runs; each covers up to the next start, at most ``window`` words."""
        steps = F.transform(
            found, lambda p, i: F.when(i + 1 < F.size(found), F.least(F.lit(window), F.get(found, i + 1) - p)).otherwise(F.lit(window))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(runs: Column) -> Column:
        """Starts of runs with an equal neighbour in ``runs``, which are sorted and carry their start."""
        twin = F.filter(runs, lambda r, i: (F.get(runs, i - 1)["w"] == r["w"]) | (F.get(runs, i + 1)["w"] == r["w"]))
        return F.array_sort(F.transform(twin, lambda r: r["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("w"), i.alias("i")))
        some = bind(F.array_sort(pairs), lambda runs: bind(repeated(runs), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(some)

    def joined(hashes: Column, reach: int) -> Column:
        """Hashes of runs of 2 * ``reach`` words from those of ``reach``."""
        if reach == window:
            return count(F.filter(hashes, lambda h, i: i + window <= F.size(hashes)))
        return bind(F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + reach))), lambda longer: joined(longer, 2 * reach))

    counted = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: joined(hashes, 1))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(counted).cast("long")


def listed(docs: DataFrame, *kept: Column | str) -> DataFrame:
    """``kept`` with the text, its words and its lines that hold a word."""
    whole = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_whole"))
    lines = F.filter(F.split("_whole", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return whole.select("*", words_of(F.col("_whole")).alias("_words"), lines.alias("_lines"))


def measures() -> dict[str, Column]:
    """The figures of a row of ``listed``; lengths are in code points.

    Repeated lines count by their characters, so short ones among long ones do not condemn a text.  Stop words are sought
    among words that have a letter of LISTED_SCRIPTS; a text without such words has none to miss.
    """
    chars = lambda lines: F.length(F.array_join(lines, "")).cast("long")
    count = lambda array: F.size(array).cast("long")
    words, lines = F.col("_words"), F.col("_lines")
    stop = [form for w in dict.fromkeys(STOP_WORDS) for form in (w, w.capitalize())]
    start = lambda line: F.ltrim(line)
    return {
        "n_words": count(words),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_whole", f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": count(lines),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "line_chars": chars(lines),
        "dup_line_chars": chars(lines) - chars(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_listed_words": count(F.filter(words, lambda w: w.rlike(letters_class("\\x{{{}}}")))),
        "n_stop_words": count(F.filter(words, lambda w: w.isin(*stop))),
        "n_bullet_lines": count(F.filter(lines, lambda line: start(line).startswith("- ") | start(line).startswith("• "))),
        "n_cut_lines": count(F.filter(lines, lambda line: line.endswith("...") | line.endswith("…"))),
        "one": F.lit(1).cast("long"),
    }


def failed(rule: Rule) -> Column:
    """False where there is nothing to measure."""
    share, base = F.lit(100) * F.col(rule.numerator), F.col(rule.denominator)
    tests = [share < rule.least * base] if rule.least is not None else []
    tests += [share > rule.most * base] if rule.most is not None else []
    return F.coalesce(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(False))


def any_failed(rules) -> Column:
    result = F.lit(False)
    for rule in rules:
        result = result | failed(rule)
    return result


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, the figures, base_failed, kept and the names of the failed ``rules``.

    A null or empty text has no words and fails the base rules.  Further columns of ``docs`` are ignored.
    """
    measured = listed(docs, "doc_id").select("doc_id", *[c.alias(n) for n, c in measures().items()])
    names = F.filter(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull())
    judged = measured.withColumn("base_failed", any_failed(base)).withColumn("failed_rules", names)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("one")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    figures = F.struct(*[c.alias(n) for n, c in measures().items()])
    # Unpacked from an array, figures are worked out once and not again for each rule that the filter names them in.
    measured = listed(docs, F.struct("*").alias("row")).select("row", F.explode(F.array(figures)).alias("figures"))
    rejected = any_failed(base) | any_failed(rules)
    return measured.select("row", "figures.*").filter(~rejected).select("row.*")
