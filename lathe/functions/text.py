"""Text primitives as column expressions: tokens, replacement, repairs in their order, sentence splits."""

from __future__ import annotations

from collections.abc import Callable, Generator

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions import lexicon as lx

_SPACE = r"(?U)\s+"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used there: an expression is otherwise copied to each use."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


#: An expression made in steps: it yields lists of values, gets columns that hold them, each computed once, and returns the result.
Steps = Generator[list[Column], list[Column], Column]


def together(*parts: Steps) -> Generator[list[Column], list[Column], list]:
    """What each part returns; their steps are taken side by side."""
    results, held, running = [None] * len(parts), [None] * len(parts), list(range(len(parts)))
    while True:
        asked: dict[int, list[Column]] = {}
        for i in running:
            try:
                asked[i] = parts[i].send(held[i])
            except StopIteration as end:
                results[i] = end.value
        if not asked:
            return results
        got = iter((yield [v for values in asked.values() for v in values]))
        for i, values in asked.items():
            held[i] = [next(got) for _ in values]
        running = list(asked)


def in_column(steps: Steps) -> Column:
    """Steps as one expression. Spark interprets it; ``in_frame`` has it compiled."""

    def following(held: list[Column] | None) -> Column:
        try:
            values = steps.send(held)
        except StopIteration as end:
            return end.value
        names = [f"v{i}" for i in range(len(values))]
        return once(F.struct(*(v.alias(n) for n, v in zip(names, values))), lambda s: following([s[n] for n in names]))

    return following(None)


#: Columns of steps by name, in their order, and the result: (gateway of the JVM that has them, steps, result).
_BUILT: dict[tuple, tuple[object, list[dict[str, Column]], Column]] = {}


def _built(steps: Callable[[], Steps], key: tuple) -> tuple[object, list[dict[str, Column]], Column]:
    """The columns of steps. They belong to no frame or session, and thousands of calls to the JVM make them: they are made once in a process."""
    gateway = SparkContext._gateway
    if key not in _BUILT or _BUILT[key][0] is not gateway:
        running, held, found, n = steps(), None, [], 0
        while True:
            try:
                values = running.send(held)
            except StopIteration as end:
                _BUILT[key] = (gateway, found, end.value)
                break
            found.append({f"_step_{n + i}": v for i, v in enumerate(values)})
            held, n = [F.col(c) for c in found[-1]], n + len(values)
    return _BUILT[key]


def in_frame(df: DataFrame, steps: Callable[[], Steps], out: str, text_col: str, key: tuple) -> DataFrame:
    """``df`` with ``out``, which steps make that read ``text_col``: each step is a projection of its own. ``key`` tells steps apart.

    Spark would compile all of them into one method, too long for the JVM to make machine code of. An expression that Spark
    only interprets, of the text alone, has each projection compiled by itself, into short methods. ``out`` comes out of a
    generator, so that a filter of it isn't pushed below, with all steps copied into it.
    """
    kept = [F.col(c) for c in df.columns if c != out]
    _, found, made = _built(steps, (*key, steps.__code__))
    text = once(F.col(text_col), lambda x: x)
    for new in found:
        df = df.withColumns(new | {text_col: text})
    return df.withColumns({out: made, text_col: text}).select(*kept, F.explode(F.array(out)).alias(out))


def strip(x: Column) -> Column:
    """Without white space at either end: any Unicode white space, unlike ``trim``."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """Stretches without white space; none for null."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), _SPACE), lambda t: t != "")


def word_count(x: Column) -> Column:
    return F.size(tokens(x)).cast("long")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, _SPACE, " "))


def normal_form(x: Column) -> Column:
    """Lower case, white space collapsed: how texts are compared."""
    return collapse(F.lower(x))


def is_plain(x: Column) -> Column:
    """Visible ASCII characters with single blanks between them: neither ``strip`` nor ``collapse`` changes such a text."""
    return x.rlike(r"\A[!-~]++(?: [!-~]++)*+\z")


def has_tokens(x: Column, least: int) -> Column:
    """Whether there are so many tokens: ``size(tokens(x)) >= least`` in one pass."""
    return x.rlike(rf"\A(?U)\s*+(?:\S++\s++){{{least - 1}}}\S")


def whole_word(word: str) -> str:
    return rf"(?i)\b{word}\b"


def replacement_of(value: str) -> str:
    """What ``regexp_replace`` reads as ``value``."""
    return value.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(x: Column, pattern: str, replacement: str | Column, flags: str = "is") -> Column:
    """Only the first match: everything before it is captured and put back. ``pattern`` has no groups of its own.

    A replacement that is a column has to be one that ``replacement_of`` made.
    """
    opening = f"(?{flags})" if flags else ""
    put = F.lit("$1" + replacement_of(replacement)) if isinstance(replacement, str) else F.concat(F.lit("$1"), replacement)
    return F.regexp_replace(x, F.lit(f"{opening}^((?s:.)*?)(?:{pattern})"), put)


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))


def preview(x: Column, n: int = 200) -> Column:
    return F.substring(x, 1, n)


def _cut_prefix(x: Column, pattern: str, least: int) -> Column:
    """Without a prefix, if at least so many words are left."""
    rest = strip(F.regexp_replace(x, pattern, ""))
    return F.when(F.size(tokens(rest)) >= least, rest).otherwise(x)


def _cut_footnote(x: Column, least: int) -> Column:
    head = F.regexp_extract(x, rf"^((?s:.)*?){lx.FOOTNOTE}", 1)
    cut = F.regexp_extract(head, r"^((?s:.)*\.)", 1)
    return F.when(x.rlike(lx.FOOTNOTE) & (F.length(cut) > 1) & (F.size(tokens(cut)) >= least), cut).otherwise(x)


def repairs(least_words: int = lx.MIN_WORDS, compat: bool = True) -> list[tuple[str, object]]:
    """(name, step) in order. ``compat`` keeps the id prefix pattern that also takes letters of the next word."""
    gone = lambda p, by="": lambda x: strip(F.regexp_replace(x, p, by))
    return [
        ("quotes", lambda x: F.translate(x, "“”‘’", "\"\"''")),
        ("tilde_metadata", gone(lx.TILDE_METADATA)),
        ("then_tail", gone(lx.THEN_TAIL, ".")),
        ("bullet", gone(lx.BULLET)),
        ("connective", gone(lx.CONNECTIVES)),
        ("id_prefix", gone(lx.ID_PREFIX if compat else lx.ID_PREFIX_REPAIRED)),
        ("section_prefix", lambda x: _cut_prefix(x, lx.SECTION_PREFIX, least_words)),
        ("table_header", lambda x: _cut_prefix(x, lx.TABLE_HEADER, least_words)),
        ("inline_reference", lambda x: collapse(F.regexp_replace(x, lx.INLINE_REFERENCE, ""))),
        ("trailing_reference", gone(lx.TRAILING_REFERENCE, ".")),
        ("optionality", gone(lx.OPTIONALITY, " ")),
        ("footnote", lambda x: _cut_footnote(x, least_words)),
        ("white_space", collapse),
        ("capital", capitalised),
    ]


def with_repairs(df, text_col: str, out: str, **options):
    """``df`` with ``out``, the repaired text. Each step is a projection of its own, so none is computed twice."""
    df = df.withColumn(out, strip(F.col(text_col)))
    for _, step in repairs(**options):
        df = df.withColumn(out, step(F.col(out)))
    return df


def join_hyphens(x: Column) -> Column:
    """Words that a line break parts, and white space."""
    return collapse(F.regexp_replace(x, r"-\s*\n\s*", ""))


def clean_article(x: Column) -> Column:
    """Without a first line of a number and a title."""
    return collapse(F.regexp_replace(strip(x), r"^\d+\s+[^\n]+\n", ""))


def sentences(x: Column) -> Column:
    """Non-empty sentences: split after a mark, before a capital."""
    return F.filter(F.transform(F.split(x, lx.SENTENCE_END), strip), lambda s: s != "")


def strip_fence(x: Column) -> Column:
    """Without a Markdown code fence around it."""
    return strip(F.regexp_replace(x, r"(?i)```json|```", ""))


def parsed_verdict(x: Column) -> Column:
    """struct(equivalent, confidence, failures, reason, status) from the JSON of a judge.

    Missing fields get defaults; malformed text gives status ``parse_error`` and the failure JSON_PARSE; JSON that is no
    object gives ``error`` and API_ERROR; in both the verdict is null.
    """
    body = strip_fence(x)
    variant = F.try_parse_json(body)
    shape = F.schema_of_variant(variant)
    got = F.from_json(body, "equivalent boolean, confidence string, failures array<string>, reason string")
    good = shape.startswith("OBJECT")
    fault = F.when(variant.isNull(), F.lit("parse_error")).otherwise(F.when(good, F.lit("ok")).otherwise(F.lit("error")))
    return F.struct(
        F.when(good, F.coalesce(got["equivalent"], F.lit(False))).alias("equivalent"),
        F.when(good, F.coalesce(got["confidence"], F.lit("low"))).otherwise(fault).alias("confidence"),
        F.when(good, F.coalesce(got["failures"], F.array().cast("array<string>"))).when(variant.isNull(), F.array(F.lit("JSON_PARSE"))).otherwise(F.array(F.lit("API_ERROR"))).alias("failures"),
        F.when(good, F.coalesce(got["reason"], F.lit(""))).otherwise(F.lit("")).alias("reason"),
        fault.alias("status"),
    )


def first_line_verdict(x: Column) -> Column:
    """struct(passed, explanation): whether the first line begins with PASS, and what follows it."""
    lines = F.split(strip(x), "\n", 2)
    return F.struct(F.upper(strip(lines[0])).startswith("PASS").alias("passed"), F.coalesce(strip(F.get(lines, F.lit(1))), F.lit("")).alias("explanation"))
