"""Probe generators: variants of a requirement as column expressions. Choices are made by a seeded hash, never at random."""

from __future__ import annotations

from collections.abc import Callable, Generator
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions import lexicon as lx
from lathe.functions.text import Steps, capitalised, collapse, has_tokens, in_column, in_frame, is_plain, once, strip, together, tokens, whole_word


def pick(values: list[str], key: Column, seed: int = 42, op: str = "") -> Column:
    """One of ``values``, by a hash of the key."""
    if len(values) == 1:
        return F.lit(values[0])
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{op}:{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def surrogate_id(prefix: str, model: Column, item: Column) -> Column:
    """An id with a suffix that the model and the item decide; signs in the model's name become underscores."""
    suffix = F.substring(F.sha2(F.concat_ws("|", model, item.cast("string")), 256), 1, 8)
    return F.concat_ws("_", F.lit(prefix), F.regexp_replace(model, "[^a-zA-Z0-9]", "_"), item.cast("string"), suffix)


class Seen(NamedTuple):
    """What several operations look at: the text in lower case, whether it is plain, and where its modal first stands."""

    low: Column
    plain: Column
    #: Where the modal's letters first are, from 1; 0 if nowhere.
    at: Column
    #: Whether the text is plain and the modal stands alone there: then its parts are cut out without regular expressions.
    clear: Column
    #: What is before the modal; null if it isn't there as a word.
    head: Column
    #: Whether a modal's form with ``is`` is not wanted.
    stiff: Column


def _alone(x: Column, at: Column, n: Column) -> Column:
    """Whether ``n`` letters of a plain text, from ``at``, are words between blanks, or before a comma, a period or the end."""
    return ((at == 1) | (F.substr(x, at - 1, F.lit(1)) == " ")) & F.substr(x, at + n, F.lit(1)).isin(" ", ",", ".", "")


def _words(pattern: str, words: Column) -> Column:
    """A pattern with a row's words in place of braces: one expression for all words of a list, which has letters and blanks only."""
    start, end = pattern.split("{}")
    return F.concat(F.lit(start), words, F.lit(end))


def _extracted(x: Column, pattern: Column, group: int) -> Column:
    return F.call_function("regexp_extract", x, pattern, F.lit(group))


def _spliced(x: Column, at: Column, old: Column, new: Column) -> Column:
    return F.concat(F.substr(x, F.lit(1), at - 1), new, F.substr(x, at + F.length(old)))


def _seen(x: Column, modal: Column) -> Steps:
    [low, plain] = yield [F.lower(x), is_plain(x)]
    return (yield from _around(x, modal, low, plain))


def _around(x: Column, modal: Column, low: Column, plain: Column) -> Steps:
    known = modal.isin(*lx.MODAL_SYNONYMS)
    [at, stiff] = yield [F.when(known, F.instr(low, modal)), x.rlike(r"^[A-Z][a-z]+s\s") | F.when(known & low.contains("be"), F.rlike(low, _words(r"\b{}\s+be\b", modal))).otherwise(False)]
    [clear] = yield [F.coalesce(plain & (at > 0) & _alone(low, at, F.length(modal)), F.lit(False))]
    [head] = yield [F.when(clear, F.substr(x, F.lit(1), at - 1)).when((at > 0) & F.rlike(x, _words(r"(?i)\b{}\b", modal)), _extracted(x, _words(r"(?is)^(.*?)\b{}\b", modal), 1))]
    return Seen(low, plain, at, clear, head, stiff)


def _tail(x: Column, modal: Column, head: Column) -> Column:
    return F.substr(x, F.length(head) + F.length(modal) + 1)


def modal_synonym(x: Column, modal: Column, key: Column | None = None, seed: int = 42) -> Column:
    """The first modal replaced by one of its synonyms; the first synonym that fits without a key.

    Forms with ``is`` don't go with a passive or a plural subject; null if nothing fits.
    """
    return in_column(_modal_synonym(x, modal, key, seed))


def _modal_synonym(x: Column, modal: Column, key: Column | None = None, seed: int = 42, seen: Seen | None = None) -> Steps:
    seen = seen or (yield from _seen(x, modal))
    choose = lambda options: pick(options, key, seed, "modal_synonym") if key is not None else F.lit(options[0])
    chosen = F.lit(None).cast("string")
    for m, synonyms in lx.MODAL_SYNONYMS.items():
        narrow = [s for s in synonyms if not s.startswith("is ")]
        best = F.when(~seen.stiff, choose(synonyms))
        chosen = F.when(modal == m, best.otherwise(choose(narrow)) if narrow else best).otherwise(chosen)
    [synonym] = yield [chosen]
    return F.concat(seen.head, synonym, _tail(x, modal, seen.head))


def condition_synonym(x: Column, key: Column | None = None, seed: int = 42) -> Column:
    """Another word for the condition that a sentence starts with; null without one."""
    return in_column(_condition_synonym(x, key, seed))


def _condition_synonym(x: Column, key: Column | None = None, seed: int = 42, seen: Seen | None = None) -> Steps:
    low, plain = (seen.low, seen.plain) if seen else (yield [F.lower(x), is_plain(x)])
    choose = lambda options: pick([o[0].upper() + o[1:] for o in options], key, seed, "condition_synonym") if key is not None else F.lit(options[0][0].upper() + options[0][1:])
    [text] = yield [F.when(plain, x).otherwise(strip(x))]
    [low] = yield [F.when(plain, low).otherwise(F.lower(text))]
    return F.coalesce(*(F.when(low.startswith(word + " "), F.concat(choose(synonyms), F.substring(text, len(word) + 1, 2**31 - 1))) for word, synonyms in lx.CONDITION_SYNONYMS.items()))


def clause_expand(x: Column) -> Column:
    """A fuller subject for the first that occurs; case counts."""
    return in_column(_clause_expand(x))


def _clause_expand(x: Column) -> Steps:
    has = lambda short: x.contains(short) & x.rlike(rf"\b{short}\b")  # noqa: E731 - the subjects are plain words
    [pair] = yield [F.coalesce(*(F.when(has(short), F.array(F.lit(short), F.lit(long))) for short, long in lx.SUBJECT_EXPANSIONS))]
    return F.regexp_replace(x, _words(r"^((?s:.)*?)\b{}\b", pair[0]), F.concat(F.lit("$1"), pair[1]))


def subject_rephrase(x: Column, modal: Column) -> Column:
    """``X shall Y`` as ``It is required that X Y.``; shall and must only, no condition first, 8 words at least."""
    return in_column(_subject_rephrase(x, modal))


def _subject_rephrase(x: Column, modal: Column, seen: Seen | None = None) -> Steps:
    seen = seen or (yield from _seen(x, modal))
    [text, tail] = yield [F.when(seen.plain, x).otherwise(strip(x)), _tail(x, modal, seen.head)]
    part = lambda group: _extracted(text, _words(r"(?i)^(.{4,60}?)\s+{}\s+(.+)$", modal), group)
    [wanted] = yield [F.when((seen.at > 0) & modal.isin("shall", "must"), ~text.rlike(r"(?i)^(if|when|while|where|unless)\b"))]
    [plain] = yield [wanted & seen.clear & seen.head.endswith(" ") & tail.startswith(" ") & F.length(seen.head).between(5, 61)]
    [subject, predicate] = yield [
        F.when(plain, F.rtrim(seen.head)).when(wanted, strip(part(1))),
        F.when(plain, F.ltrim(tail)).when(wanted, strip(part(2))),
    ]
    [found] = yield [F.when(subject != "", F.concat(F.lit("It is required that "), subject, F.lit(" "), F.rtrim(predicate, F.lit(".")), F.lit(".")))]
    return F.when(has_tokens(found, 8), found)


#: Operations that keep the meaning, in the order in which they are tried: (text, modal, key or None) -> variant or null, as a column or in steps.
OPERATIONS: dict[str, Callable[[Column, Column, Column | None], Column | Steps]] = {
    "modal_synonym": _modal_synonym,
    "condition_syn": lambda x, modal, key: _condition_synonym(x, key),
    "clause_expand": lambda x, modal, key: _clause_expand(x),
    "subject_rephrase": lambda x, modal, key: _subject_rephrase(x, modal),
}

#: The same for a text that was looked at: of a plain text they make plain texts.
_OF_SEEN: dict[str, Callable[[Column, Column, Column | None, Seen], Steps]] = {
    "modal_synonym": lambda x, modal, key, seen: _modal_synonym(x, modal, key, seen=seen),
    "condition_syn": lambda x, modal, key, seen: _condition_synonym(x, key, seen=seen),
    "clause_expand": lambda x, modal, key, seen: _clause_expand(x),
    "subject_rephrase": lambda x, modal, key, seen: _subject_rephrase(x, modal, seen),
}


def candidates(x: Column, modal: Column, n: int = 2, key: Column | None = None, operations: dict[str, Callable[[Column, Column, Column | None], Column | Steps]] = OPERATIONS) -> Column:
    """array<struct<operation, text>>: what the operations give, without what repeats the source or each other, the first n."""

    def listed() -> Steps:
        seen = yield from _seen(x, modal)
        found = yield from _candidates(x, modal, n, key, operations, seen)
        return F.array_compact(F.array(*(F.when(kept, F.struct(F.lit(name).alias("operation"), text.alias("text"))) for name, text, kept, _ in found)))

    return in_column(listed())


def _candidates(x: Column, modal: Column, n: int, key: Column | None, operations: dict, seen: Seen) -> Generator[list[Column], list[Column], list[tuple[str, Column, Column, Column]]]:
    """(operation, text, whether it is one of the first n, how many are before it) of each operation."""

    def whole(made: Column | Steps) -> Steps:
        return (yield from made) if isinstance(made, Generator) else (yield [made])[0]

    known = [make is OPERATIONS.get(name) for name, make in operations.items()]
    texts = yield from together(*(whole(_OF_SEEN[name](x, modal, key, seen) if k else make(x, modal, key)) for k, (name, make) in zip(known, operations.items())))
    texts = yield texts
    lows = yield [*map(F.lower, texts)]
    form = lambda low, plain: F.when(plain | is_plain(low), low).otherwise(collapse(low))
    own, *forms = yield [form(seen.low, seen.plain), *(form(low, seen.plain if k else F.lit(False)) for low, k in zip(lows, known))]
    awkward = lambda t, low: low.contains("going") & low.rlike(r"\bis\s+going\s+to\b") & F.regexp_extract(t, r"^(\w+)", 1).endswith("s")
    good = yield [F.coalesce(t.isNotNull() & (f != own) & ~awkward(t, low), F.lit(False)) for t, low, f in zip(texts, lows, forms)]
    repeated = lambda i: reduce(or_, (good[j] & (forms[j] == forms[i]) for j in range(i)), F.lit(False))
    fresh = yield [g & ~repeated(i) for i, g in enumerate(good)]
    before = [sum((f.cast("int") for f in fresh[:i]), F.lit(0)) for i in range(len(fresh))]
    return [(name, t, f & (b < n), b) for name, t, f, b in zip(operations, texts, fresh, before)]


def _moves(kind: str) -> list[tuple[str, str, str, str]]:
    """(operation, direction, original, new) of all moves of the scope or of the modal."""
    if kind == "scope":
        return [(f"condition_scope_{d}", d, old, new) for d, pairs in (("strengthen", lx.CONDITION_STRENGTHENERS), ("weaken", lx.CONDITION_WEAKENERS)) for old, new in pairs]
    moves = {m: (new, "strengthen") for m, new in lx.MODAL_STRENGTHEN.items()} | {m: (new, "weaken") for m, new in lx.MODAL_WEAKEN.items()}
    return [("modal_substitution", d, m, new) for m, (new, d) in moves.items()]


def _moved(x: Column, which: Column, moves: list[tuple[str, str, str, str]], low: Column, plain: Column) -> Steps:
    """struct(operation, direction, original, new, text) of the move with this number, null if it changes nothing."""
    [number] = yield [which]
    of_move = lambda i: F.get(F.array(*(F.lit(move[i]) for move in moves)), number)
    [at, old, new] = yield [F.instr(low, of_move(2)), of_move(2), of_move(3)]
    searched = F.regexp_replace(x, _words(r"(?is)^((?s:.)*?)\b{}\b", old), F.concat(F.lit("$1"), new))
    [text] = yield [F.when(plain & (at > 0) & _alone(low, at, F.length(old)), _spliced(x, at, old, new)).when(at > 0, searched)]
    return F.when(text != x, F.struct(of_move(0).alias("operation"), of_move(1).alias("direction"), old.alias("original"), new.alias("new"), text.alias("text")))


def _of_modal(modal: Column, moves: list[tuple[str, str, str, str]], first: int = 0) -> Column:
    return F.coalesce(*(F.when(modal == m, F.lit(first + i)) for i, (_, _, m, _) in enumerate(moves)))


def _of_scope(x: Column, low: Column, moves: list[tuple[str, str, str, str]]) -> Column:
    """Words that a move puts differ from those that it takes, so that it changes each text that has them."""
    there = lambda old: low.contains(old) & x.rlike(whole_word(old))
    return F.coalesce(*(F.when(there(move[2]), F.lit(i)) for i, move in enumerate(moves)))


def directional_modal(x: Column, modal: Column) -> Column:
    """The first modal made weaker, or stronger if no weaker one is listed."""
    moves = _moves("modal")

    def steps() -> Steps:
        [low, plain] = yield [F.lower(x), is_plain(x)]
        return (yield from _moved(x, _of_modal(modal, moves), moves, low, plain))

    return in_column(steps())


def directional_scope(x: Column) -> Column:
    """The first listed change of a condition that changes the text: strengtheners, then weakeners."""
    moves = _moves("scope")

    def steps() -> Steps:
        [low, plain] = yield [F.lower(x), is_plain(x)]
        return (yield from _moved(x, _of_scope(x, low, moves), moves, low, plain))

    return in_column(steps())


def directional(x: Column, modal: Column) -> Column:
    """By the scope where there is a condition and it can be changed, else by the modal."""

    def steps() -> Steps:
        [low, plain] = yield [F.lower(x), is_plain(x)]
        return (yield from _directional(x, modal, low, plain))

    return in_column(steps())


def _directional(x: Column, modal: Column, low: Column, plain: Column) -> Steps:
    scope, modals = _moves("scope"), _moves("modal")
    words = lx.CONDITION_KEYWORDS
    [conditional] = yield [reduce(or_, map(low.contains, words)) & x.rlike(rf"(?i)\b({'|'.join(words)})\b")]
    which = F.coalesce(F.when(conditional, _of_scope(x, low, scope)), _of_modal(modal, modals, len(scope)))
    return (yield from _moved(x, which, [*scope, *modals], low, plain))


def distractor_category(x: Column) -> Column:
    return once(F.lower(x), _category)


def _category(low: Column) -> Column:
    found = F.when(F.lit(False), "")
    for name, cues in lx.DISTRACTOR_CUES:
        hit = F.lit(False)
        for c in cues:
            hit = hit | low.contains(c)
        found = found.when(hit, name)
    return found.otherwise(lx.DISTRACTOR_DEFAULT)


def distractor(category: Column, key: Column | None = None, seed: int = 42) -> Column:
    """A distractor of a category: the first without a key."""
    return F.coalesce(*(F.when(category == c, pick(values, key, seed, "distractor") if key is not None else F.lit(values[0])) for c, values in lx.DISTRACTORS.items()))


def with_distractor(x: Column, phrase: Column, category: Column) -> Column:
    """Inside the condition for retry triggers; after the first modal if it is short; else at the end."""

    def steps() -> Steps:
        [low, plain] = yield [F.lower(x), is_plain(x)]
        return (yield from _with_distractor(x, phrase, category, low, plain))

    return in_column(steps())


def _with_distractor(x: Column, phrase: Column, category: Column, low: Column, plain: Column, seen: Seen | None = None, modal: Column | None = None) -> Steps:
    starts = ("if", "when", "while", "unless")
    clause = rf"(?is)^(.*?\b(?:{'|'.join(starts)})\b\s+[^,\.]{{3,40}}?)\s*[,\.]"
    first = rf"(?is)^(.*?\b(?:{'|'.join(lx.MODAL_ORDER)})\b)"
    rest = lambda head: F.substr(x, F.length(head) + 1)
    [condition] = yield [F.when((category == "retry_trigger") & reduce(or_, map(low.contains, starts)), F.regexp_extract(x, clause, 1)).otherwise("")]
    searched = F.regexp_extract(x, first, 1)
    if seen:  # the modal that was found is the first one if none is before it
        head = F.lower(seen.head)
        alone = seen.clear & ~reduce(or_, map(head.contains, lx.MODAL_ORDER))
        searched = F.when(alone, F.substr(x, F.lit(1), F.length(seen.head) + F.length(modal))).otherwise(searched)
    [opening] = yield [F.when((condition == "") & ~has_tokens(phrase, 4), searched).otherwise("")]
    [left] = yield [F.when(opening != "", F.when(plain, F.ltrim(rest(opening))).otherwise(F.regexp_replace(rest(opening), r"(?U)^\s+", "")))]
    [after, end] = yield [
        F.when(opening != "", F.concat(opening, F.lit(" "), phrase, F.lit(" "), left)),
        F.when((condition == "") & (opening == ""), F.when(plain, x).otherwise(F.regexp_replace(x, r"(?U)\s+$", ""))),
    ]
    inside = F.concat(condition, F.lit(" "), phrase, rest(condition))
    closed = F.when(end.endswith("."), F.concat(F.substr(end, F.lit(1), F.length(end) - 1), F.lit(", "), phrase, F.lit("."))).otherwise(F.concat(end, F.lit(" "), phrase, F.lit(".")))
    return F.when(condition != "", inside).when(opening != "", F.when((plain & (left != "")) | is_plain(after), after).otherwise(strip(after))).otherwise(closed)


def shortcut(x: Column, key: Column | None = None, seed: int = 42) -> Column:
    """struct(text, distractor, category, risk)."""

    def steps() -> Steps:
        [low, plain] = yield [F.lower(x), is_plain(x)]
        [category] = yield [_category(low)]
        [phrase] = yield [distractor(category, key, seed)]
        text = yield from _with_distractor(x, phrase, category, low, plain)
        risk = F.coalesce(*(F.when(category == c, r) for c, r in lx.HALLUCINATION_RISK.items()))
        return F.struct(text.alias("text"), phrase.alias("distractor"), category.alias("category"), risk.alias("risk"))

    return in_column(steps())


PROBE = "struct<probe_id:string,probe_family:string,probe_text:string,expected_relation:string,operation:string,generation_method:string,direction:string,distractor:string>"


def neighbourhood(x: Column, modal: Column, key: Column) -> Column:
    """array of probes: two of invariance, one directional, one shortcut, as far as they can be made."""
    return in_column(_neighbourhood(x, modal, key))


def with_neighbourhood(df: DataFrame, text_col: str, modal_col: str, id_col: str, out: str = "probes") -> DataFrame:
    """``df`` with the probes of ``neighbourhood``, made in projections that Spark compiles: for many rows."""
    return in_frame(df, lambda: _neighbourhood(F.col(text_col), F.col(modal_col), F.col(id_col)), out, text_col, (text_col, modal_col, id_col))


def _neighbourhood(x: Column, modal: Column, key: Column) -> Steps:
    def probe(number: Column, family: str, text: Column, relation: str, operation: Column, direction: Column | None = None, distractor_: Column | None = None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            number.alias("probe_id"), F.lit(family).alias("probe_family"), text.alias("probe_text"), F.lit(relation).alias("expected_relation"), operation.alias("operation"),
            F.lit("rule").alias("generation_method"), (null if direction is None else direction).alias("direction"), (null if distractor_ is None else distractor_).alias("distractor"),
        )

    def distracted() -> Steps:
        [category] = yield [_category(low)]
        [phrase] = yield [distractor(category, key)]
        return category, phrase

    [low, plain] = yield [F.lower(x), is_plain(x)]
    seen, move, (category, phrase) = yield from together(_around(x, modal, low, plain), _directional(x, modal, low, plain), distracted())
    found, text = yield from together(_candidates(x, modal, 2, key, OPERATIONS, seen), _with_distractor(x, phrase, category, low, plain, seen, modal))
    m, added = yield [move, text]
    probes = [(kept, probe(F.concat(F.lit("INV_"), (before + 1).cast("string")), "invariance", text, "stable", F.lit(name))) for name, text, kept, before in found]
    probes.append((m.isNotNull(), probe(F.lit("DIR_1"), "directional", m["text"], "directional", m["operation"], m["direction"])))
    probes.append((added != x, probe(F.lit("SHC_1"), "shortcut", added, "no_shortcut", F.lit("distractor_insertion"), None, phrase)))
    return F.concat(*(F.when(made, F.array(p)).otherwise(F.array().cast(f"array<{PROBE}>")) for made, p in probes))


def probe_stats(probes: Column) -> Column:
    """struct(invariance, directional, shortcut, failed): probes by family, and how many of two, one and one are missing."""
    families = probes["probe_family"]
    of = lambda f: F.size(families) - F.size(F.array_remove(families, f))
    missing = F.greatest(2 - of("invariance"), F.lit(0)) + F.greatest(1 - of("directional"), F.lit(0)) + F.greatest(1 - of("shortcut"), F.lit(0))
    return F.struct(of("invariance").alias("invariance"), of("directional").alias("directional"), of("shortcut").alias("shortcut"), missing.alias("failed"))


def admitted(items: DataFrame, extra: DataFrame, excluded: DataFrame, id_col: str = "item_id") -> DataFrame:
    """``items`` with what ``extra`` has for their ids, but for ids that ``excluded`` has. Rows are narrow before their probes are made."""
    return items.join(extra.join(excluded.select(id_col).distinct(), id_col, "left_anti"), id_col, "left")


def inject(probes: Column, extra: Column, when: Column) -> Column:
    """``extra`` before the others where ``when`` holds."""
    return F.when(when & extra.isNotNull(), F.concat(F.array(extra), probes)).otherwise(probes)


def filled(probe: Column, by_family: dict[str, str]) -> Column:
    """The ``generation_method`` of a probe, by its family if it is null."""
    return F.coalesce(probe["generation_method"], *(F.when(probe["probe_family"] == f, m) for f, m in by_family.items()), F.lit(None).cast("string"))


def fill_method(probes: Column, by_family: dict[str, str]) -> Column:
    """Null ``generation_method`` set by family."""
    return F.transform(probes, lambda p: p.withField("generation_method", filled(p, by_family)))


def lexical_substitution(x: Column, synonyms: dict[str, list[str]], protected: list[str], key: Column, seed: int = 42) -> Column:
    """Words replaced by a synonym picked by hash, protected ones kept (semantics inferred: the source has only the lists)."""
    table = F.create_map(*(y for w, ss in synonyms.items() for y in (F.lit(w), F.array(*map(F.lit, ss)))))
    keep = F.array(*map(F.lit, protected)) if protected else F.array().cast("array<string>")

    def swapped(t: Column, i: Column) -> Column:
        options = F.try_element_at(table, F.lower(t))
        choice = F.get(options, F.pmod(F.xxhash64(F.lit(seed), key, i), F.greatest(F.size(options), F.lit(1))).cast("int"))
        return F.when(~F.array_contains(keep, F.lower(t)) & options.isNotNull(), choice).otherwise(t)

    return F.array_join(F.transform(tokens(x), swapped), " ")


def appended_template(x: Column, templates: list[str], key: Column, seed: int = 42) -> Column:
    """A phrase put before the final period, or at the end (semantics inferred)."""
    phrase = pick(templates, key, seed, "template")
    return F.when(x.endswith("."), F.concat(F.regexp_replace(x, r"\.$", ""), phrase, F.lit("."))).otherwise(F.concat(x, phrase))

