"""Similarity, conformance and classification of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions import lexicon as lx
from lathe.functions.text import strip, tokens, whole_word


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def lowered(x: Column) -> Column:
    return F.array_distinct(tokens(F.lower(x)))


def set_f1(a: Column, b: Column) -> Column:
    """2 * common / (sizes) of two sets; 0 if either is empty."""
    n = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def word_f1(reference: Column, other: Column) -> Column:
    return set_f1(lowered(reference), lowered(other))


def set_jaccard(a: Column, b: Column) -> Column:
    """Rounded to 4 digits; 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4))


def content_tokens(x: Column, without: list[str] = lx.BOILERPLATE) -> Column:
    """Distinct lower-case words of more than two letters that aren't boilerplate."""
    words = tokens(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "))
    return F.array_except(F.filter(F.array_distinct(words), lambda t: F.length(t) > 2), _strings(without))


def mean_token_length(x: Column) -> Column:
    """Stand-in for a readability grade: 0 for a blank text."""
    words = tokens(x)
    return F.when(F.size(words) > 0, F.aggregate(words, F.lit(0.0), lambda s, t: s + F.length(t)) / F.size(words)).otherwise(0.0)


def grade_level(x: Column) -> Column:
    """Flesch-Kincaid grade with vowel groups for syllables: 0.39 w/s + 11.8 syl/w - 15.59; 0 for a blank text."""
    words = F.size(tokens(x))
    ends = F.greatest(F.regexp_count(x, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.greatest(F.regexp_count(F.lower(x), F.lit(r"[aeiouy]+")), words)
    return F.when(words > 0, 0.39 * words / ends + 11.8 * syllables / words - 15.59).otherwise(0.0)


def detail_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z]+)"), 1))


def detail_share(detail: Column, text: Column, stopwords: list[str] = lx.DETAIL_STOPWORDS) -> Column:
    """Share of a detail's words that a text has; 1 without any."""
    words = F.array_except(detail_tokens(detail), _strings(stopwords))
    n = F.size(words)
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.size(F.array_intersect(words, detail_tokens(F.coalesce(text, F.lit(""))))) / n).otherwise(1.0)


def detail_exact(detail: Column, text: Column) -> Column:
    """Whether a text has a detail as it stands, letters in either case; true without a detail."""
    return F.coalesce(F.lower(F.coalesce(text, F.lit(""))).contains(F.lower(detail)), F.lit(True))


def distractor_share(distractor: Column, rewrite: Column, stopwords: list[str] = lx.DISTRACTOR_STOPWORDS) -> Column:
    """Share of a distractor's words that occur anywhere in a rewrite, also within words; null without words."""
    words = F.array_except(F.array_distinct(tokens(F.regexp_replace(F.lower(distractor), r"(?U)[^\w\s]", ""))), _strings(stopwords))
    found = F.size(F.filter(words, lambda t: F.lower(rewrite).contains(t)))
    return F.when(F.size(words) > 0, found / F.size(words))


def distractor_passed(distractor: Column, rewrite: Column, most: float = lx.DISTRACTOR_SHARE_MAX) -> Column:
    return F.coalesce(distractor_share(distractor, rewrite) < most, F.lit(True))


def any_word(words: list[str]) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


def conformance(x: Column) -> Column:
    """Tenths for a modal (4), a subject before it (3), a final period (2), a trigger or a subject first (1), over 10."""
    text = strip(x)
    modals = "|".join(lx.CONFORMANCE_MODALS)
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (
        one(text.rlike(any_word(lx.CONFORMANCE_MODALS)), 4)
        + one(text.rlike(rf"(?i)\bthe\s+\w+(\s+\w+)?\s+({modals})\b"), 3)
        + one(text.endswith("."), 2)
        + one(text.rlike(any_word(lx.TRIGGERS)) | text.rlike(r"(?i)^the\s+\w"), 1)
    )
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 5, 0.0).otherwise(score / 10.0)


def modal_strength(x: Column, strengths: dict[str, int] = lx.MODAL_STRENGTH) -> Column:
    """Of the strongest modal; 0 without any."""
    return F.coalesce(F.greatest(F.lit(0), *(F.when(x.rlike(whole_word(m)), s).otherwise(0) for m, s in strengths.items())), F.lit(0))


def primary_modal(x: Column, order: list[str] = lx.MODAL_ORDER) -> Column:
    """The first of ``order`` that occurs; null without any."""
    return F.coalesce(*(F.when(x.rlike(whole_word(m)), m) for m in order))


def strongest_modal(x: Column, strengths: dict[str, int] = lx.MODAL_STRENGTH) -> Column:
    """Of modals of equal strength the first listed; ``none`` without any."""
    return F.coalesce(primary_modal(x, sorted(strengths, key=lambda m: -strengths[m])), F.lit("none"))


def ears_type(x: Column, words: list[str] = lx.UBIQUITOUS_WORDS) -> Column:
    """By the first word, else by modals anywhere, also within words."""
    text = F.upper(x)
    found = F.when(F.lit(False), "")
    for prefix, name in lx.EARS_PREFIXES.items():
        found = found.when(text.startswith(prefix), name)
    anywhere = F.lit(False)
    for w in words:
        anywhere = anywhere | text.contains(w)
    return found.when(anywhere, "Ubiquitous").otherwise("unknown")


def ears_keyword(x: Column) -> Column:
    """The first trigger in the order listed that occurs anywhere."""
    text = strip(x)
    found = F.when(F.lit(False), "")
    for t in lx.TRIGGERS:
        found = found.when(text.rlike(whole_word(t)), t.upper())
    return found.when(text.rlike(r"(?i)^(ubiquitous\b|the\s)"), "UBIQUITOUS").otherwise("NONE")


def strength_preserved(modal: Column, candidate: Column) -> Column:
    """Whether a candidate keeps the strength of a modal; phrases go before single modals."""
    own = F.coalesce(*(F.when(modal == m, s) for m, s in lx.MODAL_STRENGTH.items()), F.lit(0))
    found = F.when(F.lit(False), False)
    for phrase, strength in lx.STRENGTH_PHRASES:
        found = found.when(candidate.rlike(whole_word(phrase)), own == strength)
    return found.when(primary_modal(candidate).isNotNull(), F.coalesce(*(F.when(primary_modal(candidate) == m, s) for m, s in lx.MODAL_STRENGTH.items())) == own).otherwise(False)


def matched(a: Column, b: Column) -> Column:
    """1 if both are there and equal."""
    return F.coalesce((a == b).cast("int"), F.lit(0))


def gold_components(rewrite: Column, gold: Column) -> Column:
    """struct(jaccard, modal, ears_kw, combined, structural): how a rewrite agrees with a gold text, by words, first modal and trigger."""
    j = set_jaccard(content_tokens(rewrite), content_tokens(gold))
    m, k = matched(primary_modal(rewrite), primary_modal(gold)), matched(ears_keyword(rewrite), ears_keyword(gold))
    return F.struct(j.alias("jaccard"), m.alias("modal"), k.alias("ears_kw"), F.round((j + m + k) / 3, 4).alias("combined"), F.round((m + k) / 2, 4).alias("structural"))


def tier(x: Column) -> Column:
    """2 for a text that leans on another: a pronoun first, or a phrase that points back; else 1."""
    text = strip(F.lower(x))
    leaning = text.rlike(rf"^({'|'.join(lx.ANAPHORIC_STARTS)})\b")
    for phrase in lx.ANAPHORIC_PHRASES:
        leaning = leaning | text.contains(phrase)
    return F.when(leaning, 2).otherwise(1)


def requirement_like(x: Column) -> Column:
    return x.rlike("(?i)" + lx.MODAL_GATE)


def stars(p: Column) -> Column:
    """By p-value; none for 0 or null."""
    return F.when(p.isNull() | (p == 0), "").when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def class_family(code: Column) -> Column:
    return F.when(F.upper(code) == "F", "FR").otherwise("NFR")


def class_label(code: Column, labels: dict[str, str] = lx.REQUIREMENT_CLASSES) -> Column:
    return F.coalesce(*(F.when(F.upper(code) == k, v) for k, v in labels.items()), F.upper(code))


def prompt(text: Column, target: Column, generic: str = "Simplify: %s", levelled: str = "Simplify to %s: %s") -> Column:
    """The prompt for a target level that has a name, else the general one."""
    name = F.coalesce(*(F.when(target == k, v) for k, v in lx.CEFR_NAMES.items()))
    return F.when(name.isNotNull(), F.format_string(levelled, name, text)).otherwise(F.format_string(generic, text))


def rule_rewrite(x: Column) -> Column:
    """A text in template form: trigger and condition, subject, modal token, action."""
    req = F.regexp_replace(strip(x), r"\.+$", "")
    modal = F.coalesce(*(F.when(req.rlike(whole_word(m)), t) for m, t in lx.REWRITE_MODALS), F.lit("SHALL"))
    trigger = F.coalesce(*(F.when(req.rlike("(?i)" + p), t) for p, t in lx.REWRITE_TRIGGERS))
    modals = "shall|must|should|will|may|can"
    subject = strip(F.regexp_extract(req, rf"(?i)^(.*?)\s+(?:{modals})\b", 1))
    subject = F.when((subject == "") | (F.size(tokens(subject)) > 8), "the system").otherwise(subject)
    has_action = req.rlike(rf"(?i)\b(?:{modals})\b\s+(.*)")
    action = F.when(has_action, strip(F.regexp_extract(req, rf"(?i)\b(?:{modals})\b\s+(.*)", 1))).otherwise(req)
    condition = strip(F.regexp_extract(req, rf"(?i)\b(?:if|when|whenever|while|once|after)\b(.+?)(?:,\s*|\s+(?:the\s+)?(?:\w+\s+)?(?:{modals})\b)", 1))
    plain = F.concat(F.upper(F.substring(subject, 1, 1)), F.lower(F.substring(subject, 2, 2**31 - 1)), F.lit(" "), modal, F.lit(" "), action, F.lit("."))
    return F.when(trigger.isNotNull() & (condition != ""), F.concat(trigger, F.lit(" "), condition, F.lit(", "), subject, F.lit(" "), modal, F.lit(" "), action, F.lit("."))).otherwise(plain)
