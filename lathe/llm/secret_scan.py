"""Secret scans with one combined deterministic automaton over UTF-8 bytes (see automaton.py).

Defined cases: a null or empty text has no spans; a text of any length is scanned whole, in one pass and without
copies of it; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm import common
from lathe.llm.automaton import Automaton, Rule

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _long_value(match: bytes) -> bool:
    found = _ASSIGN.fullmatch(match)
    return found is not None and len(found[1]) >= 6


#: A run of hex digits, and a run of capitals and digits after AKIA, is matched to its end either way, so their least
#: lengths stand in the rules. A short assignment uses up its characters: it is matched first and dropped after.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _long_value),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Kinds that this scanner adds to the base.
ADDED = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
RULES = [*BASE, *ADDED]


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(list(rules))


def spans(text: str, rules: tuple[Rule, ...] = tuple(RULES)) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points, by start, then rule."""
    data = text.encode("utf-8", "surrogatepass")
    found = automaton(rules).scan(data)
    if not found:
        return []
    if len(data) == len(text):
        return sorted((s, r, e) for r, s, e in found)
    edges = sorted({x for _, s, e in found for x in (s, e)})
    points, at, n = {}, 0, 0
    for x in edges:
        n += len(data[at:x].decode("utf-8", "surrogatepass"))
        points[x], at = n, x
    return sorted((points[s], r, points[e]) for r, s, e in found)


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, value>>) for each row of ``docs``; offsets in code points, end exclusive."""
    own = tuple(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        for b in batches:
            out = [[{"kind": own[r].kind, "start": s, "end": e, "value": t[s:e]} for s, r, e in spans(t, own)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return common.in_batches(common.texts(docs, id_col, text_col), run, "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string>>")


def redact(text: str, rules: tuple[Rule, ...] = tuple(RULES)) -> str:
    """Each stretch of overlapping spans becomes ``[kind]``, the kind of its first span."""
    out, at, upto = [], 0, 0
    for s, r, e in spans(text, rules):
        if s >= upto:
            out += [text[at:s], f"[{rules[r].kind}]"]
        upto = at = max(upto, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced; ``n_chars``, where there is one, follows. Null texts stay null."""
    own = tuple(rules)
    done = common.passing(docs, lambda xs: [[redact(x, own) for x in xs]], text_col, [("__lathe_redacted", pa.string(), T.StringType())])
    text = F.when(F.col(text_col).isNotNull(), F.col("__lathe_redacted"))
    changed = {text_col: text} | ({"n_chars": F.when(F.col(text_col).isNotNull() & (F.col("__lathe_redacted") != F.col(text_col)), F.length("__lathe_redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.withColumns(changed).drop("__lathe_redacted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    joined = lambda a: F.array_join(F.transform(a, text), ",")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
