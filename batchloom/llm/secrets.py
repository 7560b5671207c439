"""Secret scans in DataFrame functions: patterns with a fixed form, and tokens that two character Markov models call random."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of secret with a known form.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # whole runs of 20 or more, as AKIA[A-Z0-9]+ finds them
HEX = r"[0-9a-f]{24,}"  # whole runs of 24 or more, as [0-9a-f]+ finds them
ASSIGN_LEAST = 6

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z][A-Za-z0-9_-]{7,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODES = 128
SAMPLE_DOCUMENTS = 20_000  # about so many documents give the labelled samples
PRIOR = 1e-4  # of a token being random
CHUNK = 256


def running(lengths: Column) -> Column:
    """Sums of the array's elements before each element, by chunks, so that long arrays don't cost their square."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    n = F.size(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: add(F.slice(lengths, c * CHUNK + 1, CHUNK)))
    before = F.transform(F.sequence(F.lit(0), F.size(chunks) - 1), lambda c: add(F.slice(chunks, F.lit(1), c)))
    at = F.sequence(F.lit(0), n - 1)
    inside = lambda i: add(F.slice(lengths, (i - i % CHUNK + 1).cast("int"), (i % CHUNK).cast("int")))
    return F.transform(at, lambda i: F.element_at(before, (F.floor(i / CHUNK) + 1).cast("int")) + inside(i))


def matches(text: Column, pattern: str, kind: str, place: int, value_group: int = 0) -> Column:
    """Spans ``(start, place, end, kind, value)`` of the leftmost matches; code points, end exclusive.

    The text between the matches and the matches themselves alternate, so their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    gap = F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g: F.char_length(g))
    own = F.transform(found, lambda m: F.char_length(m))
    both = F.zip_with(gap, own, lambda g, m: g + m)
    spans = F.transform(
        F.arrays_zip(running(both).alias("before"), gap.alias("gap"), own.alias("own"), values.alias("value")),
        lambda x: F.struct(
            (x["before"] + x["gap"]).alias("start"),
            F.lit(place).alias("place"),
            (x["before"] + x["gap"] + x["own"]).alias("end"),
            F.lit(kind).alias("kind"),
            x["value"].alias("value"),
        ),
    )
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def characters(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def steps(token: Column) -> Column:
    """Codes of the character pairs of an ASCII token."""
    codes = F.transform(characters(token), lambda c: F.ascii(c))
    n = F.size(codes)
    return F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a * CODES + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each character pair from labelled ``(token, is_random)``.

    One bigram table for each label with half a count added everywhere; only these tables, bounded by the alphabet, come
    to the driver. Without samples of a label its model is uniform.
    """
    long_enough = samples.where(F.col("token").rlike("^[A-Za-z0-9+/_=-]{2,}$"))
    pairs = long_enough.select("is_random", F.explode(steps(F.col("token"))).alias("step")).groupBy("is_random", "step").count()
    tables: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in pairs.collect():
        tables[bool(row["is_random"])][row["step"]] = row["count"]
    codes = [ord(c) for c in ALPHABET]
    ratio = [0.0] * (CODES * CODES)
    logs = {}
    for label, table in tables.items():
        totals: dict[int, float] = defaultdict(float)
        for step, n in table.items():
            totals[step // CODES] += n
        logs[label] = {(a, b): math.log((table.get(a * CODES + b, 0) + 0.5) / (totals[a] + 0.5 * len(codes))) for a in codes for b in codes}
    for a in codes:
        for b in codes:
            ratio[a * CODES + b] = logs[True][a, b] - logs[False][a, b]
    return ratio


def score(token: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")
    return F.aggregate(steps(token), F.lit(0.0), lambda total, step: total + F.get(table, step))


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, "assign", 0, 2), lambda s: F.char_length(s["value"]) >= ASSIGN_LEAST)
    return F.concat(assign, matches(text, ACCESS, "access", 1), matches(text, HEX, "hex", 2))


def labelled_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``(token, is_random)`` from about ``documents`` documents: values of the base kinds, and the words of the other text."""
    step = max(1, docs.count() // documents)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(step)) == 0).select(text.alias("text"))
    secret = sample.select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.col("s.value").alias("token"), F.lit(True).alias("is_random"))
    rest = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    ordinary = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("token")).select("token", F.lit(False).alias("is_random"))
    return secret.where(F.char_length("token") >= 16).unionByName(ordinary)


def find_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """``(doc_id, base, added)`` for every row: arrays of ``(start, place, end, kind, value)``, sorted by start and kind.

    ``base`` has the three kinds of known form; each is matched for itself. ``added`` has tokens of 20 or more
    characters that are random by the log-likelihood ratio at the ``prior`` and overlap no base span.

    Null texts count as empty; every row is judged by itself, so repeated rows and ids don't matter; no other column is
    read; an empty table gives no rows.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spanned = chosen.select("doc_id", F.array_sort(base_spans(F.col("text"))).alias("base"), matches(F.col("text"), TOKEN, "markov", 3).alias("tokens"))
    random = F.filter("tokens", lambda t: score(t["value"], model) > math.log((1 - prior) / prior))
    free = F.filter(random, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return spanned.select("doc_id", "base", free.alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
