"""Secret scans: three patterns, and Shannon entropy in a window that slides over candidate strings.

The patterns find assignments to names that mean a secret, access keys, and long runs of hexadecimal digits. A
candidate is a run of at least ``WINDOW`` characters of the kinds that keys are made of. A window of that many
characters slides over it; how often each character stands in the window is kept by adding the one that enters and
taking off the one that leaves, and with it the sum of ``c log2 c``, from which the entropy follows. Each class of
characters has its own bound. Known harmless strings are on an allow-list: identifiers in groups, runs of the
alphabet, placeholders, digests of nothing, plain numbers.

A candidate may join fields by separators. Patterns' spans and harmless fields are taken out of it first, and each rest
that is long enough is a candidate of its own.

Everything is built from string and array expressions inside the row, so nothing is shuffled. Places come from the
texts between the matches: their lengths are summed in blocks, so that a text full of matches costs in proportion.

Defined results: no text is an empty one and has no spans. Places count code points, ends being exclusive. What a
pattern's span covers is not told again. Other columns pass through; one called like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import free_name, put

WINDOW = 20
BLOCK = 256
REDACTED = "[SECRET]"

# What is looked for, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "entropy")
_NAMES = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = _NAMES + r"[A-Za-z0-9+/_.=-]+"
ASSIGNED = f"^{_NAMES}(.*)$"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

# Harmless strings, digests by their own length.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9+/_=-]*$|"
    r"^sha256-[A-Za-z0-9+/]{43}=?$|^sha384-[A-Za-z0-9+/]{64}$|^sha512-[A-Za-z0-9+/]{86}={0,2}$|"
    r"^(da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e)$"
)
# What makes a field between separators harmless.
ALLOWED_FIELD = r"([^\x20])\1{7}|(?i:example|placeholder|changeme|^your$|dummy|sample|abcdefgh|01234567|12345678|qwerty)"
EDGES = r"(?<=[\x20+/_=-])|(?=[\x20+/_=-])"


def _bound(s: str) -> str:
    """Bits a window must hold, by the class of characters of the candidate."""
    return (
        f"case when {s} rlike '^([0-9a-f]+|[0-9A-F]+)$' then 3.0D when {s} rlike '^([a-z]+|[A-Z]+)$' then 4.2D"
        f" when not {s} rlike '[0-9]' then 4.2D when {s} rlike '^([0-9a-z]+|[0-9A-Z]+)$' then 3.7D else 3.8D end"
    )


def _weight(c: str) -> str:
    return f"if({c} > 1, {c} * log2({c}), 0D)"


def _top_entropy(s: str) -> str:
    """The largest entropy of any window of the string expression, in bits."""
    start = (
        "struct(transform(letters, l -> 0) as counts, cast(0 as double) as total, cast(0 as double) as best)"
    )
    entering, leaving = "cast(array_position(letters, chars[i]) as int)", f"cast(array_position(letters, chars[i - {WINDOW}]) as int)"
    changed = f"transform(a.counts, (c, j) -> c + if(j + 1 = {entering}, 1, 0) - if(i >= {WINDOW} and j + 1 = ifnull({leaving}, 0), 1, 0))"
    up = f"element_at(a.counts, {entering})"
    same = f"i >= {WINDOW} and {entering} = {leaving}"
    down = f"element_at(a.counts, {leaving})"
    total = (
        f"case when {same} then a.total when i >= {WINDOW} then a.total + {_weight(f'({up} + 1)')} - {_weight(up)} + {_weight(f'({down} - 1)')} - {_weight(down)}"
        f" else a.total + {_weight(f'({up} + 1)')} - {_weight(up)} end"
    )
    step = (
        f"(a, i) -> element_at(transform(array({total}), t -> struct({changed} as counts, t as total,"
        f" if(i >= {WINDOW - 1}, greatest(a.best, log2({WINDOW}) - t / {WINDOW}), a.best) as best)), 1)"
    )
    return (
        f"element_at(transform(array(split({s}, '')), chars -> element_at(transform(array(array_distinct(chars)), letters -> "
        f"aggregate(sequence(0, size(chars) - 1), {start}, {step}, a -> a.best)), 1)), 1)"
    )


def _running(items: str) -> str:
    """The sums of an array of whole numbers up to and with each element, taken in blocks."""
    blocks = f"sequence(0, cast((greatest(size({items}), 1) - 1) div {BLOCK} as int))"
    part = f"slice({items}, b * {BLOCK} + 1, {BLOCK})"
    heads = (
        f"aggregate({blocks}, array(cast(0 as bigint)), (a, b) -> concat(a, array(element_at(a, -1) + "
        f"aggregate({part}, cast(0 as bigint), (s, x) -> s + x))))"
    )
    inner = f"aggregate({part}, array(heads[b]), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    return f"element_at(transform(array({heads}), heads -> flatten(transform({blocks}, b -> slice({inner}, 2, {BLOCK})))), 1)"


def _spans(text: str, pattern: str, kind: int) -> Column:
    """``start, kind, stop, said`` of every match."""
    return F.expr(_spans_sql(text, pattern, kind))


def _spans_sql(text: str, pattern: str, kind: int) -> str:
    literal = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    sums = _running("lengths")
    return (
        f"element_at(transform(array(regexp_extract_all({text}, {literal}, 0)), m -> if(size(m) = 0, "
        "cast(array() as array<struct<start:bigint,kind:int,stop:bigint,said:string>>), "
        f"element_at(transform(array(zip_with(slice(split({text}, {literal}, -1), 1, size(m)), m, (g, x) -> "
        f"cast(length(g) + length(x) as bigint))), lengths -> element_at(transform(array({sums}), ends -> "
        f"transform(m, (x, i) -> struct(ends[i] - length(x) as start, {kind} as kind, ends[i] as stop, x as said))), 1)), 1))), 1)"
    )


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: an array of ``start, kind, stop, said`` in order of start, then kind; ``kind`` counts in ``KINDS``."""
    body = free_name(df, "_body")
    names = [free_name(df, f"_{k}") for k in KINDS]
    looked = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    for i, (name, pattern) in enumerate(zip(names, (ASSIGN, ACCESS, HEX, CANDIDATE))):
        looked = looked.withColumn(name, _spans(f"`{body}`", pattern, i))
    kept = F.filter(names[0], lambda s: F.length(F.regexp_extract(s["said"], ASSIGNED, 1)) >= 6)
    based = looked.withColumn(names[0], F.concat(kept, F.col(names[1]), F.col(names[2]))).drop(names[1], names[2])

    # Same length as the candidate: spaces for what the patterns' spans cover, then for harmless fields.
    def uncovered(c: Column) -> Column:
        inside = F.filter(names[0], lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))

        def blank(m: Column, b: Column) -> Column:
            start, stop = F.greatest(b["start"], c["start"]), F.least(b["stop"], c["stop"])
            n = (stop - start).cast("int")
            return F.overlay(m, F.repeat(F.lit(" "), n), (start - c["start"] + 1).cast("int"), n)

        fields = F.split(F.aggregate(inside, c["said"], blank), EDGES, -1)
        kept = F.transform(fields, lambda x: F.when(x.rlike(ALLOWED_FIELD), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
        return F.struct(c["start"].alias("start"), F.array_join(kept, "").alias("rest"))

    told = based.withColumn(f"_rest_{names[3]}", F.transform(F.filter(names[3], lambda c: ~c["said"].rlike(ALLOWED)), uncovered))
    runs = _spans_sql("cand.rest", CANDIDATE, 3)
    moved = f"transform({runs}, r -> struct(r.start + cand.start as start, r.kind as kind, r.stop + cand.start as stop, r.said as said))"
    free = F.filter(F.flatten(F.expr(f"transform(`_rest_{names[3]}`, cand -> {moved})")), lambda s: ~s["said"].rlike(ALLOWED))
    high = F.expr(f"filter(`_free_{names[3]}`, s -> {_top_entropy('s.said')} >= {_bound('s.said')})")
    told = told.withColumn(f"_free_{names[3]}", free).drop(f"_rest_{names[3]}")
    spans = F.array_sort(F.concat(F.col(names[0]), high))
    return put(told, {"spans": spans}).drop(body, names[0], names[3], f"_free_{names[3]}")


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The text with every span replaced by ``REDACTED``; a text without spans stays as it is."""
    scanned = scan(df, text)
    masked = F.col(text)
    strong = _NAMES + r"[A-Za-z0-9+/_.=-]{6,}"
    for pattern in (strong, ACCESS, HEX):
        masked = F.regexp_replace(masked, pattern, REDACTED)
    extra = F.array_distinct(F.transform(F.filter("spans", lambda s: s["kind"] == 3), lambda s: s["said"]))
    # Longest first, as one may be a part of another.
    extra = F.transform(F.sort_array(F.transform(extra, lambda s: F.struct(F.length(s).alias("n"), s.alias("said"))), asc=False), lambda x: x["said"])
    masked = F.aggregate(extra, masked, lambda t, s: F.replace(t, s, F.lit(REDACTED)))
    return put(scanned, {text: F.when(F.size("spans") > 0, masked).otherwise(F.col(text))})
