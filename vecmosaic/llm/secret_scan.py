"""Secret scans in DataFrame expressions only.

Three fixed patterns find assigned credentials, access keys and hexadecimal keys.  Beside them,
candidate strings get the Shannon entropy of a sliding window, computed from symbol counts that
change by one entering and one leaving character; thresholds go by character class, and an allow
list suppresses identifiers, paths and strings the patterns already report.  Placeholders only
suppress themselves: what is left on either side of one is judged by itself.

Offsets are code points, ends exclusive.  A match's offset comes from the lengths of the pieces
that splitting by the same pattern leaves, so no function has to run outside the JVM.  Running
sums over the matches of a text go in runs of ``RUN`` of them: arrays grow within a run and runs
are flattened at the end, so the work stays in proportion to the text.  The expressions are put together as SQL text, which
one call hands to the parser.  A candidate is cut into
its characters once; each step reads the entering and the leaving one from the array's element
and changes one packed count for each.

Defined results: a null text is empty and has no secrets; repeated rows are scanned one by one;
an empty table gives an empty result; very long texts and very long candidates are scanned whole;
other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count as numbers
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmosaic.llm.names import unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
RUN = 64
#: Counts of at most ``2 ** _BITS - 1`` are packed into longs; candidates hold code points from ``_LOW`` to ``_HIGH`` only.
_LOW, _HIGH, _BITS = 43, 122, 5
_EACH = 60 // _BITS
_STRETCH = 1024
_SPAN = "struct<s:int,o:int,e:int,m:string>"


@dataclass(frozen=True)
class SecretOptions:
    window: int = 20
    #: Character classes, the narrowest first, with the entropy in bits from which a window is a secret.
    classes: tuple[tuple[str, str, float], ...] = (
        ("hex", r"^[0-9a-fA-F]+$", 3.0),
        ("lower", r"^[a-z0-9]+$", 3.7),
        ("upper", r"^[A-Z0-9]+$", 3.7),
        ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7),
        ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
    )
    allowed: tuple[str, ...] = (
        r"^[A-Za-z+/_=-]+$",  # no digit: words that run together
        r"^[0-9+/_=-]+$",  # no letter: numbers, dates, rules
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
        r"^/?[A-Za-z_-]++[0-9]{0,3}+(?:/[A-Za-z_-]++[0-9]{0,3}+)++/?$",  # paths
        # words and short numbers with a sign between any two: slugs, dates, paths
        r"^[/_+=-]*+(?:[A-Za-z]++|[vT]?[0-9]{1,4}(?![0-9]))(?:[/_+=-]++(?:[A-Za-z]++(?![0-9])|[vT]?[0-9]{1,4}(?![0-9])(?:T(?=[0-9]))?(?:(?<=T)[0-9]{1,4})?))++[/_+=-]*+$",
        # words joined by capitals, signs and short numbers: names in programs
        r"^[/_+=-]*+(?:(?:[A-Z]?[a-z]{2,}+|(?:By|Id|In|Is|Of|On|Or|To|At|As|No)(?![a-z])|[A-Z]{2,6}(?![a-z])|[0-9]{1,4}+(?![0-9a-z]))[/_+=-]*+)++$",
    )
    #: Parts that aren't secret; what lies between them is judged by itself if it fills a window.
    parts: str = r"(?i:example|sample|dummy|changeme|placeholder|redacted|xxxxx)|0123456789|abcdefghij|ABCDEFGHIJ"
    replacement: str = "[REDACTED]"

    def __post_init__(self) -> None:
        if not 1 <= self.window < 1 << _BITS:
            raise ValueError(f"a window holds 1 to {(1 << _BITS) - 1} characters")


_names = numbers()


def _name() -> str:
    """A name for a lambda's variable that no other one has."""
    return f"v{next(_names)}"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once, however often the body names it."""
    x = _name()
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


def _runs(a: str) -> str:
    i = _name()
    return f"transform(sequence(1, size({a}), {RUN}), {i} -> slice({a}, {i}, {RUN}))"


def _scan(items: str, state: str, step: Callable[[str, str], tuple[str, str]], kind: str) -> str:
    """The outputs of a running computation over an array: ``step`` gives the next state and an output of type ``kind``.

    The states at the starts of runs are found first; each run's outputs then grow by themselves.
    """
    none = f"cast(array() as array<{kind}>)"
    acc, x, part, r = _name(), _name(), _name(), _name()
    after, out = step(f"{acc}.at", x)
    one = f"({acc}, {x}) -> named_struct('at', {after}, 'out', concat({acc}.out, array({out})))"
    through = f"({acc}, {part}) -> named_struct('at', aggregate({part}, {acc}.at, ({r}, {x}) -> {step(r, x)[0]}), 'starts', concat({acc}.starts, array({acc}.at)))"

    def over(parts: str) -> str:
        starts = f"aggregate({parts}, named_struct('at', {state}, 'starts', slice(array({state}), 1, 0)), {through}, {acc} -> {acc}.starts)"
        grown = f"aggregate({r}.p, named_struct('at', {r}.at, 'out', {none}), {one}, {acc} -> {acc}.out)"
        return f"flatten(transform(zip_with({parts}, {starts}, ({x}, {acc}) -> named_struct('p', {x}, 'at', {acc})), {r} -> {grown}))"

    # the identity makes a plain array of one that is packed in a row, whose slices would unpack all of it
    return f"CASE WHEN size({items}) > 0 THEN {_let(f'transform({items}, {x} -> {x})', lambda plain: _let(_runs(plain), over))} ELSE {none} END"


def _found(text: str, pattern: str, kind: int, group: int = 0) -> str:
    """array<struct<s, o, e, m>>: start, kind's order, end and group of each match, leftmost first."""
    p = _text(pattern)

    def step(at: str, x: str) -> tuple[str, str]:
        start, end = f"{at} + length({x}.gap)", f"{at} + length({x}.gap) + length({x}.whole)"
        return end, f"named_struct('s', {start}, 'o', {kind}, 'e', {end}, 'm', {x}.part)"

    def spans(whole: str) -> str:
        part = f"regexp_extract_all({text}, {p}, {group})" if group else whole
        return _let(_zipped(text, p, whole, part), lambda z: _scan(z, "0", step, _SPAN))

    return f"CASE WHEN {text} rlike {p} THEN {_let(f'regexp_extract_all({text}, {p}, 0)', spans)} ELSE cast(array() as array<{_SPAN}>) END"


def _zipped(text: str, p: str, whole: str, part: str) -> str:
    """(gap before a match, the match, its group); the gap after the last match is left out."""
    gap, m, x = _name(), _name(), _name()
    pairs = f"zip_with(slice(split({text}, {p}, -1), 1, size({whole})), {whole}, ({gap}, {m}) -> named_struct('gap', {gap}, 'whole', {m}))"
    return f"zip_with({pairs}, {part}, ({x}, {m}) -> named_struct('gap', {x}.gap, 'whole', {x}.whole, 'part', {m}))"


def _entropy(text: str, window: int) -> str:
    longs = (_HIGH - _LOW) // _EACH + 1
    weight = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 2)) + ")"
    place = lambda c: f"named_struct('k', cast((ascii({c}) - {_LOW}) div {_EACH} as int), 'at', (ascii({c}) - {_LOW}) % {_EACH} * {_BITS}, 'one', shiftleft(1L, (ascii({c}) - {_LOW}) % {_EACH} * {_BITS}))"
    held = lambda n, q: f"cast(shiftright(get({n}, {q}.k), {q}.at) & {(1 << _BITS) - 1} as int)"
    acc, x, v, k, c, y = (_name() for _ in range(6))
    size = f"least({acc}.size + 1, {window})"
    same = f"coalesce({x}.come.one = {x}.go.one AND {x}.come.k = {x}.go.k, false)"
    counts = f"transform({acc}.n, ({v}, {k}) -> {v} + IF({k} = {x}.come.k, {x}.come.one, 0L) - IF({k} = {x}.go.k, {x}.go.one, 0L))"
    lost = _let(f"coalesce({held(f'{acc}.n', f'{x}.go')}, 0)", lambda g: f"get({weight}, greatest({g} - 1, 0)) - get({weight}, {g})")
    won = _let(f"{held(f'{acc}.n', f'{x}.come')} - cast({same} as int)", lambda h: f"get({weight}, {h} + 1) - get({weight}, {h})")

    def ended(total: str) -> str:
        best = f"IF({size} = {window} OR {x}.last, greatest({acc}.best, log2(cast({size} as double)) - {total} / {size}), {acc}.best)"
        return f"named_struct('n', {counts}, 'size', {size}, 'sum', {total}, 'best', {best})"

    def over(places: str) -> str:
        before = f"slice(concat(array_repeat(cast(null as struct<k:int,at:int,one:bigint>), {window}), {places}), 1, size({places}))"
        moves = f"transform(zip_with({places}, {before}, ({x}, {y}) -> named_struct('come', {x}, 'go', {y})), ({x}, {k}) -> named_struct('come', {x}.come, 'go', {x}.go, 'last', {k} = size({places}) - 1))"
        zero = f"named_struct('n', array_repeat(0L, {longs}), 'size', 0, 'sum', 0D, 'best', 0D)"
        return f"aggregate({moves}, {zero}, ({acc}, {x}) -> {_let(f'{acc}.sum + {lost} + {won}', ended)}, {acc} -> {acc}.best)"

    places = f"transform(filter(split({text}, ''), {c} -> {c} <> ''), {c} -> {place(c)})"
    return f"CASE WHEN length({text}) > 0 THEN {_let(places, over)} ELSE 0D END"


def window_entropy(text: str, window: int) -> Column:
    """The largest Shannon entropy in bits of any ``window`` characters in a row (of all, if fewer).

    Counts by symbol are packed into a few longs.  A step takes one off the leaving character's
    count and adds one to the entering one's, and the sum of c * log2(c) changes by those two terms.
    """
    return F.expr(_entropy(text, window))


def _has_random_part(text: str, window: int, least: str) -> str:
    """Whether any window reaches ``least`` bits; looks no further than the stretch in which one does."""
    i = _name()
    stretch = f"substr({text}, {i} + 1, {_STRETCH + window - 1})"
    starts = f"sequence(0, greatest(length({text}) - {window}, 0), {_STRETCH})"
    return f"exists({starts}, {i} -> {_let(stretch, lambda y: _entropy(y, window))} >= {least})"


def _apart(base: str, cand: str) -> str:
    """The candidates that touch no base span, by one scan in each direction over all in order."""
    flagged = "struct<s:int,o:int,e:int,m:string,hit:boolean>"
    span = lambda x: f"'s', {x}.s, 'o', {x}.o, 'e', {x}.e, 'm', {x}.m"
    forth = lambda at, x: (f"IF({x}.o < 3, greatest({at}, {x}.e), {at})", f"named_struct({span(x)}, 'hit', {at} > {x}.s)")
    back = lambda at, x: (f"IF({x}.o < 3, least({at}, {x}.s), {at})", f"named_struct({span(x)}, 'hit', {x}.hit OR {at} < {x}.e)")
    ahead = _let(f"sort_array(concat({base}, {cand}))", lambda a: _scan(a, "0", forth, flagged))
    both = _let(f"reverse({ahead})", lambda a: _scan(a, str((1 << 31) - 1), back, flagged))
    x = _name()
    return f"transform(filter({both}, {x} -> {x}.o = 3 AND NOT {x}.hit), {x} -> named_struct({span(x)}))"


def with_spans(df: DataFrame, text: str, base: str, spans: str, options: SecretOptions = SecretOptions()) -> DataFrame:
    """The input with the columns ``base`` and ``spans``: sorted arrays of struct<s, o, e, m>."""
    cand, body = unused(df, "cand", "body")
    x = _name()
    fixed = f"filter({_found(f'`{body}`', ASSIGN, 0, 2)}, {x} -> length({x}.m) >= 6), {_found(f'`{body}`', ACCESS, 1)}, {_found(f'`{body}`', HEX, 2)}"

    def limit(y: str) -> str:
        cases = " ".join(f"WHEN {y} rlike {_text(p)} THEN {least}D" for _, p, least in options.classes[:-1])
        return f"CASE {cases} ELSE {options.classes[-1][2]}D END"

    def random(y: str) -> str:
        return _let(limit(y), lambda least: _has_random_part(y, options.window, least))

    def allowed(y: str) -> str:
        return "(" + " OR ".join(f"{y} rlike {_text(p)}" for p in options.allowed) + ")"

    def secret(y: str) -> str:
        z = _name()
        part = f"CASE WHEN length({z}) >= {options.window} AND NOT {allowed(z)} THEN {random(z)} ELSE false END"
        return f"CASE WHEN {allowed(y)} THEN false WHEN {y} rlike {_text(options.parts)} THEN exists(split({y}, {_text(options.parts)}, -1), {z} -> {part}) ELSE {random(y)} END"

    alone = f"CASE WHEN size(`{base}`) > 0 THEN {_apart(f'`{base}`', f'`{cand}`')} ELSE `{cand}` END"
    random_ones = f"filter({alone}, {x} -> {secret(f'{x}.m')})"
    # both arrays are read more than once, so each stays a column of its own
    return (
        df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
        .withColumns({base: F.expr(f"sort_array(concat({fixed}))"), cand: F.expr(_found(f"`{body}`", CANDIDATE, 3))})
        .withColumn(spans, F.expr(f"CASE WHEN size(`{cand}`) > 0 THEN sort_array(concat(`{base}`, {random_ones})) ELSE `{base}` END"))
        .drop(cand, body)
    )


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame, options: SecretOptions = SecretOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the counts by pattern, the digest of the base spans, and all spans."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["o"] == k)).cast("long")
    return with_spans(narrow, "text", "base", "found", options).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
    )


def redacted(docs: DataFrame, options: SecretOptions = SecretOptions(), text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The input with every found span of the text replaced; spans that touch the last one merge into it."""
    cols = docs.columns
    base, spans, clean = unused(docs, "base", "spans", "clean")
    found = with_spans(docs, text, base, spans, options)

    def merged(reach: str, x: str) -> tuple[str, str]:
        """A span that begins in an earlier one only continues it: it copies nothing and starts where that ended."""
        to = f"greatest({reach}, {x}.e)"
        return to, f"named_struct('a', {reach}, 'b', greatest({reach}, {x}.s), 'e', {to}, 'fresh', {x}.s >= {reach})"

    def run_of(part: str) -> str:
        """The text up to the end of a run's last span; the run's own stretch is cut out once."""
        x, first = _name(), f"element_at({part}, 1).a"
        piece = lambda own: f"IF({x}.fresh, concat(substr({own}, {x}.a - {first} + 1, {x}.b - {x}.a), {_text(options.replacement)}), '')"
        return _let(f"substr({body}, {first} + 1, element_at({part}, -1).e - {first})", lambda own: f"array_join(transform({part}, {x} -> {piece(own)}), '')")

    def rebuilt(c: str) -> str:
        x = _name()
        return f"concat(array_join(transform({_runs(c)}, {x} -> {run_of(x)}), ''), substr({body}, element_at({c}, -1).e + 1))"

    body = f"`{text}`"
    cuts = _scan(f"`{spans}`", "0", merged, "struct<a:int,b:int,e:int,fresh:boolean>")
    found = found.withColumn(clean, F.expr(f"CASE WHEN size(`{spans}`) > 0 THEN {_let(cuts, rebuilt)} ELSE {body} END"))
    new = {text: F.col(clean)}
    if n_chars in cols:
        new[n_chars] = F.when(F.size(spans) > 0, F.length(clean).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in cols])
