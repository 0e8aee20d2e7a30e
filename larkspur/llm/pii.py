"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans, overlapping ones too: the base patterns of each kind and wider ones (obfuscated
addresses, numbers without a plus sign, numbers inside longer runs, IPv6). Boosted trees of depth two,
fitted on built-in labelled snippets, use features of a span's format and of the text around it. Each kind
has a threshold, the smallest whose precision on snippets that the fit left out is at least PRECISION. A
span is kept if it is a valid match of its base pattern (always), or if its probability reaches the
threshold and it overlaps no base span of its kind. Trees become CASE expressions of the plan.

Null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows are judged alike.
Very long texts are searched whole, in time that grows as their length and the number of matches: patterns
use possessive repeats, running offsets are folded in blocks (`scan`), and context is cut from pieces of the
text (`cut`). An empty table gives an empty result; other columns of the input pass through find_pii, but for
names that begin with larkspur_, which are replaced. Base patterns with anchors give the same leftmost matches as without (see PATTERNS).
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.97
TREES, RATE = 40, 0.3

#: (kind, pattern, text that must occur). The first four are the base patterns: a run is only entered at
#: its start (or, for addresses, where the last match ended), since a match that could begin inside a run
#: would have begun at its start; runs are possessive, since giving back a character never helps.
PATTERNS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+", ""),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++", "at"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5})(?![0-9])", ""),
    ("phone", r"(?<![0-9])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", "("),
    ("phone", r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", ""),
    ("phone", r"(?<![0-9])00[1-9][0-9]{0,2}[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", "00"),
)
#: What every match of a generator without such a text holds.
DIGITS = {2: "[0-9][ -]?[0-9]", 6: "[0-9]{3}", 8: "[0-9]{3}"}
BASES = 4
GOOD = (r"mail|e-mail|contact|write|reach", r"\bip\b|host|server|address|login|from", r"card|visa|master|credit|pay|pan\b", r"phone|tel|call|mobile|fax|cell|reach|contact")
BAD = r"version|\bv$|isbn|order|invoice|section|chapter|figure|serial|tracking|build|release|sku|part no|date|issn|\bid\b"


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0).otherwise(F.lit(False))


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind passes its check."""
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
        return F.when(F.contains(m, F.lit(":")), F.lit(True)).otherwise(small)
    if kind == "card":
        d = digits_of(m)
        return F.when((F.length(d) >= 14) & (F.length(d) <= 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(m)).between(10, 15)
    return F.lit(True)


SPAN = "struct<start:int,end:int,kind:int,generator:int,text:string>"
#: Elements that a scan folds at a time, and characters of a piece of text.
BLOCK, PIECE = 128, 1024


def let(value: str, name: str, use: str) -> str:
    """SQL of `use` with `name` for the value, computed once: a lambda would compute an expression at each element."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def scan(items: str, zero: str, step, emit) -> str:
    """SQL of the array emit(state, x) of each element, its state folded by step over the elements before it.

    Arrays are immutable, so appending one by one would take the square of their length. States at the starts
    of blocks are found first; then each block is folded by itself. (SQL text, since so many lambdas built
    call by call would take seconds.)
    """
    part = f"slice(own, b * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, cast((size(own) - 1) div {BLOCK} as int))"
    after = let(f"aggregate({part}, acc.state, (st, x) -> {step('st', 'x')})", "nx", "named_struct('state', nx, 'seen', concat(acc.seen, array(nx)))")
    starts = f"aggregate({blocks}, named_struct('state', {zero}, 'seen', array({zero})), (acc, b) -> {after}, acc -> acc.seen)"
    # the first element makes the array, which gives it its type
    first = f"named_struct('state', {step('states[b]', 'xs[0]')}, 'out', array({emit('states[b]', 'xs[0]')}))"
    add = f"(acc, x) -> named_struct('state', {step('acc.state', 'x')}, 'out', concat(acc.out, array({emit('acc.state', 'x')})))"
    block = let(part, "xs", f"aggregate(slice(xs, 2, {BLOCK}), {first}, {add}, acc -> acc.out)")
    return let(items, "own", let(starts, "states", f"flatten(transform({blocks}, b -> {block}))"))


def sql(column: Column) -> str:
    """SQL text of a column that is named or simply made."""
    return column._jc.node().sql()


def pieces_of(text: Column) -> Column:
    return F.expr(pieces_sql(sql(text)))


def pieces_sql(text: str) -> str:
    """The text in pieces of PIECE characters: a substring of the whole would be counted from its first byte."""
    return f"if(length({text}) <= {PIECE}, array({text}), regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0))"


def cut(pieces: str, start: str, n: str) -> str:
    """SQL of n characters from `start` (from 0) of a text in pieces."""
    some = f"slice({pieces}, cast(({start}) div {PIECE} + 1 as int), cast(({start} + {n} - 1) div {PIECE} - ({start}) div {PIECE} + 1 as int))"
    return f"if({n} > 0, substring(array_join({some}, ''), cast(({start}) % {PIECE} + 1 as int), {n}), '')"


def matches(text: Column, generator: int) -> Column:
    """Array of a generator's leftmost matches with their places."""
    kind, pattern, needed = PATTERNS[generator]
    name = sql(text)
    each = "transform(found, (m, i) -> named_struct('gap', length(gaps[i]), 'long', length(m), 'text', m))"
    step = lambda at, x: f"{at} + {x}.gap + {x}.long"
    span = lambda at, x: f"named_struct('start', {at} + {x}.gap, 'end', {step(at, x)}, 'kind', {KINDS.index(kind)}, 'generator', {generator}, 'text', {x}.text)"
    empty = f"cast(array() as array<{SPAN}>)"
    placed = let(f"split({name}, r'{pattern}', -1)", "gaps", scan(each, "0", step, span))
    some = let(f"regexp_extract_all({name}, r'{pattern}', 0)", "found", f"if(size(found) > 0, {placed}, {empty})")
    possible = f"contains({name}, '{needed}')" if needed else f"rlike({name}, r'{DIGITS[generator]}')"
    return F.expr(f"if({possible}, {some}, {empty})")


FEATURES = ("kind", "generator", "length", "digits", "marks", "groups", "passes", "before_word", "after_word", "good", "bad", "last_letters", "different")


def features(text: Column, s: Column) -> list[Column]:
    """Format and context of a span (a named column), as doubles in the order of FEATURES."""
    name, name_of_text = sql(s), sql(text)
    around = F.expr(let(pieces_sql(name_of_text), "pieces", context("pieces", name)))
    return features_of(s, around)


def context(pieces: str, s: str) -> str:
    """SQL of (24 characters before, one before, one after) of a span of a text in pieces."""
    at = f"greatest({s}.start - 24, 0)"
    return f"named_struct('far', lower({cut(pieces, at, f'({s}.start - {at})')}), 'before', {cut(pieces, f'greatest({s}.start - 1, 0)', f'least({s}.start, 1)')}, 'after', {cut(pieces, f'{s}.end', '1')})"


def features_of(s: Column, around: Column) -> list[Column]:
    m = s["text"]
    d = digits_of(m)
    before = around["far"]
    word = "^[\\p{N}\\p{L}]$"
    by_kind = lambda make: F.when(s["kind"] == 0, make(0)).when(s["kind"] == 1, make(1)).when(s["kind"] == 2, make(2)).otherwise(make(3))
    columns = (
        s["kind"],
        s["generator"],
        F.length(m),
        F.length(d),
        F.length(F.regexp_replace(m, "[\\p{N}\\p{L}]", "")),
        F.size(F.regexp_extract_all(m, F.lit("[\\p{N}\\p{L}]+"), F.lit(0))),
        by_kind(lambda k: valid(KINDS[k], m)),
        F.rlike(around["before"], F.lit(word)),
        F.rlike(around["after"], F.lit(word)),
        by_kind(lambda k: F.rlike(before, F.lit(GOOD[k]))),
        F.rlike(before, F.lit(BAD)),
        F.length(F.regexp_extract(m, "[A-Za-z]*$", 0)),
        F.size(F.array_distinct(F.split(d, ""))),
    )
    return [c.cast("double") for c in columns]


# --- the built-in labelled snippets -----------------------------------------------------------------


def _with_luhn(digits: str) -> str:
    for last in "0123456789":
        total = 0
        for i, c in enumerate(reversed(digits + last)):
            n = int(c) * (1 + i % 2)
            total += n - 9 * (n > 9)
        if total % 10 == 0:
            return digits + last
    raise AssertionError


def snippets(n: int = 40, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, kind, label): made-up snippets in which every candidate of the kind has the label."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghklmnoprstuvw") for _ in range(r.randint(3, 9)))
    fill = lambda: " ".join(name() for _ in range(r.randint(1, 5)))
    four = lambda d: " ".join(d[i : i + 4] for i in range(0, 16, 4))
    made: list[tuple[str, str, int]] = []
    for _ in range(n):
        card, wrong = _with_luhn("4" + number(14)), _with_luhn("5" + number(14))
        wrong = wrong[:-1] + str((int(wrong[-1]) + r.randint(1, 9)) % 10)
        area, line = str(r.randint(201, 989)), number(4)
        made += [
            (f"{fill()} {name()}.{number(2)}@{name()}.com {fill()}", "email", 1),
            (f"write {name()} (at) {name()} (dot) org {fill()}", "email", 1),
            (f"contact {name()}[at]{name()}.net, {fill()}", "email", 1),
            (f"{fill()} @ {name()}. {fill().capitalize()}", "email", 0),
            (f"meet {name()} @ {number(2)}.{number(2)} {fill()}", "email", 0),
            (f"{fill()} {r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)} {fill()}", "ip", 1),
            (f"host {':'.join('%x' % r.randint(1, 65535) for _ in range(8))} {fill()}", "ip", 1),
            (f"section {r.randint(1, 30)}.{r.randint(256, 999)}.{r.randint(256, 999)}.{r.randint(1, 9)} {fill()}", "ip", 0),
            (f"{fill()} {number(4)}.{r.randint(300, 999)}.{number(3)}.{r.randint(256, 999)} {fill()}", "ip", 0),
            (f"{fill()} {card} {fill()}", "card", 1),
            (f"card {four(card)} {fill()}", "card", 1),
            (f"pay with {four(card).replace(' ', '.')} {fill()}", "card", 1),
            (f"{fill()} +1 ({area}) 555-{line} {card} {fill()}", "card", 1),
            (f"order {wrong} {fill()}", "card", 0),
            (f"{fill()} {four(wrong)} {fill()}", "card", 0),
            (f"tracking {number(13)} {fill()}", "card", 0),
            (f"{fill()} {number(24)} {fill()}", "card", 0),
            (f"{fill()} +1 ({area}) 555-{line} {fill()}", "phone", 1),
            (f"call ({area}) 555-{line} {fill()}", "phone", 1),
            (f"tel {area}-555-{line}, {fill()}", "phone", 1),
            (f"mobile 0049 {r.randint(151, 179)} {number(4)} {number(4)} {fill()}", "phone", 1),
            (f"{fill()} {area}.555.{line} {fill()}", "phone", 1),
            (f"isbn {number(3)}-{number(3)}-{number(4)} {fill()}", "phone", 0),
            (f"serial 00{r.randint(1, 9)}{number(11)} {fill()}", "phone", 0),
            (f"part no {number(3)} {number(3)} {number(4)} {fill()}", "phone", 0),
            (f"order {number(3)}-{number(3)}-{number(4)} {fill()}", "phone", 0),
        ]
    return made


# --- boosting on the driver, over the few rows of the snippets ---------------------------------------


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple  # (feature, cut, (feature, cut, low, high), (feature, cut, low, high))
    thresholds: tuple[float, ...]

    def column(self, values: list[Column]) -> Column:
        """Probability as an expression over the features."""
        leaf = lambda t: F.when(values[t[0]] <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))
        total = F.lit(self.base)
        for f, cut, low, high in self.trees:
            total = total + F.when(values[f] <= cut, leaf(low)).otherwise(leaf(high))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        leaf = lambda t, x: np.where(x[:, t[0]] <= t[1], t[2], t[3])
        total = np.full(len(x), self.base)
        for f, cut, low, high in self.trees:
            total += np.where(x[:, f] <= cut, leaf(low, x), leaf(high, x))
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> tuple[float, tuple]:
    """Logistic gradient boosting with trees of depth two and exact splits."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    total, made = np.full(len(y), base), []
    cuts = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best, where = -1.0, (0, math.inf)
        for f, values in enumerate(cuts):
            for cut in values:
                low = rows & (x[:, f] <= cut)
                high = rows & ~(x[:, f] <= cut)
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
                if gain > best + 1e-12:
                    best, where = gain, (f, float(cut))
        return where

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        everything = np.ones(len(y), bool)
        f, cut = split(everything, g, h)
        tree = [f, cut]
        for side in (x[:, f] <= cut, x[:, f] > cut):
            sf, sc = split(side, g, h)
            leaves = []
            for part in (side & (x[:, sf] <= sc), side & (x[:, sf] > sc)):
                leaves.append(float(rate * g[part].sum() / (h[part].sum() + 1)))
                total[part] += leaves[-1]
            tree.append((sf, sc, *leaves))
        made.append(tuple(tree))
    return base, tuple(made)


def candidates(text: Column) -> Column:
    return F.concat(*[matches(text, g) for g in range(len(PATTERNS))])


def fit_model(spark: SparkSession) -> Model:
    """Fit on the built-in snippets; the features come from the same expressions as in the query."""
    frame = spark.createDataFrame([(i, *s) for i, s in enumerate(snippets())], "snippet int, text string, kind string, label int").coalesce(1)
    spans = frame.withColumn("s", F.explode(candidates(F.col("text")))).where(F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1) == F.col("kind"))
    rows = spans.select("snippet", "label", *[c.alias(n) for n, c in zip(FEATURES, features(F.col("text"), F.col("s")))]).collect()
    x, y = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float)
    taught = np.array([r[0] // 26 % 2 == 0 for r in rows])
    base, trees = boost(x[taught], y[taught])
    p = Model(base, trees, ()).predict(x)
    thresholds = []
    for k in range(len(KINDS)):
        own = ~taught & (x[:, 0] == k)
        best = 2.0  # no threshold is precise enough: nothing is added
        for t in sorted(set(np.round(p[own], 4))):
            chosen = own & (p >= t)
            if t >= 0.5 and chosen.any() and y[chosen].mean() >= PRECISION:
                best = float(t)
                break
        thresholds.append(best)
    return Model(base, trees, tuple(thresholds))


_MODELS: dict[str, Model] = {}


def built_in_model(spark: SparkSession) -> Model:
    """The snippets are constants, so the model is fitted once an application."""
    key = spark.sparkContext.applicationId
    if key not in _MODELS:
        _MODELS[key] = fit_model(spark)
    return _MODELS[key]


def _apart(marked: str) -> str:
    """SQL of the rows of an array of (start, more, kind, end, ...) that are `more` and overlap no other row of their
    kind: one sweep from each end carries the furthest end of those before and the nearest start of those after."""
    own = lambda st, x: f"element_at({st}, {x}.kind + 1)"
    seen = lambda pick, field: lambda st, x: f"transform({st}, (e, k) -> if(k = {x}.kind and not {x}.more, {pick}(e, {x}.{field}), e))"
    mark = lambda x, hit: "named_struct(" + ", ".join(f"'{c}', {x}.{c}" for c in ("start", "more", "kind", "end", "generator", "text")) + f", 'hit', {x}.hit or {hit})"
    four = lambda n: f"array({', '.join([str(n)] * len(KINDS))})"
    forth = scan(f"array_sort({marked})", four(-1), seen("greatest", "end"), lambda st, x: mark(x, f"{own(st, x)} > {x}.start"))
    back = scan(f"reverse({forth})", four(2**31 - 1), seen("least", "start"), lambda st, x: mark(x, f"{own(st, x)} < {x}.end"))
    return f"filter({back}, x -> x.more and not x.hit)"


def find_pii(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with larkspur_spans: array of (start, kind, end, base), by start, then kind as in KINDS."""
    base_valid = lambda s: (s["generator"] < BASES) & F.when(s["kind"] == 1, valid("ip", s["text"])).when(s["kind"] == 2, valid("card", s["text"])).when(s["kind"] == 3, valid("phone", s["text"])).otherwise(F.lit(True))
    short = lambda s, base: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"))
    threshold = lambda k: F.element_at(F.array(*map(F.lit, model.thresholds)), k + 1)
    text, found = F.col("larkspur_text"), F.col("larkspur_found")
    made = df.withColumn("larkspur_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    made = made.withColumn("larkspur_found", candidates(text))
    ranked = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (~base_valid(s)).alias("more"), *[s[c].alias(c) for c in ("kind", "end", "generator", "text")], F.lit(False).alias("hit")))
    made = made.withColumn("larkspur_found", F.when(F.size(found) > 0, ranked))
    # matches that overlap a base span of their kind are settled; of the others the trees judge
    made = made.withColumn("larkspur_more", F.expr(f"if(exists(larkspur_found, x -> x.more), {_apart('larkspur_found')}, null)"))
    made = made.withColumn("larkspur_pieces", F.when(F.size("larkspur_more") > 0, pieces_of(text)))
    with_context = F.expr(f"transform(larkspur_more, s -> named_struct('s', s, 'around', {context('larkspur_pieces', 's')}))")
    with_features = F.transform(with_context, lambda x: F.struct(x["s"].alias("s"), F.array(*features_of(x["s"], x["around"])).alias("v")))
    made = made.withColumn("larkspur_more", F.when(F.size("larkspur_more") > 0, with_features))
    likely = F.filter("larkspur_more", lambda x: model.column([x["v"][i] for i in range(len(FEATURES))]) >= threshold(x["s"]["kind"]))
    made = made.withColumn("larkspur_more", F.transform(likely, lambda x: short(x["s"], False)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")
    base = F.transform(F.filter(found, lambda s: ~s["more"]), lambda s: short(s, True))
    spans = F.coalesce(F.array_sort(F.concat(F.coalesce(base, none), F.coalesce("larkspur_more", none))), none)
    made = made.withColumn("larkspur_spans", spans)
    # several generators may propose one span
    distinct = F.expr("filter(larkspur_spans, (s, i) -> i = 0 or s <> larkspur_spans[greatest(i - 1, 0)])")
    return made.withColumn("larkspur_spans", distinct).drop("larkspur_text", "larkspur_found", "larkspur_more", "larkspur_pieces")


def redact(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its kind in brackets; overlapping spans become one of the first's kind."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    name = sql(text)
    part = lambda at, s: f"if({s}.start >= {at}, concat({cut('pieces', at, f'({s}.start - {at})')}, element_at({names}, {s}.kind + 1)), '')"
    kept = scan("spans", "0", lambda at, s: f"greatest({at}, {s}.end)", part)
    end = "array_max(transform(spans, s -> s.end))"
    whole = let(pieces_sql(name), "pieces", let(sql(spans), "spans", f"concat(array_join({kept}, ''), {let(end, 'last', cut('pieces', 'last', f'(length({name}) - last)'))})"))
    return F.expr(f"if(size({sql(spans)}) > 0, {whole}, {name})")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("larkspur_spans")
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return find_pii(docs, built_in_model(spark)).select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, name), ",").alias("spans"),
    )
