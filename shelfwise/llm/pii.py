"""Personal data: generous generators propose spans, boosted trees and thresholds select them.

Exact rules find e-mail addresses, IP addresses, card and phone numbers. Beside them, generators
propose overlapping spans that look like one of these or like a secret. Each proposal is
described by binned features of its format and of the text before it. As there are few
different feature vectors, all proposals of the corpus are counted by vector, and boosted trees
are fitted to the counts; the labels are weak ones, from the exact rules and from formats of
secrets. A threshold for each generator, set on documents left out of the fit, decides.
All work on rows is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import whole_row, written

KINDS = ["email", "ip", "card", "phone", "secret"]
JOIN = "\x01"  # stands for a single separator inside an e-mail domain or a row of digits

#: The exact rules, on texts whose inner separators are joined (see ``_joined``): the same matches as
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on, without recursion or retries
#: over long rows of characters.
LOCAL = r"A-Za-z0-9._%+\x01-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]+\x01[A-Za-z0-9\x01-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # a match starts and ends with its rows of digits
CARD = r"(?<![0-9\x01])(?:[0-9]\x01?){12,18}[0-9](?![0-9\x01])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

AT = r"[^\s@]{1,64}\s?(?:@|\(at\)|\[at\])\s?[^\s@]{1,253}"
DOTTED = r"[0-9]{1,3}(?:\.[0-9]{1,5}){2,5}"
DIGITS = r"\+?\(?[0-9][0-9 ().-]{6,30}[0-9]"
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,200}[0-9])[A-Za-z0-9_-]{16,}"
ASSIGNED = r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}"
GENERATORS = [AT, DOTTED, DIGITS, TOKEN, ASSIGNED]
#: Formats of secrets that count as positive in the weak labels.
SECRET = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk-[A-Za-z0-9_-]{20,}$"
NAMED = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?$"
FEATURES = ["gen", "size", "digits", "upper", "seps", "turns", "at", "sign", "named", "number", "luhn"]
#: Matches whose places add up in one list; code points of a block in which spans are compared.
RUN, BLOCK = 256, 4096
TREES, RATE, PRECISION = 24, 0.4, 0.9


def _joined(text: Column, before: str, sign: str, after: str) -> Column:
    """``text`` with the joining mark in place of each ``sign`` between two such characters."""
    plain = F.translate(text, JOIN, "\x02")
    return F.regexp_replace(plain, f"(?<={before}){sign}(?={after})", JOIN)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """All matches as (s, e, m, left): code points from and to, the match, the text before it.

    Places add up within runs of bounded length and over the runs, as a list that grows by one
    match at a time would be copied for each.
    """
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,left:string>>)")

    def step(acc, x):
        s = acc["at"] + x["g"]
        one = F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m"), x["left"].alias("left"))
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    starts = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def next_start(acc, run):
        at = acc["out"]
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(at, F.array(acc["at"])).alias("out"))

    def moved(run, at):
        return F.transform(
            run["out"], lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["m"].alias("m"), x["left"].alias("left"))
        )

    def placed(parts):
        last = F.floor((F.size(parts) - 1) / RUN).cast("int")
        runs = F.transform(
            F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(parts, k * RUN + 1, F.lit(RUN)), start, step)
        )
        spread_out = lambda r: F.zip_with(r, F.aggregate(r, starts, next_start, lambda acc: acc["out"]), moved)
        return F.when(F.size(parts) > 0, F.flatten(_bound(runs, spread_out))).otherwise(none)

    def cut(hits):
        gaps = F.split(text, pattern, -1)
        return F.zip_with(
            F.slice(gaps, 1, F.size(hits)),
            hits,
            lambda g, m: F.struct(
                F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"), F.substring(g, -24, 24).alias("left")
            ),
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _bound(hits, lambda h: F.when(F.size(h) > 0, _bound(cut(h), placed)).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _ip_parts(m: Column) -> Column:
    def small(part):
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(m, "\\."), small)


def _spans(kind: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def base_spans(text: Column) -> Column:
    """The spans of the exact rules as (kind, s, e), by kind and start."""
    none = F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")
    mail = _matches(_joined(text, "[A-Za-z0-9-]", r"\.", "[A-Za-z0-9-]"), EMAIL)
    ip = F.filter(_matches(text, IP), lambda x: _ip_parts(x["m"]))
    card = F.filter(_matches(_joined(text, "[0-9]", "[ -]", "[0-9]"), CARD), lambda x: _luhn(_digits(x["m"])))
    phone = F.filter(_matches(text, PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15))
    number = text.rlike("[0-9]")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), _spans(0, mail)).otherwise(none),
        F.when(number & F.contains(text, F.lit(".")), _spans(1, ip)).otherwise(none),
        F.when(number, _spans(2, card)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _spans(3, phone)).otherwise(none),
    )


def _bucket(value: Column, *limits: float) -> Column:
    out = F.lit(0)
    for limit in limits:
        out = out + F.when(value >= limit, 1).otherwise(0)
    return out


def _described(gen: int, x: Column) -> Column:
    """A proposal with its features, each a bin of at most six."""
    m, left = x["m"], x["left"]
    n = F.length(m)
    digits = F.length(_digits(m))
    upper = F.length(F.regexp_replace(m, "[^A-Z]", ""))
    seps = F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))
    turns = F.size(F.regexp_extract_all(m, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0)))
    values = {
        "gen": F.lit(gen),
        "size": _bucket(n, 9, 13, 17, 25, 45),
        "digits": _bucket(digits / n, 0.05, 0.25, 0.6, 0.95),
        "upper": _bucket(upper / n, 0.05, 0.5),
        "seps": _bucket(seps, 1, 3, 6),
        "turns": _bucket(turns, 1, 3, 6),
        "at": F.when(F.contains(m, F.lit("@")), 1).otherwise(0),
        "sign": F.when(F.startswith(m, F.lit("+")) | F.endswith(left, F.lit("+")), 1).otherwise(0),
        "named": F.when(left.rlike(NAMED), 1).otherwise(0),
        "number": _bucket(digits, 9, 10, 13, 16, 20),
        "luhn": F.when(digits.between(13, 19) & _luhn(_digits(m)), 1).otherwise(0),
    }
    secret = m.rlike(SECRET) | left.rlike(NAMED) | F.lit(gen == 4)
    return F.struct(
        x["s"].alias("s"),
        x["e"].alias("e"),
        *[values[f].cast("int").alias(f) for f in FEATURES],
        (F.lit(gen >= 3) & secret).alias("secret"),
    )


def _describer(gen: int):
    return lambda x: _described(gen, x)


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def proposals(text: Column) -> Column:
    """The spans of all generators, overlapping each other (``clear`` is set by ``found_spans``)."""
    asks = [
        F.contains(text, F.lit("@")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")),
        text.rlike("[0-9]\\.[0-9]"),
        text.rlike("[0-9]"),
        text.rlike("[0-9]"),
        text.rlike("[=:]"),
    ]
    out = []
    for gen, (pattern, ask) in enumerate(zip(GENERATORS, asks, strict=True)):
        out.append(F.transform(_matches(F.when(ask, text).otherwise(""), pattern), _describer(gen)))
    return F.concat(*out)


def _meets(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _by_block(spans: Column, last: Column) -> Column:
    """The spans that reach into each block of code points, from the first block to ``last``."""
    inside = lambda b: lambda x: (x["s"] < (b + 1) * BLOCK) & (x["e"] > b * BLOCK)
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.filter(spans, inside(b)))


def _compared(spans: Column, others: Column, clash, body) -> Column:
    """``body`` of a test whether a span clashes with any of ``others``. Only those that reach into
    the same block of code points are compared; clashing spans overlap."""
    end = F.coalesce(F.array_max(F.transform(spans, lambda y: y["e"])), F.lit(0))
    last = F.floor(end / BLOCK).cast("int")

    def compare(blocks):
        def any_of(x):
            first = F.floor(x["s"] / BLOCK).cast("int")
            near = F.slice(blocks, first + 1, F.floor(x["e"] / BLOCK).cast("int") - first + 1)
            return F.exists(near, lambda own: F.exists(own, lambda y: clash(x, y)))

        return body(any_of)

    return F.when(F.size(others) > 0, _bound(_by_block(others, last), compare)).otherwise(
        body(lambda x: F.lit(False))
    )


@dataclass
class Model:
    """Trees as (feature, limit, feature, limit, feature, limit, four leaves): the first split and
    one on either side; and the margin from which proposals of each generator are taken."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    least: list[float] = field(default_factory=lambda: [np.inf] * len(GENERATORS))

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, g, u, h, v, *leaves in self.trees:
            right = x[:, f] > t
            low = np.where(x[:, g] > u, leaves[1], leaves[0])
            out += np.where(right, np.where(x[:, h] > v, leaves[3], leaves[2]), low)
        return out

    def margin(self, of) -> Column:
        out = F.lit(self.start)
        for f, t, g, u, h, v, *leaves in self.trees:
            low = F.when(of(FEATURES[g]) > u, F.lit(leaves[1])).otherwise(F.lit(leaves[0]))
            high = F.when(of(FEATURES[h]) > v, F.lit(leaves[3])).otherwise(F.lit(leaves[2]))
            out = out + F.when(of(FEATURES[f]) > t, high).otherwise(low)
        return out


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int, float, float, float]:
    """The best split of some rows: feature, limit, gain, and the value on either side."""
    best = (0, 99, 0.0, -grad.sum() / (hess.sum() + 1), 0.0)
    whole = grad.sum() ** 2 / (hess.sum() + 1)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            g, h = grad[low].sum(), hess[low].sum()
            g2, h2 = grad.sum() - g, hess.sum() - h
            gain = g * g / (h + 1) + g2 * g2 / (h2 + 1) - whole
            if gain > best[2] + 1e-9:
                best = (f, int(t), gain, -g / (h + 1), -g2 / (h2 + 1))
    return best


def boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> Model:
    """Boosted trees for counted rows: ``total`` proposals of each vector, ``positive`` of them."""
    rate = np.clip(positive.sum() / max(total.sum(), 1), 1e-4, 1 - 1e-4)
    model = Model(start=float(np.log(rate / (1 - rate))))
    for _ in range(TREES if total.sum() else 0):
        p = 1 / (1 + np.exp(-model.margins(x)))
        grad, hess = total * p - positive, total * p * (1 - p)
        f, t, *_ = _split(x, grad, hess)
        side = x[:, f] > t
        g, u, _, a, b = _split(x[~side], grad[~side], hess[~side])
        h, v, _, c, d = _split(x[side], grad[side], hess[side]) if side.any() else (0, 99, 0, 0.0, 0.0)
        model.trees.append((f, t, g, u, h, v, *[float(RATE * y) for y in (a, b, c, d)]))
    return model


def fit(found: DataFrame) -> Model:
    """Model from the proposals of all documents (doc_id, base, proposed).

    The counts by feature vector, bounded by the bins, come to the driver. Documents whose id's
    checksum 5 divides set the thresholds: the smallest margin from which on nine in ten
    proposals of a generator are right; without such a margin the generator adds nothing, and
    without any proposal in that part the margin is that of a chance of nine in ten.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = found.where(F.size("proposed") > 0).select(
        held.alias("held"), F.explode("proposed").alias("p")
    )
    right = ~F.col("p.clear") | F.col("p.secret")
    counted = (
        rows.select("held", *[F.col(f"p.{f}").alias(f) for f in FEATURES], right.cast("long").alias("right"))
        .groupBy("held", *FEATURES)
        .agg(F.sum("right").alias("right"), F.count("*").alias("n"))
    )
    rows = np.array([tuple(r) for r in counted.collect()], dtype=np.float64).reshape(-1, len(FEATURES) + 3)
    rows = rows[np.lexsort(rows.T[::-1])]
    fold, x = rows[:, 0] == 1, rows[:, 1:-2].astype(np.int64)
    model = boost(x[~fold], rows[~fold, -2], rows[~fold, -1])
    margin = model.margins(x)
    for gen in range(len(GENERATORS)):
        own = fold & (x[:, 0] == gen)
        order = np.argsort(-margin[own], kind="stable")
        level, good, n = margin[own][order], rows[own, -2][order].cumsum(), rows[own, -1][order].cumsum()
        last = np.append(level[1:] < level[:-1], True) if len(level) else np.zeros(0, bool)
        enough = np.flatnonzero(last & (good >= PRECISION * n) & (level > 0)) if len(level) else []
        if len(enough):
            model.least[gen] = float(level[enough[-1]])
        elif not own.any():
            model.least[gen] = float(np.log(PRECISION / (1 - PRECISION)))
    return model


def found_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``proposed`` spans of the whole text (null: empty); ``clear``
    proposals meet no base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumns({"base": base_spans(text), "_all": proposals(text)})
    clear = _compared(
        F.col("_all"),
        F.col("base"),
        _meets,
        lambda hit: F.transform("_all", lambda p: p.withField("clear", ~hit(p))),
    )
    return found.withColumn("proposed", clear).drop("_all")


def selected(model: Model) -> Column:
    """The spans that the model may add to ``base``: those over the threshold that meet no base
    span, with what orders them (length, margin, the first)."""
    kind = (
        lambda p: F.when(p["gen"] == 0, 0)
        .when(p["gen"] == 1, 1)
        .when(p["gen"] == 2, F.when(p["number"] >= 3, 2).otherwise(3))
        .otherwise(4)
    )

    def scored(p):
        return F.struct(
            (p["e"] - p["s"]).alias("n"),
            model.margin(lambda f: p[f]).alias("margin"),
            (-p["s"]).alias("first"),
            (-p["gen"]).alias("order"),
            kind(p).alias("kind"),
            p["s"].alias("s"),
            p["e"].alias("e"),
        )

    def over(p):
        least = F.lit(float("inf"))
        for gen, value in enumerate(model.least):
            least = F.when(p["gen"] == gen, F.lit(float(value))).otherwise(least)
        return model.margin(lambda f: p[f]) >= least - 1e-9

    chosen = F.filter("proposed", lambda p: p["clear"] & over(p))
    return F.transform(chosen, scored)


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``spans``: base spans and selected ones, by kind and start. A selected span that
    lies within another one is left out; all that any of them covers stays covered."""
    kept = found.withColumn("_chosen", selected(model))
    within = lambda p, q: (q["s"] <= p["s"]) & (p["e"] <= q["e"]) & (q > p)
    best = _compared(
        F.col("_chosen"), F.col("_chosen"), within, lambda hit: F.filter("_chosen", lambda p: ~hit(p))
    )
    added = F.transform(best, lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e")))
    return kept.withColumn("spans", F.array_sort(F.concat("base", added))).drop("_chosen")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the exact rules' spans and the list of all spans of each document.

    Null texts are empty, null ids stay null, repeated rows are returned each; an empty table
    gives no rows. Other columns are ignored.
    """
    found = written(found_spans(docs.select("doc_id", "text")).drop("text"))
    out = with_spans(found, fit(found))
    counts = [
        F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}")
        for i, k in enumerate(KINDS[:4])
    ]
    return out.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs``, all columns, with every span of ``text`` replaced by its kind in brackets;
    ``n_chars`` follows in the rows that change. Of overlapping spans the first names the gap.
    Without a model one is fitted to the proposals of ``docs``."""
    spans = written(found_spans(docs.select(whole_row(docs), "doc_id", "text")))
    found = with_spans(spans, model or fit(spans))
    by_place = F.array_sort(
        F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc, x):
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        add = F.when(x["s"] >= acc["at"], F.concat(gap, F.element_at(names, x["kind"] + 1))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.lit(2**31 - 1)
    cut = F.aggregate(
        by_place, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, rest))
    )
    changed = F.size("spans") > 0
    out = found.withColumn("new", F.when(changed, cut).otherwise(F.col("text")))
    columns = []
    for field_ in docs.schema:
        own = F.col("row").getField(field_.name)
        if field_.name == "text":
            own = F.col("new")
        elif field_.name == "n_chars":
            own = F.when(changed, F.length("new").cast(field_.dataType)).otherwise(own)
        columns.append(own.alias(field_.name))
    return out.select(*columns)
